import json
import random
from datetime import datetime

from pyspark.sql import functions as F

from tuffstone.operators import nested, snapshots

OSV = "row_id bigint, snap_no int, eco string, pkg string, id string, sev string, rel string, summary string, events array<struct<type:string,value:string>>, loaded_at timestamp, change string"


def brute_changes(rows):
    """Snapshot differences by plain loops."""
    kinds = {"introduced": "i", "fixed": "f", "last_affected": "l"}
    state = {}
    snaps = sorted({r[1] for r in rows if r[1] is not None})
    for r in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[9] or datetime.min, r[0])):
        key = (r[2] or "", r[3] or "", (r[4] or "").strip().upper(), (r[6] or "").strip())
        events = [(kinds.get((e[0] or "").strip().lower(), (e[0] or "").strip().lower()), (e[1] or "").strip()) for e in r[8] or []]
        state.setdefault(r[1], {})[key] = ((r[5] or "").strip(), events)
    out = set()
    for a, b in zip(snaps, snaps[1:]):
        for key in state[a].keys() | state[b].keys():
            old, new = state[a].get(key), state[b].get(key)
            change = "added" if old is None else "removed" if new is None else "changed" if old != new else None
            if change:
                out.add((b, *key, change))
    return out


def test_snapshot_changes_against_loops(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        snap = rng.choice([1, 2, 3, 5, None])
        events = rng.choice([None, [], [("i", "0")], [("I\t", "\n0\u3000")], [("introduced", "0"), ("fixed", "1")], [("f", None)]])
        loaded = rng.choice([None, datetime(2025, 1, 1 + rng.randrange(9))])
        # A third of all rows deliver one key again and again.
        pkg = "hot" if rng.random() < 0.33 else rng.choice(["a", "b", "c", None])
        rows.append((i, snap, rng.choice(["x", None]), pkg, rng.choice(["cve-1", " CVE-1", "CVE-1\t", "\u00a0CVE-2\r\n", "CVE-2"]), rng.choice([None, "", "s", "s\t"]), rng.choice([None, "1", "\n1\u2009"]), "t", events, loaded, "clash"))
    got = snapshots.advisory_changes(spark.createDataFrame(rows, OSV)).collect()
    assert len(got) == len(set(got))
    assert {tuple(r) for r in got} == brute_changes(rows)


def test_snapshot_changes_of_nothing(spark):
    empty = spark.createDataFrame([], OSV)
    assert snapshots.advisory_changes(empty).count() == 0
    one = spark.createDataFrame([(1, 1, "a", "b", "c", None, None, None, None, None, None)], OSV)
    assert snapshots.advisory_changes(one).count() == 0


def test_kernel_feed_sets_and_scores(spark):
    schema = "row_id bigint, snap_no int, id string, ranges array<struct<lo:string,hi:string>>, broad array<struct<lo:string,hi:string>>, mainline struct<lo:string,hi:string>, sev string, score double, summary string, loaded_at timestamp"
    t = datetime(2025, 1, 1)
    rows = [
        (1, 1, "c-1", [("1", "2"), ("3", "4")], None, None, "HIGH", None, "", t),
        (2, 2, "C-1\t", [("3", "4"), ("1\n", "\u00a02"), ("1", "2")], [], ("", None), "LOW", -1.0, "x", t),
        (3, 1, "c-2", None, None, None, None, 3.0, "", t),
        (4, 2, "c-2", None, None, None, None, 4.0, "", t),
        (5, 2, "c-3", None, None, None, None, None, "", t),
    ]
    got = {(r.snap_no, r.id, r.change) for r in snapshots.kernel_feed_changes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(2, "C-2", "changed"), (2, "C-3", "added")}


def test_intervals_that_move_between_ranges_and_broad(spark):
    schema = "row_id bigint, snap_no int, id string, ranges array<struct<lo:string,hi:string>>, broad array<struct<lo:string,hi:string>>, mainline struct<lo:string,hi:string>, sev string, score double, summary string, loaded_at timestamp"
    t, a, b = datetime(2025, 1, 1), ("1", "2"), ("3", "4")
    pairs = {"ALL": (([a], []), ([], [a])), "SPLIT": (([a], [b]), ([a, b], [])), "BACK": (([], [a, b]), ([a], [b])), "NULL": (([a], None), (None, [a])), "SAME": (([a], [b]), ([a], [b]))}
    rows = [(0, snap, name, *states[snap - 1], ("", ""), "LOW", 1.0, "", t) for name, states in pairs.items() for snap in (1, 2)]
    got = {(r.snap_no, r.id, r.change) for r in snapshots.kernel_feed_changes(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(2, name, "changed") for name in pairs if name != "SAME"}


def brute_events(raw_id, body):
    """Events of a body by plain loops over the decoded JSON."""
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]
    try:
        value = json.loads(body.lstrip("﻿")) if body else None
        if isinstance(value, str):
            value = json.loads(value)
    except ValueError:
        return
    if isinstance(value, dict):
        value = many(value["vulns"]) if "vulns" in value else [value]
    for v, record in enumerate(many(value)):
        if not isinstance(record, dict):
            continue
        for p, pair in enumerate(record.get("ev") or []):
            if pair and pair[1]:
                yield raw_id, v, 0, 0, p, pair[0][0].lower(), str(pair[1])
        for a, affected in enumerate(many(record.get("affected"))):
            for r, rng in enumerate(many((affected or {}).get("ranges"))):
                for e, event in enumerate(many((rng or {}).get("events"))):
                    for kind in ("introduced", "fixed", "last_affected"):
                        if event and event.get(kind) not in (None, ""):
                            yield raw_id, v, a, r, e, kind[0], str(event[kind])


BODIES = [
    '{"affected":[{"ranges":[{"events":[{"introduced":0},null,{"fixed":"1.0","last_affected":"0.9"},{"fixed":""},{"limit":"*"}]},null,{"type":"GIT","events":{"introduced":"a"}}]},null,{"versions":["1"],"database_specific":{"events":[{"introduced":"9"}]}}]}',
    '[{"affected":{"ranges":{"events":[{"introduced":"0"}]}}},null,{"affected":null}]',
    '{"vulns":[{"ev":[["i","0"],["f",null],null,["F","2"]]},{"id":"x","ev":[]}]}',
    '{"affected":[{"ranges":[{"events":[{"introd',
    "﻿{\"affected\":[{\"ranges\":[{\"events\":[{\"introduced\":\"1\"}]}]}]}",
    json.dumps('{"affected":[{"ranges":[{"events":[{"fixed":"7"}]}]}]}'),
    None, "", "   ", "17", "null", '"text"', "[]", "{}",
]


def test_nested_events_against_loops(spark):
    rows = list(enumerate(BODIES)) + [(99, BODIES[0])]
    df = spark.createDataFrame([(i, b, "x") for i, b in rows], "raw_id bigint, body string, ev_type string")
    got = sorted(tuple(r) for r in nested.flatten_advisories(df, "events").collect())
    assert got == sorted(e for i, b in rows for e in brute_events(i, b))
    assert nested.flatten_advisories(df.limit(0), "events").count() == 0


def test_nested_tables_keep_the_way_to_their_record(spark, sf):
    raw = spark.read.parquet(f"{sf}/osv_raw.parquet")
    key = ["raw_id", "vuln_pos"]
    records = nested.flatten_advisories(raw, "records")
    assert records.groupBy(*key).count().where("count > 1").count() == 0
    for name in ("aliases", "severities", "references", "affected", "ranges", "versions", "events"):
        assert nested.flatten_advisories(raw, name).join(records, key, "left_anti").count() == 0
    got = sorted(tuple(r) for r in nested.flatten_advisories(raw, "events").collect())
    assert got == sorted(e for r in raw.collect() for e in brute_events(r.raw_id, r.body))


def test_a_very_long_body(spark):
    body = json.dumps({"affected": [{"ranges": [{"events": [{"introduced": str(i)} for i in range(50_000)]}]}]})
    df = spark.createDataFrame([(1, body)], "raw_id bigint, body string")
    assert nested.flatten_advisories(df, "events").agg(F.max("event_pos")).first()[0] == 49_999


def test_ranges_of_bodies_against_the_events(spark, sf):
    raw = spark.read.parquet(f"{sf}/osv_raw.parquet")
    got = nested.advisory_ranges(raw).select("raw_id", "vuln_pos", "affected_pos", "range_pos", F.explode("events").alias("e")).select("raw_id", "vuln_pos", "affected_pos", "range_pos", "e.type", "e.value")
    named = nested.flatten_advisories(raw, "affected").where("eco is not null and pkg is not null")
    key = ["raw_id", "vuln_pos", "affected_pos"]
    want = nested.flatten_advisories(raw, "events").join(named, key, "left_semi").select(*key, "range_pos", F.col("ev_type").alias("type"), F.col("ev_value").alias("value"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    odd = spark.createDataFrame(list(enumerate(BODIES)), "raw_id bigint, body string")
    assert nested.advisory_ranges(odd).count() == 0 and nested.advisory_ranges(odd.limit(0)).count() == 0


def test_salting_changes_no_match(spark):
    from tuffstone.operators import advisories

    c = spark.createDataFrame([("Debian", "hot" if i % 3 else f"p{i}", f"1.{i}", "", "x") for i in range(60)], "eco string, name string, version string, release string, purl string")
    index = spark.createDataFrame([("Debian", "hot" if i % 3 else f"p{i}", f"CVE-1-{i}", "", None, "", [("i", f"1.{i}")]) for i in range(60)], "eco string, pkg string, id string, rel string, sev string, summary string, events array<struct<type:string,value:string>>")
    few, many = (sorted(map(str, advisories.osv_join(c, index, salts=n).collect())) for n in (1, 7))
    assert few == many and len(few) > 500


def test_streamed_components_are_matched_by_range(spark):
    from tuffstone.streaming.scan import match_stream

    c = spark.createDataFrame([(1, "cpe:2.3:a:v:p:1.5:*", "1.5"), (2, "cpe:2.3:a:v:p:2.5:*", "2.5"), (3, None, "1.5"), (4, "cpe:2.3:a:v:p:1:*", None)], "comp_id bigint, cpe string, version string")
    e = spark.createDataFrame([("v", "p", "CVE-1", None, None, None, None, None, "2.0"), ("v", "p", "CVE-2", None, "\t2.5", None, None, None, None)], "vendor string, product string, id string, cvss string, ver string, si string, se string, ei string, ee string")
    assert {tuple(r) for r in match_stream(c, e).collect()} == {(1, "CVE-1"), (2, "CVE-2")}
