import random
import re
from collections import defaultdict
from datetime import datetime

from tuffstone.llm import survivors as s

SCHEMA = "comp_id bigint, image_id bigint, name string, version string, license string, source string, confidence int, scanned_at timestamp, field string, value string"


def brute(rows):
    """Sets of duplicates and their rows by plain loops."""
    clean = lambda t: t.strip() if t and t.strip() else None
    named = defaultdict(list)
    for r in rows:
        key = re.sub(r"[\s_.\-]", "", (r[2] or "").lower())
        if r[1] is not None and key:
            v = clean(r[3])
            up = re.sub(r"(\+dfsg[^-]*)?(-r?[0-9][0-9a-z.+~]*)?$", "", re.sub(r"^([0-9]+:)?v?(?=[0-9])", "", v.lower())) if v else None
            named[r[1], key].append((up, r))
    out = set()
    for members in named.values():
        ups = {u for u, _ in members if u}
        groups = defaultdict(list)
        for u, r in members:
            if u or len(ups) < 2:
                groups[u or next(iter(ups), "")].append(r)
        for g in groups.values():
            if len(g) > 1:
                g.sort(key=lambda r: (-(r[6] if r[6] is not None and 0 <= r[6] <= 100 else -1), -(r[7].timestamp() if r[7] else -1e18), r[0]))
                pick = lambda k: next((r[0] for r in g if clean(r[k])), 0)  # noqa: B023, E731
                out.add((min(r[0] for r in g), g[0][0], pick(3), pick(4)))
    return out


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        hot = rng.random() < 0.33
        name = "hot-pkg" if hot else rng.choice(["a", "A ", "b_b", "B-B", "bb-dev", "", None, "c.c"])
        version = rng.choice(["1.0", "v1.0", "2:1.0-3+deb11u1", "1.0+dfsg-1", "1.0-r4", "1.1-9.el8", "", None])
        rows.append((i + 1, 1 if hot else rng.choice([1, 2, None]), name, version, rng.choice(["MIT", "mit ", "GPL-2", "", None]), rng.choice(["dpkg", "rpm", "npm", None]), rng.choice([None, -1, 255, 0, 60, 95, 100]), rng.choice([None, datetime(2025, 1, 1), datetime(2025, 1, 2)]), "f", "v"))
    return rows


def test_groups_against_loops(spark):
    rows = made(500, 1)
    got = s.survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.first_comp_id, r.keep_comp_id, r.version_comp_id, r.license_comp_id) for r in got} == brute(rows)
    assert all(0 < r.version_posterior <= 1 for r in got if r.version)


def test_a_fit_beyond_the_bound_leaves_no_pattern_out(spark):
    groups = s.duplicate_groups(spark.createDataFrame(made(500, 1), SCHEMA))
    whole, parts = s.fit_sources(groups), s.fit_sources(groups, max_patterns=2)
    assert whole.accuracy.keys() == parts.accuracy.keys() and whole.dependence.keys() == parts.dependence.keys()
    assert all(abs(v - parts.accuracy[k]) < 1e-9 for k, v in whole.accuracy.items())
    assert all(abs(v - parts.dependence[k]) < 1e-9 for k, v in whole.dependence.items())


def test_nothing(spark):
    assert s.survivors(spark.createDataFrame([], SCHEMA)).count() == 0
    assert s.survivors(spark.createDataFrame([(1, 1, "a", None, None, None, None, None, None, None), (2, 1, None, None, None, None, None, None, None, None)], SCHEMA)).count() == 0


def test_records_that_all_state_no_version_are_one_group(spark):
    rows = [(1, 1, "a", None, None, None, None, None, None, None), (2, 1, "A\t", "\u00a0", "MIT", "x", 50, None, None, None)]
    got = s.survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.upstream, r.first_comp_id, r.keep_comp_id, r.version_comp_id, r.license_comp_id, r.version) for r in got] == [("", 1, 2, 0, 2, None)]


def test_fused_values_beat_the_count_of_votes_where_errors_are_copied(spark):
    # Sources a, b and c err on their own, c often and with little confidence; d, e and f repeat c.
    rng = random.Random(3)
    rows, truth, counted = [], {}, 0
    for k in range(600):
        truth[f"p{k}"] = true = f"license{rng.randrange(40)}"
        wrong = lambda: f"license{rng.randrange(40)}"
        copied = true if rng.random() < 0.6 else wrong()
        said = {"a": true if rng.random() < 0.9 else wrong(), "b": true if rng.random() < 0.9 else wrong(), "c": copied, "d": copied, "e": copied, "f": copied}
        votes = list(said.values())
        counted += max(sorted(set(votes)), key=votes.count) == true
        for source, value in said.items():
            rows.append((len(rows) + 1, 1, f"p{k}", "1.0", value, source, 90 if source in "ab" else 60, None, "f", "v"))
    got = s.survivors(spark.createDataFrame(rows, SCHEMA)).collect()
    right = sum(r.license == truth[r.name_key] for r in got)
    assert counted < 0.65 * 600 and right > 0.85 * 600


def test_confidence_and_recency_decide_between_equal_sources(spark):
    old, new = datetime(2025, 1, 1), datetime(2025, 2, 1)
    rows = [(1, 1, "a", "1", "MIT", "x", 95, old, "f", "v"), (2, 1, "a", "1", "ISC", "x", 20, new, "f", "v"), (3, 2, "a", "1", "MIT", "x", 80, old, "f", "v"), (4, 2, "a", "1", "ISC", "x", 80, new, "f", "v")]
    got = {r.image_id: r.license for r in s.survivors(spark.createDataFrame(rows, SCHEMA), s.Sources({"x": 0.9})).collect()}
    assert got == {1: "mit", 2: "isc"}


def test_copied_votes_count_less():
    # Source d repeats c, mistakes included; a, b and e err on their own.
    patterns = [([("a|b|c|d|e", 1)], 500), ([("a|b|e", 1), ("c|d", 1)], 150), *[([(x, 1), ("|".join(sorted(set("abcde") - {x})), 1)], 30) for x in "abe"]]
    model = s.fit(patterns)
    assert model.dependence["c", "d"] > 0.5
    assert model.accuracy["a"] > model.accuracy["c"]
    assert model.score(["a", "b"]) > model.score(["c", "d"])
