"""Deeply nested records as related flat tables, by Arrow offsets.

Spark hands over Arrow batches. Each body is decoded once into a canonical nested Arrow array; child
tables then come out of list offsets and parent indices, level by level, and keys are carried down by
vectorised ``take``. No level is walked row by row and no shuffle is needed: every output row depends on
one input row.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

TEXT = pa.string()
EVENT = pa.struct([("i", TEXT), ("f", TEXT), ("l", TEXT), ("limit", TEXT)])
RANGE = pa.struct([("type", TEXT), ("repo", TEXT), ("events", pa.list_(EVENT))])
AFFECTED = pa.struct([("eco", TEXT), ("pkg", TEXT), ("purl", TEXT), ("versions", pa.list_(TEXT)), ("ranges", pa.list_(RANGE))])
SEVERITY = pa.struct([("type", TEXT), ("score", TEXT)])
REFERENCE = pa.struct([("type", TEXT), ("url", TEXT)])
RECORD = pa.struct(
    [
        ("id", TEXT),
        ("summary", TEXT),
        ("details", TEXT),
        ("modified", TEXT),
        ("rel", TEXT),
        ("aliases", pa.list_(TEXT)),
        ("severity", pa.list_(SEVERITY)),
        ("references", pa.list_(REFERENCE)),
        ("affected", pa.list_(AFFECTED)),
    ]
)
BODY = pa.list_(RECORD)

#: Child tables: the list fields walked from the body, the name of each position, the columns taken at the end.
TABLES: dict[str, tuple[list[str], list[str], list[str]]] = {
    "records": ([], ["vuln_pos"], ["id", "summary", "details", "modified", "rel"]),
    "aliases": (["aliases"], ["vuln_pos", "alias_pos"], ["alias"]),
    "severities": (["severity"], ["vuln_pos", "severity_pos"], ["type", "score"]),
    "references": (["references"], ["vuln_pos", "reference_pos"], ["type", "url"]),
    "affected": (["affected"], ["vuln_pos", "affected_pos"], ["eco", "pkg", "purl"]),
    "versions": (["affected", "versions"], ["vuln_pos", "affected_pos", "version_pos"], ["version"]),
    "ranges": (["affected", "ranges"], ["vuln_pos", "affected_pos", "range_pos"], ["type", "repo"]),
    "events": (["affected", "ranges", "events"], ["vuln_pos", "affected_pos", "range_pos", "event_pos"], ["ev_type", "ev_value"]),
}


def _text(value: object) -> str | None:
    """A scalar as text; empty text, null and anything that isn't a scalar are nothing."""
    if value is None or isinstance(value, (dict, list)):
        return None
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value).encode("utf-8", "replace").decode("utf-8") or None


def _many(value: object) -> list:
    """What stands where an array is usual: an array as it is, one object or scalar as an array of one."""
    return value if isinstance(value, list) else [] if value is None else [value]


def _event(e: object) -> dict | None:
    if not isinstance(e, dict):
        return None
    return {"i": _text(e.get("introduced")), "f": _text(e.get("fixed")), "l": _text(e.get("last_affected")), "limit": _text(e.get("limit"))}


def _range(r: object) -> dict | None:
    if not isinstance(r, dict):
        return None
    return {"type": _text(r.get("type")), "repo": _text(r.get("repo")), "events": [_event(e) for e in _many(r.get("events"))]}


def _affected(a: object) -> dict | None:
    if not isinstance(a, dict):
        return None
    p = a.get("package")
    p = p if isinstance(p, dict) else {}
    versions = [_text(v) for v in _many(a.get("versions"))]
    return {"eco": _text(p.get("ecosystem")), "pkg": _text(p.get("name")), "purl": _text(p.get("purl")), "versions": versions, "ranges": [_range(r) for r in _many(a.get("ranges"))]}


SHORT_KINDS = {"i": "i", "introduced": "i", "f": "f", "fixed": "f", "l": "l", "last_affected": "l"}


def _pair(e: object) -> dict | None:
    """An index-form event ``[kind, value]``."""
    if not isinstance(e, list) or len(e) < 2:
        return _event(e)
    kind = SHORT_KINDS.get(str(e[0]).strip().lower())
    return {kind: _text(e[1])} if kind else {}


def _record(v: object) -> dict | None:
    if not isinstance(v, dict):
        return None
    out = {"id": _text(v.get("id")), "modified": _text(v.get("modified")), "rel": _text(v.get("rel"))}
    if "ev" in v and "affected" not in v:
        ev = v["ev"]
        pairs = [ev] if isinstance(ev, list) and ev and not isinstance(ev[0], (list, dict)) and ev[0] is not None else _many(ev)
        one = {"type": None, "repo": None, "events": [_pair(e) for e in pairs]}
        sev = [{"type": None, "score": _text(v.get("sev"))}] if v.get("sev") else []
        out |= {"summary": _text(v.get("sum")), "details": None, "aliases": [], "severity": sev, "references": []}
        return out | {"affected": [{"eco": _text(v.get("eco")), "pkg": _text(v.get("pkg")), "purl": None, "versions": [], "ranges": [one]}]}
    sev = [{"type": _text(s.get("type")), "score": _text(s.get("score"))} if isinstance(s, dict) else None for s in _many(v.get("severity"))]
    refs = [{"type": _text(s.get("type")), "url": _text(s.get("url"))} if isinstance(s, dict) else None for s in _many(v.get("references"))]
    out |= {"summary": _text(v.get("summary")), "details": _text(v.get("details")), "aliases": [_text(a) for a in _many(v.get("aliases"))]}
    return out | {"severity": sev, "references": refs, "affected": [_affected(a) for a in _many(v.get("affected"))]}


def decode_body(body: str | None, depth: int = 4) -> list | None:
    """The records of one body in canonical form; None if no JSON comes out of it.

    A byte-order mark and outer blanks are skipped and JSON that holds JSON as text is opened, up to
    ``depth`` times. Numbers keep their spelling.
    """
    value: object = body
    for _ in range(depth):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value.strip().lstrip("﻿"), parse_int=str, parse_float=str)
        except (ValueError, RecursionError):
            return None
        if isinstance(value, str) and not value.strip().lstrip("﻿")[:1] in ("{", "[", '"'):
            return None
    if isinstance(value, dict):
        value = _many(value["vulns"]) if "vulns" in value else [value]
    return [_record(v) for v in value] if isinstance(value, list) else None


def descend(keys: dict[str, pa.Array], lists: pa.Array, position: str) -> tuple[dict[str, pa.Array], pa.Array]:
    """One level down: the elements of ``lists`` with the keys of their parents and their own position.

    Null and empty lists have no children; null elements keep their place.
    """
    parent = pc.list_parent_indices(lists).cast(pa.int64())
    lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
    starts = pc.subtract(pc.cumulative_sum(lengths), lengths)
    place = pc.subtract(pa.array(range(len(parent)), pa.int64()), starts.take(parent))
    return {k: v.take(parent) for k, v in keys.items()} | {position: place.cast(pa.int32())}, pc.list_flatten(lists)


def _flatten(raw_ids: pa.Array, bodies: pa.Array, name: str) -> pa.Table:
    fields, positions, columns = TABLES[name]
    keys, values = descend({"raw_id": raw_ids}, bodies, positions[0])
    for field, position in zip(fields, positions[1:], strict=True):
        keys, values = descend(keys, pc.struct_field(values, field), position)
    if name != "events":
        there = pc.is_valid(values)
        got = {c: pc.struct_field(values, c) if pa.types.is_struct(values.type) else values for c in columns}
        return pa.table(keys | got).filter(there)
    parts = []
    for kind in ("i", "f", "l"):
        value = pc.struct_field(values, kind)
        part = pa.table(keys | {"ev_type": pa.repeat(kind, len(value)), "ev_value": value})
        parts.append(part.filter(pc.is_valid(value)))
    return pa.concat_tables(parts)


def schema_of(name: str) -> str:
    _, positions, columns = TABLES[name]
    return ", ".join(["raw_id bigint", *(f"{p} int" for p in positions), *(f"`{c}` string" for c in columns)])


def flatten_advisories(df: DataFrame, name: str) -> DataFrame:
    """Child table ``name`` (see ``TABLES``) of the JSON bodies in ``df(raw_id, body)``.

    Unreadable, empty and null bodies give no rows, as do elements of another shape than the table needs;
    positions count every element of an array. An event with several values gives one row for each.
    Repeated bodies stay: each has its own raw_id. Other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            decoded = pa.array((decode_body(b) for b in batch.column("body").to_pylist()), BODY, size=len(batch))
            yield from _flatten(batch.column("raw_id"), decoded, name).to_batches()

    return df.select("raw_id", "body").mapInArrow(run, schema_of(name))


INDEX = "raw_id bigint, vuln_pos int, affected_pos int, range_pos int, eco string, pkg string, id string, cve string, sev string, rel string, summary string, details string, events array<struct<type:string,value:string>>"


def _first(keys: pa.Array, values: pa.Array, n: int) -> pa.Array:
    """The first of ``values`` for each parent number 0..n-1 in ``keys`` (ascending); null for none."""
    parents, at = np.unique(keys.to_numpy(), return_index=True)
    place = np.full(n, -1, np.int64)
    place[parents] = at
    return values.take(pa.array(place, mask=place < 0))


def _of_records(records: pa.Array) -> dict[str, pa.Array]:
    """Fields of each record, with its first CVE alias and the score of its first severity."""
    n = len(records)
    alias_of, alias = pc.list_parent_indices(pc.struct_field(records, "aliases")), pc.list_flatten(pc.struct_field(records, "aliases"))
    named = pc.fill_null(pc.starts_with(alias, "CVE-"), False)
    sev_of, sev = pc.list_parent_indices(pc.struct_field(records, "severity")), pc.list_flatten(pc.struct_field(records, "severity"))
    told = pc.is_valid(sev)
    own = {f: pc.struct_field(records, f) for f in ("id", "rel", "summary", "details")}
    return own | {"cve": _first(alias_of.filter(named), alias.filter(named), n), "sev": _first(sev_of.filter(told), pc.struct_field(sev.filter(told), "score"), n)}


def _event_lists(events: pa.Array) -> pa.Array:
    """Lists of (type, value) in place of lists of event objects; an object with several values gives one each."""
    items, of, n = pc.list_flatten(events), pc.list_parent_indices(events).to_numpy(), len(pc.list_flatten(events))
    kinds = ("i", "f", "l")
    order = (np.arange(n)[:, None] + n * np.arange(len(kinds))).ravel()
    values = pa.concat_arrays([pc.struct_field(items, k) for k in kinds]).take(pa.array(order))
    there = pc.is_valid(values)
    types = pa.array(np.tile(np.array(kinds, dtype=object), n), TEXT).filter(there)
    counts = np.bincount(np.repeat(of, len(kinds))[there.to_numpy(zero_copy_only=False)], minlength=len(events))
    offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([types, values.filter(there)], ["type", "value"]))


def advisory_ranges(df: DataFrame) -> DataFrame:
    """One row ``INDEX`` per range with events of the JSON bodies in ``df(raw_id, body)``.

    Each body is decoded once and everything above a range is carried down to it, so no join is needed.
    ``cve`` is the first alias that is a CVE number, ``sev`` the score of the first severity. Unreadable, empty and
    null bodies give no rows; packages without ecosystem or name neither.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in INDEX.split(", ")]
        for batch in batches:
            decoded = pa.array((decode_body(b) for b in batch.column("body").to_pylist()), BODY, size=len(batch))
            keys, records = descend({"raw_id": batch.column("raw_id")}, decoded, "vuln_pos")
            keys, affected = descend(keys | _of_records(records), pc.struct_field(records, "affected"), "affected_pos")
            keys |= {"eco": pc.struct_field(affected, "eco"), "pkg": pc.struct_field(affected, "pkg")}
            keys, ranges = descend(keys, pc.struct_field(affected, "ranges"), "range_pos")
            events = _event_lists(pc.struct_field(ranges, "events"))
            rows = pa.table(keys | {"events": events}).select(names)
            known = pc.and_(pc.and_(pc.is_valid(rows["eco"]), pc.is_valid(rows["pkg"])), pc.greater(pc.list_value_length(rows["events"]), 0))
            yield from rows.filter(known).to_batches()

    return df.select("raw_id", "body").mapInArrow(run, INDEX)
