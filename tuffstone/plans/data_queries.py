"""Queries of the general data operators: nested records and snapshot differences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.operators import nested, snapshots
from tuffstone.runtime import table


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_advisories(table(spark, sf, "osv_raw"), "events")


def p2_child(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: nested.flatten_advisories(table(spark, sf, "osv_raw"), name)


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    osv = snapshots.advisory_changes(table(spark, sf, "osv_index"))
    kernel = snapshots.kernel_feed_changes(table(spark, sf, "kernel_feed"))
    none = F.lit("")
    return osv.select(F.lit("osv").alias("feed"), "snap_no", "eco", "pkg", "id", "rel", "change").unionByName(
        kernel.select(F.lit("kernel").alias("feed"), "snap_no", none.alias("eco"), none.alias("pkg"), "id", none.alias("rel"), "change")
    )


def p5_change_counts(spark: SparkSession, sf: str) -> DataFrame:
    return p5_found(spark, sf).groupBy("feed", "snap_no", "change").agg(F.count("*").alias("n"))


QUERIES = {"p2_found": p2_found, "p5_found": p5_found, "p5_change_counts": p5_change_counts} | {f"p2_{n}": p2_child(n) for n in nested.TABLES if n != "events"}

_P5 = """
with o as (
  select 'osv' as feed, snap_no, coalesce(eco,'') as eco, coalesce(pkg,'') as pkg, upper(bare(coalesce(id,''))) as id,
         bare(coalesce(rel,'')) as rel, loaded_at, row_id,
         bare(coalesce(sev,'')) || '|' || coalesce(array_to_string(list_transform(events, lambda e:
           case lower(bare(coalesce(e.type,''))) when 'introduced' then 'i' when 'fixed' then 'f' when 'last_affected' then 'l'
                else lower(bare(coalesce(e.type,''))) end || '=' || bare(coalesce(e.value,''))), ';'), '') as body
  from osv_index where snap_no is not null),
k as (
  select 'kernel' as feed, snap_no, '' as eco, '' as pkg, upper(bare(coalesce(id,''))) as id, '' as rel, loaded_at, row_id,
         coalesce(array_to_string(list_sort(list_distinct(list_transform(ranges, lambda r: bare(coalesce(r.lo,'')) || '-' || bare(coalesce(r.hi,''))))), ';'), '') || '|' ||
         coalesce(array_to_string(list_sort(list_distinct(list_transform(broad, lambda r: bare(coalesce(r.lo,'')) || '-' || bare(coalesce(r.hi,''))))), ';'), '') || '|' ||
         bare(coalesce(mainline.lo,'')) || '-' || bare(coalesce(mainline.hi,'')) || '|' || cast(coalesce(score, -1) as varchar) as body
  from kernel_feed where snap_no is not null),
a as (select * from o union all select * from k),
l as (select * from (select *, row_number() over (partition by feed, eco, pkg, id, rel, snap_no order by loaded_at desc nulls last, row_id desc) as rn from a) where rn = 1),
s as (select feed, snap_no, lead(snap_no) over (partition by feed order by snap_no) as nxt from (select distinct feed, snap_no from l)),
p as (select l.*, s.nxt from l join s on l.feed = s.feed and l.snap_no = s.snap_no),
f as (
  select n.feed, n.snap_no, n.eco, n.pkg, n.id, n.rel, case when p.feed is null then 'added' when p.body <> n.body then 'changed' end as change
  from l n left join p on p.feed = n.feed and p.nxt = n.snap_no and p.eco = n.eco and p.pkg = n.pkg and p.id = n.id and p.rel = n.rel
  where n.snap_no > (select min(snap_no) from l m where m.feed = n.feed)
  union all
  select p.feed, p.nxt, p.eco, p.pkg, p.id, p.rel, 'removed' as change
  from p left join l n on p.feed = n.feed and p.nxt = n.snap_no and p.eco = n.eco and p.pkg = n.pkg and p.id = n.id and p.rel = n.rel
  where p.nxt is not null and n.feed is null)
"""

def _level(name: str, source: str, keys: str, value: str, position: str) -> str:
    """One level of arrays: elements of ``value`` with their place; one object counts as an array of one."""
    many = f"case when json_type({value}) = 'ARRAY' then json_extract({value}, '$[*]') when {value} is null or json_type({value}) = 'NULL' then [] else [{value}] end"
    return f"{name} as (select {keys}, unnest(generate_series(0, len(l) - 1)) as {position}, unnest(l) as j from (select {keys}, {many} as l from {source}))"


_P2 = f"""
with t as (select raw_id, ltrim(trim(body, e' \\n\\t\\r'), chr(65279)) as b from osv_raw),
w as (select raw_id, case when json_valid(b) then case when json_type(b) = 'VARCHAR' then ltrim(trim(json_extract_string(b, '$')), chr(65279)) else b end end as b from t),
p as (select raw_id, cast(b as json) as j from w where json_valid(b) and json_type(b) in ('ARRAY', 'OBJECT')),
r as (select raw_id, case when json_type(j) = 'OBJECT' and json_extract(j, '$.vulns') is not null then json_extract(j, '$.vulns') else j end as j from p),
{_level("v", "r", "raw_id", "j", "vuln_pos")},
{_level("a", "(select raw_id, vuln_pos, json_extract(j, '$.affected') as j from v where json_type(j) = 'OBJECT')", "raw_id, vuln_pos", "j", "affected_pos")},
{_level("g", "(select raw_id, vuln_pos, affected_pos, json_extract(j, '$.ranges') as j from a where json_type(j) = 'OBJECT')", "raw_id, vuln_pos, affected_pos", "j", "range_pos")},
{_level("e", "(select raw_id, vuln_pos, affected_pos, range_pos, json_extract(j, '$.events') as j from g where json_type(j) = 'OBJECT')", "raw_id, vuln_pos, affected_pos, range_pos", "j", "event_pos")},
{_level("x", "(select raw_id, vuln_pos, json_extract(j, '$.ev') as j from v where json_type(j) = 'OBJECT' and json_extract(j, '$.affected') is null)", "raw_id, vuln_pos", "j", "event_pos")},
o as (
  select raw_id, vuln_pos, affected_pos, range_pos, event_pos, k.t as ev_type, json_extract_string(j, k.f) as ev_value from e, (values ('i', '$.introduced'), ('f', '$.fixed'), ('l', '$.last_affected')) k(t, f) where json_type(j) = 'OBJECT'
  union all select raw_id, vuln_pos, 0, 0, event_pos, left(lower(json_extract_string(j, '$[0]')), 1), json_extract_string(j, '$[1]') from x where json_type(j) = 'ARRAY')
"""

_FULL = "select raw_id, vuln_pos, json_extract(j,"
_FULL_ONLY = "json_type(j) = 'OBJECT' and not (json_extract(j, '$.ev') is not null and json_extract(j, '$.affected') is null)"
_P2_ALIASES = (
    _P2
    + f""", {_level("ax", f"({_FULL} '$.aliases') as j from v where {_FULL_ONLY})", "raw_id, vuln_pos", "j", "alias_pos")},
al as (select raw_id, vuln_pos, alias_pos, json_extract_string(j, '$') as alias from ax where json_type(j) not in ('OBJECT', 'ARRAY', 'NULL'))
"""
)
_P2_SEVERITIES = (
    _P2_ALIASES
    + f""", {_level("sx", f"({_FULL} '$.severity') as j from v where {_FULL_ONLY})", "raw_id, vuln_pos", "j", "severity_pos")},
sv as (select raw_id, vuln_pos, severity_pos, nullif(json_extract_string(j, '$.type'), '') as type, nullif(json_extract_string(j, '$.score'), '') as score from sx where json_type(j) = 'OBJECT'
  union all select raw_id, vuln_pos, 0, null, json_extract_string(j, '$.sev') from v where json_type(j) = 'OBJECT' and json_extract(j, '$.ev') is not null and json_extract(j, '$.affected') is null and json_extract_string(j, '$.sev') <> '')
"""
)
OSV_INGEST = (
    _P2_SEVERITIES
    + """, rec as (select raw_id, vuln_pos, nullif(json_extract_string(j, '$.id'), '') as id, nullif(json_extract_string(j, '$.rel'), '') as rel from v where json_type(j) = 'OBJECT'),
pk as (select raw_id, vuln_pos, affected_pos, nullif(json_extract_string(j, '$.package.ecosystem'), '') as eco, nullif(json_extract_string(j, '$.package.name'), '') as pkg from a where json_type(j) = 'OBJECT'
  union all select raw_id, vuln_pos, 0, nullif(json_extract_string(j, '$.eco'), ''), nullif(json_extract_string(j, '$.pkg'), '') from v where json_type(j) = 'OBJECT' and json_extract(j, '$.ev') is not null and json_extract(j, '$.affected') is null),
rg as (select raw_id, vuln_pos, affected_pos, range_pos, count(*) as n from o where ev_value <> '' group by all),
cv as (select raw_id, vuln_pos, arg_min(alias, alias_pos) as cve from al where alias like 'CVE-%' group by all),
ix as (select split_part(eco, ':', 1) as eco, n, coalesce(nullif(regexp_extract(coalesce(cve, id), 'CVE-[0-9]+-[0-9]+'), ''), coalesce(cve, id)) as id,
         nullif(substr(eco, length(split_part(eco, ':', 1)) + 2), '') as tail, rel, position(':' in eco) > 0 as released
  from rg join pk using (raw_id, vuln_pos, affected_pos) join rec using (raw_id, vuln_pos) left join cv using (raw_id, vuln_pos) where eco not like '%FIPS%' and pkg is not null)
select eco, coalesce(rel, case when released then coalesce(nullif(regexp_extract(tail, '[0-9][0-9][.][0-9][0-9]'), ''), tail) end) as rel, count(*) as n_ranges, count(distinct id) as n_ids, sum(n) as n_events from ix group by all
"""
)

ORACLE = {
    "p2_records": _P2
    + """, f as (select *, json_extract(j, '$.ev') is not null and json_extract(j, '$.affected') is null as ix from v where json_type(j) = 'OBJECT')
      select raw_id, vuln_pos, nullif(json_extract_string(j, '$.id'), '') as id, nullif(json_extract_string(j, case when ix then '$.sum' else '$.summary' end), '') as summary, case when not ix then nullif(json_extract_string(j, '$.details'), '') end as details,
      nullif(json_extract_string(j, '$.modified'), '') as modified, nullif(json_extract_string(j, '$.rel'), '') as rel from f""",
    "p2_affected": _P2
    + """select raw_id, vuln_pos, affected_pos, nullif(json_extract_string(j, '$.package.ecosystem'), '') as eco, nullif(json_extract_string(j, '$.package.name'), '') as pkg, nullif(json_extract_string(j, '$.package.purl'), '') as purl from a where json_type(j) = 'OBJECT'
      union all select raw_id, vuln_pos, 0, nullif(json_extract_string(j, '$.eco'), ''), nullif(json_extract_string(j, '$.pkg'), ''), null from v where json_type(j) = 'OBJECT' and json_extract(j, '$.ev') is not null and json_extract(j, '$.affected') is null""",
    "p2_aliases": _P2_ALIASES + "select raw_id, vuln_pos, alias_pos, alias from al where alias <> ''",
    "p2_severities": _P2_SEVERITIES + "select raw_id, vuln_pos, severity_pos, type, score from sv",
    "p2_references": _P2
    + f""", {_level("rf", f"({_FULL} '$.references') as j from v where {_FULL_ONLY})", "raw_id, vuln_pos", "j", "reference_pos")}
      select raw_id, vuln_pos, reference_pos, nullif(json_extract_string(j, '$.type'), '') as type, nullif(json_extract_string(j, '$.url'), '') as url from rf where json_type(j) = 'OBJECT'""",
    "p2_versions": _P2
    + f""", {_level("ve", "(select raw_id, vuln_pos, affected_pos, json_extract(j, '$.versions') as j from a where json_type(j) = 'OBJECT')", "raw_id, vuln_pos, affected_pos", "j", "version_pos")}
      select raw_id, vuln_pos, affected_pos, version_pos, json_extract_string(j, '$') as version from ve where json_type(j) not in ('OBJECT', 'ARRAY', 'NULL') and json_extract_string(j, '$') <> ''""",
    "p2_ranges": _P2
    + """select raw_id, vuln_pos, affected_pos, range_pos, nullif(json_extract_string(j, '$.type'), '') as type, nullif(json_extract_string(j, '$.repo'), '') as repo from g where json_type(j) = 'OBJECT'
      union all select raw_id, vuln_pos, 0, 0, null, null from v where json_type(j) = 'OBJECT' and json_extract(j, '$.ev') is not null and json_extract(j, '$.affected') is null""",
    "p2_found": _P2 + "select * from o where ev_value <> ''",
    "p5_found": _P5 + "select feed, snap_no, eco, pkg, id, rel, change from f where change is not null",
    "p5_change_counts": _P5 + "select feed, snap_no, change, count(*) as n from f where change is not null group by all",
}
