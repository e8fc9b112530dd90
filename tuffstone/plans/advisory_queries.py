"""Queries of advisory joins, scores and gates over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.functions import scoring
from tuffstone.functions.text import stripped
from tuffstone.functions.versions import version_key, version_key_sql
from tuffstone.operators import advisories as adv
from tuffstone.plans.data_queries import OSV_INGEST
from tuffstone.runtime import table


def exploited(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a known-exploited list: every advisory number ending in 7."""
    return table(spark, sf, "nvd_entries").where("id like 'CVE-%7'").select(F.col("id").alias("cve_id")).distinct()


def likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """A stand-in for a likelihood list: a share of the last two digits, missing for every third number."""
    n = F.substring("id", -2, 2).cast("int")
    return table(spark, sf, "nvd_entries").where("id like 'CVE-%'").where(n % 3 != 0).select(F.col("id").alias("cve_id"), (n / 100.0).alias("epss")).distinct()


def version_order(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "components").where("version is not null and name is not null")
    return c.groupBy("name").agg(F.max_by("version", F.struct(version_key(F.col("version")).alias("k"), F.col("version"))).alias("newest"), F.count("*").alias("n"))


def cvss_score(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "nvd_entries").select(F.col("cvss").alias("vector")).union(table(spark, sf, "osv_index").select("sev")).distinct()
    return vectors.select("vector", scoring.cvss_base_score(F.col("vector")).alias("score"), scoring.cvss_rank(F.col("vector")).alias("richness"))


def canonical_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "osv_index").select(scoring.canonical_cve(F.upper(stripped(F.col("id")))).alias("cve_id")).groupBy("cve_id").agg(F.count("*").alias("n"))


def ecosystem_of(spark: SparkSession, sf: str) -> DataFrame:
    c = adv.with_distro(table(spark, sf, "components"), table(spark, sf, "images"))
    return c.groupBy("source", "eco").agg(F.count("*").alias("n"))


def _osv(spark: SparkSession, sf: str) -> DataFrame:
    c = adv.with_distro(table(spark, sf, "components"), table(spark, sf, "images"))
    return adv.osv_join(c, adv.latest_index(table(spark, sf, "osv_index"), keyed=False), sizes=table(spark, sf, "osv_index"))


def _nvd(spark: SparkSession, sf: str) -> DataFrame:
    return adv.nvd_join(table(spark, sf, "components"), table(spark, sf, "nvd_entries"))


def osv_join(spark: SparkSession, sf: str) -> DataFrame:
    return _osv(spark, sf).select("component", "cve_id", "basis", "severity")


def nvd_join(spark: SparkSession, sf: str) -> DataFrame:
    return _nvd(spark, sf).select("component", "cve_id", "basis", "severity", "unbounded_below")


def _annotated(spark: SparkSession, sf: str) -> DataFrame:
    return adv.annotate(adv.reconcile(_osv(spark, sf), _nvd(spark, sf)), exploited(spark, sf), likelihood(spark, sf))


def reconcile_cves(spark: SparkSession, sf: str) -> DataFrame:
    return adv.reconcile(_osv(spark, sf), _nvd(spark, sf)).select("component", "cve_id", "severity", "basis")


def high_signal_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _annotated(spark, sf).where("high").select("component", "cve_id", "kev", "epss", "score")


def worst_first_topk(spark: SparkSession, sf: str) -> DataFrame:
    return adv.worst_first(_annotated(spark, sf), 40).select("component", "cve_id", "kev", "epss", "score")


def cve_counters(spark: SparkSession, sf: str) -> DataFrame:
    return adv.outcome_counts(_annotated(spark, sf))


def kev_annotate(spark: SparkSession, sf: str) -> DataFrame:
    return _annotated(spark, sf).where("kev").select("component", "cve_id")


def epss_annotate(spark: SparkSession, sf: str) -> DataFrame:
    return _annotated(spark, sf).groupBy("epss").agg(F.count("*").alias("n"))


def unmatched_components(spark: SparkSession, sf: str) -> DataFrame:
    """Components in no match, by source (anti join)."""
    hits = adv.reconcile(_osv(spark, sf), _nvd(spark, sf)).select("component").distinct()
    c = table(spark, sf, "components").where("coalesce(name, '') <> '' and coalesce(version, '') <> ''").withColumn("component", F.concat_ws("@", "name", "version"))
    return c.join(hits, "component", "left_anti").groupBy("source").agg(F.count("*").alias("n"))


def osv_ingest(spark: SparkSession, sf: str) -> DataFrame:
    rows = adv.ingest_osv(table(spark, sf, "osv_raw"))
    return rows.groupBy("eco", "rel").agg(F.count("*").alias("n_ranges"), F.countDistinct("id").alias("n_ids"), F.sum(F.size("events")).alias("n_events"))


QUERIES = {
    f.__name__: f
    for f in (version_order, cvss_score, canonical_ids, ecosystem_of, osv_join, nvd_join, reconcile_cves, kev_annotate, epss_annotate, high_signal_gate, worst_first_topk, cve_counters, unmatched_components, osv_ingest)
}

_M = lambda k: f"regexp_extract('/' || coalesce(v, ''), '/{k}:([^/])', 1)"
_SCORE = f"""
(with m as (select v, {_M("AV")} as av, {_M("AC")} as ac, {_M("PR")} as pr, {_M("UI")} as ui, {_M("S")} as s, {_M("C")} as c, {_M("I")} as i, {_M("A")} as a, {_M("Au")} as au from vectors),
w as (select *, case av when 'N' then .85 when 'A' then .62 when 'L' then .55 when 'P' then .2 end as wav, case ac when 'L' then .77 when 'H' then .44 end as wac,
  case when pr = 'N' then .85 when pr = 'L' then case when s = 'C' then .68 else .62 end when pr = 'H' then case when s = 'C' then .5 else .27 end end as wpr,
  case ui when 'N' then .85 when 'R' then .62 end as wui,
  1 - (1 - case c when 'H' then .56 when 'L' then .22 when 'N' then 0 end) * (1 - case i when 'H' then .56 when 'L' then .22 when 'N' then 0 end) * (1 - case a when 'H' then .56 when 'L' then .22 when 'N' then 0 end) as iss,
  10.41 * (1 - (1 - case c when 'C' then .66 when 'P' then .275 when 'N' then 0 end) * (1 - case i when 'C' then .66 when 'P' then .275 when 'N' then 0 end) * (1 - case a when 'C' then .66 when 'P' then .275 when 'N' then 0 end)) as hurt,
  20 * case av when 'N' then 1.0 when 'A' then .646 when 'L' then .395 end * case ac when 'L' then .71 when 'M' then .61 when 'H' then .35 end * case au when 'N' then .704 when 'S' then .56 when 'M' then .45 end as reach from m),
f as (select *, case when s = 'C' then 7.52 * (iss - .029) - 3.25 * pow(iss - .02, 15) when s <> '' then 6.42 * iss end as felt, 8.22 * wav * wac * wpr * wui as ease from w)
select v, coalesce(case
  when v like 'CVSS:3.%' then case when felt + ease is null then null when felt <= 0 then 0 else ceil(least(10.0, case when s = 'C' then 1.08 * (felt + ease) else felt + ease end) * 10) / 10 end
  when au <> '' then case when hurt + reach is null then null when hurt = 0 then 0 else round(greatest(0, (.6 * hurt + .4 * reach - 1.5) * 1.176) * 10) / 10 end end, -1) as score,
  ac, c, i, av, case when v like 'CVSS:3.1%' then 3 when v like 'CVSS:3.0%' then 2 when coalesce(v, '') <> '' then 1 else 0 end as richness from f)
""".replace(" .", " 0.")

_ECO = """case when source = 'dpkg' then case when lower(i.distro_id) = 'ubuntu' then 'Ubuntu' else 'Debian' end
  when source = 'apk' then case when lower(c.distro_id) = 'alpine' then 'Alpine' end
  when source = 'rpm' then case when lower(i.distro_id) in ('rhel','redhat','red hat','centos','fedora') then 'Red Hat' when lower(i.distro_id) = 'rocky' then 'Rocky Linux'
    when lower(i.distro_id) in ('almalinux','alma') then 'AlmaLinux' when lower(i.distro_id) like 'opensuse%' then 'openSUSE' when lower(i.distro_id) like 'sle%' or lower(i.distro_id) = 'suse' then 'SUSE' end
  when source = 'npm' then 'npm' when source = 'pypi' then 'PyPI' when source = 'golang' then 'Go' when source = 'cargo' then 'crates.io' when source = 'composer' then 'Packagist' when source = 'gem' then 'RubyGems' end"""

_OSV = f"""
idx as (select eco, pkg, upper(bare(id)) as id, bare(coalesce(rel, '')) as rel, nullif(sev, '') as sev, events, coalesce(summary, '') as summary from (
  select *, row_number() over (partition by eco, pkg, upper(bare(id)), bare(coalesce(rel, '')) order by loaded_at desc nulls last, row_id desc) as rn
  from osv_index where snap_no = (select max(snap_no) from osv_index)) where rn = 1),
ev as (select eco, pkg, id, rel, unnest(generate_series(1, len(events))) as p, unnest(events) as e from idx),
ek as (select eco, pkg, id, rel, p, substr(lower(bare(e.type)), 1, 1) as kind, bare(e.value) as val, {version_key_sql("bare(e.value)")} as k from ev where e.value is not null),
comp as (select distinct eco, name, version, release, {version_key_sql("version")} as k from (
  select {_ECO} as eco, c.name, c.version, case when source <> 'apk' and lower(i.distro_id) in ('debian','ubuntu') then coalesce(i.distro_version, '') else '' end as release
  from components c left join images i on c.image_id = i.image_id) where eco is not null and coalesce(name, '') <> '' and coalesce(version, '') <> ''),
fold as (select c.eco, c.name, c.version, c.release, e.id, e.rel, arg_max(e.kind, e.p) as last_kind from comp c join ek e on c.eco = e.eco and c.name = e.pkg
  where (c.release = '' or e.rel = '' or c.release = e.rel) and (e.kind = 'i' and (e.val = '0' or c.k >= e.k) or e.kind = 'f' and c.k >= e.k or e.kind = 'l' and c.k > e.k) group by all),
osv_rows as (select f.name || '@' || f.version as component, f.id as cve_id, coalesce(x.sev, '') as severity,
  'exact-range (' || f.eco || case when f.release <> '' and f.rel <> '' then ':' || f.rel else '' end || ')' as basis, x.summary
  from fold f join idx x on f.eco = x.eco and f.name = x.pkg and f.id = x.id and f.rel = x.rel where last_kind = 'i'),
osv as (select component, cve_id, severity, basis, summary, false as fork, false as unbounded_below from (select *, row_number() over (partition by component, cve_id order by basis, severity, summary) as rn from osv_rows) where rn = 1)
"""
_B = ", ".join(f"nullif(bare({c}), '') as {c}, {version_key_sql(f'nullif(bare({c}), {chr(39) * 2})')} as {c}_k" for c in ("ver", "si", "se", "ei", "ee"))
_NVD = f"""
nb as (select distinct vendor, product, id, cvss, {_B} from nvd_entries),
nc as (select split_part(cpe, ':', 4) as vendor, split_part(cpe, ':', 5) as product, coalesce(name, '') as name, version, max(coalesce(fork, '')) as fork, {version_key_sql("version")} as k
  from components where len(string_split(cpe, ':')) >= 6 and coalesce(version, '') <> '' group by all),
nvd_rows as (select c.name || '@' || c.version as component, b.id as cve_id, coalesce(b.cvss, '') as severity, b.ver is null and b.si is null and b.se is null as unbounded_below, c.fork <> '' as fork,
  'nvd-cpe-range (' || c.vendor || ':' || c.product || ')' || case when c.fork <> '' and b.ver is null and b.si is null and b.se is null then ' [' || c.fork || '; range lower-bound unknown -- verify]' else '' end as basis
  from nc c join nb b on c.vendor = b.vendor and c.product = b.product
  where case when b.ver is not null then c.k = b.ver_k else (b.si is null or c.k >= b.si_k) and (b.se is null or c.k > b.se_k) and (b.ei is null or c.k <= b.ei_k) and (b.ee is null or c.k < b.ee_k) end),
nvd as (select component, cve_id, severity, basis, '' as summary, fork, unbounded_below from (select *, row_number() over (partition by component, cve_id order by basis, severity, fork, unbounded_below) as rn from nvd_rows) where rn = 1)
"""
_REC = f"""with {_OSV}, {_NVD}, every as (select * from osv union all select * from nvd),
ranked as (select *, case when severity like 'CVSS:3.1%' then 3 when severity like 'CVSS:3.0%' then 2 when severity <> '' then 1 else 0 end as r from every),
rec as (select component, cve_id, first(severity order by r desc, severity) as severity, array_to_string(list_sort(list_distinct(list(basis))), ' + ') as basis, bool_or(fork) as fork, bool_or(unbounded_below) as unbounded_below from ranked group by all)
"""
_ANN = (
    _REC
    + f""", vectors as (select distinct severity as v from rec), sc as {_SCORE},
kev as (select distinct id from nvd_entries where id like 'CVE-%7'),
ep as (select distinct id, cast(right(id, 2) as int) / 100.0 as epss from nvd_entries where id like 'CVE-%' and cast(right(id, 2) as int) % 3 <> 0),
ann as (select r.component, r.cve_id, k.id is not null as kev, cast(coalesce(e.epss, -1) as double) as epss, cast(s.score as double) as score, s.*exclude(v, score, richness), r.fork, r.unbounded_below
  from rec r left join kev k on r.cve_id = k.id left join ep e on r.cve_id = e.id join sc s on s.v = r.severity),
gated as (select *, kev or (not (fork and unbounded_below) and (score >= 9 or (score >= 7 and epss >= 0.10 and ac = 'L' and (c not in ('', 'N') or i not in ('', 'N') or (av = 'N' and epss >= 0.70))))) as high from ann)
"""
)

ORACLE = {
    "osv_ingest": OSV_INGEST,
    "version_order": f"select name, arg_max(version, row(k, version)) as newest, count(*) as n from (select name, version, {version_key_sql('version')} as k from components where version is not null and name is not null) group by name",
    "cvss_score": f"with vectors as (select distinct v from (select cvss as v from nvd_entries union all select sev from osv_index)), sc as {_SCORE} select v as vector, cast(score as double) as score, richness from sc",
    "canonical_ids": "select coalesce(nullif(regexp_extract(upper(bare(id)), 'CVE-[0-9]+-[0-9]+'), ''), upper(bare(id))) as cve_id, count(*) as n from osv_index group by 1",
    "ecosystem_of": f"select source, {_ECO} as eco, count(*) as n from components c left join images i on c.image_id = i.image_id group by all",
    "osv_join": f"with {_OSV} select component, cve_id, basis, severity from osv",
    "nvd_join": f"with {_NVD} select component, cve_id, basis, severity, unbounded_below from nvd",
    "reconcile_cves": _REC + "select component, cve_id, severity, basis from rec",
    "kev_annotate": _ANN + "select component, cve_id from gated where kev",
    "epss_annotate": _ANN + "select epss, count(*) as n from gated group by 1",
    "high_signal_gate": _ANN + "select component, cve_id, kev, epss, score from gated where high",
    "worst_first_topk": _ANN + "select component, cve_id, kev, epss, score from gated order by kev desc, score desc, epss desc, cve_id, component limit 40",
    "cve_counters": _ANN + "select count(*) as total, count(*) filter (where high) as high, count(*) filter (where not high) as hidden from gated",
    "unmatched_components": _REC + "select source, count(*) as n from components c where coalesce(name, '') <> '' and coalesce(version, '') <> '' and name || '@' || version not in (select component from rec) group by 1",
}
