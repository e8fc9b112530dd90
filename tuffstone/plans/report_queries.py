"""Queries of sinks, sources and streams, with their SQL."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.functions.versions import version_key_sql
from tuffstone.operators import reports
from tuffstone.plans.advisory_queries import _B
from tuffstone.runtime import put_file, table
from tuffstone.sources import files as sources
from tuffstone.streaming import scan


def cyclonedx(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of all images: line counts and total length, numbering aside."""
    lines = reports.cyclonedx(table(spark, sf, "components"))
    return lines.groupBy("image_id", "section").agg(F.count("*").alias("n_lines"), F.max("n").alias("last"))


def spdx(spark: SparkSession, sf: str) -> DataFrame:
    lines = reports.spdx(table(spark, sf, "components"), "2026-01-01T00:00:00Z")
    return lines.groupBy("image_id", "section").agg(F.count("*").alias("n_lines"), F.max("n").alias("last"))


def sbom_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = reports.cyclonedx(table(spark, sf, "components")).where("section = 1")
    name = F.get_json_object(F.regexp_replace("line", "^,", ""), "$.name")
    return lines.select("image_id", name.alias("name")).groupBy("image_id", "name").agg(F.count("*").alias("n"))


def scan_summary(spark: SparkSession, sf: str) -> DataFrame:
    return reports.summary(table(spark, sf, "findings"), table(spark, sf, "components"), table(spark, sf, "nvd_entries"), table(spark, sf, "source_files"))


def json_report(spark: SparkSession, sf: str) -> DataFrame:
    got = reports.json_report({"components": table(spark, sf, "components").select("comp_id", "name"), "findings": table(spark, sf, "findings").select("finding_id", "type")})
    return got.groupBy("relation").agg(F.count("*").alias("n"), F.count(F.get_json_object("line", "$.name")).alias("named"))


def json_escape(spark: SparkSession, sf: str) -> DataFrame:
    return spark.createDataFrame([('a"b\\c\n\x01é',), ("",)], "t string").select(reports.latin1_escaped(F.col("t")).alias("j"))


def text_listing(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "findings").select(F.when(F.col("confidence") >= 90, "high").when(F.col("confidence") >= 80, "medium").otherwise("info").alias("severity"), "type", F.coalesce("label", F.lit("")).alias("label"), F.col("file_id").cast("string").alias("path"))
    return reports.text_listing(f).select("type", "label", "times")


def _tree(spark: SparkSession) -> str:
    """A small tree in the shared folder."""
    folder = f"tree-{uuid.uuid4().hex}"
    sums = f"{hashlib.sha256(b'x=1' + bytes([10])).hexdigest()}  a.conf\n{'0' * 64} *b\n{'1' * 64}  gone\nnot a line\n".encode()
    for path, content in (("etc/a.conf", b"x=1\n"), ("bin/b", b"\x7fELF\0"), ("empty", b""), ("SHA256SUMS", sums)):
        put_file(spark, path, content, folder)
    return f"{spark.sparkContext.getCheckpointDir()}/{folder}"


def tree_scan(spark: SparkSession, sf: str) -> DataFrame:
    return sources.files_df(spark, _tree(spark)).where("path <> 'SHA256SUMS'").select("path", "length")


def symlink_facts(spark: SparkSession, sf: str) -> DataFrame:
    with tempfile.TemporaryDirectory() as root:  # links are read by the driver alone
        os.makedirs(f"{root}/bin")
        os.symlink("b", f"{root}/bin/link")
        return sources.symlinks(spark, root)


def checksum_verify(spark: SparkSession, sf: str) -> DataFrame:
    files = sources.files_df(spark, _tree(spark))
    manifest = sources.checksum_manifest(files.where("path = 'SHA256SUMS'").select(F.col("content").cast("string").alias("content")))
    return sources.verify_files(files, manifest)


def index_file(spark: SparkSession, sf: str) -> DataFrame:
    rows = [("Debian", "busybox", "CVE-1", "s", "12", "text", [("i", "0"), ("f", "1.2")]), ("Alpine", "zlib", "CVE-2", "", "", "", []), ("Debian", "busybox", "CVE-3", "", "", "é", [("l", "9")])]
    whole = sources.index_bytes(rows, "mirror", 1)
    files = spark.createDataFrame([("a", bytearray(whole)), ("cut", bytearray(whole[: len(whole) // 2])), ("other", bytearray(b"MOS2" + b"\0" * 80))], "path string, content binary")
    return sources.read_index(files.where("path <> 'cut'")).select("eco", "pkg", "id", "sev", "rel", "sum", F.array_join(F.transform("events", lambda e: F.concat(e["type"], e["value"])), ";").alias("ev"))


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly counts by type over the whole event table, streamed to its end."""
    static = table(spark, sf, "events")
    name = f"w{uuid.uuid4().hex}"
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/events.parquet" if os.path.isdir(f"{sf}/events.parquet") else f"{sf}/events*.parquet")
    return scan.run_to_end(scan.counts_by_window(stream, "ts", "event_type"), spark, name, "complete")


def stream_dedup(spark: SparkSession, sf: str) -> DataFrame:
    static = table(spark, sf, "events")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/events.parquet" if os.path.isdir(f"{sf}/events.parquet") else f"{sf}/events*.parquet")
    got = scan.run_to_end(scan.first_sightings(stream, ["user_id", "event_type"], "ts", "10000 days"), spark, f"d{uuid.uuid4().hex}")
    return got.select("user_id", "event_type")


def stream_matches(spark: SparkSession, sf: str) -> DataFrame:
    """Advisory ranges that hold a component, over the whole component table as a stream."""
    static = table(spark, sf, "components")
    stream = spark.readStream.schema(static.schema).parquet(f"{sf}/components.parquet" if os.path.isdir(f"{sf}/components.parquet") else f"{sf}/components*.parquet")
    got = scan.run_to_end(scan.match_stream(stream, table(spark, sf, "nvd_entries")), spark, f"m{uuid.uuid4().hex}")
    return got.groupBy("comp_id", "cve_id").agg(F.count("*").alias("n_ranges"))


QUERIES = {f.__name__: f for f in (cyclonedx, spdx, sbom_lines, scan_summary, json_report, json_escape, text_listing, tree_scan, symlink_facts, checksum_verify, index_file, event_windows, stream_dedup, stream_matches)}

_N = "(select image_id, count(*) as c from components where image_id is not null group by 1)"
ORACLE = {
    "cyclonedx": f"select image_id, 0 as section, 1 as n_lines, 0 as last from {_N} union all select image_id, 1, c, c - 1 from {_N} union all select image_id, 9, 1, 0 from {_N}",
    "spdx": f"select image_id, unnest([0, 2, 9]) as section, 1 as n_lines, 0 as last from {_N} union all select image_id, unnest([1, 3]), c, c - 1 from {_N}",
    "sbom_lines": "select image_id, coalesce(name, '') as name, count(*) as n from components where image_id is not null group by all",
    "scan_summary": """select (select count(*) || ' secrets' || case when count(*) filter (where confidence >= 95) > 0 then ' (' || count(*) filter (where confidence >= 95) || ' checksum-validated)' else '' end from findings where category = 'secret') || ', ' ||
      (select count(*) from components) || ' components, ' || (select count(*) from nvd_entries) || ' CVEs, ' || (select count(distinct type) from findings where category = 'license') || ' licenses, ' || (select count(*) from findings where category = 'boot') || ' boot findings, ' ||
      (select count(*) from findings where category = 'keys') || ' key findings across ' || (select count(*) from source_files) || ' files' as summary""",
    "json_report": "select 'components' as relation, count(*) as n, count(name) as named from components union all select 'findings', count(*), 0 from findings",
    "json_escape": "select unnest(['\"a\\\"b\\\\c\\n\\u0001\\u00c3\\u00a9\"', '\"\"']) as j",
    "text_listing": "select type, label, times from (select case when confidence >= 90 then 0 when confidence >= 80 then 1 else 2 end as rank, type, coalesce(label, '') as label, count(*) as times from findings group by all order by rank, times desc, type, label limit 40)",
    "tree_scan": "select * from (values ('etc/a.conf', 4), ('bin/b', 5)) t(path, length)",
    "symlink_facts": "select 'bin/link' as path, 'b' as target",
    "checksum_verify": "select * from (values ('a.conf', true), ('b', false), ('gone', false)) t(name, ok)",
    "index_file": "select * from (values ('Debian', 'busybox', 'CVE-1', 's', '12', 'text', 'i0;f1.2'), ('Alpine', 'zlib', 'CVE-2', '', '', '', ''), ('Debian', 'busybox', 'CVE-3', '', '', 'é', 'l9')) t(eco, pkg, id, sev, rel, sum, ev)",
    "event_windows": "select cast(date_trunc('hour', ts) as timestamp) as start, event_type, count(*) as n from events group by all",
    "stream_matches": f"""with nb as (select distinct vendor, product, id, cvss, {_B} from nvd_entries),
      nc as (select comp_id, split_part(cpe, ':', 4) as vendor, split_part(cpe, ':', 5) as product, {version_key_sql("version")} as k from components where len(string_split(cpe, ':')) >= 6 and coalesce(version, '') <> '')
      select comp_id, id as cve_id, count(*) as n_ranges from nc c join nb b on c.vendor = b.vendor and c.product = b.product
      where case when b.ver is not null then c.k = b.ver_k else (b.si is null or c.k >= b.si_k) and (b.se is null or c.k > b.se_k) and (b.ei is null or c.k <= b.ei_k) and (b.ee is null or c.k < b.ee_k) end group by all""",
    "stream_dedup": "select distinct user_id, event_type from events",
}
