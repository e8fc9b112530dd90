"""Queries of this subpackage, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.functions.text import with_blanks_stripped
from tuffstone.llm import homoglyphs, leakage, licensing, linkage, packing, survivors
from tuffstone.runtime import table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """The rows each group keeps; every stated version must have been fused to a value."""
    got = survivors.survivors(table(spark, sf, "components"))
    sound = (F.col("version_comp_id") == 0) | (F.col("version_posterior") > 0)
    return got.where(sound & ((F.col("license_comp_id") == 0) | (F.col("license_posterior") > 0))).select("first_comp_id", "keep_comp_id", "version_comp_id", "license_comp_id")


def p1_survivors(spark: SparkSession, sf: str) -> DataFrame:
    return survivors.survivors(table(spark, sf, "components"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return licensing.licenses(table(spark, sf, "source_files"), table(spark, sf, "findings"), table(spark, sf, "components"))


def p3_statements(spark: SparkSession, sf: str) -> DataFrame:
    return licensing.statements(table(spark, sf, "source_files"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_matches(spark, sf).select("comp_id", "vendor", "product")


def p4_matches(spark: SparkSession, sf: str) -> DataFrame:
    return linkage.matches(table(spark, sf, "components"), table(spark, sf, "nvd_entries"))


def p6_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.containers(table(spark, sf, "documents"))


def p6_fill_report(spark: SparkSession, sf: str) -> DataFrame:
    return packing.fill_report(packing.containers(table(spark, sf, "documents")))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id", "item_id")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items"))


def p7_clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_items")).select("doc_id")


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return homoglyphs.same_look_pairs(table(spark, sf, "documents"))


def p8_classes(spark: SparkSession, sf: str) -> DataFrame:
    return homoglyphs.look_classes(table(spark, sf, "documents"))


def queries() -> dict:
    named = [p1_found, p1_survivors, p3_found, p3_statements, p4_found, p4_matches, p6_containers, p6_fill_report, p7_found, p7_report, p7_clean_documents, p8_found, p8_classes]
    return {f.__name__: f for f in named}


_P1 = """
with r as (
  select image_id, comp_id, nullif(regexp_replace(lower(name), '[\\s\\x{00a0}_.\\-]+', '', 'g'), '') as k,
         nullif(bare(version), '') as version, nullif(bare(license), '') as license,
         case when confidence between 0 and 100 then confidence else -1 end as conf, scanned_at,
         nullif(regexp_replace(regexp_replace(lower(nullif(bare(version), '')), '^([0-9]+:)?v?([0-9])', '\\2'),
                '(\\+(dfsg|ds|repack|git)[^-]*)?(-r?[0-9][0-9a-z.+~]*)?$', ''), '') as up
  from components),
v as (select image_id, k, min(up) as lo, max(up) as hi from r where k is not null and image_id is not null group by 1, 2),
g as (select r.*, coalesce(r.up, case when v.lo is null then '' when v.lo = v.hi then v.lo end) as u from r join v on r.image_id = v.image_id and r.k = v.k),
o as (select *, row_number() over (partition by image_id, k, u order by conf desc, scanned_at desc nulls last, comp_id) as rn from g where u is not null)
select min(comp_id) as first_comp_id, min(comp_id) filter (where rn = 1) as keep_comp_id,
       coalesce(arg_min(comp_id, rn) filter (where version is not null), 0) as version_comp_id,
       coalesce(arg_min(comp_id, rn) filter (where license is not null), 0) as license_comp_id
from o group by image_id, k, u having count(*) > 1
"""


def oracle_sql() -> dict[str, str]:
    return {name: with_blanks_stripped(sql) for name, sql in {"p1_found": _P1}.items()}
