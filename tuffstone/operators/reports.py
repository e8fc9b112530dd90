"""Sinks: bill-of-materials documents, JSON reports, summary lines and text listings, as lines per image.

A document is a set of numbered lines; written in order they are the document. So a document of any size is
made in parallel and no row has to hold it whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOOL = "tuffstone"


def numbered(df: DataFrame, key: str, *order: str, parts: int = 64) -> DataFrame:
    """``df`` with ``n``: 0, 1, ... within each key, in the order of hash parts and then of ``order``.

    Rows are counted within ``parts`` parts of a key and the parts are put behind each other, so no key is
    ever in one task. The numbering depends on the rows alone.
    """
    split = df.withColumn("__part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = split.groupBy(key, "__part").agg(F.count("*").alias("__size"))
    before = sizes.withColumn("__before", F.sum("__size").over(Window.partitionBy(key).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)))
    within = split.withColumn("__n", F.row_number().over(Window.partitionBy(key, "__part").orderBy(*order)) - 1)
    both = within.join(before.select(key, "__part", F.coalesce("__before", F.lit(0)).alias("__before")), [key, "__part"])
    return both.withColumn("n", F.col("__n") + F.col("__before")).drop("__n", "__before", "__part")


def latin1_escaped(text: Column) -> Column:
    """JSON text of a string as a byte-wise writer gives it: control and non-ASCII bytes as ``\\u00xx``."""
    seen = F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")
    named = F.create_map(*[F.lit(x) for x in ('"', '\\"', "\\", "\\\\", "\n", "\\n", "\r", "\\r", "\t", "\\t")])

    def one(c: Column) -> Column:
        code = F.ascii(c)
        return F.coalesce(F.try_element_at(named, c), F.when((code < 32) | (code >= 128), F.concat(F.lit("\\u00"), F.lower(F.lpad(F.hex(code), 2, "0")))), c)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(seen, ""), lambda c: c != ""), one), ""), F.lit('"'))


def _given(c: str) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _wrapped(rows: DataFrame, key: str, head: str, tail: str, extra: DataFrame | None = None) -> DataFrame:
    """Lines (key, section, n, line): a head, the rows with commas between them, a tail."""
    keys = rows.select(key).distinct()
    line = F.concat(F.when(F.col("n") > 0, ",").otherwise(""), F.col("line"))
    parts = [keys.select(key, F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("n"), F.lit(head).alias("line")), rows.select(key, F.lit(1).alias("section"), F.col("n").cast("bigint").alias("n"), line.alias("line"))]
    if extra is not None:
        parts.append(extra)
    parts.append(keys.select(key, F.lit(9).alias("section"), F.lit(0).cast("bigint").alias("n"), F.lit(tail).alias("line")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def cyclonedx(components: DataFrame, key: str = "image_id", version: str = "1") -> DataFrame:
    """Lines of one CycloneDX 1.5 document per ``key``; empty fields are left out, null keys have no document."""
    named = numbered(components.where(F.col(key).isNotNull()), key, "comp_id")
    tool = lambda name, value: F.struct(F.lit(f"{TOOL}:{name}").alias("name"), F.coalesce(value, F.lit("")).alias("value"))
    body = F.struct(
        F.coalesce(_given("type"), F.lit("library")).alias("type"), F.coalesce(F.col("name"), F.lit("")).alias("name"), _given("version").alias("version"), _given("purl").alias("purl"), _given("cpe").alias("cpe"),
        F.when(_given("license").isNotNull(), F.array(F.struct(F.struct(F.col("license").alias("name")).alias("license")))).alias("licenses"),
        F.array(tool("source", F.col("source")), tool("origin", F.col("origin_path")), tool("confidence", F.col("confidence").cast("string"))).alias("properties"),
    )
    head = '{"bomFormat":"CycloneDX","specVersion":"1.5","version":1,"metadata":{"tools":[{"vendor":"%s","name":"%s","version":"%s"}]},"components":[' % (TOOL, TOOL, version)
    return _wrapped(named.select(key, "n", F.to_json(body).alias("line")), key, head, "]}")


def spdx(components: DataFrame, created: str, key: str = "image_id", version: str = "1") -> DataFrame:
    """Lines of one SPDX 2.3 document per ``key``, made at ``created`` (ISO time)."""
    named = numbered(components.where(F.col(key).isNotNull()), key, "comp_id")
    ident = F.concat(F.lit("SPDXRef-Package-"), "n")
    ref = F.struct(F.lit("PACKAGE-MANAGER").alias("referenceCategory"), F.lit("purl").alias("referenceType"), F.col("purl").alias("referenceLocator"))
    body = F.struct(
        ident.alias("SPDXID"), F.coalesce(F.col("name"), F.lit("")).alias("name"), _given("version").alias("versionInfo"), F.lit("NOASSERTION").alias("downloadLocation"), F.lit(False).alias("filesAnalyzed"),
        F.lit("NOASSERTION").alias("licenseConcluded"), F.coalesce(_given("license"), F.lit("NOASSERTION")).alias("licenseDeclared"), F.when(_given("purl").isNotNull(), F.array(ref)).alias("externalRefs"),
    )
    head = '{"spdxVersion":"SPDX-2.3","dataLicense":"CC0-1.0","SPDXID":"SPDXRef-DOCUMENT","name":"%s-sbom","documentNamespace":"https://%s.invalid/sbom/%s","creationInfo":{"created":"%s","creators":["Tool: %s-%s"]},"packages":[' % (TOOL, TOOL, created, created, TOOL, version)
    said = F.concat(F.when(F.col("n") > 0, ",").otherwise(""), F.lit('"'), ident, F.lit('"'))
    keys = named.select(key).distinct().select(key, F.lit(2).alias("section"), F.lit(0).cast("bigint").alias("n"), F.lit('],"documentDescribes":[').alias("line"))
    listed = named.select(key, F.lit(3).alias("section"), F.col("n").cast("bigint").alias("n"), said.alias("line"))
    return _wrapped(named.select(key, "n", F.to_json(body).alias("line")), key, head, "]}", keys.unionByName(listed))


def write_documents(lines: DataFrame, path: str, key: str = "image_id") -> None:
    """Documents as text files, a folder for each key; reading its files in order gives the document."""
    lines.repartitionByRange(key, "section", "n").sortWithinPartitions(key, "section", "n").select(key, "line").write.mode("overwrite").partitionBy(key).option("lineSep", "").text(path)


def plural(n: Column, word: str) -> Column:
    return F.concat(n.cast("string"), F.lit(f" {word}"), F.when(n == 1, "").otherwise("s"))


def summary(findings: DataFrame, components: DataFrame, matches: DataFrame, files: DataFrame) -> DataFrame:
    """One row (summary): what was found in how many files.

    ``findings(category, type, confidence)``; categories secret, license, boot and keys are counted apart.
    """
    f = findings.agg(
        F.count_if(F.col("category") == "secret").alias("secrets"), F.count_if((F.col("category") == "secret") & (F.col("confidence") >= 95)).alias("validated"),
        F.countDistinct(F.when(F.col("category") == "license", F.col("type"))).alias("licenses"), F.count_if(F.col("category") == "boot").alias("boot"), F.count_if(F.col("category") == "keys").alias("keys"),
    )
    counts = [components.agg(F.count("*").alias("components")), matches.agg(F.count("*").alias("cves")), files.agg(F.count("*").alias("files"))]
    # Four rows of one: a join of single rows on a constant.
    row = reduce(lambda a, b: a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k"), counts, f)
    c = F.col
    validated = F.when(c("validated") > 0, F.concat(F.lit(" ("), c("validated").cast("string"), F.lit(" checksum-validated)"))).otherwise("")
    parts = F.array_compact(F.array(
        F.concat(plural(c("secrets"), "secret"), validated), plural(c("components"), "component"), plural(c("cves"), "CVE"), plural(c("licenses"), "license"),
        F.when(c("boot") > 0, plural(c("boot"), "boot finding")), F.when(c("keys") > 0, plural(c("keys"), "key finding")),
    ))
    return row.select(F.concat(F.array_join(parts, ", "), F.lit(" across "), plural(c("files"), "file")).alias("summary"))


def json_report(relations: dict[str, DataFrame]) -> DataFrame:
    """Rows (relation, line) of several relations, each row as JSON without its empty fields."""
    parts = [df.select(F.lit(name).alias("relation"), F.to_json(F.struct(*df.columns)).alias("line")) for name, df in relations.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def text_listing(findings: DataFrame, most: int = 40) -> DataFrame:
    """The ``most`` (type, label) groups to show first: severity, then how often, with a text line each."""
    groups = findings.groupBy("severity", "type", "label").agg(F.count("*").alias("times"), F.min("path").alias("first_path"))
    rank = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    times = F.when(F.col("times") > 1, F.concat(F.lit(" x"), "times")).otherwise("")
    line = F.concat(F.lit("["), "severity", F.lit("] "), "type", F.lit(": "), F.substring("label", 1, 100), times, F.lit("  "), "first_path")
    return groups.withColumn("rank", rank).orderBy("rank", F.desc("times"), "type", "label").limit(most).select("rank", "type", "label", "times", line.alias("line"))
