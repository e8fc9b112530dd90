"""All passes over one tree of files, and the report of a scan as one JSON document.

Every pass is a lazily planned relation over the same files; whoever reads only one of them runs only that.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuffstone.operators import boot, credentials, kernel, keys, licenses, packages, reports, secrets
from tuffstone.operators.leaked_corpus import leaked_corpus
from tuffstone.sources.tree import unknown_roots

#: Sections of the report in their order.
SECTIONS = ("secrets", "notable", "components", "licenses", "boot_security", "key_weakness", "kernel_config", "hardening", "errors")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def scan_tree(pieces: DataFrame, links: DataFrame, rules: tuple = secrets.RULES, now: int = 0, corpus: DataFrame | None = None, sections: tuple[str, ...] = SECTIONS) -> dict[str, DataFrame]:
    """The relations ``sections`` of files ``(path, offset, content, length, error)`` as ``read_tree`` gives them.

    Secrets are sought in every range of a file; other passes read the files that are one range. Links ``(path,
    target)`` decide which distributions are unknown and name libraries. Files that couldn't be read are in ``errors``
    and nowhere else. Each relation reads the files anew, so they should lie in a table (``runtime.cut``) where listing or
    reading is dear. ``kernel_config`` has one row for each configuration recovered, from disk or out of an image.
    """
    spark = pieces.sparkSession
    read = pieces.where("content is not null")
    mark = "\x01"  # never part of a path; tells a range of a file through the path column
    ranged = read.select(F.concat_ws(mark, "path", "offset").alias("path"), "content")
    place = F.split("path", mark)
    found = secrets.scan_secrets(ranged, rules, now).withColumn("offset", F.col("offset") + F.get(place, 1).cast("bigint")).withColumn("path", F.get(place, 0))
    whole = read.where("octet_length(content) = length").select("path", "content")
    text = whole.select("path", F.decode("content", "UTF-8").alias("content"))

    def secret_findings() -> DataFrame:
        stored = credentials.password_files(text).select(
            "path", "offset", F.lit(0).cast("bigint").alias("size"), "type", F.lit("credential").alias("category"), F.when(F.col("weak"), 95).otherwise(80).alias("confidence"),
            F.lit("").alias("confidence_tier"), F.coalesce("algorithm", F.lit("")).alias("evidence"), F.col("user").alias("label"), F.lit("").alias("description"),
        )
        every = [found, keys.der_private_keys(whole), credentials.config_credentials(text), stored]
        return secrets.dedup_findings(_all([e.select(*[c.split()[0] for c in secrets.FINDING.split(", ")]) for e in every]))

    def weak_keys() -> DataFrame:
        extracted = keys.extract_keys(whole)
        return _all([keys.key_weaknesses(extracted), keys.leaked_keys(extracted, leaked_corpus(spark) if corpus is None else corpus), keys.small_scalars(extracted), keys.shared_primes(extracted)])

    def components() -> DataFrame:
        release = packages.os_release(text, unknown_roots(links))
        root = F.regexp_replace(F.regexp_replace("path", r"(?:^|/)lib/apk/db/installed$", ""), "/$", "")
        apk = packages.apk_components(text.where("path like '%installed'").withColumn("root", root).join(_apk_roots(release), "root", "left"), F.col("distro"))
        names = text.select("path").unionByName(links.select(F.col("target").alias("path")))
        of_text = [packages.status_components, packages.npm_components, packages.composer_components, packages.requirements_components, packages.metadata_components, packages.go_components, packages.cargo_components, packages.gem_components]
        of_bytes = [packages.rpm_components, packages.banner_components, packages.kernel_banners, packages.uboot_banners]
        component = _all([apk, *[read_(text) for read_ in of_text], *[read_(whole) for read_ in of_bytes], packages.filename_components(names)])
        return packages.first_components(component, -F.col("confidence"), "source", "path")

    build = {
        "secrets": secret_findings,
        "notable": lambda: secrets.notable_paths(read.where("offset = 0").select("path")),
        "components": components,
        "licenses": lambda: licenses.file_licenses(text),
        "boot_security": lambda: boot.boot_findings(boot.boot_facts(whole)),
        "key_weakness": weak_keys,
        "kernel_config": lambda: kernel.kconfig_summary(kernel_configs(text, whole)),
        "hardening": lambda: kernel.hardening(kernel_configs(text, whole)),
        "errors": lambda: pieces.where("error is not null").select("path", F.col("error").alias("reason")).distinct(),
    }
    return {name: build[name]() for name in sections}


def _apk_roots(release: DataFrame) -> DataFrame:
    return release.select("root", F.nullif("distro_id", F.lit("")).alias("distro"))


def kernel_configs(text: DataFrame, whole: DataFrame) -> DataFrame:
    """(path, content) of kernel configurations: files that look like one, and those embedded in images."""
    return text.where(kernel.looks_like_kconfig(F.col("content"))).unionByName(kernel.embedded_configs(whole))


def dump_config(configs: DataFrame) -> DataFrame:
    """The longest configuration of ``configs(path, content)`` as it stands, the first path of equals; no row for none."""
    best = configs.where("content <> ''").agg(F.max_by(F.struct("path", "content"), F.struct(F.length("content"), _last_first(F.col("path")))).alias("c"))
    return best.where("c is not null").select("c.path", "c.content")


def _last_first(path: Column) -> Column:
    """A text that orders paths the other way round."""
    return F.transform(F.split(path, ""), lambda c: -F.ascii(c))


def report_object(relations: dict[str, DataFrame]) -> DataFrame:
    """(section, n, line): the lines, in order of section and n, of one JSON object with an array for each relation.

    Rows of a relation come in an order that depends on them alone (see ``reports.numbered``), so a relation of any
    size is written in parallel; empty fields are left out, binary ones too.
    """
    parts = []
    spark = next(iter(relations.values())).sparkSession
    fixed = []
    for k, (name, df) in enumerate(relations.items()):
        fixed.append((2 * k, 0, ("{" if k == 0 else "],") + f'"{name}":['))
        shown = [c for c, t in df.dtypes if t != "binary"]
        line = df.select(F.to_json(F.struct(*shown)).alias("line")).withColumn("all", F.lit(1))
        numbered = reports.numbered(line, "all", "line")
        parts.append(numbered.select(F.lit(2 * k + 1).alias("section"), F.col("n").cast("bigint").alias("n"), F.concat(F.when(F.col("n") > 0, ",").otherwise(""), "line").alias("line")))
    fixed.append((2 * len(relations), 0, "]}"))
    return _all([spark.createDataFrame(fixed, "section int, n bigint, line string"), *parts])


def report_text(lines: DataFrame) -> DataFrame:
    """(json): the lines of ``report_object`` as one text, for reports that one row can hold."""
    ordered = F.array_sort(F.collect_list(F.struct("section", "n", "line")))
    return lines.agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "").alias("json"))
