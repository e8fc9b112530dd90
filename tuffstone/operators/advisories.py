"""Advisories: ingest of raw records, joins with components, reconciliation, annotation, gate and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuffstone.functions.scoring import canonical_cve, cvss_base_score, cvss_rank, high_signal
from tuffstone.functions.text import stripped
from tuffstone.functions.versions import version_key
from tuffstone.operators.nested import advisory_ranges
from tuffstone.runtime import largest_keys, salted

# How a component source names the ecosystem of its advisories.
SOURCE_ECOSYSTEM = {"npm": "npm", "pypi": "PyPI", "golang": "Go", "cargo": "crates.io", "composer": "Packagist", "gem": "RubyGems"}
RPM_ECOSYSTEM = {"rhel": "Red Hat", "redhat": "Red Hat", "red hat": "Red Hat", "centos": "Red Hat", "fedora": "Red Hat", "rocky": "Rocky Linux", "almalinux": "AlmaLinux", "alma": "AlmaLinux", "sles": "SUSE", "sled": "SUSE", "suse": "SUSE"}

BOUNDS = ("ver", "si", "se", "ei", "ee")
EVENTS = "array<struct<type:string,value:string,vkey:string>>"


def _case(of: Column, table: dict[str, str]) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for k, v in table.items():
        out = out.when(of == k, v)
    return out


def source_ecosystem(source: Column, distro: Column) -> Column:
    """Ecosystem of a component source in an image of a distribution; null where there is none."""
    d = F.lower(F.coalesce(distro, F.lit("")))
    rpm = _case(d, RPM_ECOSYSTEM)
    rpm = F.coalesce(rpm, F.when(d.startswith("opensuse"), "openSUSE").when(d.startswith("sle"), "SUSE"))
    return (
        F.when(source == "dpkg", F.when(d == "ubuntu", "Ubuntu").otherwise("Debian"))
        .when((source == "apk") & (d == "alpine"), "Alpine")
        .when(source == "rpm", rpm)
        .otherwise(_case(source, SOURCE_ECOSYSTEM))
    )


def is_affected(vkey: Column, events: Column) -> Column:
    """State of a version after an ordered list of events with keys: introduced, fixed, last affected."""

    def step(on: Column, e: Column) -> Column:
        return (
            F.when((e["type"] == "i") & ((e["value"] == "0") | (vkey >= e["vkey"])), True)
            .when((e["type"] == "f") & (vkey >= e["vkey"]), False)
            .when((e["type"] == "l") & (vkey > e["vkey"]), False)
            .otherwise(on)
        )

    return F.aggregate(events, F.lit(False), step)


def keyed_events(events: Column) -> Column:
    """Events with one-letter kinds and version keys, as an advisory index stores them."""
    kind = lambda e: F.substring(F.lower(stripped(e["type"])), 1, 1)
    return F.transform(F.filter(events, lambda e: e["value"].isNotNull()), lambda e: F.struct(kind(e).alias("type"), stripped(e["value"]).alias("value"), version_key(stripped(e["value"])).alias("vkey")))


def numeric_release(release: Column) -> Column:
    """``22.04`` of an Ubuntu release spelled ``22.04:LTS`` or alike; other releases as they are."""
    return F.coalesce(F.nullif(F.regexp_extract(release, r"([0-9]{2}\.[0-9]{2})", 1), F.lit("")), release)


def ingest_osv(raw: DataFrame) -> DataFrame:
    """Index rows (raw_id, eco, pkg, id, sev, rel, summary, events) of advisory bodies: one per range.

    The id is the first CVE alias, else the id; a missing summary is taken from the details and cut to 157
    characters and '...' beyond 160. The release follows the colon of the ecosystem. Ranges of any type are
    kept; ``versions`` lists are ignored, and paid tiers of an ecosystem (FIPS) are dropped.
    """
    text = F.coalesce("summary", "details")
    eco = F.split("eco", ":")
    release = numeric_release(F.when(F.size(eco) > 1, F.array_join(F.slice(eco, 2, F.size(eco)), ":")))
    return advisory_ranges(raw).where(~F.col("eco").contains("FIPS")).select(
        "raw_id", "vuln_pos", "affected_pos", "range_pos", F.get(eco, 0).alias("eco"), "pkg", canonical_cve(F.coalesce("cve", "id")).alias("id"), "sev", F.coalesce("rel", release).alias("rel"),
        F.when(F.length(text) > 160, F.concat(F.substring(text, 1, 157), F.lit("..."))).otherwise(text).alias("summary"), "events",
    )


def latest_index(osv_index: DataFrame, keyed: bool = True) -> DataFrame:
    """The last snapshot of an advisory index, each (eco, pkg, id, rel) as loaded last.

    With ``keyed`` the events carry version keys, as an index that is written once should; ``osv_join`` also
    takes one without and then keys only the packages it needs.
    """
    newest = osv_index.agg(F.max("snap_no").alias("snap_no"))
    rows = osv_index.join(F.broadcast(newest), "snap_no")
    clean = rows.select("eco", "pkg", F.upper(stripped(F.col("id"))).alias("id"), F.coalesce(stripped(F.col("rel")), F.lit("")).alias("rel"), F.nullif(stripped(F.col("sev")), F.lit("")).alias("sev"), "summary", "events", "loaded_at", "row_id")
    last = Window.partitionBy("eco", "pkg", "id", "rel").orderBy(F.col("loaded_at").desc_nulls_last(), F.desc("row_id"))
    kept = clean.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n", "loaded_at", "row_id")
    events = F.coalesce("events", F.array().cast("array<struct<type:string,value:string>>"))
    return kept.withColumn("events", keyed_events(events) if keyed else events)


def with_distro(components: DataFrame, images: DataFrame) -> DataFrame:
    """Components with the distribution and release of their image; an apk component keeps its own."""
    of_image = images.select("image_id", F.col("distro_id").alias("image_distro"), F.col("distro_version").alias("image_release"))
    joined = components.join(of_image, "image_id", "left")
    distro = F.when(F.col("source") == "apk", F.col("distro_id")).otherwise(F.col("image_distro"))
    release = F.when((F.col("source") != "apk") & F.lower("image_distro").isin("debian", "ubuntu"), F.col("image_release"))
    return joined.withColumn("eco", source_ecosystem(F.col("source"), distro)).withColumn("release", F.coalesce(release, F.lit("")))


def osv_join(components: DataFrame, index: DataFrame, salts: int = 16, sizes: DataFrame | None = None) -> DataFrame:
    """Matches of components with eco and release against an index: ``(component, purl, cve_id, severity, basis, summary)``.

    Components are folded to distinct (eco, name, version, release) before the join, so a package found in
    many images is matched once; releases must agree only where both are known. One row per component and
    advisory: the smallest basis, then severity, is kept. The advisories of the largest packages lie in ``salts``
    parts, each met by the versions of the package, so one package may hold any share of either table; ``sizes(eco,
    pkg)`` may give the rows to find these packages by, where ``index`` is costly to read twice.
    """
    wanted = components.where("eco is not null and coalesce(name, '') <> '' and coalesce(version, '') <> ''")
    distinct = wanted.groupBy("eco", "name", "version", "release").agg(F.min("purl").alias("purl")).withColumn("vkey", version_key(F.col("version")))
    advisories = index.select("eco", F.col("pkg").alias("name"), "id", "rel", "sev", "summary", "events")
    if "vkey" not in dict(index.dtypes)["events"]:
        advisories = advisories.join(distinct.select("eco", "name").distinct(), ["eco", "name"], "left_semi").withColumn("events", keyed_events(F.col("events")))
    known = distinct.join(advisories.select("eco", "name").distinct(), ["eco", "name"], "left_semi")
    hot = largest_keys((index if sizes is None else sizes).select("eco", F.col("pkg").alias("name")), ["eco", "name"])
    parts, held = salted(known, hot, ["eco", "name"], salts, None), salted(advisories, hot, ["eco", "name"], salts, ["id", "rel"])
    both = parts.join(held, ["eco", "name", "salt"]).where("release = '' or rel = '' or release = rel").where(is_affected(F.col("vkey"), F.col("events")))
    precise = (F.col("release") != "") & (F.col("rel") != "")
    basis = F.concat(F.lit("exact-range ("), "eco", F.when(precise, F.concat(F.lit(":"), F.col("rel"))).otherwise(""), F.lit(")"))
    rows = both.select(F.concat_ws("@", "name", "version").alias("component"), "purl", F.col("id").alias("cve_id"), F.coalesce("sev", F.lit("")).alias("severity"), basis.alias("basis"), F.coalesce("summary", F.lit("")).alias("summary"))
    best = rows.groupBy("component", "cve_id").agg(F.min(F.struct("basis", "severity", "summary", "purl")).alias("b"))
    return best.select("component", "b.purl", "cve_id", "b.severity", "b.basis", "b.summary", F.lit(False).alias("fork"), F.lit(False).alias("unbounded_below"))


def cpe_part(cpe: Column, field: int) -> Column:
    """Field 3 (vendor) or 4 (product) of a formatted platform name of six or more fields, else null."""
    parts = F.split(cpe, ":")
    return F.when(F.size(parts) >= 6, F.nullif(F.get(parts, field), F.lit("")))


def nvd_bounds(entries: DataFrame) -> DataFrame:
    """Distinct ranges of an advisory table: (vendor, product, id, cvss), each bound and the version key of each bound."""
    bare = lambda c: F.nullif(stripped(F.col(c)), F.lit(""))
    return entries.select("vendor", "product", "id", "cvss", *[bare(c).alias(c) for c in BOUNDS], *[version_key(bare(c)).alias(f"{c}_key") for c in BOUNDS]).distinct()


def in_bounds(v: Column) -> Column:
    """Whether a version key lies in the range of a row of ``nvd_bounds``: its one version, or between its ends."""
    low = (F.col("si").isNull() | (v >= F.col("si_key"))) & (F.col("se").isNull() | (v > F.col("se_key")))
    high = (F.col("ei").isNull() | (v <= F.col("ei_key"))) & (F.col("ee").isNull() | (v < F.col("ee_key")))
    return F.when(F.col("ver").isNotNull(), v == F.col("ver_key")).otherwise(low & high)


def nvd_join(components: DataFrame, entries: DataFrame, salts: int = 16) -> DataFrame:
    """Matches of components with a platform name against vendor and product ranges; columns as ``osv_join``.

    The ranges of the largest products lie in ``salts`` parts, each met by the versions of the product.
    """
    known = components.withColumn("vendor", cpe_part(F.col("cpe"), 3)).withColumn("product", cpe_part(F.col("cpe"), 4))
    wanted = known.where("vendor is not null and product is not null and coalesce(version, '') <> ''")
    distinct = wanted.groupBy("vendor", "product", F.coalesce("name", F.lit("")).alias("name"), "version").agg(F.min("purl").alias("purl"), F.max(F.coalesce("fork", F.lit(""))).alias("fork"))
    distinct = distinct.withColumn("vkey", version_key(F.col("version")))
    hot = largest_keys(entries, ["vendor", "product"])
    parts, held = salted(distinct, hot, ["vendor", "product"], salts, None), salted(nvd_bounds(entries), hot, ["vendor", "product"], salts, ["id", "ver", "si", "ei"])
    both = parts.join(held, ["vendor", "product", "salt"]).where(in_bounds(F.col("vkey")))
    open_below = F.col("ver").isNull() & F.col("si").isNull() & F.col("se").isNull()
    fork = F.col("fork") != ""
    note = F.when(fork & open_below, F.concat(F.lit(" ["), "fork", F.lit("; range lower-bound unknown -- verify]"))).otherwise("")
    basis = F.concat(F.lit("nvd-cpe-range ("), "vendor", F.lit(":"), "product", F.lit(")"), note)
    rows = both.select(F.concat_ws("@", "name", "version").alias("component"), "purl", F.col("id").alias("cve_id"), F.coalesce("cvss", F.lit("")).alias("severity"), basis.alias("basis"), F.lit("").alias("summary"), fork.alias("fork"), open_below.alias("unbounded_below"))
    best = rows.groupBy("component", "cve_id").agg(F.min(F.struct("basis", "severity", "summary", "purl", "fork", "unbounded_below")).alias("b"))
    return best.select("component", "b.purl", "cve_id", "b.severity", "b.basis", "b.summary", "b.fork", "b.unbounded_below")


def reconcile(*parts: DataFrame) -> DataFrame:
    """One row per component and advisory of several match tables.

    The richest vector wins (then the smallest), bases are listed once each in order, the smallest non-empty
    summary is kept; fork and open-range flags hold if any match has them.
    """
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    rank = F.struct(-cvss_rank(F.col("severity")), F.col("severity"))
    return every.groupBy("component", "cve_id").agg(
        F.min("purl").alias("purl"),
        F.min_by("severity", rank).alias("severity"),
        F.array_join(F.array_sort(F.collect_set("basis")), " + ").alias("basis"),
        F.coalesce(F.min(F.nullif(F.col("summary"), F.lit(""))), F.lit("")).alias("summary"),
        F.max("fork").alias("fork"),
        F.max("unbounded_below").alias("unbounded_below"),
    )


def annotate(matches: DataFrame, kev: DataFrame, epss: DataFrame) -> DataFrame:
    """Matches with ``kev`` (known exploited) and ``epss`` (-1 where unknown), score and gate."""
    exploited = kev.select(F.col("cve_id")).distinct().withColumn("kev", F.lit(True))
    likely = epss.groupBy("cve_id").agg(F.max("epss").alias("epss"))
    both = matches.join(exploited, "cve_id", "left").join(likely, "cve_id", "left")
    both = both.withColumn("kev", F.coalesce("kev", F.lit(False))).withColumn("epss", F.coalesce("epss", F.lit(-1.0)))
    gate = high_signal(F.col("severity"), F.col("score"), F.col("kev"), F.col("epss"), F.col("fork"), F.col("unbounded_below"))
    # Vectors repeat, so each is scored once; no vector, and any common one, falls into 16 parts.
    scores = matches.select("severity").distinct().withColumn("score", cvss_base_score(F.col("severity"))).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    parts = both.withColumn("salt", F.pmod(F.xxhash64("component", "cve_id"), F.lit(16)).cast("int"))
    return parts.join(scores, ["severity", "salt"]).drop("salt").withColumn("high", gate)


def worst_first(matches: DataFrame, n: int) -> DataFrame:
    """The ``n`` matches to look at first: exploited, then score, likelihood, id, component."""
    return matches.orderBy(F.desc("kev"), F.desc("score"), F.desc("epss"), "cve_id", "component").limit(n)


def outcome_counts(matches: DataFrame) -> DataFrame:
    high = F.count_if("high")
    return matches.agg(F.count("*").alias("total"), high.alias("high"), (F.count("*") - high).alias("hidden"))


def read_kev(spark, path: str) -> DataFrame:
    """``(cve_id)`` of a known-exploited list: JSON with ``vulnerabilities[].cveID`` or ``cves[]``."""
    df = spark.read.schema("vulnerabilities array<struct<cveID:string>>, cves array<string>").json(path, multiLine=True)
    ids = F.concat(F.coalesce(F.transform("vulnerabilities", lambda v: v["cveID"]), F.array().cast("array<string>")), F.coalesce("cves", F.array().cast("array<string>")))
    return df.select(F.explode(ids).alias("cve_id")).where(F.col("cve_id").startswith("CVE-")).distinct()


def read_epss(spark, path: str) -> DataFrame:
    """``(cve_id, epss)`` of a (gzipped) CSV with a comment line, an optional header and two or more columns."""
    df = spark.read.schema("cve_id string, epss double, rest string").csv(path, comment="#", header=False)
    return df.where(F.col("cve_id").startswith("CVE-") & F.col("epss").isNotNull()).select("cve_id", "epss")


_BOUND = "versionStartIncluding:string,versionStartExcluding:string,versionEndIncluding:string,versionEndExcluding:string"
_METRIC = "array<struct<cvssData:struct<vectorString:string>>>"
NVD_FEED = f"vulnerabilities array<struct<cve:struct<id:string,metrics:struct<cvssMetricV31:{_METRIC},cvssMetricV30:{_METRIC},cvssMetricV2:{_METRIC}>,configurations:array<struct<nodes:array<struct<cpeMatch:array<struct<vulnerable:boolean,criteria:string,{_BOUND}>>>>>>>>>"


def ingest_nvd(feed: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Rows (id, vendor, product, cvss, ver, si, se, ei, ee) of a feed read with ``NVD_FEED``.

    Vulnerable matches only; an exact version counts where the criteria name one and no bound is given.
    ``wanted(vendor, product)`` keeps the products of interest.
    """
    cve = feed.select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    vector = F.coalesce(*[F.try_element_at(F.col(f"metrics.{m}"), F.lit(1))["cvssData"]["vectorString"] for m in ("cvssMetricV31", "cvssMetricV30", "cvssMetricV2")])
    nodes = cve.select("id", vector.alias("cvss"), F.explode("configurations").alias("c")).select("id", "cvss", F.explode("c.nodes").alias("n"))
    hits = nodes.select("id", "cvss", F.explode("n.cpeMatch").alias("m")).where("m.vulnerable").select("id", "cvss", "m.*")
    parts = F.split("criteria", ":")
    free = F.coalesce("versionStartIncluding", "versionStartExcluding", "versionEndIncluding", "versionEndExcluding").isNull()
    rows = hits.where(F.size(parts) >= 6).select(
        "id", F.get(parts, 3).alias("vendor"), F.get(parts, 4).alias("product"), "cvss", F.when(free & ~F.get(parts, 5).isin("*", "-"), F.get(parts, 5)).alias("ver"),
        F.col("versionStartIncluding").alias("si"), F.col("versionStartExcluding").alias("se"), F.col("versionEndIncluding").alias("ei"), F.col("versionEndExcluding").alias("ee"),
    )
    return rows.join(wanted, ["vendor", "product"], "left_semi") if wanted is not None else rows


def write_index(index: DataFrame, path: str) -> None:
    """An advisory index as parquet in order of (eco, pkg), so that lookups prune by statistics."""
    index.repartitionByRange("eco", "pkg").sortWithinPartitions("eco", "pkg").write.mode("overwrite").parquet(path)


def lookup(index: DataFrame, eco: str, pkg: str) -> DataFrame:
    """The advisories of one package."""
    return index.where((F.col("eco") == eco) & (F.col("pkg") == pkg))


def read_nvd_index(spark, path: str) -> DataFrame:
    """Rows (id, vendor, product, cvss, ver, si, se, ei, ee) of an index file ``{source, vulns: [...]}``; '' for what is absent."""
    fields = ("id", "vendor", "product", "cvss", "ver", "si", "se", "ei", "ee")
    schema = f"source string, vulns array<struct<{','.join(f'{f}:string' for f in fields)}>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("vulns").alias("v")).select("v.*")
    return rows.select(*[F.coalesce(f, F.lit("")).alias(f) for f in fields]).where("id <> '' and vendor <> '' and product <> ''")


def read_feed_index(spark, path: str) -> DataFrame:
    """Rows (id, ranges, broad, mainline, sev, score, summary) of a kernel feed file ``{schema, source, generated, cves: [...]}``."""
    schema = "cves array<struct<id:string,ranges:array<array<string>>,broad:array<array<string>>,mainline:array<string>,sev:string,score:double,sum:string>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("cves").alias("c")).select("c.*")
    pair = lambda p: F.struct(F.get(p, 0).alias("lo"), F.get(p, 1).alias("hi"))
    pairs = lambda c: F.transform(F.coalesce(F.col(c), F.array().cast("array<array<string>>")), pair)
    main = F.when(F.size("mainline") == 2, pair(F.col("mainline")))
    return rows.select("id", pairs("ranges").alias("ranges"), pairs("broad").alias("broad"), main.alias("mainline"), "sev", F.coalesce("score", F.lit(-1.0)).alias("score"), F.col("sum").alias("summary"))


def products_of(components: DataFrame) -> DataFrame:
    """Distinct (vendor, product) of the platform names of components: what an advisory feed has to cover."""
    return components.select(cpe_part(F.col("cpe"), 3).alias("vendor"), cpe_part(F.col("cpe"), 4).alias("product")).where("vendor is not null and product is not null").distinct()
