"""Software components from package databases, lock files, banners and file names."""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuffstone.functions.text import basename

COMPONENT = "path string, name string, version string, purl string, cpe string, arch string, license string, source string, confidence int, evidence string, fork string"
_FIELDS = [c.split()[0] for c in COMPONENT.split(", ")]


def purl(kind: str | Column, name: Column, version: Column, arch: Column | None = None) -> Column:
    """``pkg:<kind>/<name>@<version>?arch=<arch>``; empty version and arch are left out."""
    kind = F.lit(kind) if isinstance(kind, str) else kind
    at = F.when(F.coalesce(version, F.lit("")) != "", F.concat(F.lit("@"), version)).otherwise("")
    tail = F.when(F.coalesce(arch, F.lit("")) != "", F.concat(F.lit("?arch="), arch)).otherwise("") if arch is not None else F.lit("")
    return F.concat(F.lit("pkg:"), kind, F.lit("/"), name, at, tail)


def _field(block: Column, name: str) -> Column:
    return F.trim(F.regexp_extract(block, rf"(?m)^{name}:[ \t]*([^\r\n]*)", 1))


def _rows(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` shaped as ``COMPONENT``; columns that aren't given are ''."""
    kinds = dict(c.split() for c in COMPONENT.split(", "))
    return df.select(*[columns.get(c, F.lit("")).cast(kinds[c]).alias(c) for c in _FIELDS])


def status_components(files: DataFrame) -> DataFrame:
    """Installed packages of dpkg and opkg status files: any file named ``status``; opkg if its path says so."""
    named = files.where(basename(F.col("path")) == "status")
    block = named.select("path", F.explode(F.split("content", r"\n[ \t]*\r?\n")).alias("b"))
    got = block.select("path", *[_field(F.col("b"), f).alias(f.lower()) for f in ("Package", "Version", "Architecture", "Status")])
    good = got.where("package <> '' and status rlike '(^|\\\\s)installed$'")
    source = F.when(F.col("path").contains("opkg"), "opkg").otherwise("dpkg")
    kind = F.when(F.col("path").contains("opkg"), "opkg").otherwise("deb")
    installed = F.concat(source, F.lit(" status: "), F.col("status"))
    return _rows(good, path=F.col("path"), name=F.col("package"), version=F.col("version"), arch=F.col("architecture"), purl=purl(kind, F.col("package"), F.col("version"), F.col("architecture")), source=source, confidence=F.lit(95), evidence=installed)


def apk_components(files: DataFrame, distro: Column | None = None) -> DataFrame:
    """Packages of apk databases: any file named ``installed``; the namespace is the distribution, if known."""
    named = files.where(basename(F.col("path")) == "installed")
    block = named.select("*", F.explode(F.split("content", r"\n\r?\n")).alias("b"))
    got = block.select("*", *[_field(F.col("b"), f).alias(n) for f, n in (("P", "p"), ("V", "v"), ("A", "a"), ("L", "l"))]).where("p <> ''")
    space = F.concat(F.lit("apk"), F.when(F.coalesce(distro, F.lit("")) != "", F.concat(F.lit("/"), distro)).otherwise("")) if distro is not None else F.lit("apk")
    return _rows(got, path=F.col("path"), name=F.col("p"), version=F.col("v"), arch=F.col("a"), license=F.col("l"), purl=purl(space, F.col("p"), F.col("v"), F.col("a")), source=F.lit("apk"), confidence=F.lit(95), evidence=F.lit("apk installed db"))


def npm_components(files: DataFrame) -> DataFrame:
    """Packages of npm lock files, versions 1 to 3; nested dependencies of version 1 are followed."""

    def read(text: str) -> list[tuple]:
        root = json.loads(text)
        out = []
        for place, spec in (root.get("packages") or {}).items():
            if place and isinstance(spec, dict) and spec.get("version"):
                out.append((place.rpartition("node_modules/")[2], str(spec["version"])))
        stack = [] if out else [root.get("dependencies") or {}]
        while stack:
            for name, spec in stack.pop().items():
                if isinstance(spec, dict):
                    if spec.get("version"):
                        out.append((name, str(spec["version"])))
                    if isinstance(spec.get("dependencies"), dict):
                        stack.append(spec["dependencies"])
        return out

    return _manifest(files.where(basename(F.col("path")) == "package-lock.json"), read, "npm", "npm", 85)


def composer_components(files: DataFrame) -> DataFrame:
    def read(text: str) -> list[tuple]:
        root = json.loads(text)
        every = [*(root.get("packages") or []), *(root.get("packages-dev") or [])]
        return [(p["name"], re.sub("^v", "", str(p["version"]))) for p in every if isinstance(p, dict) and p.get("name") and p.get("version")]

    return _manifest(files.where(basename(F.col("path")) == "composer.lock"), read, "composer", "composer", 85)


def _manifest(files: DataFrame, read, source: str, kind: str, confidence: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    rows += [(path, n, v) for n, v in read(text)]
                except (ValueError, AttributeError, TypeError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["path", "name", "version"])

    got = files.where("content is not null").select("path", "content").mapInArrow(run, "path string, name string, version string")
    return _named(got, source, kind, confidence)


def _named(got: DataFrame, source: str, kind: str, confidence: int) -> DataFrame:
    name, version = F.col("name"), F.col("version")
    return _rows(got, path=F.col("path"), name=name, version=version, purl=purl(kind, name, version), source=F.lit(source), confidence=F.lit(confidence), evidence=F.lit(f"{source} manifest"))


def _matched(files: DataFrame, text: Column, pattern: str, source: str, kind: str, confidence: int) -> DataFrame:
    """Components of every match of ``pattern`` (name, version) in ``text``."""
    names, versions = F.regexp_extract_all(text, F.lit(pattern), 1), F.regexp_extract_all(text, F.lit(pattern), 2)
    got = files.select("path", F.explode(F.arrays_zip(names.alias("name"), versions.alias("version"))).alias("m")).select("path", "m.name", "m.version")
    return _named(got, source, kind, confidence)


def requirements_components(files: DataFrame) -> DataFrame:
    """Exact pins of Python requirement files; ranges, options and comments are none."""
    named = files.where(basename(F.col("path")) == "requirements.txt")
    return _matched(named, F.col("content"), r"(?m)^[ \t]*([A-Za-z0-9][A-Za-z0-9._-]*)[ \t]*(?:\[[^\]\n]*\])?[ \t]*==[ \t]*([^ \t\r\n;#,]+)[ \t]*(?:[;#][^\r\n]*)?\r?$", "pypi", "pypi", 80)


def metadata_components(files: DataFrame) -> DataFrame:
    """Name and version, the last of each, of Python package metadata."""
    named = files.where(basename(F.col("path")).isin("PKG-INFO", "METADATA"))
    last = lambda f: F.coalesce(F.try_element_at(F.regexp_extract_all("content", F.lit(rf"(?m)^{f}:[ \t]*([^\r\n]*)"), 1), F.lit(-1)), F.lit(""))
    got = named.select("path", F.trim(last("Name")).alias("name"), F.trim(last("Version")).alias("version")).where("name <> '' and version <> ''")
    return _named(got, "pypi", "pypi", 85)


def go_components(files: DataFrame) -> DataFrame:
    """Modules of ``require`` lines and blocks; the leading v of a version stays."""
    named = files.where(basename(F.col("path")) == "go.mod")
    blocks = F.array_join(F.regexp_extract_all("content", F.lit(r"(?s)(?:^|\n)require[ \t]*\((.*?)\)"), 1), "\n")
    single = F.array_join(F.regexp_extract_all("content", F.lit(r"(?m)^require[ \t]+([^(\r\n]+)"), 1), "\n")
    return _matched(named, F.concat_ws("\n", blocks, single), r"(?m)^[ \t]*([^ \t\r\n/][^ \t\r\n]*)[ \t]+(v[^ \t\r\n]+)", "golang", "golang", 85)


def cargo_components(files: DataFrame) -> DataFrame:
    named = files.where(basename(F.col("path")) == "Cargo.lock")
    part = named.select("path", F.explode(F.slice(F.split("content", r"\[\[package\]\]"), 2, 1 << 30)).alias("b"))
    field = lambda f: F.regexp_extract("b", rf'(?m)^{f}[ \t]*=[ \t]*"([^"\r\n]*)"', 1)
    return _named(part.select("path", field("name").alias("name"), field("version").alias("version")).where("name <> '' and version <> ''"), "cargo", "cargo", 85)


def gem_components(files: DataFrame) -> DataFrame:
    """Resolved gems of the GEM section; constraints are none."""
    named = files.where(basename(F.col("path")) == "Gemfile.lock")
    section = F.regexp_extract("content", r"(?s)(?:^|\n)GEM\r?\n(.*?)(?:\n\r?\n|$)", 1)
    return _matched(named, section, r"(?m)^[ \t]+([A-Za-z0-9._-]+) \(([^<>=~()\r\n]+)\)\r?$", "gem", "gem", 80)


#: Name, pattern of the banner, vendor, product, and whether the banner may be trusted outside executables.
BANNERS = (
    ("busybox", r"BusyBox v(\d+\.\d+\.\d+)", "busybox", "busybox", True),
    ("openssl", r"OpenSSL (\d+\.\d+\.\d+[a-z]?)(?:[-\s][A-Za-z][\w-]*)?\s+(?:\d{1,2} [A-Z][a-z]{2}|[A-Z][a-z]{2} +\d{1,2}) \d{4}", "openssl", "openssl", True),
    ("dropbear", r"(?:Dropbear v|Dropbear-|dropbear_)[ _v-]*(\d{4}\.\d+)", "dropbear_ssh_project", "dropbear_ssh", True),
    ("dnsmasq", r"Dnsmasq version (\d+\.\d+)", "thekelleys", "dnsmasq", True),
    ("curl", r"curl/(\d+\.\d+\.\d+)", "haxx", "libcurl", True),
    ("zlib", r"(?:in|de)flate (\d+\.\d+\.\d+)", "zlib", "zlib", False),
    ("lighttpd", r"lighttpd/(\d+\.\d+\.\d+)", "lighttpd", "lighttpd", True),
    ("wget", r"GNU Wget (\d+\.\d+(?:\.\d+)?)", "gnu", "wget", True),
    ("wpa_supplicant", r"wpa_supplicant v(\d+\.\d+(?:\.\d+)?)", "w1.fi", "wpa_supplicant", True),
    ("hostapd", r"hostapd v(\d+\.\d+(?:\.\d+)?)", "w1.fi", "hostapd", True),
    ("mosquitto", r"mosquitto version (\d+\.\d+\.\d+)", "eclipse", "mosquitto", True),
    ("glibc", r"GNU C Library.{0,40}?release version (\d+\.\d+(?:\.\d+)?)", "gnu", "glibc", True),
    ("musl", r"musl libc.{0,40}?Version (\d+\.\d+\.\d+)", "musl-libc", "musl", True),
    ("mbedtls", r"mbed TLS (\d+\.\d+\.\d+)", "arm", "mbed_tls", True),
    ("gnutls", r"GnuTLS (\d+\.\d+\.\d+)", "gnu", "gnutls", True),
    ("openvpn", r"OpenVPN (\d+\.\d+\.\d+)", "openvpn", "openvpn", True),
    ("lua", r"Lua (5\.\d+\.\d+)", "lua", "lua", True),
)


def fork_label(tail: Column) -> Column:
    """The maker of a changed copy, told by what follows the version in its banner; '' for none."""
    low = F.lower(tail)
    changed = tail.rlike(r"^(?:\.[A-Za-z]|[_-][A-Za-z])")
    return F.when(~changed, "").when(low.contains("rtw") | low.contains("realtek"), "Realtek SDK").when(low.contains("atbm"), "AltoBeam SDK").otherwise("vendor fork")


def banner_components(files: DataFrame, monolithic: Column | None = None) -> DataFrame:
    """Versions in banners of ``files(path, content binary)``, one for each (path, name, version).

    Executables are searched for every banner; other files only where ``monolithic`` holds, and then only
    for banners that can be trusted there. Bytes are read as ISO-8859-1, so offsets in them are kept.
    """
    text = F.decode("content", "ISO-8859-1")
    elf = text.startswith("\x7fELF")
    whole = F.coalesce(monolithic, F.lit(False)) if monolithic is not None else F.lit(False)
    found = []
    for name, pattern, vendor, product, safe in BANNERS:
        both = f"(?s){pattern}([^\\x00\\s]{{0,32}})"
        zipped = _groups(F.regexp_extract_all(text, F.lit(both), 0), both)
        as_rows = _banner_rows(zipped, name, vendor, product)
        found.append(F.when(elf | (whole if safe else F.lit(False)), as_rows).otherwise(F.array().cast("array<struct<name:string,version:string,tail:string,vendor:string,product:string>>")))
    # One pass tells the few files that hold any banner at all.
    any_banner = text.rlike("(?s)" + "|".join(f"(?:{b[1]})" for b in BANNERS))
    got = files.where(F.col("content").isNotNull() & any_banner).select("path", F.explode(F.flatten(F.array(*found))).alias("b")).select("path", "b.*")
    one = got.groupBy("path", "name", "version", "vendor", "product").agg(F.min(fork_label(F.col("tail"))).alias("fork"))
    cpe = F.concat_ws(":", F.lit("cpe:2.3:a"), "vendor", "product", "version", F.lit("*:*:*:*:*:*:*"))
    return _rows(one, path=F.col("path"), name=F.col("name"), version=F.col("version"), purl=purl("generic", F.col("name"), F.col("version")), cpe=cpe, source=F.lit("binary-version"), confidence=F.lit(70), evidence=F.lit("version banner"), fork=F.col("fork"))


def _groups(hits: Column, pattern: str) -> Column:
    """(version, tail) of texts that ``pattern`` matched."""
    return F.transform(hits, lambda m: F.struct(F.regexp_extract(m, pattern, 1).alias("version"), F.regexp_extract(m, pattern, 2).alias("tail")))


def _banner_rows(zipped: Column, name: str, vendor: str, product: str) -> Column:
    return F.transform(zipped, lambda m: F.struct(F.lit(name).alias("name"), m["version"].alias("version"), m["tail"].alias("tail"), F.lit(vendor).alias("vendor"), F.lit(product).alias("product")))


def kernel_banners(files: DataFrame) -> DataFrame:
    """The first ``Linux version`` of each file."""
    version = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"Linux version (\d+\.\d+(?:\.\d+)?)", 1)
    got = files.select("path", version.alias("version")).where("version <> ''").withColumn("name", F.lit("linux-kernel"))
    return _rows(got, path=F.col("path"), name=F.col("name"), version=F.col("version"), purl=purl("generic", F.col("name"), F.col("version")), source=F.lit("kernel-banner"), confidence=F.lit(80), evidence=F.lit("Linux version banner"))


def uboot_banners(files: DataFrame) -> DataFrame:
    """U-Boot versions followed by a build time, other than those a tool was compiled with."""
    version = F.regexp_extract(F.decode("content", "ISO-8859-1"), r"(?<!Compiled with )U-Boot (?:SPL )?(\d{4}\.\d{2}(?:\.\d+)?)[^\x00\n]{0,60}\(", 1)
    got = files.select("path", version.alias("version")).where("version <> ''").withColumn("name", F.lit("u-boot"))
    cpe = F.concat(F.lit("cpe:2.3:a:denx:u-boot:"), "version", F.lit(":*:*:*:*:*:*:*"))
    return _rows(got, path=F.col("path"), name=F.col("name"), version=F.col("version"), cpe=cpe, purl=purl("generic", F.col("name"), F.col("version")), source=F.lit("binary-version"), confidence=F.lit(80), evidence=F.lit("U-Boot version banner"))


def filename_components(paths: DataFrame) -> DataFrame:
    """C libraries told by the name of a file or by the target of a link."""
    base = basename(F.col("path"))
    # Patterns of versioned library names.
    small, big = F.regexp_extract(base, r"^(?:lib|ld-)uClibc-(\d+\.\d+(?:\.\d+){0,2})\.so$", 1), F.regexp_extract(base, r"^(?:libc|ld)-(\d+\.\d+(?:\.\d+)?)\.so$", 1)
    got = paths.select("path", F.when(small != "", "uclibc").when(big != "", "glibc").alias("name"), F.when(small != "", small).otherwise(big).alias("version")).where("name is not null")
    vendor = F.when(F.col("name") == "uclibc", "uclibc").otherwise("gnu")
    cpe = F.concat_ws(":", F.lit("cpe:2.3:a"), vendor, "name", "version", F.lit("*:*:*:*:*:*:*"))
    return _rows(got, path=F.col("path"), name=F.col("name"), version=F.col("version"), cpe=cpe, purl=purl("generic", F.col("name"), F.col("version")), source=F.lit("filename"), confidence=F.lit(80), evidence=F.concat(F.lit("versioned library filename: "), basename(F.col("path"))))


def read_rpm_headers(data: bytes) -> list[tuple[str, str, str]]:
    """(name, version-release, arch) of the package headers in a database, once each, in order."""
    out: dict[tuple, None] = {}
    for at in (m.start() for m in re.finditer(rb"\x8e\xad\xe8\x01", data)):
        if at + 16 > len(data):
            break
        count, size = struct.unpack_from(">II", data, at + 8)
        index, store = at + 16, at + 16 + 16 * count
        if not 0 < count <= 65536 or size > 1 << 28 or store + size > len(data):
            continue
        tags = {}
        for k in range(count):
            tag, kind, offset, _ = struct.unpack_from(">IIII", data, index + 16 * k)
            if tag in (1000, 1001, 1002, 1022) and kind in (6, 9) and offset < size:
                end = data.find(b"\0", store + offset, store + size)
                if end >= 0:
                    tags[tag] = data[store + offset : end].decode("utf-8", "replace")
        if tags.get(1000) and tags.get(1001):
            release = f"-{tags[1002]}" if tags.get(1002) else ""
            out[tags[1000], tags[1001] + release, tags.get(1022, "")] = None
    first: dict[tuple, tuple] = {}
    for name, version, arch in out:
        first.setdefault((name, version), (name, version, arch))
    return list(first.values())


def rpm_components(files: DataFrame) -> DataFrame:
    """Packages of rpm databases in ``files(path, content binary)``."""
    named = files.where(basename(F.col("path")).isin("Packages", "rpmdb.sqlite", "Packages.db") & F.decode("content", "ISO-8859-1").contains("\x8e\xad\xe8\x01"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *r) for p, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for r in read_rpm_headers(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(4)], ["path", "name", "version", "arch"])

    got = named.select("path", "content").mapInArrow(run, "path string, name string, version string, arch string")
    return _rows(got, path=F.col("path"), name=F.col("name"), version=F.col("version"), arch=F.col("arch"), purl=purl("rpm", F.col("name"), F.col("version"), F.col("arch")), source=F.lit("rpm"), confidence=F.lit(90), evidence=F.lit("rpm header"))


def os_release(files: DataFrame, unknown: DataFrame | None = None) -> DataFrame:
    """(root, distro_id, version_id) of each root with an os-release file.

    The last assignment counts; the file under etc goes before the one under usr/lib. A file that states no
    valid id makes the distribution of its root '' (unknown), which hides the other one; so do the links that make
    a root one of ``unknown(root)``.
    """
    pattern = r"^(?:(.*)/)?(etc|usr/lib)/os-release$"
    named = files.where(F.col("path").rlike(pattern))
    last = lambda k: F.trim(F.regexp_replace(F.coalesce(F.try_element_at(F.regexp_extract_all("content", F.lit(rf"(?m)^{k}=([^\r\n]*)"), 1), F.lit(-1)), F.lit("")), "[\"']", ""))
    got = named.select(F.regexp_extract("path", pattern, 1).alias("root"), (F.regexp_extract("path", pattern, 2) != "etc").alias("later"), last("ID").alias("id"), last("VERSION_ID").alias("version_id"))
    first = got.groupBy("root").agg(F.min_by(F.struct("id", "version_id"), F.struct("later", "id", "version_id")).alias("o"))
    valid = F.col("o.id").rlike("^[a-z0-9._-]+$")
    got = first.select("root", F.when(valid, F.col("o.id")).otherwise("").alias("distro_id"), F.when(valid, F.col("o.version_id")).otherwise("").alias("version_id"))
    if unknown is None:
        return got
    none = unknown.select("root", F.lit("").alias("distro_id"), F.lit("").alias("version_id"))
    return got.join(unknown, "root", "left_anti").unionByName(none)


def is_monolithic(files: DataFrame) -> DataFrame:
    """One row: whether no file of the tree is an executable."""
    return files.agg((~F.coalesce(F.max(F.substring(F.col("content"), 1, 4) == F.lit(bytearray(b"\x7fELF"))), F.lit(False))).alias("monolithic"))


def first_components(components: DataFrame, rank: Column, *order: str) -> DataFrame:
    """One component for each (name, version, purl): the first by ``rank`` and ``order``.

    Candidates are reduced by a combining aggregate, so a package found everywhere stays cheap.
    """
    rest = [c for c in components.columns if c not in ("name", "version", "purl")]
    kept = components.groupBy("name", "version", "purl").agg(F.min_by(F.struct(*rest), F.struct(rank, *[F.col(o) for o in order])).alias("c"), F.count("*").alias("n_seen"))
    return kept.select("name", "version", "purl", "c.*", "n_seen")


def newest_per_name(components: DataFrame, n: int = 1) -> DataFrame:
    """The ``n`` first rows of each name in order of scan time.

    Rows are ranked in 16 parts of a name first, so a name may hold any share of them.
    """
    order = [F.col("scanned_at").desc_nulls_last(), F.col("comp_id")]
    part = F.pmod(F.xxhash64("comp_id"), F.lit(16))
    first = components.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("name", "part").orderBy(*order))).where(F.col("rank") <= n)
    return first.drop("part").withColumn("rank", F.row_number().over(Window.partitionBy("name").orderBy(*order))).where(F.col("rank") <= n)
