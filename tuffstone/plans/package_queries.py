"""Queries of the package readers: a fixture tree for each format, the component table for the rest."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.operators import packages as pk
from tuffstone.runtime import table

TREE = [
    ("r/var/lib/dpkg/status", "Package: busybox\nStatus: install ok installed\nVersion: 1:1.30.1-6\nArchitecture: armhf\n\nPackage: gone\nStatus: deinstall ok config-files\nVersion: 1\n\nPackage: openssl\nStatus: install ok installed\nVersion: 1.1.1m\n"),
    ("r/usr/lib/opkg/status", "Package: dropbear\nVersion: 2019.78-2\nStatus: install user installed\nArchitecture: mips\n"),
    ("r/lib/apk/db/installed", "P:musl\nV:1.2.4-r2\nA:x86_64\nL:MIT\n\nP:zlib\nV:1.3-r0\n"),
    ("r/etc/os-release", 'NAME=x\nID="alpine"\nVERSION_ID=3.19\n'),
    ("r/usr/lib/os-release", "ID=debian\n"),
    ("q/usr/lib/os-release", "ID=debian\nVERSION_ID='12'\n"),
    ("p/etc/os-release", "ID=bad id\n"),
    ("a/package-lock.json", '{"lockfileVersion":3,"packages":{"":{"version":"1"},"node_modules/lodash":{"version":"4.17.19"},"node_modules/a/node_modules/@s/b":{"version":"2.0.0"}}}'),
    ("b/package-lock.json", '{"lockfileVersion":1,"dependencies":{"x":{"version":"1.0.0","dependencies":{"y":{"version":"0.1.0"}}}}}'),
    ("c/package-lock.json", "{broken"),
    ("a/requirements.txt", "flask==2.0.1\nrequests>=2\nnumpy == 1.2 ; python_version > '3'\n# x==1\n-r other.txt\n"),
    ("a/foo.dist-info/METADATA", "Metadata-Version: 2.1\nName: foo\nVersion: 1.0\n\nName: text\n"),
    ("a/go.mod", "module m\n\ngo 1.20\n\nrequire (\n\tgithub.com/x/y v1.2.3\n\tgithub.com/z/w v0.7.0 // indirect\n)\n\nrequire single.org/q v2.0.0\n"),
    ("a/Cargo.lock", 'version = 3\n\n[[package]]\nname = "serde"\nversion = "1.0.1"\n\n[[package]]\nname = "libc"\nversion = "0.2"\n'),
    ("a/composer.lock", '{"packages":[{"name":"m/n","version":"v1.2"}],"packages-dev":[{"name":"p/q","version":"3.0"}]}'),
    ("a/Gemfile.lock", "GEM\n  remote: https://rubygems.org/\n  specs:\n    rake (13.0.1)\n    rspec (3.1)\n      rspec-core (~> 3.1)\n\nPLATFORMS\n  ruby\n"),
]
ELF = b"\x7fELF\x01\x01"
BLOBS = [
    ("bin/busybox", ELF + b"\0\0BusyBox v1.30.1 (2020)\0OpenSSL 1.1.1l  24 Aug 2021\0OpenSSL 3.0.0 or later\0"),
    ("bin/hostapd", ELF + b"\0hostapd v0.8.x\0hostapd v2.10_ATBM_0.2\0hostapd v2.9_rtw_r24\0deflate 1.2.11 Copyright\0"),
    ("fw.bin", b"\0\0Linux version 3.10.14 (gcc)\0U-Boot 2019.04-dirty (Jan 01 2020)\0BusyBox v1.2.3 \0inflate 1.2.3 \0Linux version 4.4\0"),
    ("tool.bin", b"Compiled with U-Boot 2020.01 (x)\0"),
]
NAMES = ["lib/libuClibc-0.9.30.so", "lib/ld-uClibc-1.0.31.so", "lib/libc-2.31.so", "lib/ld-2.25.so", "lib/libc.so.6", "lib/libcrypt-2.31.so", "lib/libc-2.31.so.bak"]


def rpm_blob() -> bytes:
    texts = {1000: b"busybox\0", 1001: b"1.30.1\0", 1002: b"1.el8\0", 1022: b"x86_64\0"}
    store, index = b"", b""
    for tag, value in texts.items():
        index += struct.pack(">IIII", tag, 6, len(store), 1)
        store += value
    header = b"\x8e\xad\xe8\x01\0\0\0\0" + struct.pack(">II", len(texts), len(store)) + index + store
    return b"junk" + header + b"more" + header + b"\x8e\xad\xe8\x01\0\0\0\0\xff\xff\xff\xff"


def tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TREE, "path string, content string")


def blobs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(b)) for p, b in BLOBS], "path string, content binary")


def _of(read):
    return lambda spark, sf: read(tree(spark)).select("path", "name", "version", "purl", "source")


def banner_components(spark: SparkSession, sf: str) -> DataFrame:
    return pk.banner_components(blobs(spark), F.col("path") == "fw.bin").select("path", "name", "version", "cpe", "fork")


def kernel_uboot_banners(spark: SparkSession, sf: str) -> DataFrame:
    return pk.kernel_banners(blobs(spark)).unionByName(pk.uboot_banners(blobs(spark))).select("path", "name", "version")


def filename_versions(spark: SparkSession, sf: str) -> DataFrame:
    listed = spark.createDataFrame([(n,) for n in NAMES], "path string")
    origin = table(spark, sf, "components").select(F.col("origin_path").alias("path")).where("path is not null")
    return pk.filename_components(listed.union(origin)).select("path", "name", "version", "cpe")


def rpm_components(spark: SparkSession, sf: str) -> DataFrame:
    files = spark.createDataFrame([("var/lib/rpm/Packages", bytearray(rpm_blob()))], "path string, content binary")
    return pk.rpm_components(files).select("path", "name", "version", "arch", "purl")


def distro_resolve(spark: SparkSession, sf: str) -> DataFrame:
    return pk.os_release(tree(spark))


def monolithic_flag(spark: SparkSession, sf: str) -> DataFrame:
    return pk.is_monolithic(blobs(spark)).withColumn("which", F.lit("all")).unionByName(pk.is_monolithic(blobs(spark).where("path like '%.bin'")).withColumn("which", F.lit("raw")))


def component_dedup(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "components")
    return pk.first_components(c, (F.col("source") == "filename").cast("int"), "origin_path", "comp_id").select("name", "version", "purl", "comp_id", "source", "n_seen")


def newest_per_name(spark: SparkSession, sf: str) -> DataFrame:
    return pk.newest_per_name(table(spark, sf, "components"), 2).select("name", "comp_id", "rank")


QUERIES = {
    "dpkg_components": _of(pk.status_components),
    "apk_components": _of(lambda f: pk.apk_components(f, F.lit("alpine"))),
    "npm_lock": _of(pk.npm_components),
    "requirements_pins": _of(pk.requirements_components),
    "python_metadata": _of(pk.metadata_components),
    "go_mod": _of(pk.go_components),
    "cargo_lock": _of(pk.cargo_components),
    "composer_lock": _of(pk.composer_components),
    "gemfile_lock": _of(pk.gem_components),
} | {f.__name__: f for f in (banner_components, kernel_uboot_banners, filename_versions, rpm_components, distro_resolve, monolithic_flag, component_dedup, newest_per_name)}

_V = "select * from (values {}) t(path, name, version, purl, source)"
ORACLE = {
    "dpkg_components": _V.format("('r/var/lib/dpkg/status', 'busybox', '1:1.30.1-6', 'pkg:deb/busybox@1:1.30.1-6?arch=armhf', 'dpkg'), ('r/var/lib/dpkg/status', 'openssl', '1.1.1m', 'pkg:deb/openssl@1.1.1m', 'dpkg'), ('r/usr/lib/opkg/status', 'dropbear', '2019.78-2', 'pkg:opkg/dropbear@2019.78-2?arch=mips', 'opkg')"),
    "apk_components": _V.format("('r/lib/apk/db/installed', 'musl', '1.2.4-r2', 'pkg:apk/alpine/musl@1.2.4-r2?arch=x86_64', 'apk'), ('r/lib/apk/db/installed', 'zlib', '1.3-r0', 'pkg:apk/alpine/zlib@1.3-r0', 'apk')"),
    "npm_lock": _V.format("('a/package-lock.json', 'lodash', '4.17.19', 'pkg:npm/lodash@4.17.19', 'npm'), ('a/package-lock.json', '@s/b', '2.0.0', 'pkg:npm/@s/b@2.0.0', 'npm'), ('b/package-lock.json', 'x', '1.0.0', 'pkg:npm/x@1.0.0', 'npm'), ('b/package-lock.json', 'y', '0.1.0', 'pkg:npm/y@0.1.0', 'npm')"),
    "requirements_pins": _V.format("('a/requirements.txt', 'flask', '2.0.1', 'pkg:pypi/flask@2.0.1', 'pypi'), ('a/requirements.txt', 'numpy', '1.2', 'pkg:pypi/numpy@1.2', 'pypi')"),
    "python_metadata": _V.format("('a/foo.dist-info/METADATA', 'text', '1.0', 'pkg:pypi/text@1.0', 'pypi')"),
    "go_mod": _V.format("('a/go.mod', 'github.com/x/y', 'v1.2.3', 'pkg:golang/github.com/x/y@v1.2.3', 'golang'), ('a/go.mod', 'github.com/z/w', 'v0.7.0', 'pkg:golang/github.com/z/w@v0.7.0', 'golang'), ('a/go.mod', 'single.org/q', 'v2.0.0', 'pkg:golang/single.org/q@v2.0.0', 'golang')"),
    "cargo_lock": _V.format("('a/Cargo.lock', 'serde', '1.0.1', 'pkg:cargo/serde@1.0.1', 'cargo'), ('a/Cargo.lock', 'libc', '0.2', 'pkg:cargo/libc@0.2', 'cargo')"),
    "composer_lock": _V.format("('a/composer.lock', 'm/n', '1.2', 'pkg:composer/m/n@1.2', 'composer'), ('a/composer.lock', 'p/q', '3.0', 'pkg:composer/p/q@3.0', 'composer')"),
    "gemfile_lock": _V.format("('a/Gemfile.lock', 'rake', '13.0.1', 'pkg:gem/rake@13.0.1', 'gem'), ('a/Gemfile.lock', 'rspec', '3.1', 'pkg:gem/rspec@3.1', 'gem')"),
    "banner_components": """select * from (values ('bin/busybox', 'busybox', '1.30.1', 'cpe:2.3:a:busybox:busybox:1.30.1:*:*:*:*:*:*:*', ''), ('bin/busybox', 'openssl', '1.1.1l', 'cpe:2.3:a:openssl:openssl:1.1.1l:*:*:*:*:*:*:*', ''),
      ('bin/hostapd', 'hostapd', '0.8', 'cpe:2.3:a:w1.fi:hostapd:0.8:*:*:*:*:*:*:*', 'vendor fork'), ('bin/hostapd', 'hostapd', '2.10', 'cpe:2.3:a:w1.fi:hostapd:2.10:*:*:*:*:*:*:*', 'AltoBeam SDK'),
      ('bin/hostapd', 'hostapd', '2.9', 'cpe:2.3:a:w1.fi:hostapd:2.9:*:*:*:*:*:*:*', 'Realtek SDK'), ('bin/hostapd', 'zlib', '1.2.11', 'cpe:2.3:a:zlib:zlib:1.2.11:*:*:*:*:*:*:*', ''), ('fw.bin', 'busybox', '1.2.3', 'cpe:2.3:a:busybox:busybox:1.2.3:*:*:*:*:*:*:*', '')) t(path, name, version, cpe, fork)""",
    "kernel_uboot_banners": "select * from (values ('fw.bin', 'linux-kernel', '3.10.14'), ('fw.bin', 'u-boot', '2019.04')) t(path, name, version)",
    "filename_versions": """select *, 'cpe:2.3:a:' || case name when 'uclibc' then 'uclibc' else 'gnu' end || ':' || name || ':' || version || ':*:*:*:*:*:*:*' as cpe from (values ('lib/libuClibc-0.9.30.so', 'uclibc', '0.9.30'), ('lib/ld-uClibc-1.0.31.so', 'uclibc', '1.0.31'), ('lib/libc-2.31.so', 'glibc', '2.31'), ('lib/ld-2.25.so', 'glibc', '2.25')) t(path, name, version)
      union all select path, 'glibc', v, 'cpe:2.3:a:gnu:glibc:' || v || ':*:*:*:*:*:*:*' from (select origin_path as path, regexp_extract(origin_path, '(^|/)(libc|ld)-([0-9]+[.][0-9]+([.][0-9]+)?)[.]so$', 3) as v from components) where v <> ''""",
    "rpm_components": "select 'var/lib/rpm/Packages' as path, 'busybox' as name, '1.30.1-1.el8' as version, 'x86_64' as arch, 'pkg:rpm/busybox@1.30.1-1.el8?arch=x86_64' as purl",
    "distro_resolve": "select * from (values ('r', 'alpine', '3.19'), ('q', 'debian', '12'), ('p', '', '')) t(root, distro_id, version_id)",
    "monolithic_flag": "select * from (values (false, 'all'), (true, 'raw')) t(monolithic, which)",
    "component_dedup": "select name, version, purl, comp_id, source, n_seen from (select *, row_number() over (partition by name, version, purl order by source = 'filename' nulls first, origin_path nulls first, comp_id) as rn, count(*) over (partition by name, version, purl) as n_seen from components) where rn = 1",
    "newest_per_name": "select name, comp_id, rank from (select name, comp_id, row_number() over (partition by name order by scanned_at desc nulls last, comp_id) as rank from components) where rank <= 2",
}
