"""Queries of the kernel checks, with their SQL."""

from __future__ import annotations

import gzip
import json
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.functions.versions import version_key_sql
from tuffstone.operators import kernel as k
from tuffstone.operators.kallsyms import DIGITS, kernel_symbols
from tuffstone.runtime import table

CONFIG = "#\n# Automatically generated file; DO NOT EDIT.\n# Linux/arm 5.4.0 Kernel Configuration\n#\nCONFIG_NETFILTER=y\nCONFIG_NF_TABLES=m\n# CONFIG_TIPC is not set\nCONFIG_STACKPROTECTOR_STRONG=y\n# CONFIG_RANDOMIZE_BASE is not set\nCONFIG_BPF_SYSCALL=y\nCONFIG_BPF_UNPRIV_DEFAULT_OFF=y\nCONFIG_LOCALVERSION=\"x\"\n"
DENSE = "\n".join([f"CONFIG_D{i}=y" for i in range(60)] + [f"# CONFIG_N{i} is not set" for i in range(20)] + ["CONFIG_HZ=100", "CONFIG_MMU=y", ""])
CONFIGS = [("boot/config", CONFIG), ("x/.config", "\n" + DENSE), ("x/buildroot", "\n" + DENSE.replace("CONFIG_HZ", "BR2_HZ").replace("CONFIG_MMU", "BR2_MMU")), ("x/short", "CONFIG_HZ=1\n")]


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONFIGS, "path string, content string")


def kconfig_options(spark: SparkSession, sf: str) -> DataFrame:
    return configs(spark).where("path = 'boot/config'").select(F.explode(k.enabled_options(F.col("content"))).alias("option"))


def kconfig_sniff(spark: SparkSession, sf: str) -> DataFrame:
    return configs(spark).select("path", k.looks_like_kconfig(F.col("content")).alias("is_config"))


def kconfig_summary(spark: SparkSession, sf: str) -> DataFrame:
    return k.kconfig_summary(configs(spark).where("path = 'boot/config'"))


def hardening(spark: SparkSession, sf: str) -> DataFrame:
    return k.hardening(configs(spark).where("path = 'boot/config'"))


def ikconfig(spark: SparkSession, sf: str) -> DataFrame:
    blob = b"\x01\x02IKCFG_STnot gzip" + b"IKCFG_ST" + gzip.compress(CONFIG.encode()) + b"IKCFG_ED\xff"
    files = spark.createDataFrame([("vmlinux", bytearray(blob)), ("other", bytearray(b"IKCFG_ST")), ("none", bytearray(b""))], "path string, content binary")
    return k.embedded_configs(files).select("path", F.length("content").alias("n_chars"))


def kernel_checklist(spark: SparkSession, sf: str) -> DataFrame:
    """All images, no configuration: what is in range."""
    return k.kernel_checklist(table(spark, sf, "images"))


def _facts(spark: SparkSession) -> DataFrame:
    config = spark.createDataFrame([(1, CONFIG)], "image_id bigint, content string")
    modules = spark.createDataFrame([(2, "lib/modules/5.4.0/kernel/net/mac80211.ko"), (2, "lib/modules/5.4.0/kernel/net/tipc.ko.xz"), (2, "opt/af_packet.ko")], "image_id bigint, path string")
    builtin = spark.createDataFrame([(3, "kernel/fs/overlayfs/overlay.ko\nkernel/net/unix/unix.ko\n")], "image_id bigint, content string")
    symbols = spark.createDataFrame([(2, "packet_rcv", True), (2, "key_alloc", True), (3, "nft_do_chain", False)], "image_id bigint, symbol string, complete boolean")
    strings = spark.createDataFrame([(3, "... io_uring ..."), (3, "overlayfs: x")], "image_id bigint, content string")
    parts = [k.facts_from_config(config), k.facts_from_modules(modules, spark), k.facts_from_builtin_list(builtin, spark), k.facts_from_symbols(symbols, spark), k.facts_from_strings(strings, spark)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def option_state(spark: SparkSession, sf: str) -> DataFrame:
    return k.option_states(_facts(spark)).where("option <> '*'").where("option in ('CONFIG_NETFILTER', 'CONFIG_MAC80211', 'CONFIG_TIPC', 'CONFIG_PACKET', 'CONFIG_USER_NS', 'CONFIG_OVERLAY_FS', 'CONFIG_IO_URING', 'CONFIG_NF_TABLES')")


def kernel_gating(spark: SparkSession, sf: str) -> DataFrame:
    images = spark.createDataFrame([(1, "5.10.0"), (2, "5.10.0"), (4, "5.10.0")], "image_id bigint, kernel_version string")
    return k.kernel_checklist(images, _facts(spark)).where("cve in ('CVE-2021-22555', 'CVE-2021-43267', 'CVE-2021-3490', 'CVE-2022-42719', 'CVE-2022-0185', 'CVE-2022-0847')").select("image_id", "cve", "state", "reason")


def kernel_feed(spark: SparkSession, sf: str) -> DataFrame:
    return k.kernel_feed_matches(table(spark, sf, "images"), k.latest_feed(table(spark, sf, "kernel_feed")))


def kernel_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Feed matches beyond the checklist, counted by version and basis."""
    return k.without_curated(kernel_feed(spark, sf)).groupBy("kernel_version", "basis").agg(F.count("*").alias("n"))


RECORD = {
    "cveMetadata": {"cveId": "CVE-1"},
    "containers": {"cna": {"title": "t", "affected": [{"versions": [
        {"version": "6.6.2", "lessThan": "6.6.9", "status": "affected", "versionType": "semver"}, {"version": "5.0", "lessThan": "5.4.7", "status": "affected", "versionType": "custom"},
        {"version": "0", "lessThan": "5.1", "status": "unaffected"}, {"version": "6.6.9", "lessThanOrEqual": "6.6.*", "status": "unaffected"}, {"version": "6.1.30", "lessThanOrEqual": "6.1.*", "status": "unaffected"}, {"version": "6.8", "lessThanOrEqual": "*", "status": "unaffected"}]}, {}],
        "metrics": [{"other": 1}, {"cvssV3_1": {"baseScore": 7.8, "baseSeverity": "HIGH"}}]}},
}


def cna_ingest(spark: SparkSession, sf: str) -> DataFrame:
    raw = spark.createDataFrame([(json.dumps(RECORD),), ('{"cveMetadata":{"cveId":"CVE-2"},"containers":{"cna":{"affected":[{"versions":[]}]}}}',)], "body string")
    records = raw.select(F.from_json("body", k.CNA).alias("r")).select("r.*")
    show = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("-", p["lo"], p["hi"])), ",")
    return k.ingest_cna(records).select("id", show("ranges").alias("ranges"), show("broad").alias("broad"), F.concat_ws("-", "mainline.lo", "mainline.hi").alias("mainline"), "sev", "score", "summary")


QUERIES = {f.__name__: f for f in (kconfig_options, kconfig_sniff, kconfig_summary, hardening, ikconfig, kernel_checklist, option_state, kernel_gating, kernel_feed, kernel_merge, cna_ingest)}

_CHECK = ", ".join(f"('{c}', '{impact}', nullif('{i}', ''), nullif('{f}', ''))" for c, i, f, impact, _, _ in k._table(k.CHECKLIST))
_FEED = f"""with f as (select * from (select *, upper(bare(id)) as cve, row_number() over (partition by upper(bare(id)) order by loaded_at desc nulls last, row_id desc) as rn from kernel_feed where snap_no = (select max(snap_no) from kernel_feed)) where rn = 1),
s as (select cve, 'a' as rank, unnest(ranges) as r from f union all select cve, 'b', unnest(broad) from f union all select cve, 'c', mainline from f where coalesce(bare(mainline.lo), '') <> '' and coalesce(bare(mainline.hi), '') <> ''),
sk as (select cve, rank, {version_key_sql("nullif(bare(r.lo), '')")} as lo, {version_key_sql("nullif(bare(r.hi), '')")} as hi from s where r is not null),
v as (select kernel_version, {version_key_sql("kernel_version")} as k from (select distinct kernel_version from images where coalesce(kernel_version, '') <> '')),
m as (select kernel_version, cve, min(rank) as rank from sk join v on (lo is null or k >= lo) and (hi is null or k < hi) and (rank <> 'c' or regexp_matches(kernel_version, '^[0-9]+[.][0-9]+([.]0)?$')) group by all),
b as (select kernel_version, cve, case when rank = 'a' then 'branch-exact' else 'broad-range' end as basis from m) """

ORACLE = {
    "kconfig_options": "select unnest(['CONFIG_NETFILTER', 'CONFIG_NF_TABLES', 'CONFIG_STACKPROTECTOR_STRONG', 'CONFIG_BPF_SYSCALL', 'CONFIG_BPF_UNPRIV_DEFAULT_OFF']) as option",
    "kconfig_sniff": "select * from (values ('boot/config', true), ('x/.config', true), ('x/buildroot', false), ('x/short', false)) t(path, is_config)",
    "kconfig_summary": "select 'boot/config' as path, 5 as n_enabled, false as stack_protector, false as kaslr, false as fortify, false as module_signing",
    "hardening": "select 'boot/config' as path, * from (values ('stack protector', 'on'), ('fortify source', 'absent'), ('kaslr', 'off'), ('strict kernel rwx', 'absent'), ('hardened usercopy', 'absent'), ('slab freelist hardened', 'absent'), ('unprivileged bpf off', 'on'), ('module signing', 'absent')) t(feature, state)",
    "ikconfig": f"select 'vmlinux' as path, {len(CONFIG)} as n_chars",
    "kernel_checklist": f"""with c(cve, impact, a, b) as (values {_CHECK}), ck as (select cve, impact, {version_key_sql("a")} as lo, {version_key_sql("b")} as hi from c),
      v as (select image_id, {version_key_sql("kernel_version")} as k from images where coalesce(kernel_version, '') <> '')
      select image_id, cve, impact, 'undetermined' as state, 'config unknown (no kconfig recovered)' as reason from v join ck on (lo is null or k >= lo) and (hi is null or k < hi)""",
    "option_state": """select * from (values (1, 'CONFIG_NETFILTER', 'on', 'kconfig'), (1, 'CONFIG_NF_TABLES', 'on', 'kconfig'), (2, 'CONFIG_MAC80211', 'on', 'ko-file'), (2, 'CONFIG_PACKET', 'on', 'kallsyms'), (2, 'CONFIG_TIPC', 'off', 'kallsyms+modules'),
      (2, 'CONFIG_USER_NS', 'off', 'kallsyms'), (2, 'CONFIG_NETFILTER', 'off', 'kallsyms+modules'), (2, 'CONFIG_NF_TABLES', 'off', 'kallsyms+modules'), (2, 'CONFIG_IO_URING', 'off', 'kallsyms'), (2, 'CONFIG_OVERLAY_FS', 'off', 'kallsyms+modules'),
      (3, 'CONFIG_OVERLAY_FS', 'on', 'modules.builtin'), (3, 'CONFIG_IO_URING', 'on', 'string'), (3, 'CONFIG_NF_TABLES', 'on', 'kallsyms')) t(image_id, option, state, evidence)""",
    "kernel_gating": """select * from (values (1, 'CVE-2021-22555', 'applicable', 'subsystem present'), (1, 'CVE-2021-43267', 'ruled_out', 'requires CONFIG_TIPC (not enabled, kconfig)'), (1, 'CVE-2021-3490', 'ruled_out', 'mitigated by CONFIG_BPF_UNPRIV_DEFAULT_OFF'),
      (1, 'CVE-2022-42719', 'ruled_out', 'requires CONFIG_MAC80211 (not enabled, kconfig)'), (1, 'CVE-2022-0185', 'ruled_out', 'requires CONFIG_USER_NS (not enabled, kconfig)'), (1, 'CVE-2022-0847', 'applicable', 'subsystem present'),
      (2, 'CVE-2021-22555', 'ruled_out', 'requires CONFIG_NETFILTER (not enabled, kallsyms+modules)'), (2, 'CVE-2021-43267', 'ruled_out', 'requires CONFIG_TIPC (not enabled, kallsyms+modules)'), (2, 'CVE-2021-3490', 'ruled_out', 'requires CONFIG_BPF_SYSCALL (not enabled, kallsyms)'),
      (2, 'CVE-2022-42719', 'applicable', 'subsystem present'), (2, 'CVE-2022-0185', 'ruled_out', 'requires CONFIG_USER_NS (not enabled, kallsyms)'), (2, 'CVE-2022-0847', 'applicable', 'subsystem present'),
      (4, 'CVE-2021-22555', 'undetermined', 'config unknown (no kconfig recovered)'), (4, 'CVE-2021-43267', 'undetermined', 'config unknown (no kconfig recovered)'), (4, 'CVE-2021-3490', 'undetermined', 'config unknown (no kconfig recovered)'),
      (4, 'CVE-2022-42719', 'undetermined', 'config unknown (no kconfig recovered)'), (4, 'CVE-2022-0185', 'undetermined', 'config unknown (no kconfig recovered)'), (4, 'CVE-2022-0847', 'undetermined', 'config unknown (no kconfig recovered)')) t(image_id, cve, state, reason)""",
    "kernel_feed": _FEED + "select kernel_version, cve, basis from b",
    "kernel_merge": _FEED + "select kernel_version, basis, count(*) as n from b group by all",
    "cna_ingest": "select 'CVE-1' as id, '6.6.2-6.6.9,6.1-6.1.30' as ranges, '5.0-5.4.7' as broad, '5.1-6.8' as mainline, 'HIGH' as sev, 7.8::double as score, 't' as summary",
}


def symbol_blob(names: list[str], order: str = "<", width: int = 4) -> bytes:
    """A kernel image with a symbol table of ``names``, each compressed by one or two tokens."""
    tokens = [bytes([c]) if 33 <= c < 127 else f"t{c}".encode() for c in range(256)]
    tokens[200], tokens[201] = b"init_", b"sys_"
    body, marks = b"", []
    for i, n in enumerate(names):
        if i % 256 == 0:
            marks.append(len(body))
        raw = ("T" + n).encode().replace(b"init_", b"\xc8").replace(b"sys_", b"\xc9")
        body += (bytes([len(raw)]) if len(raw) < 128 else bytes([len(raw) & 0x7F | 0x80, len(raw) >> 7])) + raw
    align = lambda b: b + b"\0" * (-len(b) % 8)
    table, offsets = b"", []
    for t in tokens:
        offsets.append(len(table))
        table += t + b"\0"
    head = align(b"\x01" * 40 + b"Linux version 5.4.0 (x)\0")
    return head + struct.pack(f"{order}I", len(names)) + (b"\0" * 4 if width == 8 else b"") + align(body) + b"".join(struct.pack(f"{order}{'I' if width == 4 else 'Q'}", m) for m in marks) + table + b"\0" * (len(table) % 2) + struct.pack(f"{order}256H", *offsets) + b"\xff" * 64


SYMBOLS = [f"sys_call_{i}" for i in range(300)] + ["init_module", "nft_do_chain", "x" * 200]


def kallsyms(spark: SparkSession, sf: str) -> DataFrame:
    blobs = [("le32", symbol_blob(SYMBOLS)), ("be32", symbol_blob(SYMBOLS, ">")), ("le64", symbol_blob(SYMBOLS, "<", 8)), ("cut", symbol_blob(SYMBOLS)[:2000]), ("none", b"Linux version 4\0" + DIGITS * 3)]
    got = kernel_symbols(spark.createDataFrame([(p, bytearray(b)) for p, b in blobs], "path string, content binary"))
    return got.groupBy("path", "complete").agg(F.count("*").alias("n"), F.max("symbol").alias("last"), F.min("symbol").alias("first"))


QUERIES["kallsyms"] = kallsyms
ORACLE["kallsyms"] = "select unnest(['le32', 'be32', 'le64']) as path, true as complete, 303 as n, repeat('x', 200) as last, 'init_module' as first"
