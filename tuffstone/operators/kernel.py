"""Kernel checks: configuration evidence, three-valued gating, version ranges of a checklist and of a feed."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tuffstone.functions.text import stripped
from tuffstone.functions.versions import version_key

# The checklist. Advisory, first affected and first fixed version (- for an open end), impact,
# required options and mitigations (- for none).
CHECKLIST = """
CVE-2016-5195 2.6.22 4.8.3 LPE - -
CVE-2022-0847 5.8 5.16.11 LPE - -
CVE-2021-33909 - 5.13.4 LPE - -
CVE-2019-13272 - 5.1.17 LPE - -
CVE-2018-14634 - 4.18.9 LPE - -
CVE-2023-3269 6.1 6.4.1 LPE - -
CVE-2016-0728 - 4.4.1 LPE CONFIG_KEYS -
CVE-2014-3153 - 3.15 LPE - -
CVE-2017-5123 - 4.13.5 LPE - -
CVE-2021-3347 - 5.11 LPE - -
CVE-2013-2094 - 3.8.9 LPE CONFIG_PERF_EVENTS -
CVE-2017-1000112 - 4.13 LPE - -
CVE-2021-22555 2.6.19 5.12 LPE CONFIG_NETFILTER -
CVE-2023-32233 - 6.4 LPE CONFIG_NF_TABLES -
CVE-2022-32250 - 5.18.1 LPE CONFIG_NF_TABLES -
CVE-2022-34918 - 5.18.9 LPE CONFIG_NF_TABLES -
CVE-2022-2586 - 5.19 LPE CONFIG_NF_TABLES -
CVE-2023-35001 - 6.4.3 LPE CONFIG_NF_TABLES -
CVE-2024-1086 - 6.8 LPE CONFIG_NF_TABLES -
CVE-2022-1015 5.5 5.17 LPE CONFIG_NF_TABLES -
CVE-2024-1085 - 6.8 LPE CONFIG_NF_TABLES -
CVE-2023-0179 - 6.2 LPE CONFIG_NF_TABLES -
CVE-2021-3490 5.7 5.13 LPE CONFIG_BPF_SYSCALL CONFIG_BPF_UNPRIV_DEFAULT_OFF
CVE-2017-16995 4.4 4.14.8 LPE CONFIG_BPF_SYSCALL CONFIG_BPF_UNPRIV_DEFAULT_OFF
CVE-2020-8835 5.5 5.6.1 LPE CONFIG_BPF_SYSCALL CONFIG_BPF_UNPRIV_DEFAULT_OFF
CVE-2022-2588 - 5.19 LPE CONFIG_NET_CLS_ROUTE4 -
CVE-2023-1829 - 6.3 LPE CONFIG_NET_CLS_TCINDEX -
CVE-2022-29581 - 5.17 LPE CONFIG_NET_CLS_U32 -
CVE-2021-41073 5.11 5.14.6 LPE CONFIG_IO_URING -
CVE-2022-1786 5.11 5.18 LPE CONFIG_IO_URING -
CVE-2023-2598 6.3 6.4 LPE CONFIG_IO_URING -
CVE-2022-2602 - 6.0 LPE CONFIG_IO_URING,CONFIG_UNIX -
CVE-2016-8655 - 4.9 LPE CONFIG_PACKET -
CVE-2017-7308 - 4.10.6 LPE CONFIG_PACKET -
CVE-2020-14386 - 5.9 LPE CONFIG_PACKET -
CVE-2021-22600 - 5.16 LPE CONFIG_PACKET -
CVE-2022-0185 - 5.16.2 LPE CONFIG_USER_NS -
CVE-2021-4154 - 5.16 LPE CONFIG_CGROUPS -
CVE-2023-0386 - 6.2 LPE CONFIG_OVERLAY_FS,CONFIG_FUSE_FS -
CVE-2015-1328 - 4.1 LPE CONFIG_OVERLAY_FS -
CVE-2019-2215 - 5.0 LPE CONFIG_ANDROID_BINDER_IPC -
CVE-2017-6074 - 4.9.11 LPE CONFIG_IP_DCCP -
CVE-2015-3636 - 4.1 LPE - -
CVE-2021-26708 - 5.10.13 LPE CONFIG_VSOCKETS -
CVE-2017-11176 - 4.11.9 LPE CONFIG_POSIX_MQUEUE -
CVE-2022-27666 - 5.17 LPE CONFIG_INET_ESP -
CVE-2022-2639 - 6.0 LPE CONFIG_OPENVSWITCH -
CVE-2021-43267 5.10 5.15.1 RCE CONFIG_TIPC -
CVE-2022-0435 - 5.17 RCE CONFIG_TIPC -
CVE-2019-11477 - 4.19.42 DoS - -
CVE-2022-42719 5.1 6.1 RCE CONFIG_MAC80211 -
CVE-2022-42720 5.1 6.1 RCE CONFIG_MAC80211 -
CVE-2020-12351 4.8 5.10 RCE CONFIG_BT -
CVE-2021-27365 - 5.11.4 LPE CONFIG_SCSI_ISCSI_ATTRS -
CVE-2022-25636 - 5.16.11 LPE CONFIG_NETFILTER -
"""
# What shows that an option is on: symbols, modules, strings; whether it can only be built in.
KNOWLEDGE = """
CONFIG_NETFILTER nf_hook_slow,nf_register_net_hook,nf_register_hook x_tables,nf_conntrack - any
CONFIG_NF_TABLES nft_do_chain,nft_register_obj,nf_tables_api_init nf_tables - any
CONFIG_BPF_SYSCALL bpf_prog_load,bpf_check,__sys_bpf - - builtin
CONFIG_BPF_UNPRIV_DEFAULT_OFF - - - any
CONFIG_NET_CLS_ROUTE4 route4_classify cls_route - any
CONFIG_NET_CLS_TCINDEX tcindex_classify cls_tcindex - any
CONFIG_NET_CLS_U32 u32_classify cls_u32 - any
CONFIG_IO_URING io_submit_sqes,io_uring_create,__do_sys_io_uring_setup - io_uring builtin
CONFIG_UNIX unix_create,unix_stream_connect,unix_dgram_recvmsg unix - any
CONFIG_PACKET packet_rcv,tpacket_rcv,packet_create af_packet - any
CONFIG_USER_NS create_user_ns,free_user_ns - - builtin
CONFIG_CGROUPS cgroup_attach_task,cgroup_mkdir,cgroup_procs_write - - builtin
CONFIG_OVERLAY_FS ovl_fill_super,ovl_lookup overlay overlayfs any
CONFIG_FUSE_FS fuse_fill_super,fuse_dev_read,fuse_request_alloc fuse - any
CONFIG_ANDROID_BINDER_IPC binder_ioctl,binder_thread_read binder,binder_linux - any
CONFIG_IP_DCCP dccp_v4_init_sock,dccp_rcv_state_process dccp,dccp_ipv4,dccp_ipv6 - any
CONFIG_VSOCKETS __vsock_create,vsock_bind vsock - any
CONFIG_POSIX_MQUEUE mqueue_get_inode,mqueue_evict_inode - - builtin
CONFIG_INET_ESP esp_init_state,esp6_init_state,esp_output esp4,esp6 - any
CONFIG_OPENVSWITCH ovs_dp_process_packet,ovs_vport_receive openvswitch - any
CONFIG_TIPC tipc_sk_create,tipc_rcv tipc - any
CONFIG_MAC80211 ieee80211_register_hw,ieee80211_rx_list mac80211 - any
CONFIG_BT hci_register_dev,l2cap_recv_frame bluetooth - any
CONFIG_QAT adf_dev_init,qat_algs_register intel_qat,qat_c62x,qat_4xxx,qat_dh895xcc - any
CONFIG_SCSI_ISCSI_ATTRS iscsi_create_session,iscsi_add_session scsi_transport_iscsi - any
CONFIG_KEYS key_alloc,keyring_alloc - - builtin
CONFIG_PERF_EVENTS perf_event_alloc,perf_event_create_kernel_counter - - builtin
"""
# Hardening features and the options that stand for them.
HARDENING = (
    ("stack protector", ("STACKPROTECTOR_STRONG", "STACKPROTECTOR", "CC_STACKPROTECTOR_STRONG", "CC_STACKPROTECTOR_REGULAR", "CC_STACKPROTECTOR")),
    ("fortify source", ("FORTIFY_SOURCE",)),
    ("kaslr", ("RANDOMIZE_BASE",)),
    ("strict kernel rwx", ("STRICT_KERNEL_RWX", "DEBUG_RODATA")),
    ("hardened usercopy", ("HARDENED_USERCOPY",)),
    ("slab freelist hardened", ("SLAB_FREELIST_HARDENED",)),
    ("unprivileged bpf off", ("BPF_UNPRIV_DEFAULT_OFF",)),
    ("module signing", ("MODULE_SIG",)),
)
# Options only a kernel configuration has; trust in each kind of evidence.
KERNEL_MARKS = ("CONFIG_HZ", "CONFIG_MMU", "CONFIG_ARCH_", "CONFIG_INIT_ENV", "CONFIG_CC_IS_", "CONFIG_HAVE_ARCH_", "CONFIG_PAGE_OFFSET", "CONFIG_KALLSYMS")
TRUST = {"kconfig": 5, "modules.builtin": 4, "ko-file": 3, "kallsyms": 2, "string": 1}


def _table(text: str) -> list[list[str]]:
    return [["" if f == "-" else f for f in line.split()] for line in text.strip().splitlines()]


def _options(names: str) -> list[str]:
    return [n for n in names.split(",") if n]


def checklist_table(spark: SparkSession) -> DataFrame:
    """(cve, introduced, fixed, impact, required, mitigations): the fixed checklist."""
    rows = [(c, i, f, impact, _options(req), _options(mit)) for c, i, f, impact, req, mit in _table(CHECKLIST)]
    return spark.createDataFrame(rows, "cve string, introduced string, fixed string, impact string, required array<string>, mitigations array<string>")


def knowledge_table(spark: SparkSession) -> DataFrame:
    """(option, kind, token, builtin_only): what shows that an option is on; kind is symbol, module or text."""
    rows = []
    for name, symbols, modules, strings, built in _table(KNOWLEDGE):
        for kind, tokens in (("symbol", symbols), ("module", modules), ("text", strings)):
            rows += [(name, kind, t.replace("-", "_") if kind == "module" else t, built == "builtin") for t in tokens.split(",") if t]
    return spark.createDataFrame(rows, "option string, kind string, token string, builtin_only boolean")


BUILTIN_ONLY = tuple(r[0] for r in _table(KNOWLEDGE) if r[4] == "builtin")
GATING_OPTIONS = tuple(r[0] for r in _table(KNOWLEDGE) if r[1] or r[2] or r[3])


# -- configuration text ----------------------------------------------------------------------------------------


def enabled_options(config: Column) -> Column:
    """Options set to y or m in a kernel configuration."""
    return F.array_distinct(F.regexp_extract_all(config, F.lit(r"(?m)^(CONFIG_[^=\r\n]*)=[ym]"), 1))


def looks_like_kconfig(text: Column) -> Column:
    """A generated header in the first 8 KiB, or many settings, many unset lines and two marks of a kernel."""
    head = F.substring(text, 1, 8192)
    titled = head.contains("Automatically generated file") & head.contains("Kernel Configuration")
    hits = sum((text.contains(m).cast("int") for m in KERNEL_MARKS), F.lit(0))
    dense = (F.size(F.regexp_extract_all(text, F.lit("(\nCONFIG_)"), 1)) > 40) & (F.size(F.regexp_extract_all(text, F.lit("(\n# CONFIG_)"), 1)) > 10)
    return (F.length(text) >= 128) & (titled | (dense & (hits >= 2)))


def kconfig_summary(configs: DataFrame) -> DataFrame:
    """(path, n_enabled, stack_protector, kaslr, fortify, module_signing) of ``configs(path, content)``."""
    on = enabled_options(F.col("content"))
    flags = {"stack_protector": "STACKPROTECTOR", "kaslr": "RANDOMIZE_BASE", "fortify": "FORTIFY_SOURCE", "module_signing": "MODULE_SIG"}
    return configs.select("path", F.size(on).alias("n_enabled"), *[F.array_contains(on, f"CONFIG_{o}").alias(n) for n, o in flags.items()])


def hardening(configs: DataFrame) -> DataFrame:
    """(path, feature, state): on, off or absent for each feature; any alias that is on wins."""
    text = F.concat(F.lit("\n"), F.col("content"))
    items = []
    for feature, aliases in HARDENING:
        names = "|".join(f"CONFIG_{a}" for a in aliases)
        state = F.when(text.rlike(f"\n(?:{names})=[ym]"), "on").when(text.rlike(f"\n# (?:{names}) is not set"), "off").otherwise("absent")
        items.append(F.struct(F.lit(feature).alias("feature"), state.alias("state")))
    return configs.where("content <> ''").select("path", F.explode(F.array(*items)).alias("h")).select("path", "h.*")


def read_ikconfig(data: bytes) -> str | None:
    """The configuration embedded in a kernel image between its start mark and a gzip stream; None for none."""
    at, view = data.find(b"IKCFG_ST"), memoryview(data)
    while at >= 0:
        try:
            text = zlib.decompressobj(31).decompress(view[at + 8 :])
            if text:
                return text.decode("utf-8", "replace")
        except zlib.error:
            pass
        at = data.find(b"IKCFG_ST", at + 1)
    return None


def embedded_configs(files: DataFrame) -> DataFrame:
    """(path, content) of the configurations found inside ``files(path, content binary)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [read_ikconfig(c) for c in batch.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("path"), pa.array(texts, pa.string())], ["path", "content"])

    marked = files.where(F.decode("content", "ISO-8859-1").contains("IKCFG_ST"))
    return marked.select("path", "content").mapInArrow(run, "path string, content string").where("content is not null")


# -- facts and views -------------------------------------------------------------------------------------------

FACT = "image_id bigint, option string, fact string, source string"


def facts_from_config(configs: DataFrame) -> DataFrame:
    """Facts of complete configurations ``(image_id, content)``: every option that is on, and that no other is."""
    on = configs.select("image_id", F.explode(enabled_options(F.col("content"))).alias("option"), F.lit("on").alias("fact"), F.lit("kconfig").alias("source"))
    return on.unionByName(configs.select("image_id", F.lit("*").alias("option"), F.lit("authoritative").alias("fact"), F.lit("kconfig").alias("source")))


def facts_from_modules(paths: DataFrame, spark: SparkSession) -> DataFrame:
    """Facts of module files ``(image_id, path)`` under lib/modules; compressed modules only show that there are modules."""
    tree = paths.where(F.col("path").contains("lib/modules/"))
    seen = tree.select("image_id", F.lit("*").alias("option"), F.lit("modules_seen").alias("fact"), F.lit("ko-file").alias("source")).distinct()
    module = F.translate(F.regexp_extract("path", r"([^/]+)\.ko$", 1), "-", "_").alias("token")
    return seen.unionByName(_known(tree.select("image_id", module), "module", "ko-file", spark))


def facts_from_builtin_list(lists: DataFrame, spark: SparkSession) -> DataFrame:
    """Facts of ``modules.builtin`` files ``(image_id, content)``."""
    line = lists.select("image_id", F.explode(F.split("content", "\r?\n")).alias("line"))
    module = F.translate(F.regexp_extract("line", r"([^/]+)\.ko$", 1), "-", "_").alias("token")
    seen = lists.select("image_id", F.lit("*").alias("option"), F.lit("modules_seen").alias("fact"), F.lit("modules.builtin").alias("source")).distinct()
    return seen.unionByName(_known(line.select("image_id", module), "module", "modules.builtin", spark))


def _known(tokens: DataFrame, kind: str, source: str, spark: SparkSession) -> DataFrame:
    table = knowledge_table(spark).where(F.col("kind") == kind).select("token", "option")
    hit = tokens.join(F.broadcast(table), "token").select("image_id", "option").distinct()
    facts = F.array(F.lit("on"), F.lit("present")) if kind == "module" else F.array(F.lit("on"))
    return hit.select("image_id", "option", F.explode(facts).alias("fact"), F.lit(source).alias("source"))


def facts_from_symbols(symbols: DataFrame, spark: SparkSession) -> DataFrame:
    """Facts of kernel symbols ``(image_id, symbol, complete)``: found ones are on; if the table is complete, options without any are not built in."""
    on = _known(symbols.select("image_id", F.col("symbol").alias("token")), "symbol", "kallsyms", spark)
    whole = symbols.where("complete").select("image_id").distinct()
    options = [F.lit(o) for o in sorted({r[0] for r in _table(KNOWLEDGE) if r[1]})]
    every = whole.select("image_id", F.explode(F.array(*options)).alias("option"))
    missing = every.join(on, ["image_id", "option"], "left_anti").select("image_id", "option", F.lit("not_builtin").alias("fact"), F.lit("kallsyms").alias("source"))
    return on.unionByName(missing)


def facts_from_strings(texts: DataFrame, spark: SparkSession) -> DataFrame:
    """Facts of kernel texts ``(image_id, content)``: a telling string puts its option on, with least trust."""
    rows = [(r[0], s) for r in _table(KNOWLEDGE) for s in r[3].split(",") if s]
    hits = [F.when(F.col("content").contains(s), F.lit(o)) for o, s in rows]
    got = texts.select("image_id", F.explode(F.array_compact(F.array(*hits))).alias("option"))
    return got.distinct().select("image_id", "option", F.lit("on").alias("fact"), F.lit("string").alias("source"))


def option_states(facts: DataFrame) -> DataFrame:
    """(image_id, option, state, evidence) of facts: on, off or unknown, with the most trusted evidence.

    Rows with option '*' tell what holds for every other option of the image.
    """
    trust = F.create_map(*[x for s, t in TRUST.items() for x in (F.lit(s), F.lit(t))])
    has = lambda f: F.max(F.when(F.col("fact") == f, 1).otherwise(0)) == 1
    per_option = facts.groupBy("image_id", "option").agg(
        has("on").alias("on"), has("present").alias("present"), has("not_builtin").alias("not_builtin"), has("authoritative").alias("authoritative"), has("modules_seen").alias("modules_seen"),
        F.max_by(F.when(F.col("fact") == "on", F.col("source")), F.when(F.col("fact") == "on", F.struct(trust[F.col("source")].alias("t"), F.col("source")))).alias("best"),
    )
    whole = per_option.groupBy("image_id").agg(F.max("authoritative").alias("a"), F.max("modules_seen").alias("m"))
    both = per_option.join(whole, "image_id")
    builtin = F.col("option").isin(*BUILTIN_ONLY)
    off_by = F.when(F.col("a"), "kconfig").when(F.col("not_builtin") & builtin, "kallsyms").when(F.col("not_builtin") & F.col("m") & ~F.col("present"), "kallsyms+modules")
    state = F.when(F.col("on"), "on").when(off_by.isNotNull(), "off").otherwise("unknown")
    return both.select("image_id", "option", state.alias("state"), F.when(F.col("on"), F.col("best")).otherwise(off_by).alias("evidence"))


def in_range(vkey: Column, low: Column, high: Column) -> Column:
    """Half-open range of version keys; a missing end is open."""
    return (low.isNull() | (vkey >= low)) & (high.isNull() | (vkey < high))


def _key(c: Column) -> Column:
    return version_key(F.nullif(stripped(c), F.lit("")))


def kernel_checklist(images: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """(image_id, cve, impact, state, reason) of every check in the version range of an image's kernel.

    A required option that is off, or a mitigation that is on, rules a check out; else an unknown required
    option leaves it undetermined; else it applies. Without facts about an image all its checks are
    undetermined. Kernel versions are checked once each against the 55 fixed rows, then images are joined.
    """
    spark = images.sparkSession
    table = checklist_table(spark).withColumn("low", _key(F.col("introduced"))).withColumn("high", _key(F.col("fixed")))
    packed = F.array(*[F.struct(F.lit(c).alias("cve"), F.lit(impact).alias("impact"), F.lit(i).alias("introduced"), F.lit(f).alias("fixed")) for c, i, f, impact, _, _ in _table(CHECKLIST)])
    kernels = images.where("coalesce(kernel_version, '') <> ''").select("image_id", "kernel_version")
    distinct = kernels.select("kernel_version").distinct().withColumn("vkey", version_key(F.col("kernel_version")))
    each = distinct.select("kernel_version", "vkey", F.explode(F.transform(packed, lambda c: c["cve"])).alias("cve")).join(F.broadcast(table), "cve")
    hits = kernels.join(each.where(in_range(F.col("vkey"), F.col("low"), F.col("high"))).drop("vkey", "low", "high"), "kernel_version")
    if facts is None:
        return hits.select("image_id", "cve", "impact", F.lit("undetermined").alias("state"), F.lit("config unknown (no kconfig recovered)").alias("reason"))
    needs = F.concat(F.transform("required", lambda o, i: F.struct(o.alias("option"), F.lit("req").alias("role"), i.alias("at"))), F.transform("mitigations", lambda o, i: F.struct(o.alias("option"), F.lit("mit").alias("role"), i.alias("at"))))
    known = option_states(facts)
    of_image = known.groupBy("image_id").agg(F.max((F.col("evidence") == "kconfig") & (F.col("option") == "*")).alias("authoritative"))
    asked = hits.select("image_id", "cve", "impact", F.explode_outer(needs).alias("n")).select("image_id", "cve", "impact", "n.*").join(of_image, "image_id", "left")
    joined = asked.join(known, ["image_id", "option"], "left").withColumn("state", F.coalesce("state", F.when(F.col("authoritative"), "off").otherwise("unknown")))
    joined = joined.withColumn("evidence", F.coalesce("evidence", F.when(F.col("authoritative"), "kconfig")))
    off, on, open_ = [(F.col("role") == r) & (F.col("state") == s) for r, s in (("req", "off"), ("mit", "on"), ("req", "unknown"))]
    pick = lambda c: F.min(F.when(c, F.struct("at", "option", "evidence")))
    got = joined.groupBy("image_id", "cve", "impact").agg(F.max(F.col("authoritative").isNotNull()).alias("known"), pick(off).alias("off"), pick(on).alias("on"), pick(open_).alias("open"))
    state = F.when(~F.col("known"), "undetermined").when(F.col("off").isNotNull() | F.col("on").isNotNull(), "ruled_out").when(F.col("open").isNotNull(), "undetermined").otherwise("applicable")
    reason = (
        F.when(~F.col("known"), "config unknown (no kconfig recovered)")
        .when(F.col("off").isNotNull(), F.concat(F.lit("requires "), F.col("off.option"), F.lit(" (not enabled"), F.coalesce(F.concat(F.lit(", "), F.col("off.evidence")), F.lit("")), F.lit(")")))
        .when(F.col("on").isNotNull(), F.concat(F.lit("mitigated by "), F.col("on.option")))
        .when(F.col("open").isNotNull(), F.concat(F.col("open.option"), F.lit(" undetermined")))
        .otherwise("subsystem present")
    )
    return got.select("image_id", "cve", "impact", state.alias("state"), reason.alias("reason"))


# -- kernel feed -----------------------------------------------------------------------------------------------


def series(version: Column) -> Column:
    """``X.Y`` of a version of digits and dots."""
    return F.regexp_extract(version, r"^([0-9]+\.[0-9]+)", 1)


def latest_feed(kernel_feed: DataFrame) -> DataFrame:
    """The last snapshot of the feed, each id as loaded last."""
    newest = kernel_feed.agg(F.max("snap_no").alias("snap_no"))
    w = Window.partitionBy("id").orderBy(F.col("loaded_at").desc_nulls_last(), F.desc("row_id"))
    rows = kernel_feed.join(F.broadcast(newest), "snap_no").withColumn("id", F.upper(stripped(F.col("id"))))
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def kernel_feed_matches(images: DataFrame, feed: DataFrame, most_series: int = 10_000) -> DataFrame:
    """(kernel_version, cve, basis): entries whose intervals hold a kernel version of ``images``.

    A branch interval makes it ``branch-exact``; a broad one, or the mainline window for an ``X.Y`` or
    ``X.Y.0`` version, ``broad-range``. Intervals are spread over the release series they touch and joined on
    the series, so no version meets every interval; the series that occur come to the driver, at most
    ``most_series`` of them.
    """
    versions = images.where("coalesce(kernel_version, '') <> ''").select("kernel_version").distinct()
    versions = versions.withColumn("vkey", version_key(F.col("kernel_version"))).withColumn("series", series(F.col("kernel_version")))
    found = versions.select("series").distinct().withColumn("k", version_key(F.col("series"))).withColumn("top", version_key(F.concat("series", F.lit(".999999999")))).limit(most_series + 1).collect()
    if len(found) > most_series:
        raise ValueError(f"more than {most_series} kernel series")
    grid = F.array(*[F.struct(F.lit(r.series).alias("series"), F.lit(r.k).alias("k"), F.lit(r.top).alias("top")) for r in found]) if found else F.array().cast("array<struct<series:string,k:string,top:string>>")
    kinds = F.array(F.struct(F.lit("a").alias("rank"), F.col("ranges").alias("r")), F.struct(F.lit("b").alias("rank"), F.col("broad").alias("r")), F.struct(F.lit("c").alias("rank"), F.array("mainline").alias("r")))
    spans = feed.select("id", F.explode(kinds).alias("x")).select("id", "x.rank", F.explode("x.r").alias("r")).where("r is not null")
    keyed = spans.select("id", "rank", _key(F.col("r.lo")).alias("low"), _key(F.col("r.hi")).alias("high")).where("rank <> 'c' or (low is not null and high is not null)")
    touched = F.filter(grid, lambda s: (F.col("low").isNull() | (s["top"] >= F.col("low"))) & (F.col("high").isNull() | (s["k"] < F.col("high"))))
    parts = keyed.select("id", "rank", "low", "high", F.explode(F.transform(touched, lambda s: s["series"])).alias("series"))
    main = F.col("kernel_version").rlike(r"^[0-9]+\.[0-9]+(?:\.0)?$")
    hits = parts.join(versions, "series").where(in_range(F.col("vkey"), F.col("low"), F.col("high"))).where((F.col("rank") != "c") | main)
    best = hits.groupBy("kernel_version", F.col("id").alias("cve")).agg(F.min("rank").alias("rank"))
    return best.select("kernel_version", "cve", F.when(F.col("rank") == "a", "branch-exact").otherwise("broad-range").alias("basis"))


def without_curated(feed_matches: DataFrame) -> DataFrame:
    """Feed matches of advisories that the fixed checklist doesn't already judge."""
    return feed_matches.join(F.broadcast(checklist_table(feed_matches.sparkSession).select("cve")), "cve", "left_anti")


CNA = "cveMetadata struct<cveId:string>, containers struct<cna:struct<title:string,affected:array<struct<versions:array<struct<version:string,lessThan:string,lessThanOrEqual:string,status:string,versionType:string>>>>,metrics:array<struct<cvssV3_1:struct<baseScore:double,baseSeverity:string>,cvssV3_0:struct<baseScore:double,baseSeverity:string>,cvssV4_0:struct<baseScore:double,baseSeverity:string>>>>>"


def ingest_cna(records: DataFrame) -> DataFrame:
    """Feed rows (id, ranges, broad, mainline, sev, score, summary) of records read with ``CNA``.

    Semver intervals are branch ranges, others broad ones; a fix on a branch without an interval affects the
    branch from its start; unaffected below M and from N on bound the mainline window. Records without any
    interval are left out.
    """
    cna = records.select(F.col("cveMetadata.cveId").alias("id"), "containers.cna.*")
    empty = F.array().cast("array<struct<version:string,lessThan:string,lessThanOrEqual:string,status:string,versionType:string>>")
    listed = F.coalesce(F.flatten(F.filter(F.transform("affected", lambda a: a["versions"]), lambda v: v.isNotNull())), empty)
    ok = lambda c: c.rlike(r"^[0-9.]+$")
    is_series = lambda c: F.regexp_extract(c, r"^([0-9]+\.[0-9]+)", 1)
    hurt = F.filter("v", lambda v: (v["status"] == "affected") & ok(v["lessThan"]) & ok(v["version"]))
    pair = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"))
    fine = F.filter("v", lambda v: (v["status"] == "unaffected"))
    rows = cna.withColumn("v", listed).withColumn("hurt", hurt).withColumn("fine", fine)
    rows = rows.withColumn("own", F.transform(F.filter("hurt", lambda v: v["versionType"] == "semver"), lambda v: pair(v["version"], v["lessThan"])))
    rows = rows.withColumn("broad", F.transform(F.filter("hurt", lambda v: ~F.coalesce(v["versionType"] == "semver", F.lit(False))), lambda v: pair(v["version"], v["lessThan"])))
    rows = rows.withColumn("told", F.transform("own", lambda r: is_series(r["lo"])))
    fixes = F.filter("fine", lambda v: v["lessThanOrEqual"].rlike(r"^.+\.\*$") & ok(v["version"]) & ~((v["version"] == "0") & ok(v["lessThan"])))
    grown = F.transform(F.filter(fixes, lambda v: ~F.array_contains(F.col("told"), is_series(v["version"]))), lambda v: pair(is_series(v["version"]), v["version"]))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    low = last(F.transform(F.filter("fine", lambda v: (v["version"] == "0") & ok(v["lessThan"])), lambda v: v["lessThan"]))
    high = last(F.transform(F.filter("fine", lambda v: (v["lessThanOrEqual"] == "*") & ok(v["version"]) & ~(v["version"] == "0")), lambda v: v["version"]))
    metric = F.try_element_at(F.filter(F.transform("metrics", lambda m: F.coalesce(m["cvssV3_1"], m["cvssV3_0"], m["cvssV4_0"])), lambda m: m.isNotNull()), F.lit(1))
    out = rows.select("id", F.concat("own", grown).alias("ranges"), "broad", F.when(low.isNotNull() & high.isNotNull(), pair(low, high)).alias("mainline"), metric["baseSeverity"].alias("sev"), F.coalesce(metric["baseScore"], F.lit(-1.0)).alias("score"), F.col("title").alias("summary"))
    return out.where("size(ranges) > 0 or size(broad) > 0 or mainline is not null")
