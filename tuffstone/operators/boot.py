"""Boot posture of firmware files.

Binary formats are decoded once into facts (path, source, key, text, num): environment variables, device
tree and image members, verified-boot headers, Secure Boot variables, certificates. Findings are relational
rules over the facts, so a rule is a filter, a join with known keys or an aggregate of one file.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.operators import der
from tuffstone.operators.keys import pkcs7_certificate, read_certificate

FACT = "path string, source string, key string, text string, num bigint"
FINDING = "path string, type string, severity string, label string"

# What a kernel command line tells, as any of some words.
CMDLINE = (
    ("cmdline-init-shell", "high", ("init=/bin/sh", "init=/bin/bash", "init=/bin/busybox", "rdinit=/bin/sh")),
    ("cmdline-single-user", "high", (" single", " S ")),
    ("cmdline-selinux-off", "medium", ("selinux=0", "enforcing=0")),
    ("cmdline-androidboot-permissive", "medium", ("androidboot.selinux=permissive",)),
    ("cmdline-avb-state", "medium", ("androidboot.verifiedbootstate=orange", "androidboot.verifiedbootstate=red", "androidboot.verifiedbootstate=yellow")),
    ("cmdline-debug", "info", ("earlyprintk", "earlycon", " debug", "loglevel=8", "ignore_loglevel")),
    ("cmdline-serial-console", "info", ("console=ttyS", "console=ttyAMA", "console=ttymxc", "console=ttyO", "console=ttyUSB")),
)
# Passwords a bootloader ships with.
WEAK_PASSWORDS = ("", "root", "admin", "password", "pass", "toor", "default", "1234", "12345", "123456", "1234567", "12345678", "0000", "1111", "guest", "user", "system", "uboot", "u-boot", "linux", "vendor")
# Fingerprints of public test keys.
TEST_KEYS = """
avb 22de3994532196f61c039e90260d78a9 AOSP AVB test key (RSA-2048)
avb 7728e30f50bfa5cea165f473175a0880 AOSP AVB test key (RSA-4096)
avb e15e2365469ce672a91d02cc8d9c2f29 AOSP AVB test key (RSA-8192)
cert 465983f7791f2abeb43ea2cbdc7f21a8 AOSP media signing test cert
cert e1dbadce60dc080d15b58a014b0dcf94 AOSP networkstack signing test cert
cert c8a2e9bccf597c2fb6dc66bee293fc13 AOSP platform signing test cert
cert 28bbfe4a7b97e74681dc55c2fbb6ccb8 AOSP shared signing test cert
cert a40da80a59d170caa950cf15c18c454d AOSP testkey signing test cert
cert 01adaf2c334e76a6479516daf6183818 AMI 'DO NOT TRUST' test PK (PKfail, AmiTestPk00)
cert d7ddc0ac61513b51601e76673826cd44 AMI 'DO NOT TRUST' test PK (PKfail, AmiTestPk01)
cert cca4e3f3170230030dc3e33d1e3fa7d1 AMI 'DO NOT TRUST' test PK (PKfail, AmiTestPk02)
cert 617f9a3582de92b19a14bf45cd704195 AMI 'DO NOT TRUST' test PK (PKfail, AmiTestPk03)
"""
# Identifiers of variable stores, variable spaces and signature types, as they lie on disk.
AUTH_STORE, PLAIN_STORE = bytes.fromhex("782cf3aa7b949a43a1802e144ec37792"), bytes.fromhex("1636cfdd7532644198b6fe85707ffe7d")
GLOBAL, IMAGE_DB = bytes.fromhex("61dfe48bca93d211aa0d00e098032b8c"), bytes.fromhex("cbb219d73a3d9645a3bcdad00e67656f")
SIGNATURES = {bytes.fromhex("a159c0a5e494a74a87b5ab155c2bf072"): "x509", bytes.fromhex("2616c4c14c509240aca941f936934328"): "sha256", bytes.fromhex("12a56c8210cfc94ab187be01496631bd"): "sha1", bytes.fromhex("e866573c9c26344eaa14ed776e85b3b6"): "rsa2048"}
AVB_ALGORITHMS = ("NONE", "SHA256_RSA2048", "SHA256_RSA4096", "SHA256_RSA8192", "SHA512_RSA2048", "SHA512_RSA4096", "SHA512_RSA8192")


# -- decoders ----------------------------------------------------------------------------------------------------


def env_text(data: bytes) -> list[tuple[str, str]]:
    """``key=value`` lines."""
    return [(k, v) for k, eq, v in (line.partition("=") for line in data.decode("latin-1").split("\n")) if eq and k]


def env_region(data: bytes) -> list[tuple[str, str]]:
    """A list of NUL-ended variables after a header of 0, 4 or 5 bytes; none if fewer than four or if anything is off."""
    for start in (0, 4, 5):
        m = re.compile(rb"((?:[A-Za-z0-9_]+=[^\0]*\0){4,})\0").match(data, start, start + (1 << 20))
        if m:
            return [(k, v) for k, _, v in (e.partition("=") for e in m[1].decode("latin-1").split("\0") if e)]
    return []


def read_fdt(data: bytes) -> list[tuple[str, dict[str, bytes]]] | None:
    """(path, properties) of every node of a flattened device tree; None if it is broken."""
    if len(data) < 40 or data[:4] != b"\xd0\x0d\xfe\xed":
        return None
    total, structure, strings, _, version, compatible = struct.unpack_from(">6I", data, 4)
    if total > len(data) or structure >= total or strings > total or not 2 <= version or compatible > 17:
        return None
    nodes: list[tuple[str, dict[str, bytes]]] = []
    stack: list[int] = []
    at, tokens = structure, 0
    while at + 4 <= total and tokens < 1_000_000:
        (token,) = struct.unpack_from(">I", data, at)
        at, tokens = at + 4, tokens + 1
        if token == 1:
            end = data.find(b"\0", at, total)
            if end < 0 or len(stack) >= 64 or len(nodes) >= 100_000:
                return None
            name = data[at:end].decode("latin-1")
            parent = nodes[stack[-1]][0] if stack else ""
            nodes.append((f"{parent.rstrip('/')}/{name}" if stack else "/", {}))
            stack.append(len(nodes) - 1)
            at = (end + 4) & ~3
        elif token == 2:
            if not stack:
                return None
            stack.pop()
        elif token == 3:
            if at + 8 > total or not stack:
                return None
            size, name_at = struct.unpack_from(">II", data, at)
            if at + 8 + size > total or strings + name_at >= total:
                return None
            end = data.find(b"\0", strings + name_at, total)
            nodes[stack[-1]][1][data[strings + name_at : max(end, strings + name_at)].decode("latin-1")] = data[at + 8 : at + 8 + size]
            at = (at + 8 + size + 3) & ~3
        elif token == 9:
            return nodes if not stack else None
        elif token != 4:
            return None
    return None


def _string(value: bytes | None) -> str:
    return (value or b"").split(b"\0")[0].decode("latin-1")


def fdt_facts(data: bytes) -> list[tuple]:
    nodes = read_fdt(data)
    if nodes is None:
        return []
    facts: list[tuple] = []
    members = {"/images": 0, "/configurations": 0}
    count = dict.fromkeys(("hashed", "signed_images", "signed_configs", "signatures", "required"), 0)
    for path, props in nodes:
        name = path.rpartition("/")[2]
        if path == "/chosen" and _string(props.get("bootargs")):
            facts.append(("cmdline", "bootargs", _string(props["bootargs"]), None))
        if path == "/":
            facts += [("fdt", k, _string(props.get(k)), None) for k in ("model", "compatible") if _string(props.get(k))]
        base = path.rpartition("/")[0]
        if base in members:
            members[base] += 1
        if base == "/configurations" and ("signature" in props or _string(props.get("sign-images"))):
            count["signed_configs"] += 1
        if name.startswith("signature") and path.count("/") > 1:
            count["signatures"] += 1
            count["signed_images"] += path.startswith("/images/")
            count["signed_configs"] += path.startswith("/configurations/")
            count["required"] += "required" in props
        if name.startswith("hash") and path.startswith("/images/"):
            count["hashed"] += 1
        if path.startswith("/signature/key"):
            hint, algo = _string(props.get("key-name-hint")) or name, _string(props.get("algo"))
            count["required"] += "required" in props
            facts.append(("fit", "signing-key", hint + (f" ({algo})" if algo else ""), None))
    if any(p == "/images" for p, _ in nodes):
        facts += [("fit", k, None, int(v)) for k, v in (count | {"images": members["/images"]}).items()]
    return facts


def avb_facts(data: bytes) -> list[tuple]:
    """Header, signing key and descriptors of a vbmeta image whose parts fit together."""
    if len(data) < 256:
        return []
    auth, aux = struct.unpack_from(">QQ", data, 12)
    (algorithm,) = struct.unpack_from(">I", data, 28)
    key_at, key_size = struct.unpack_from(">QQ", data, 64)
    list_at, list_size, rollback = struct.unpack_from(">QQQ", data, 96)
    (flags,) = struct.unpack_from(">I", data, 120)
    if max(auth, aux) > 16 << 20 or 256 + auth + aux > len(data) or key_at + key_size > aux or list_at + list_size > aux:
        return []
    base = 256 + auth
    name = AVB_ALGORITHMS[algorithm] if algorithm < len(AVB_ALGORITHMS) else "unknown"
    facts: list[tuple] = [("avb", "flags", None, flags), ("avb", "algorithm", name, algorithm), ("avb", "rollback", None, rollback)]
    if key_size:
        facts.append(("avb", "key", hashlib.sha256(data[base + key_at : base + key_at + key_size]).hexdigest()[:32], None))
    at, end = base + list_at, base + list_at + list_size
    clean = lambda b: re.sub(r"[^\x20-\x7e]", "", b.split(b"\0")[0].decode("latin-1"))
    for _ in range(512):
        if at + 16 > end:
            break
        tag, size = struct.unpack_from(">QQ", data, at)
        body = data[at + 16 : at + 16 + size]
        if size > end - at - 16:
            break
        if tag == 1 and len(body) >= 164:
            (n,) = struct.unpack_from(">I", body, 88)
            facts.append(("avb", "hashtree", f"{clean(body[164 : 164 + n])} ({clean(body[56:88])})", None))
        elif tag == 4 and len(body) >= 76:
            place, n = struct.unpack_from(">II", body, 0)
            facts.append(("avb", "chain", f"{clean(body[76 : 76 + n])} (rollback loc {place})", None))
        elif tag == 3 and len(body) >= 68:
            (n,) = struct.unpack_from(">I", body, 4)
            if clean(body[68 : 68 + n]):
                facts.append(("cmdline", "avb", clean(body[68 : 68 + n]), None))
        at += 16 + size
    return facts


def signature_lists(data: bytes) -> tuple[bool, dict[str, int], list[bytes]]:
    """(well formed, entries by type, certificates) of concatenated EFI signature lists."""
    counts, certs, at, sound = dict.fromkeys(SIGNATURES.values(), 0), [], 0, False
    while at + 28 <= len(data) and data[at : at + 16] in SIGNATURES:
        size, head, each = struct.unpack_from("<III", data, at + 16)
        if size < 28 + head or each <= 16 or each > size or size > len(data) - at:
            break
        sound, kind, n = True, SIGNATURES[data[at : at + 16]], (size - 28 - head) // each
        counts[kind] += n
        if kind == "x509":
            certs += [data[at + 28 + head + k * each + 16 : at + 28 + head + (k + 1) * each] for k in range(n)]
        at += size
    return sound, counts, certs


def edk2_variables(data: bytes, store: int) -> dict[str, bytes]:
    """Live Secure Boot variables of an authenticated variable store."""
    out: dict[str, bytes] = {}
    at = store + 28
    if data[store + 20 : store + 21] != b"\x5a":
        return out
    for _ in range(8192):
        if at + 60 > len(data) or data[at : at + 2] != b"\xaa\x55":
            break
        name_size, size = struct.unpack_from("<II", data, at + 36)
        body = at + 60 + name_size
        if name_size > 4096 or size > 16 << 20 or body + size > len(data):
            break
        if data[at + 2] == 0x3F:
            name = data[at + 60 : body].decode("utf-16-le", "replace").rstrip("\0")
            space = data[at + 44 : at + 60]
            if (space == GLOBAL and name in ("SetupMode", "SecureBoot", "PK", "KEK")) or (space == IMAGE_DB and name in ("db", "dbx")):
                out[name] = data[body : body + size]
        at = (body + size + 3) & ~3
    return out


def nvar_variables(data: bytes) -> dict[str, bytes]:
    """Secure Boot variables of an NVAR store; the last valid entry of a name counts."""
    out: dict[str, bytes] = {}
    at = data.find(b"NVAR")
    while at >= 0 and at + 10 <= len(data):
        (size,) = struct.unpack_from("<H", data, at + 4)
        flags = data[at + 9]
        if size < 11 or size == 0xFFFF or at + size > len(data):
            at = data.find(b"NVAR", at + 1)
            continue
        if flags & 0x80 and not flags & 0x08:
            body = data[at + 10 + (16 if flags & 4 else 1) : at + size]
            if flags & 2:
                name, _, rest = body.partition(b"\0")
            else:
                cut = next((i for i in range(0, len(body) - 1, 2) if body[i : i + 2] == b"\0\0"), len(body))
                name, rest = body[:cut:2], body[cut + 2 :]
            if name.decode("latin-1") in ("SetupMode", "SecureBoot", "PK", "KEK", "db", "dbx"):
                out[name.decode("latin-1")] = rest
        at = data.find(b"NVAR", at + size)
    return out


def uefi_facts(data: bytes) -> list[tuple]:
    store = data.find(AUTH_STORE)
    store = data.find(PLAIN_STORE) if store < 0 else store
    found = (edk2_variables(data, store) if store >= 0 else {}) or nvar_variables(data)
    facts: list[tuple] = [("uefi", k, None, found[k][0]) for k in ("SetupMode", "SecureBoot") if found.get(k)]
    for k in ("PK", "KEK", "db", "dbx"):
        if k in found:
            sound, counts, certs = signature_lists(found[k])
            facts.append(("uefi", k, None, sum(counts.values()) if sound else 0))
            prints = [der.fingerprint(c) for c in certs]
            if k == "PK" and not prints and found[k]:
                prints = [der.fingerprint(found[k])]
            facts += [("uefi", f"{k}-cert", p, i) for i, p in enumerate(prints)]
    return facts


def siglist_facts(data: bytes) -> list[tuple]:
    sound, counts, certs = signature_lists(data)
    if not sound:
        return []
    words = {"x509": ("X.509 cert", "X.509 certs"), "sha256": ("SHA-256 hash", "SHA-256 hashes"), "sha1": ("SHA-1 hash", "SHA-1 hashes"), "rsa2048": ("RSA-2048 key", "RSA-2048 keys")}
    text = ", ".join(f"{n} {words[k][n != 1]}" for k, n in counts.items() if n) or "0 entries"
    return [("siglist", "entries", text, sum(counts.values())), *(("siglist", "cert", der.fingerprint(c), i) for i, c in enumerate(certs))]


def certificate_facts(name: str, data: bytes) -> list[tuple]:
    if name.endswith((".RSA", ".DSA", ".EC")):
        cert = pkcs7_certificate(data)
    elif name.endswith((".x509.pem", ".crt", ".cer", ".der", ".pem")):
        m = re.search(rb"-----BEGIN CERTIFICATE-----(.*?)-----END CERTIFICATE-----", data, re.DOTALL)
        try:
            cert = base64.b64decode(re.sub(rb"\s", b"", m[1])) if m else data
        except (ValueError, binascii.Error):
            cert = None
    else:
        cert = None
    return [("cert", "code-signing", der.fingerprint(cert), None)] if cert and read_certificate(cert) else []


def decode(path: str, data: bytes) -> list[tuple]:
    """Facts of one file without its path; the first format that fits."""
    name = path.rpartition("/")[2]
    if not data:
        return []
    if name == "uboot-env.txt":
        return [("env", k, v, None) for k, v in env_text(data)]
    if data[:4] == b"AVB0":
        return avb_facts(data)
    if data[:4] == b"\xd0\x0d\xfe\xed":
        return fdt_facts(data)
    facts = uefi_facts(data) if data[:16] in (AUTH_STORE, PLAIN_STORE) or data[:4] == b"NVAR" or b"_FVH" in data else []
    facts = facts or (siglist_facts(data) if data[:16] in SIGNATURES else []) or certificate_facts(name, data)
    return facts or [("env", k, v, None) for k, v in env_region(data)]


def boot_facts(files: DataFrame) -> DataFrame:
    """``FACT`` rows of ``files(path, content binary)``; broken files give none."""
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    text = F.decode("content", "ISO-8859-1")
    lists = reduce(lambda a, b: a | b, [F.substring("content", 1, 16) == F.lit(bytearray(g)) for g in (AUTH_STORE, PLAIN_STORE, *SIGNATURES)])
    likely = F.col("path").rlike(r"(?:uboot-env\.txt|\.RSA|\.DSA|\.EC|\.pem|\.crt|\.cer|\.der)$") | head.rlike(r"(?s)^(?:AVB0|\xd0\x0d\xfe\xed|NVAR|.{0,5}[A-Za-z0-9_]+=)") | lists | text.contains("_FVH")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *f) for p, d in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True) for f in decode(p, d)]
            kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [c.split()[0] for c in FACT.split(", ")])

    return files.where(F.col("content").isNotNull() & likely).select("path", "content").mapInArrow(run, FACT)


# -- rules -------------------------------------------------------------------------------------------------------


def cmdline_types(args: Column) -> Column:
    """Array of (type, severity) a kernel command line gives; empty text gives none."""
    hits = [F.struct(F.lit("kernel-cmdline").alias("type"), F.lit("info").alias("severity"))]
    for type_, severity, words in CMDLINE:
        test = reduce(lambda a, b: a | b, [args.contains(w) for w in words])
        test = test | args.endswith(" S") if type_ == "cmdline-single-user" else test
        hits.append(F.when(test, F.struct(F.lit(type_).alias("type"), F.lit(severity).alias("severity"))))
    return F.when(args != "", F.array_compact(F.array(*hits)))


def env_type(key: Column, value: Column) -> Column:
    """(type, severity) of a bootloader variable other than bootargs; null for none."""
    # Words in names of variables, in the order in which they decide, and what they tell.
    low = F.lower(key)
    out = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"))
    secret = low.rlike("passw|secret|token") | (low.contains("key") & ~low.contains("keyboard"))
    waits = value.rlike(r"^\s*\+?[0-9]+$|^\s*-0+$")
    return (
        F.when(key.isin("bootcmd", "preboot", "altbootcmd"), out("uboot-bootcmd", "info"))
        .when(key == "bootdelay", F.when(waits, out("uboot-console-interruptible", "medium")))
        .when(secret & low.contains("passw") & F.lower(value).isin(*WEAK_PASSWORDS), out("uboot-env-weak-password", "high"))
        .when(secret, out("uboot-env-secret", "high"))
        .when(low.rlike("ethaddr|macaddr|wlanaddr|hwaddr"), out("uboot-env-mac", "info"))
        .when((key == "serial#") | low.rlike("serial|board_sn|sn"), out("uboot-env-serial", "info"))
        .when(low.rlike("ipaddr|serverip|gatewayip|netmask|dnsip|tftp|nfsroot|rootpath|bootfile"), out("uboot-env-network", "info"))
    )


def test_keys(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(line.split(" ", 2)) for line in TEST_KEYS.strip().splitlines()], "corpus string, fingerprint string, name string")


def boot_findings(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``FINDING`` rows of boot facts; ``known(corpus, fingerprint, name)`` are public test keys."""
    known = test_keys(facts.sparkSession) if known is None else known
    source, key, text, num = (F.col(c) for c in ("source", "key", "text", "num"))
    row = lambda df, type_, severity, label: df.select("path", F.lit(type_).alias("type"), F.lit(severity).alias("severity"), label.alias("label"))
    args = facts.where((source == "cmdline") | ((source == "env") & (key == "bootargs"))).select("path", text.alias("label"), F.explode(cmdline_types(text)).alias("t"))
    env = facts.where((source == "env") & (key != "bootargs")).select("path", F.concat_ws("=", key, text).alias("label"), env_type(key, text).alias("t")).where("t is not null")
    parts = [d.select("path", "t.type", "t.severity", "label") for d in (args, env)]

    def when(test: Column, type_: str, severity: str, label: Column = text) -> None:
        parts.append(row(facts.where(test), type_, severity, label))

    when((source == "fdt") & (key == "model"), "hardware-model", "info")
    when((source == "fdt") & (key == "compatible"), "hardware-compatible", "info")
    when((source == "fit") & (key == "signing-key"), "fit-signing-key", "info")
    when((source == "avb") & (key == "flags") & (num.bitwiseAND(2) != 0), "avb-verification-disabled", "high", F.lit("flags=0x2"))
    when((source == "avb") & (key == "flags") & (num.bitwiseAND(1) != 0), "avb-hashtree-disabled", "high", F.lit("flags=0x1"))
    when((source == "avb") & (key == "algorithm") & (num == 0), "avb-unsigned", "high", F.lit("algorithm=NONE"))
    when((source == "avb") & (key == "algorithm") & (num != 0), "avb-signed", "info")
    when((source == "avb") & (key == "hashtree"), "avb-dm-verity", "info")
    when((source == "avb") & (key == "chain"), "avb-chain-partition", "info")
    when((source == "siglist") & (key == "entries"), "uefi-siglist", "info")

    # Fingerprints against the public test keys.
    prints = facts.where(key.isin("key", "PK-cert", "KEK-cert", "db-cert", "cert", "code-signing"))
    corpus = known.select(F.col("corpus"), F.col("fingerprint").alias("text"), "name")
    told = prints.withColumn("corpus", F.when(source == "avb", "avb").otherwise("cert")).join(corpus, ["corpus", "text"], "left")
    role = F.when(source == "siglist", "signature list").otherwise(F.regexp_replace("key", "-cert$", ""))
    hit = told.where("name is not null")
    parts += [
        row(hit.where(source == "avb"), "avb-test-key", "high", F.concat(F.lit("key = "), "name")),
        row(told.where((source == "avb") & F.col("name").isNull()), "avb-signing-key", "info", F.concat(F.lit("sha256:"), text)),
        row(hit.where(source == "cert"), "apk-test-signing-cert", "high", F.concat(F.lit("cert = "), "name")),
        row(hit.where(key == "PK-cert"), "uefi-test-platform-key", "high", F.concat(F.lit("PK = "), "name")),
        row(hit.where(source.isin("uefi", "siglist") & (key != "PK-cert")), "uefi-test-key", "high", F.concat(role, F.lit(" = "), "name")),
    ]

    # Posture of one image: all its counts and variables in a row.
    def one(k: str) -> Column:
        return F.max(F.when(key == k, num)).alias(k.replace("-", "_"))

    fit = facts.where(source == "fit").groupBy("path").agg(*[one(k) for k in ("images", "hashed", "signed_images", "signed_configs", "signatures", "required")]).where("images is not null")
    signed = F.concat("signed_images", F.lit(" signed image(s), "), "signed_configs", F.lit(" signed config(s)"))
    bare = F.concat("images", F.lit(" image(s), "), "hashed", F.lit(" with a hash, none signed"))
    parts += [
        row(fit.where("signatures > 0"), "fit-signed", "info", signed),
        row(fit.where("signatures > 0 and required = 0"), "fit-signature-not-enforced", "medium", signed),
        row(fit.where("signatures = 0 and images > 0"), "fit-unsigned", "medium", bare),
    ]
    first = lambda k: F.min_by(F.when(key == f"{k}-cert", text), F.when(key == f"{k}-cert", num)).alias(f"{k}_print")
    uefi = facts.where(source == "uefi").groupBy("path").agg(*[one(k) for k in ("SetupMode", "SecureBoot", "PK", "KEK", "db", "dbx")], *[first(k) for k in ("PK", "KEK", "db")])
    bad_pk = hit.where(key == "PK-cert").select("path").distinct().withColumn("bad", F.lit(True))
    uefi = uefi.join(bad_pk, "path", "left")
    also = lambda c, t: F.when(F.col(c).isNotNull(), t).otherwise("")
    parts += [
        row(uefi.where("SecureBoot = 0"), "uefi-secureboot-off", "high", F.lit("SecureBoot=0")),
        row(uefi.where("SetupMode = 1 or PK is null"), "uefi-setup-mode", "high", F.when(F.col("PK").isNull(), "no PK").otherwise("SetupMode=1")),
        row(uefi.where("PK is not null and bad is null"), "uefi-platform-key", "info", F.coalesce(F.concat(F.lit("PK cert sha256:"), "PK_print"), F.lit("PK"))),
        row(uefi.where("SecureBoot = 1 and PK is not null"), "uefi-secureboot-on", "info", F.concat(F.lit("SecureBoot=1"), also("KEK", ", KEK present"))),
        row(uefi.where("SecureBoot is null and PK is not null"), "uefi-secureboot-on", "info", F.concat(F.lit("PK enrolled"), also("KEK", ", KEK present"), also("db", ", db present"))),
        row(uefi.where("PK_print = KEK_print and PK_print = db_print"), "uefi-single-anchor", "medium", F.lit("PK = KEK = db")),
        row(uefi.where("dbx = 0 or (dbx is null and (db is not null or PK is not null))"), "uefi-dbx-empty", "medium", F.when(F.col("dbx").isNull(), "no dbx").otherwise("dbx empty")),
        row(uefi.where("dbx > 0"), "uefi-dbx", "info", F.concat(F.lit("dbx: "), "dbx", F.lit(" revocation(s)"))),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)
