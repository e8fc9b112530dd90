"""Queries of the boot posture over generated files, with their results as SQL."""

from __future__ import annotations

import hashlib
import struct

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.operators import boot
from tuffstone.runtime import cut, table

ENV = "bootargs=console=ttyS0,115200 root=/dev/mtd2 init=/bin/sh\nbootcmd=run tftp\nbootdelay=3\nadmin_password=ADMIN\napi_token=s3cr3t\nethaddr=00:11:22:33:44:55\nserial#=42\nserverip=10.0.0.1\nkeyboard=us\nother=1\nbroken\n"


def fdt(nodes: list) -> bytes:
    """A device tree of (name, properties, children) nodes."""
    strings, body = b"", b""

    def put(name: str, props: dict, below: list) -> None:
        nonlocal strings, body
        raw = name.encode() + b"\0"
        body += struct.pack(">I", 1) + raw + b"\0" * (-len(raw) % 4)
        for k, v in props.items():
            at = len(strings)
            strings += k.encode() + b"\0"
            body += struct.pack(">III", 3, len(v), at) + v + b"\0" * (-len(v) % 4)
        for b in below:
            put(*b)
        body += struct.pack(">I", 2)

    put(*nodes)
    body += struct.pack(">I", 9)
    total = 40 + len(body) + len(strings)
    return struct.pack(">10I", 0xD00DFEED, total, 40, 40 + len(body), 40, 17, 16, 0, len(strings), len(body)) + body + strings


def vbmeta(flags: int, algorithm: int, key: bytes, descriptors: bytes) -> bytes:
    head = bytearray(256)
    aux = descriptors + key
    aux += b"\0" * (-len(aux) % 64)
    head[:4] = b"AVB0"
    struct.pack_into(">QQ", head, 12, 64, len(aux))
    struct.pack_into(">I", head, 28, algorithm)
    struct.pack_into(">QQ", head, 64, len(descriptors), len(key))
    struct.pack_into(">QQQ", head, 96, 0, len(descriptors), 7)
    struct.pack_into(">I", head, 120, flags)
    return bytes(head) + b"\0" * 64 + aux


def descriptor(tag: int, body: bytes) -> bytes:
    body += b"\0" * (-len(body) % 8)
    return struct.pack(">QQ", tag, len(body)) + body


def siglist(kind: str, entries: list[bytes]) -> bytes:
    guid = next(g for g, k in boot.SIGNATURES.items() if k == kind)
    each = 16 + len(entries[0])
    return guid + struct.pack("<III", 28 + each * len(entries), 0, each) + b"".join(b"o" * 16 + e for e in entries)


def store(variables: list[tuple[bytes, str, bytes]]) -> bytes:
    out = boot.AUTH_STORE + struct.pack("<I", 0) + b"\x5a\xfe" + b"\0" * 6
    for space, name, value in variables:
        raw = name.encode("utf-16-le") + b"\0\0"
        out += b"\xaa\x55\x3f\0" + b"\0" * 32 + struct.pack("<II", len(raw), len(value)) + space + raw + value
        out += b"\0" * (-len(out) % 4)
    return out


def nvar(name: str, value: bytes) -> bytes:
    body = b"\0" + name.encode() + b"\0" + value
    return b"NVAR" + struct.pack("<H", 10 + len(body)) + b"\xff\xff\xff" + b"\x82" + body


CERT = b"a certificate of no one"
PRINT = hashlib.sha256(CERT).hexdigest()[:32]
HASHTREE = b"\0" * 56 + b"sha256".ljust(32, b"\0") + struct.pack(">I", 6) + b"\0" * 72 + b"system"
CHAIN = struct.pack(">II", 2, 4) + b"\0" * 68 + b"boot"
CMDLINE = struct.pack(">II", 0, 9) + b"\0" * 60 + b"enforcing=0"[:9]
FIT = ("", {"model": b"Board\0"}, [("images", {}, [("kernel", {}, [("hash-1", {}, []), ("signature-1", {}, [])]), ("fdt", {}, [])]), ("configurations", {}, [("conf-1", {}, [])]), ("signature", {}, [("key-dev", {"key-name-hint": b"dev\0", "algo": b"sha256,rsa2048\0"}, [])])])
FILES = [
    ("a/uboot-env.txt", ENV.encode()),
    ("a/env.bin", b"\1\2\3\4" + b"a=1\0b=2\0bootdelay=-1\0ipaddr=1.2.3.4\0\0" + b"\xff" * 8),
    ("a/short.bin", b"a=1\0b=2\0\0"),
    ("a/board.dtb", fdt(("", {"model": b"Some Board\0", "compatible": b"acme,x\0acme,y\0"}, [("chosen", {"bootargs": b"ro single quiet\0"}, [])]))),
    ("a/fit.itb", fdt(FIT)),
    ("a/plain.itb", fdt(("", {}, [("images", {}, [("k", {}, [("hash-1", {}, [])])])]))),
    ("a/vbmeta.img", vbmeta(3, 1, b"public key", descriptor(1, HASHTREE) + descriptor(4, CHAIN))),
    ("a/vbmeta0.img", vbmeta(0, 0, b"", descriptor(3, struct.pack(">II", 0, 11) + b"\0" * 60 + b"enforcing=0"))),
    ("a/broken.img", b"AVB0" + b"\xff" * 400),
    ("a/vars.fd", store([(boot.GLOBAL, "SecureBoot", b"\1"), (boot.GLOBAL, "SetupMode", b"\0"), (boot.GLOBAL, "PK", siglist("x509", [CERT])), (boot.GLOBAL, "KEK", siglist("x509", [CERT])), (boot.IMAGE_DB, "db", siglist("x509", [CERT])), (boot.IMAGE_DB, "dbx", siglist("sha256", [b"h" * 32] * 5))])),
    ("a/nvram.bin", nvar("SecureBoot", b"\0") + nvar("db", siglist("x509", [CERT]))),
    ("a/dbx.esl", siglist("sha256", [b"h" * 32] * 3) + siglist("x509", [CERT])),
    ("a/text.txt", b"hello = world\n"),
]


def facts(spark: SparkSession) -> DataFrame:
    return boot.boot_facts(spark.createDataFrame([(p, bytearray(b)) for p, b in FILES], "path string, content binary"))


def boot_posture(spark: SparkSession, sf: str) -> DataFrame:
    return boot.boot_findings(cut(facts(spark)))


def boot_known_keys(spark: SparkSession, sf: str) -> DataFrame:
    known = spark.createDataFrame([("cert", PRINT, "demo cert"), ("avb", hashlib.sha256(b"public key").hexdigest()[:32], "demo key")], "corpus string, fingerprint string, name string")
    return boot.boot_findings(cut(facts(spark)), known).where("type like '%test%'")


def bootargs(spark: SparkSession, sf: str) -> DataFrame:
    """Command-line rules over the text of all documents and components."""
    texts = table(spark, sf, "components").select(F.col("evidence").alias("t")).union(table(spark, sf, "documents").select("text"))
    return texts.where("t is not null").select(F.explode(boot.cmdline_types(F.col("t"))).alias("c")).groupBy("c.type", "c.severity").agg(F.count("*").alias("n"))


def uboot_env(spark: SparkSession, sf: str) -> DataFrame:
    return boot.boot_findings(cut(facts(spark).where("source = 'env'"))).where("path = 'a/uboot-env.txt'").select("type", "severity", "label")


QUERIES = {f.__name__: f for f in (boot_posture, boot_known_keys, bootargs, uboot_env)}

_ARGS = "console=ttyS0,115200 root=/dev/mtd2 init=/bin/sh"
_ENV = f"""('kernel-cmdline', 'info', '{_ARGS}'), ('cmdline-init-shell', 'high', '{_ARGS}'), ('cmdline-serial-console', 'info', '{_ARGS}'), ('uboot-bootcmd', 'info', 'bootcmd=run tftp'), ('uboot-console-interruptible', 'medium', 'bootdelay=3'),
  ('uboot-env-weak-password', 'high', 'admin_password=ADMIN'), ('uboot-env-secret', 'high', 'api_token=s3cr3t'), ('uboot-env-mac', 'info', 'ethaddr=00:11:22:33:44:55'), ('uboot-env-serial', 'info', 'serial#=42'), ('uboot-env-network', 'info', 'serverip=10.0.0.1')"""
_KEY = hashlib.sha256(b"public key").hexdigest()[:32]
ORACLE = {
    "uboot_env": f"select * from (values {_ENV}) t(type, severity, label)",
    "bootargs": """with t as (select evidence as t from components where evidence <> '' union all select text from documents where text <> '')
      select type, severity, count(*) as n from (select 'kernel-cmdline' as type, 'info' as severity from t
      union all select 'cmdline-single-user', 'high' from t where contains(t, ' single') or contains(t, ' S ') or t like '% S'
      union all select 'cmdline-debug', 'info' from t where contains(t, 'earlyprintk') or contains(t, 'earlycon') or contains(t, ' debug') or contains(t, 'loglevel=8')) group by all""",
    "boot_known_keys": "select * from (values ('a/vbmeta.img', 'avb-test-key', 'high', 'key = demo key'), ('a/vars.fd', 'uefi-test-platform-key', 'high', 'PK = demo cert'), ('a/vars.fd', 'uefi-test-key', 'high', 'KEK = demo cert'), ('a/vars.fd', 'uefi-test-key', 'high', 'db = demo cert'), ('a/nvram.bin', 'uefi-test-key', 'high', 'db = demo cert'), ('a/dbx.esl', 'uefi-test-key', 'high', 'signature list = demo cert')) t(path, type, severity, label)",
    "boot_posture": f"""select 'a/uboot-env.txt' as path, * from (values {_ENV}) t(type, severity, label) union all
      select * from (values ('a/env.bin', 'uboot-env-network', 'info', 'ipaddr=1.2.3.4'), ('a/board.dtb', 'kernel-cmdline', 'info', 'ro single quiet'), ('a/board.dtb', 'cmdline-single-user', 'high', 'ro single quiet'),
      ('a/board.dtb', 'hardware-model', 'info', 'Some Board'), ('a/board.dtb', 'hardware-compatible', 'info', 'acme,x'), ('a/fit.itb', 'hardware-model', 'info', 'Board'), ('a/fit.itb', 'fit-signing-key', 'info', 'dev (sha256,rsa2048)'),
      ('a/fit.itb', 'fit-signed', 'info', '1 signed image(s), 0 signed config(s)'), ('a/fit.itb', 'fit-signature-not-enforced', 'medium', '1 signed image(s), 0 signed config(s)'), ('a/plain.itb', 'fit-unsigned', 'medium', '1 image(s), 1 with a hash, none signed'),
      ('a/vbmeta.img', 'avb-verification-disabled', 'high', 'flags=0x2'), ('a/vbmeta.img', 'avb-hashtree-disabled', 'high', 'flags=0x1'), ('a/vbmeta.img', 'avb-signed', 'info', 'SHA256_RSA2048'), ('a/vbmeta.img', 'avb-signing-key', 'info', 'sha256:{_KEY}'),
      ('a/vbmeta.img', 'avb-dm-verity', 'info', 'system (sha256)'), ('a/vbmeta.img', 'avb-chain-partition', 'info', 'boot (rollback loc 2)'), ('a/vbmeta0.img', 'avb-unsigned', 'high', 'algorithm=NONE'), ('a/vbmeta0.img', 'kernel-cmdline', 'info', 'enforcing=0'),
      ('a/vbmeta0.img', 'cmdline-selinux-off', 'medium', 'enforcing=0'), ('a/vars.fd', 'uefi-platform-key', 'info', 'PK cert sha256:{PRINT}'), ('a/vars.fd', 'uefi-secureboot-on', 'info', 'SecureBoot=1, KEK present'), ('a/vars.fd', 'uefi-single-anchor', 'medium', 'PK = KEK = db'),
      ('a/vars.fd', 'uefi-dbx', 'info', 'dbx: 5 revocation(s)'), ('a/nvram.bin', 'uefi-secureboot-off', 'high', 'SecureBoot=0'), ('a/nvram.bin', 'uefi-setup-mode', 'high', 'no PK'), ('a/nvram.bin', 'uefi-dbx-empty', 'medium', 'no dbx'),
      ('a/dbx.esl', 'uefi-siglist', 'info', '1 X.509 cert, 3 SHA-256 hashes')) t(path, type, severity, label)""",
}
