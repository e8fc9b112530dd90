"""Inputs beyond the limits of the reference are worked on whole."""

import base64
import gzip
import json

from pyspark.sql import functions as F

from tuffstone.operators import boot, credentials, kallsyms, kernel, keys, licenses
from tuffstone.plans import boot_queries, kernel_queries, key_queries


def test_configs_of_any_size(spark):
    pins = {"items": [{"pin": f"87{i:05}1"} for i in range(300)], "padding": "x" * (1 << 20), "last": {"psk": "correct-horse"}}
    long = {"password": "battery staple " * 400}
    df = spark.createDataFrame([("pins", json.dumps(pins)), ("long", json.dumps(long))], "path string, content string")
    got = credentials.config_credentials(df)
    assert {r.path: r.n for r in got.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"pins": 301, "long": 1}


def test_keys_anywhere_in_a_file(spark):
    n = key_queries.prime(256, 1) * key_queries.prime(256, 2)
    pem = key_queries.pem("PUBLIC KEY", key_queries.spki(n, 65537))
    fields = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-rsa", b"\1\0\1", n.to_bytes(64, "big")))
    far = b"\0" * (8 << 20) + b"\n" + pem + b"ssh-rsa " + base64.b64encode(fields) + b" me\n"
    bundle = key_queries.pem("OTHER", b"0123456789abcdef") * 4096 + pem
    df = spark.createDataFrame([("far", bytearray(far)), ("bundle", bytearray(bundle))], "path string, content binary")
    got = {(r.path, r.origin, r.offset) for r in keys.extract_keys(df).collect()}
    assert got == {("far", "public-key", (8 << 20) + 1), ("far", "ssh-public-key", (8 << 20) + 1 + len(pem)), ("bundle", "public-key", len(bundle) - len(pem))}


def test_kernel_images_of_any_size(spark):
    image = kernel_queries.symbol_blob(kernel_queries.SYMBOLS)
    df = spark.sql(f"select 'vmlinux' as path, concat(X'{image.hex()}', cast(repeat(' ', {64 << 20}) as binary)) as content")
    assert kallsyms.kernel_symbols(df).where("complete").count() == len(kernel_queries.SYMBOLS)
    config = b"CONFIG_A=y\n" * (3 << 20) + b"CONFIG_LAST=y\n"
    text = kernel.read_ikconfig(b"IKCFG_ST" + gzip.compress(config) + b"IKCFG_ED")
    assert len(text) == len(config) and text.endswith("CONFIG_LAST=y\n")
    plain = boot_queries.store([(boot.GLOBAL, "SecureBoot", b"\1")])
    firmware = b"\xff" * (64 << 20) + b"_FVH" + plain
    assert ("uefi", "SecureBoot", None, 1) in [(f[0], f[1], f[2], int.from_bytes(f[3], "little") if isinstance(f[3], bytes) else f[3]) for f in boot.decode("bios.bin", firmware)]


def test_license_markers_anywhere(spark):
    df = spark.sql(f"select 'NOTICE' as path, concat(repeat('x', {16 << 20}), ' Permission is hereby granted, free of charge') as content")
    assert [tuple(r) for r in licenses.file_licenses(df).collect()] == [("NOTICE", "MIT", 80)]
