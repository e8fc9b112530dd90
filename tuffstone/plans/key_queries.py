"""Queries of the key operators over generated keys, with their results as SQL."""

from __future__ import annotations

import base64
import math
from functools import cache

from pyspark.sql import DataFrame, SparkSession

from tuffstone.operators import der, keys


SMALL = math.prod(p for p in range(2, 5000) if all(p % d for d in range(2, math.isqrt(p) + 1)))


def is_prime(n: int) -> bool:
    """Whether a number above 5000 passes a sieve and twelve Miller-Rabin rounds."""
    if math.gcd(n, SMALL) != 1:
        return False
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37):
        x = pow(a, d, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(s - 1)):
            return False
    return True


@cache
def prime(bits: int, k: int) -> int:
    """A prime of ``bits`` bits; another one for each k."""
    n = (3 << (bits - 2)) + (k * 7919 << (bits // 2)) + 1
    while not is_prime(n):
        n += 2
    return n


def tlv(tag: int, body: bytes) -> bytes:
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x80 | (n.bit_length() + 7) // 8]) + n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([tag]) + size + body


def number(n: int) -> bytes:
    return tlv(2, n.to_bytes(n.bit_length() // 8 + 1, "big"))


def spki(n: int, e: int) -> bytes:
    return tlv(0x30, tlv(0x30, tlv(6, der.RSA) + tlv(5, b"")) + tlv(3, b"\0" + tlv(0x30, number(n) + number(e))))


def ec_spki(curve: str, x: int, y: int) -> bytes:
    size = (keys.CURVE_PARAMETERS[curve][0].bit_length() + 7) // 8
    oid = next(o for o, c in der.CURVES.items() if c == curve)
    return tlv(0x30, tlv(0x30, tlv(6, der.EC) + tlv(6, oid)) + tlv(3, b"\0\4" + x.to_bytes(size, "big") + y.to_bytes(size, "big")))


def pem(kind: str, raw: bytes) -> bytes:
    text = base64.encodebytes(raw).decode()
    return f"-----BEGIN {kind}-----\n{text}-----END {kind}-----\n".encode()


def private(n: int, p: int, q: int, e: int = 65537) -> bytes:
    d = pow(e, -1, (p - 1) * (q - 1))
    return tlv(0x30, b"".join(number(v) for v in (0, n, e, d, p, q, d % (p - 1), d % (q - 1), pow(q, -1, p))))


def certificate(key: bytes) -> bytes:
    alg, name = tlv(0x30, tlv(6, bytes.fromhex("2a864886f70d01010b"))), tlv(0x30, b"")
    return tlv(0x30, tlv(0x30, number(1) + alg + name + tlv(0x30, b"") + name + key) + alg + tlv(3, b"\0\0"))


@cache
def fixture() -> list[tuple[str, bytes]]:
    sound = prime(1024, 1) * prime(1024, 2)
    close = prime(1024, 3)
    near = close + 2
    while not is_prime(near):
        near += 2
    small_d = 65537
    wp, wq = prime(1024, 5), prime(1024, 6)
    ssh = b"".join(len(f).to_bytes(4, "big") + f for f in (b"ssh-rsa", b"\1\0\1", b"\0" + sound.to_bytes(256, "big")))
    points = {c: next(t for t in keys.multiples(c, 300) if t[0] == d)[1:] for c, d in (("secp256r1", 2), ("secp384r1", 4), ("secp521r1", 255))}
    gx, gy = keys.CURVE_PARAMETERS["secp256k1"][2:]
    files = [
        ("ok.pub", b"ssh-rsa " + base64.b64encode(ssh) + b" me\n"), ("ok.pem", pem("PUBLIC KEY", spki(sound, 65537))), ("cert.pem", pem("CERTIFICATE", certificate(spki(sound, 65537)))), ("cert.der", certificate(spki(sound, 65537))),
        ("tiny.pem", pem("PUBLIC KEY", spki(prime(256, 1) * prime(256, 2), 65537))), ("weak.pem", pem("RSA PUBLIC KEY", tlv(0x30, number(prime(768, 1) * prime(768, 2)) + number(3)))),
        ("exp1.pem", pem("PUBLIC KEY", spki(prime(1024, 7) * prime(1024, 8), 1))), ("expeven.pem", pem("PUBLIC KEY", spki(prime(1024, 9) * prime(1024, 10), 4))), ("even.pem", pem("PUBLIC KEY", spki(2 * prime(1024, 14) * prime(1024, 15), 65537))),
        ("fermat.pem", pem("PUBLIC KEY", spki(close * near, 65537))), ("wiener.pem", pem("PUBLIC KEY", spki(wp * wq, pow(small_d, -1, (wp - 1) * (wq - 1))))),
        ("share1.pem", pem("PUBLIC KEY", spki(prime(1024, 11) * prime(1024, 12), 65537))), ("share2.pem", pem("PUBLIC KEY", spki(prime(1024, 11) * prime(1024, 13), 65537))),
        *[(f"ec-{c}.pem", pem("PUBLIC KEY", ec_spki(c, *xy))) for c, xy in points.items()], ("ec-secp256k1.pem", pem("PUBLIC KEY", ec_spki("secp256k1", gx, gy))),
        ("key.pem", pem("RSA PRIVATE KEY", private(sound, prime(1024, 1), prime(1024, 2)))),
        ("blob.bin", b"\1\2\3" + private(sound, prime(1024, 1), prime(1024, 2)) + b"\0" * 9 + tlv(0x30, number(0) + tlv(0x30, tlv(6, der.RSA) + tlv(5, b"")) + tlv(4, private(sound, prime(1024, 1), prime(1024, 2))))),
        ("noise.bin", b"0\x82\xff\xff\2\1\0\x30" + b"-----BEGIN PUBLIC KEY-----\n!!!!aaaaaaaaaaaaaaaaaaaa\n-----END PUBLIC KEY-----"),
    ]
    return files


def files(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p, bytearray(b)) for p, b in fixture()], "path string, content binary")


def public_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.extract_keys(files(spark)).select("path", "algo", "curve", "bits", "origin")


def der_private_keys(spark: SparkSession, sf: str) -> DataFrame:
    return keys.der_private_keys(files(spark)).select("path", "offset", "label", "confidence")


def key_weaknesses(spark: SparkSession, sf: str) -> DataFrame:
    return keys.key_weaknesses(keys.extract_keys(files(spark))).select("path", "type", "severity")


def ec_small_scalar(spark: SparkSession, sf: str) -> DataFrame:
    return keys.small_scalars(keys.extract_keys(files(spark))).select("path", "type", "evidence")


def shared_prime(spark: SparkSession, sf: str) -> DataFrame:
    return keys.shared_primes(keys.extract_keys(files(spark)), block=3).select("path", "type")


def leaked_key_join(spark: SparkSession, sf: str) -> DataFrame:
    found = keys.extract_keys(files(spark))
    sound = (prime(1024, 1) * prime(1024, 2)).to_bytes(256, "big")
    known = spark.createDataFrame([(der.fingerprint(sound), "demo key", "host", "fixture")], "fingerprint string, name string, key_use string, ref string")
    return keys.leaked_keys(found, known).select("path", "type", "label", "evidence")


QUERIES = {f.__name__: f for f in (public_keys, der_private_keys, key_weaknesses, ec_small_scalar, shared_prime, leaked_key_join)}


def oracle() -> dict[str, str]:
    one = len(private(prime(1024, 1) * prime(1024, 2), prime(1024, 1), prime(1024, 2)))
    return {
        "public_keys": """select * from (values ('ok.pub', 'RSA', null, 2048, 'ssh-public-key'), ('ok.pem', 'RSA', null, 2048, 'public-key'), ('cert.pem', 'RSA', null, 2048, 'certificate'), ('cert.der', 'RSA', null, 2048, 'certificate'),
          ('tiny.pem', 'RSA', null, 512, 'public-key'), ('weak.pem', 'RSA', null, 1536, 'public-key'), ('exp1.pem', 'RSA', null, 2048, 'public-key'), ('expeven.pem', 'RSA', null, 2048, 'public-key'), ('even.pem', 'RSA', null, 2049, 'public-key'),
          ('fermat.pem', 'RSA', null, 2048, 'public-key'), ('wiener.pem', 'RSA', null, 2048, 'public-key'), ('share1.pem', 'RSA', null, 2048, 'public-key'), ('share2.pem', 'RSA', null, 2048, 'public-key'),
          ('ec-secp256r1.pem', 'EC', 'secp256r1', 256, 'public-key'), ('ec-secp384r1.pem', 'EC', 'secp384r1', 384, 'public-key'), ('ec-secp521r1.pem', 'EC', 'secp521r1', 528, 'public-key'), ('ec-secp256k1.pem', 'EC', 'secp256k1', 256, 'public-key'),
          ('key.pem', 'RSA', null, 2048, 'private-key')) t(path, algo, curve, bits, origin)""",
        "der_private_keys": f"select 'blob.bin' as path, o as \"offset\", 'RSA-2048 private key' as label, 80 as confidence from (values (3::bigint), ({3 + one + 9})) t(o)",
        "key_weaknesses": """select * from (values ('tiny.pem', 'rsa-tiny-modulus', 'high'), ('weak.pem', 'rsa-weak-modulus', 'medium'), ('exp1.pem', 'rsa-broken-exponent', 'high'), ('expeven.pem', 'rsa-even-exponent', 'high'),
          ('even.pem', 'rsa-even-modulus', 'high'), ('fermat.pem', 'fermat-factorable', 'high'), ('wiener.pem', 'wiener-weak', 'high')) t(path, type, severity)""",
        "ec_small_scalar": """select 'ec-' || c || '.pem' as path, 'ec-small-scalar' as type, 'private scalar recovered: d=' || d || ' on ' || c as evidence from (values ('secp256r1', 2), ('secp384r1', 4), ('secp521r1', 255), ('secp256k1', 1)) t(c, d)""",
        "shared_prime": "select unnest(['share1.pem', 'share2.pem']) as path, 'shared-prime' as type",
        "leaked_key_join": "select unnest(['ok.pub', 'ok.pem', 'cert.pem', 'cert.der', 'key.pem']) as path, 'leaked-key' as type, 'demo key' as label, 'an attacker can impersonate/MITM this host (host key)' as evidence",
    }


ORACLE = oracle()
