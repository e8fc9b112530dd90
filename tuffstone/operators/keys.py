"""Keys in content and weaknesses of public keys.

Key extraction reads bytes in Python behind a filter on anchors. What follows is relational: leaked keys are
an equi-join on fingerprints, small EC scalars an equi-join on a table of the first multiples of each base
point, shared primes a product tree in blocks; sizes and exponents are expressions.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tuffstone.operators import der
from tuffstone.operators.secrets import FINDING, TIERS, finding_batch

KEY = "path string, offset bigint, algo string, curve string, bits int, n binary, e binary, x binary, y binary, origin string, fp_der string, fp_ssh string, fp_modn string, label string"
_NAMES = [c.split()[0] for c in KEY.split(", ")]
PEM = re.compile(rb"-----BEGIN ([A-Z0-9 ]{1,40})-----(.{16,65536}?)-----END \1-----", re.DOTALL)
SSH = re.compile(rb"(?<![A-Za-z0-9+/])((?:ssh-rsa|ssh-dss|ssh-ed25519|ecdsa-sha2-nistp(?:256|384|521))) +(AAAA[A-Za-z0-9+/]+={0,2})")
SSH_CURVES = {"nistp256": "secp256r1", "nistp384": "secp384r1", "nistp521": "secp521r1"}
EFI_X509 = bytes.fromhex("a159c0a5e494a74a87b5ab155c2bf072")


def _be(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _rsa(n: int, e: int) -> dict:
    return {"algo": "RSA", "bits": n.bit_length(), "n": _be(n), "e": _be(e), "fp_modn": der.fingerprint(_be(n))} if n else {}


def _point(raw: bytes) -> dict:
    """Coordinates of an uncompressed point."""
    if len(raw) < 3 or raw[0] != 4 or len(raw) % 2 == 0:
        return {}
    half = len(raw) // 2
    return {"x": raw[1 : half + 1], "y": raw[half + 1 :], "bits": half * 8}


def read_spki(data: bytes, at: int = 0, end: int | None = None) -> dict | None:
    """Fields of a SubjectPublicKeyInfo."""
    outer = der.node(data, at, end)
    parts = der.children(data, outer) if outer and outer.tag == 0x30 else None
    if not parts or len(parts) < 2 or parts[0].tag != 0x30 or parts[1].tag != 3:
        return None
    alg = der.children(data, parts[0])
    if not alg or alg[0].tag != 6:
        return None
    oid, bits = der.value(data, alg[0]), der.value(data, parts[1])[1:]
    if oid == der.RSA:
        return read_pkcs1(bits)
    if oid == der.EC:
        curve = der.CURVES.get(der.value(data, alg[1]), "") if len(alg) > 1 and alg[1].tag == 6 else ""
        return {"algo": "EC", "curve": curve} | _point(bits)
    if oid == der.DSA:
        params = der.children(data, alg[1]) if len(alg) > 1 and alg[1].tag == 0x30 else None
        return {"algo": "DSA", "bits": der.integer(data, params[0]).bit_length() if params and params[0].tag == 2 else 0}
    if oid in der.MODERN:
        return dict(zip(("algo", "bits"), der.MODERN[oid], strict=True))
    return None


def read_pkcs1(data: bytes) -> dict | None:
    """Fields of an RSAPublicKey."""
    outer = der.node(data, 0)
    parts = der.children(data, outer) if outer and outer.tag == 0x30 else None
    if not parts or len(parts) < 2 or parts[0].tag != 2 or parts[1].tag != 2:
        return None
    return _rsa(der.integer(data, parts[0]), der.integer(data, parts[1])) or None


def read_certificate(data: bytes) -> dict | None:
    """Key and fingerprint of an X.509 certificate."""
    outer = der.node(data, 0)
    parts = der.children(data, outer) if outer and outer.tag == 0x30 else None
    if not parts or len(parts) != 3 or parts[0].tag != 0x30:
        return None
    for part in der.children(data, parts[0]) or []:
        if part.tag == 0x30:
            got = read_spki(data, part.start, part.end)
            if got:
                return got | {"origin": "certificate", "fp_der": der.fingerprint(data[: outer.end])}
    return None


def read_private(data: bytes) -> dict | None:
    """The public half of a PKCS#1, PKCS#8 or SEC1 private key."""
    outer = der.node(data, 0)
    parts = der.children(data, outer) if outer and outer.tag == 0x30 else None
    if not parts or parts[0].tag != 2:
        return None
    if len(parts) >= 9 and all(p.tag == 2 for p in parts[:9]):
        return (_rsa(der.integer(data, parts[1]), der.integer(data, parts[2])) or {}) | {"origin": "private-key"}
    if len(parts) >= 3 and parts[1].tag == 0x30 and parts[2].tag == 4:
        inner = read_private(der.value(data, parts[2]))
        if inner:
            return inner
        alg = der.children(data, parts[1])
        if alg and der.value(data, alg[0]) in der.MODERN:
            return dict(zip(("algo", "bits"), der.MODERN[der.value(data, alg[0])], strict=True)) | {"origin": "private-key"}
    if len(parts) >= 2 and parts[1].tag == 4 and der.integer(data, parts[0]) == 1:
        got = {"algo": "EC", "origin": "private-key", "bits": len(der.value(data, parts[1])) * 8}
        for p in parts[2:]:
            inner = der.node(data, p.body, p.end)
            if inner and p.tag == 0xA0 and inner.tag == 6:
                got["curve"] = der.CURVES.get(der.value(data, inner), "")
            elif inner and p.tag == 0xA1 and inner.tag == 3:
                got |= _point(der.value(data, inner)[1:])
        return got
    return None


def read_ssh(blob: bytes) -> dict | None:
    """Fields of a public key in SSH wire form."""
    fields, at = [], 0
    while at + 4 <= len(blob) and len(fields) < 16:
        n = int.from_bytes(blob[at : at + 4], "big")
        if at + 4 + n > len(blob):
            return None
        fields.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    if not fields:
        return None
    kind = fields[0].decode("latin-1")
    base = {"origin": "ssh-public-key", "fp_ssh": der.fingerprint(blob)}
    if kind == "ssh-rsa" and len(fields) >= 3:
        return base | _rsa(int.from_bytes(fields[2], "big"), int.from_bytes(fields[1], "big"))
    if kind == "ssh-dss":
        return base | {"algo": "DSA", "bits": int.from_bytes(fields[1], "big").bit_length() if len(fields) > 1 else 0}
    if kind == "ssh-ed25519":
        return base | {"algo": "Ed25519", "bits": 256}
    if kind.startswith("ecdsa-sha2-"):
        curve = fields[1].decode("latin-1") if len(fields) > 1 else ""
        return base | {"algo": "EC", "curve": SSH_CURVES.get(curve, curve)} | (_point(fields[2]) if len(fields) > 2 else {})
    return None


def efi_certificates(data: bytes) -> list[tuple[int, bytes]]:
    """(offset, certificate) of the X.509 entries of an EFI signature list."""
    out, at = [], 0
    while at + 28 <= len(data):
        size, head, each = (int.from_bytes(data[at + k : at + k + 4], "little") for k in (16, 20, 24))
        if size < 28 or at + size > len(data) or each <= 16:
            break
        if data[at : at + 16] == EFI_X509:
            place = at + 28 + head
            while place + each <= at + size:
                out.append((place + 16, data[place + 16 : place + each]))
                place += each
        at += size
    return out


def pkcs7_certificate(data: bytes) -> bytes | None:
    """The first certificate of a PKCS#7 SignedData."""
    outer = der.node(data, 0)
    parts = der.children(data, outer) if outer and outer.tag == 0x30 else None
    if not parts or len(parts) < 2 or parts[0].tag != 6 or parts[1].tag != 0xA0:
        return None
    signed = der.node(data, parts[1].body, parts[1].end)
    for p in (der.children(data, signed) or []) if signed else []:
        if p.tag == 0xA0:
            first = der.node(data, p.body, p.end)
            return data[first.start : first.end] if first else None
    return None


def public_keys(data: bytes) -> list[dict]:
    """Keys of one file by offset: PEM blocks, SSH lines, a whole-file certificate or key, EFI lists; each once."""
    found: list[dict] = []
    for m in PEM.finditer(data):
        kind = m[1].decode()
        body = re.sub(rb"(?m)^[A-Za-z0-9-]+:.*$", b"", m[2])
        try:
            raw = base64.b64decode(re.sub(rb"[^A-Za-z0-9+/=]", b"", body))
        except (ValueError, binascii.Error):
            continue
        if "CERTIFICATE" in kind:
            got = read_certificate(raw)
        elif kind == "RSA PUBLIC KEY":
            got = read_pkcs1(raw)
        elif kind.endswith("PUBLIC KEY"):
            got = read_spki(raw)
            got = got and got | {"fp_der": der.fingerprint(raw)}
        elif kind.endswith("PRIVATE KEY"):
            got = read_private(raw)
        else:
            got = None
        if got and got.get("algo"):
            found.append({"origin": "public-key"} | got | {"offset": m.start()})
    for m in SSH.finditer(data):
        try:
            bare = m[2].rstrip(b"=")
            got = read_ssh(base64.b64decode(bare + b"=" * (-len(bare) % 4)))
        except (ValueError, binascii.Error):
            continue
        if got and got.get("algo"):
            found.append(got | {"offset": m.start()})
    if data[:1] == b"\x30":
        whole = pkcs7_certificate(data) or data
        got = read_certificate(whole) or read_private(data) or read_spki(data) or read_pkcs1(data)
        if got and got.get("algo"):
            found.append({"origin": "public-key", "fp_der": der.fingerprint(whole)} | got | {"offset": 0})
    for at, cert in efi_certificates(data):
        got = read_certificate(cert)
        if got and got.get("algo"):
            found.append(got | {"offset": at})
    seen, out = set(), []
    for k in sorted(found, key=lambda k: k["offset"]):
        ident = (k.get("fp_ssh", ""), k.get("fp_der", ""), k.get("fp_modn", ""), k.get("x", b""))
        if ident not in seen:
            seen.add(ident)
            size = f"-{k['bits']}" if k.get("bits") else ""
            out.append(k | {"label": f"{k['algo']}{size} {k['origin']}"})
    return out


def extract_keys(files: DataFrame) -> DataFrame:
    """``KEY`` rows of ``files(path, content binary)``; broken encodings give none."""
    text = F.decode("content", "ISO-8859-1")
    hint = text.rlike(r"-----BEGIN |ssh-(?:rsa|dss|ed25519) |ecdsa-sha2-") | text.startswith("0") | (F.substring(F.col("content"), 1, 16) == F.lit(bytearray(EFI_X509)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = {"offset": pa.int64(), "bits": pa.int32(), "n": pa.binary(), "e": pa.binary(), "x": pa.binary(), "y": pa.binary()}
        for batch in batches:
            rows = []
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows += [k | {"path": path} for k in public_keys(data)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(c) for r in rows], schema.get(c, pa.string())) for c in _NAMES], _NAMES)

    return files.select("path", "content").where(hint).mapInArrow(run, KEY)


# -- private keys in raw form ------------------------------------------------------------------------------------

ANCHOR = re.compile(rb"(?=\x02\x01\x00\x30|\x02\x01\x00\x02[\x81\x82]|\x02\x01\x01\x04[\x20\x30\x42])")


def _private_label(data: bytes, start: int) -> tuple[int, str] | None:
    """(end, kind) of a private key whose outer sequence begins at ``start``."""
    outer = der.node(data, start)
    if not outer or outer.tag != 0x30:
        return None
    parts = der.children(data, outer)
    if not parts:
        return None
    if len(parts) == 9 and all(p.tag == 2 for p in parts):
        bits = der.integer(data, parts[1]).bit_length()
        return (outer.end, f"RSA-{(bits + 7) // 8 * 8}") if bits >= 512 else None
    if len(parts) >= 3 and parts[1].tag == 0x30 and parts[2].tag == 4:
        alg = der.children(data, parts[1])
        if not alg or alg[0].tag != 6:
            return None
        oid = der.value(data, alg[0])
        if oid == der.RSA:
            inner = der.node(data, parts[2].body, parts[2].end)
            got = inner and _private_label(data, inner.start)
            return (outer.end, got[1]) if got else None
        if oid == der.EC:
            curve = der.CURVES.get(der.value(data, alg[1]), "") if len(alg) > 1 and alg[1].tag == 6 else ""
            return outer.end, f"EC {curve}".strip()
        return (outer.end, der.MODERN[oid][0]) if oid in der.MODERN else None
    if len(parts) >= 2 and parts[1].tag == 4 and len(der.value(data, parts[1])) in (32, 48, 66):
        size = {32: "P-256", 48: "secp384r1", 66: "secp521r1"}[len(der.value(data, parts[1]))]
        if any(p.tag not in (0xA0, 0xA1) for p in parts[2:]):
            return None
        for p in parts[2:]:
            inner = der.node(data, p.body, p.end)
            if p.tag == 0xA0 and inner and inner.tag == 6:
                size = der.CURVES.get(der.value(data, inner), size)
        return outer.end, f"EC {size}"
    return None


def raw_private_keys(data: bytes) -> list[tuple]:
    """``FINDING`` tuples without path: outermost private keys in DER anywhere in the bytes."""
    hits = []
    for m in ANCHOR.finditer(data):
        for head in range(2, 7):
            start = m.start() - head
            outer = der.node(data, start) if start >= 0 and data[start] == 0x30 else None
            if outer and outer.body == m.start():
                got = _private_label(data, start)
                if got:
                    hits.append((start, got[0], got[1]))
    out, claimed = [], -1
    for start, end, label in sorted(hits, key=lambda h: (h[0], -h[1])):
        if start >= claimed:
            claimed = end
            out.append((start, end - start, "der-private-key", "secret", 80, TIERS[80], "DER private key structurally parsed", f"{label} private key", f"Embedded {label} private key in raw DER form"))
    return out


def der_private_keys(files: DataFrame) -> DataFrame:
    """``FINDING`` rows of raw private keys in ``files(path, content binary)``."""
    text = F.decode("content", "ISO-8859-1")
    hint = text.rlike(r"(?s)\x02\x01\x00\x30|\x02\x01\x00\x02[\x81\x82]|\x02\x01\x01\x04[\x20\x30\x42]")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)
            yield finding_batch([(path, *f) for path, data in pairs for f in raw_private_keys(data)])

    return files.select("path", "content").where(hint).mapInArrow(run, FINDING)


# -- weaknesses --------------------------------------------------------------------------------------------------

# Primes of the structured-modulus test.
ROCA_PRIMES = (3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97, 101, 103, 107, 109, 113, 127, 131, 137, 139, 149, 151, 157, 163, 167)


@cache
def roca_residues() -> dict[int, frozenset]:
    """For each prime, the powers of 65537."""
    return {p: frozenset(pow(65537, k, p) for k in range(p)) for p in ROCA_PRIMES}


def is_roca(n: int) -> bool:
    return n > 0 and all(n % p in r for p, r in roca_residues().items())


def fermat(n: int, steps: int = 100) -> tuple[int, int] | None:
    """Factors of an odd modulus whose primes are close."""
    if n < 9 or n % 2 == 0:
        return None
    a = math.isqrt(n)
    a += a * a < n
    for _ in range(steps):
        b = math.isqrt(a * a - n)
        if b * b == a * a - n:
            return (a - b, a + b) if a - b > 1 else None
        a += 1
    return None


def wiener(n: int, e: int) -> int | None:
    """A small private exponent, from the convergents of e/n."""
    a, b = e, n
    k0, k1, d0, d1 = 0, 1, 1, 0
    while b:
        q, (a, b) = a // b, (b, a % b)
        k0, k1, d0, d1 = k1, q * k1 + k0, d1, q * d1 + d0
        if k1 and d1 and (e * d1 - 1) % k1 == 0:
            s = n - (e * d1 - 1) // k1 + 1
            gap = s * s - 4 * n
            if gap >= 0 and math.isqrt(gap) ** 2 == gap and (s + math.isqrt(gap)) % 2 == 0:
                return d1
    return None


WEAK = "path string, offset bigint, type string, severity string, confidence int, label string, evidence string"
_WEAK = [c.split()[0] for c in WEAK.split(", ")]


def rsa_weaknesses(n: int, e: int) -> list[tuple[str, str, int, str]]:
    """(type, severity, tier, note) of one RSA key."""
    out, bits = [], n.bit_length()
    if is_roca(n):
        out.append(("roca-key", "high", 95, "structured primes: the private key can be recovered"))
    if 0 < bits < 1024:
        out.append(("rsa-tiny-modulus", "high", 80, f"{bits}-bit modulus"))
    elif 0 < bits < 2048:
        out.append(("rsa-weak-modulus", "medium", 80, f"{bits}-bit modulus"))
    if e in (0, 1):
        out.append(("rsa-broken-exponent", "high", 80, f"exponent {e}"))
    elif e % 2 == 0:
        out.append(("rsa-even-exponent", "high", 80, "even exponent"))
    if n and n % 2 == 0:
        out.append(("rsa-even-modulus", "high", 80, "even modulus"))
    if 256 <= bits <= 16384:
        if fermat(n):
            out.append(("fermat-factorable", "high", 95, "close primes: factored"))
        if 2 * e.bit_length() > bits and wiener(n, e):
            out.append(("wiener-weak", "high", 95, "small private exponent recovered"))
    return out


def key_weaknesses(keys: DataFrame) -> DataFrame:
    """``WEAK`` rows of RSA and DSA keys: size, exponent, structure, close primes, small private exponent.

    The bignum checks run in Python, once for each distinct (n, e).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, e in zip(batch.column("n").to_pylist(), batch.column("e").to_pylist(), strict=True):
                out += [(n, e, *w) for w in rsa_weaknesses(int.from_bytes(n, "big"), int.from_bytes(e or b"", "big"))]
            kinds = [pa.binary(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.string()]
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["n", "e", "type", "severity", "confidence", "evidence"])

    rsa = keys.where("algo = 'RSA' and n is not null").withColumn("e", F.coalesce("e", F.lit(bytearray(b""))))
    judged = rsa.select("n", "e").distinct().mapInArrow(run, "n binary, e binary, type string, severity string, confidence int, evidence string")
    of_rsa = rsa.select("path", "offset", "label", "n", "e").join(judged, ["n", "e"]).select(*_WEAK)
    small = keys.where("algo = 'DSA' and bits > 0 and bits < 2048")
    severity = F.when(F.col("bits") < 1024, "high").otherwise("medium")
    of_dsa = small.select("path", "offset", F.lit("dsa-weak-parameters").alias("type"), severity.alias("severity"), F.lit(80).alias("confidence"), "label", F.concat("bits", F.lit("-bit prime")).alias("evidence"))
    return of_rsa.unionByName(of_dsa)


def leaked_keys(keys: DataFrame, known: DataFrame) -> DataFrame:
    """Keys in a corpus ``known(fingerprint, name, key_use, ref)`` of public private keys.

    The first fingerprint that hits counts: SSH blob, modulus, DER.
    """
    prints = F.array(*[F.struct(F.lit(i).alias("order"), F.col(c).alias("fingerprint")) for i, c in enumerate(("fp_ssh", "fp_modn", "fp_der"))])
    each = keys.select("path", "offset", F.explode(prints).alias("f")).select("path", "offset", "f.*").where("fingerprint is not null")
    hits = each.join(known, "fingerprint").groupBy("path", "offset").agg(F.min_by(F.struct("name", "key_use", "ref"), F.struct("order", "name")).alias("k"))
    # What a leaked key allows, by its use.
    impact = (
        F.when(F.col("k.key_use") == "host", "an attacker can impersonate/MITM this host (host key)")
        .when(F.col("k.key_use") == "authorized", "an attacker can log in with the public-domain private key")
        .otherwise("the matching private key is publicly available")
    )
    return hits.select("path", "offset", F.lit("leaked-key").alias("type"), F.lit("high").alias("severity"), F.lit(95).alias("confidence"), F.col("k.name").alias("label"), impact.alias("evidence"))


# Parameters of the curves, p, a, and the base point.
CURVE_PARAMETERS = {
    "secp256r1": (2**256 - 2**224 + 2**192 + 2**96 - 1, -3, 0x6B17D1F2E12C4247F8BCE6E563A440F277037D812DEB33A0F4A13945D898C296, 0x4FE342E2FE1A7F9B8EE7EB4A7C0F9E162BCE33576B315ECECBB6406837BF51F5),
    "secp384r1": (2**384 - 2**128 - 2**96 + 2**32 - 1, -3, 0xAA87CA22BE8B05378EB1C71EF320AD746E1D3B628BA79B9859F741E082542A385502F25DBF55296C3A545E3872760AB7, 0x3617DE4A96262C6F5D9E98BF9292DC29F8F41DBD289A147CE9DA3113B5F0B8C00A60B1CE1D7E819D7A431D7C90EA0E5F),
    "secp521r1": (2**521 - 1, -3, 0x00C6858E06B70404E9CD9E3ECB662395B4429C648139053FB521F828AF606B4D3DBAA14B5E77EFE75928FE1DC127A2FFA8DE3348B3C1856A429BF97E7E31C2E5BD66, 0x011839296A789A3BC0045C8A5FB42C7D1BD998F54449579B446817AFBD17273E662C97EE72995EF42640C550B9013FAD0761353C7086A272C24088BE94769FD16650),
    "secp256k1": (2**256 - 2**32 - 977, 0, 0x79BE667EF9DCBBAC55A06295CE870B07029BFCDB2DCE28D959F2815B16F81798, 0x483ADA7726A3C4655DA4FBFC0E1108A8FD17B448A68554199C47D08FFB10D4B8),
}


def multiples(curve: str, most: int) -> Iterator[tuple[int, int, int]]:
    """(d, x, y) of d times the base point, d from 1."""
    p, a, gx, gy = CURVE_PARAMETERS[curve]
    x, y = gx, gy
    for d in range(1, most + 1):
        yield d, x, y
        if (x, y) == (gx, gy):
            slope = (3 * x * x + a) * pow(2 * y, -1, p) % p
        elif x == gx:
            return
        else:
            slope = (y - gy) * pow(x - gx, -1, p) % p
        x2 = (slope * slope - x - gx) % p
        y = (slope * (gx - x2) - gy) % p
        x = x2


def scalar_table(spark: SparkSession, most: int = 4096) -> DataFrame:
    """(curve, x, y, d): the first ``most`` multiples of each base point, made in parallel by curve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for curve in batch.column(0).to_pylist():
                size = (CURVE_PARAMETERS[curve][0].bit_length() + 7) // 8
                rows = [(curve, x.to_bytes(size, "big"), y.to_bytes(size, "big"), d) for d, x, y in multiples(curve, most)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.binary()), pa.array(columns[3], pa.int64())], ["curve", "x", "y", "d"])

    names = spark.createDataFrame([(c,) for c in CURVE_PARAMETERS], "curve string").repartition(len(CURVE_PARAMETERS), "curve")
    return names.mapInArrow(run, "curve string, x binary, y binary, d bigint")


def small_scalars(keys: DataFrame, most: int = 4096) -> DataFrame:
    """``WEAK`` rows of EC keys whose private scalar is at most ``most``.

    Every key is held against the whole table by an equi-join; there is no budget per file.
    """
    points = keys.where("algo = 'EC' and x is not null").withColumn("size", F.octet_length("x"))
    hits = points.join(scalar_table(keys.sparkSession, most), ["curve", "x", "y"])
    note = F.concat(F.lit("private scalar recovered: d="), "d", F.lit(" on "), "curve")
    return hits.select("path", "offset", F.lit("ec-small-scalar").alias("type"), F.lit("high").alias("severity"), F.lit(95).alias("confidence"), "label", note.alias("evidence"))


def product_tree(values: list[int]) -> list[list[int]]:
    tree = [values]
    while len(tree[-1]) > 1:
        last = tree[-1]
        tree.append([last[i] * last[i + 1] if i + 1 < len(last) else last[i] for i in range(0, len(last), 2)])
    return tree


def remainders(product: int, tree: list[list[int]], square: bool) -> list[int]:
    """``product`` modulo each leaf of ``tree``, or modulo its square."""
    rest = [product]
    for level in reversed(tree):
        rest = [rest[i // 2] % (v * v if square else v) for i, v in enumerate(level)] if len(level) > 1 or len(rest) > 1 else [product % (level[0] ** 2 if square else level[0])]
    return rest


def shared_primes(keys: DataFrame, block: int = 2000, most_bits: int = 16384) -> DataFrame:
    """``WEAK`` rows of RSA keys that share a prime with another modulus of the table.

    Distinct moduli lie in blocks; each pair of blocks is one task that takes the product of one block
    modulo the (squared) leaves of the other by a remainder tree. Blocks, not pairs of keys, meet; every
    modulus of up to ``most_bits`` bits takes part.
    """
    rsa = keys.where(f"algo = 'RSA' and n is not null and bits between 2 and {most_bits}")
    distinct = rsa.select("n").distinct()
    blocks = int(distinct.count() // block) + 1
    placed = distinct.withColumn("b", F.pmod(F.xxhash64("n"), F.lit(blocks)).cast("int"))
    # Each modulus goes once to every pair of blocks that its own block is part of.
    partners = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    paired = partners.select("n", "b", F.least("b", "o").alias("lo"), F.greatest("b", "o").alias("hi"))

    def run(table: pa.Table) -> pa.Table:
        raw, of = table.column("n").to_pylist(), table.column("b").to_pylist()
        lo, hi = (table.column(c)[0].as_py() for c in ("lo", "hi")) if len(raw) else (0, 0)
        sides = {s: sorted({int.from_bytes(n, "big") for n, b in zip(raw, of, strict=True) if b == s}) for s in (lo, hi)}
        bad: set[int] = set()
        trees = {s: product_tree(v) for s, v in sides.items() if v}
        for mine, other in {(lo, hi), (hi, lo)}:
            if mine in trees and other in trees:
                whole = trees[other][-1][0]
                for n, r in zip(sides[mine], remainders(whole, trees[mine], mine == other), strict=True):
                    if math.gcd(r // n if mine == other else r, n) > 1:
                        bad.add(n)
        return pa.table({"n": pa.array([_be(n) for n in sorted(bad)], pa.binary())})

    hits = paired.groupBy("lo", "hi").applyInArrow(run, "n binary").distinct()
    return rsa.join(hits, "n").select("path", "offset", F.lit("shared-prime").alias("type"), F.lit("high").alias("severity"), F.lit(95).alias("confidence"), "label", F.lit("shares a prime factor with another key").alias("evidence"))


def fingerprint_corpus(files: DataFrame, key_use: str) -> DataFrame:
    """``(fingerprint, name, key_use, ref)`` of the keys in ``files(path, content binary)``: a corpus for ``leaked_keys``.

    Every fingerprint of a key is listed; the smallest path names it.
    """
    found = extract_keys(files)
    each = found.select("path", "label", F.explode(F.array("fp_ssh", "fp_modn", "fp_der")).alias("fingerprint")).where("fingerprint is not null")
    named = each.groupBy("fingerprint").agg(F.min("label").alias("name"), F.min("path").alias("ref"))
    return named.select("fingerprint", "name", F.lit(key_use).alias("key_use"), "ref")
