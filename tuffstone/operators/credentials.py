"""Credential stores and configuration files."""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tuffstone.functions.text import PLACEHOLDERS, basename
from tuffstone.operators.secrets import FINDING, TIERS, finding_batch, redacted, shannon

# Prefixes of password hashes, their algorithm and whether it is weak.
HASHES = (
    (r"\$1\$", "md5crypt", True), (r"\$apr1\$", "apr1-md5", True), (r"\$2[aby]\$", "bcrypt", False), (r"\$5\$", "sha256crypt", False), (r"\$6\$", "sha512crypt", False),
    (r"\$7\$", "scrypt", False), (r"\$y\$", "yescrypt", False), (r"\$gy\$", "gost-yescrypt", False), (r"\{SHA\}", "sha1-base64", True), (r"[A-Za-z0-9./]{13}$", "descrypt", True),
)
# Normalised names of fields that hold a short secret, and of those that hold a long one.
PIN_KEYS = ("passwd", "password", "passcode", "pass", "passphrase", "pin", "pincode", "psk", "presharedkey", "sharedkey", "wpakey", "wepkey", "wifikey", "wlankey")
TOKEN_KEYS = ("secret", "apikey", "token", "authtoken", "accesstoken", "refreshtoken", "privatekey", "credential", "credentials", "clientsecret", "consumersecret", "appsecret", "sessionkey", "authkey")
WIFI_KEYS = ("psk", "presharedkey", "sharedkey", "wpakey", "wepkey", "wifikey", "wlankey")
COVERED_KEYS = ("password", "passwd", "secret", "apikey", "accesstoken", "authtoken", "privatekey")
# Values that are defaults, states or types rather than credentials.
DEFAULT_VALUES = (
    "admin", "administrator", "default", "password", "passwd", "pass", "none", "null", "nil", "na", "n/a", "root", "guest", "user", "enable", "disable", "enabled", "disabled",
    "true", "false", "yes", "no", "on", "off", "test", "unknown", "undefined", "empty", "set", "unset", "value",
)


def hash_algorithm(value: Column) -> Column:
    """Algorithm of a stored password hash; null if it is none."""
    out = F.when(F.lit(False), F.lit(""))
    for pattern, name, _ in HASHES:
        out = out.when(value.rlike("^" + pattern), name)
    return out


def is_weak_hash(algorithm: Column) -> Column:
    return algorithm.isin(*[name for _, name, weak in HASHES if weak])


def password_files(files: DataFrame) -> DataFrame:
    """Accounts of shadow and htpasswd files in ``files(path, content string)``.

    Rows (path, offset, user, type, algorithm, weak); the offset is that of the hash in bytes, of the line
    for an empty password. Locked accounts, comments and unknown hashes give none; in htpasswd files an
    empty hash gives none.
    """
    name = basename(F.col("path"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, shadow, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lines = text.encode().split(b"\n")
                ends = accumulate((len(x) + 1 for x in lines), initial=0)
                at = pa.array(list(ends)[:-1], pa.int64())
                texts = pa.array([x.decode().removesuffix("\r") for x in lines], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([shadow] * len(lines), pa.bool_()), texts, at], ["path", "shadow", "line", "at"])

    named = files.where(name.isin("shadow", "htpasswd", ".htpasswd") & F.col("content").isNotNull()).select("path", (name == "shadow").alias("shadow"), "content")
    line = named.mapInArrow(split, "path string, shadow boolean, line string, at bigint")
    parts = line.where(~F.col("line").startswith("#") & F.col("line").contains(":")).select(
        "path", "shadow", "at", F.get(F.split("line", ":"), 0).alias("user"),
        F.when(F.col("shadow"), F.get(F.split("line", ":"), 1)).otherwise(F.regexp_extract("line", "^[^:]*:(.*)$", 1)).alias("hash"),
    )
    known = parts.where("user <> ''").withColumn("algorithm", hash_algorithm(F.col("hash")))
    empty = F.col("shadow") & (F.col("hash") == "")
    type_ = F.when(empty, "empty-password").when(F.col("shadow"), "password-hash").otherwise("htpasswd-hash")
    offset = F.when(empty, F.col("at")).otherwise(F.col("at") + F.octet_length("user") + 1)
    hits = known.where(empty | (F.col("algorithm").isNotNull() & ~F.col("hash").rlike("^[*!]")))
    return hits.select("path", offset.cast("bigint").alias("offset"), "user", type_.alias("type"), "algorithm", F.coalesce(is_weak_hash(F.col("algorithm")), F.lit(False)).alias("weak"))


def _decoded(value: str) -> tuple[str, str] | None:
    """(encoding, text) of a value that decodes to mostly printable text."""
    tries = []
    if len(value) >= 4 and len(value) % 4 == 0 and re.fullmatch(r"[A-Za-z0-9+/]*={0,2}", value):
        tries.append(("base64", lambda: base64.b64decode(value)))
    if len(value) >= 4 and len(value) % 2 == 0 and re.fullmatch(r"[0-9A-Fa-f]+", value):
        tries.append(("hex", lambda: bytes.fromhex(value)))
    for name, get in tries:
        try:
            raw = get()
        except (ValueError, binascii.Error):
            continue
        if raw and sum(b == 9 or 32 <= b < 127 for b in raw) * 100 >= len(raw) * 80:
            return name, raw.decode("latin-1")
    return None


def is_default_value(value: str) -> bool:
    low = value.lower()
    return not value or len(set(value)) == 1 or low in DEFAULT_VALUES or any(w in low for w in PLACEHOLDERS)


def judge(key: str, value: str, numeric: bool) -> tuple[str, int, str | None] | None:
    """(type, tier, encoding) of a named configuration value that is a credential."""
    name = re.sub(r"[^a-z0-9]", "", key.lower())
    if not (name in PIN_KEYS or name in TOKEN_KEYS) or not value.strip() or is_default_value(value):
        return None
    open_text = None if numeric else _decoded(value)
    if open_text and is_default_value(open_text[1]):
        open_text = None
    if open_text is None:
        if name in TOKEN_KEYS and (numeric or len(value) < 8):
            return None
        if len(value) >= 16 and name in COVERED_KEYS and shannon(value.encode()) >= 3.5:
            return None
    kind = "config-wifi-key" if name in WIFI_KEYS else "config-password" if name in PIN_KEYS else "config-secret"
    return kind, 80 if open_text else 60, open_text and open_text[0]


def scan_config(path: str | None, text: str) -> list[tuple]:
    """``FINDING`` tuples of one JSON document, in document order; every field of it is judged."""
    try:
        root = json.loads(text)
    except (ValueError, RecursionError):
        return []
    rows: list[tuple] = []
    stack: list[tuple[str, str, object]] = [("", "", root)]
    while stack:
        at, key, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{at}.{k}" if at else k, k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            stack += [(f"{at}[]", key, v) for v in reversed(value)]
        elif not isinstance(value, bool) and value is not None:
            numeric = not isinstance(value, str)
            if numeric and not (0 <= value <= 1e12 and value == int(value)):
                continue
            shown = str(int(value)) if numeric else value
            got = judge(key, shown, numeric)
            if got:
                kind, tier, encoding = got
                evidence = f"config key + {encoding}-decoded value" if encoding else "config key + non-placeholder value"
                label = redacted(shown) + (f" ({encoding})" if encoding else "")
                rows.append((path, 0, len(shown), kind, "config-credential", tier, TIERS[tier], evidence, label, f"Credential field `{at}`"))
    return rows


def config_credentials(files: DataFrame) -> DataFrame:
    """``FINDING`` rows of the JSON documents of any size among ``files(path, content string)``."""
    keys = "|".join(sorted({*PIN_KEYS, *TOKEN_KEYS}))
    loose = F.regexp_replace(F.lower("content"), r"[^a-z0-9\"]", "")
    likely = files.where(F.col("content").rlike(r"^[ \t\r\n]*[{\[]")).where(loose.rlike(f'(?:{keys})"'))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True)
            yield finding_batch([f for path, text in pairs for f in scan_config(path, text)])

    return likely.select("path", "content").mapInArrow(run, FINDING)
