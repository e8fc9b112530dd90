"""Text functions of the content scanners, as expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
# Words that mark a token as a placeholder.
PLACEHOLDERS = ("example", "sample", "changeme", "placeholder", "your_", "yourkey", "test_key", "notreal", "redacted", "dummy", "xxxxxx", "aaaaaa", "000000", "<your", "insert_")

#: Everything without ink that may surround a value: blanks of any kind, line ends, controls, zero-width marks.
BLANKS = "".join(c for c in map(chr, range(0x10000)) if unicodedata.category(c) in ("Zs", "Zl", "Zp", "Cc") or c in "\u200b\u2060\ufeff")


def stripped(text: Column) -> Column:
    """Text without outer blanks of any kind (spaces, tabs, line ends, no-break spaces, controls); null stays null."""
    return F.trim(text, F.lit(BLANKS))


def with_blanks_stripped(sql: str) -> str:
    """SQL the tests compare with, each ``bare(x)`` in it spelled out: ``x`` without outer blanks, by character classes."""
    ends = r"[\s\p{Z}\p{Cc}\x{200B}\x{2060}\x{FEFF}]+"
    while (at := re.search(r"\bbare\(", sql)) is not None:
        stop, depth = at.end(), 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[stop], 0)
            stop += 1
        sql = f"{sql[: at.start()]}regexp_replace({sql[at.end() : stop - 1]}, '^{ends}|{ends}$', '', 'g'){sql[stop:]}"
    return sql


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def owning_root(path: Column, suffix: str) -> Column:
    """The part of ``path`` before ``suffix`` as whole trailing segments; null if it doesn't end so."""
    pattern = "^(?:(.*)/)?" + re.escape(suffix) + "$"
    return F.when(path.rlike(pattern), F.regexp_extract(path, pattern, 1))


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``*`` and ``?`` stay in a segment, ``**/`` spans any number of
    segments and none, a closing ``**`` or ``**/`` spans everything."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**", i):
            whole = glob.startswith("**/", i)
            rest = glob[i + (3 if whole else 2) :]
            out += "(?:[^/]*/)*" if whole and rest else ".*"
            i += 3 if whole else 2
        elif glob[i] in "*?":
            out += "[^/]*" if glob[i] == "*" else "[^/]"
            i += 1
        else:
            out += re.escape(glob[i])
            i += 1
    return f"^(?s:{out})$"


def redact(token: Column) -> Column:
    return F.when(F.length(token) <= 10, F.concat(F.left(token, F.lit(3)), F.lit("..."))).otherwise(F.concat(F.left(token, F.lit(4)), F.lit("..."), F.right(token, F.lit(4))))


def is_placeholder(token: Column) -> Column:
    return F.lower(token).rlike("|".join(map(re.escape, PLACEHOLDERS)))


def entropy(token: Column) -> Column:
    """Shannon entropy in bits per character; 0 for empty text."""
    n = F.length(token)
    counts = F.transform(F.array_distinct(F.split(token, "")), lambda c: (n - F.length(F.replace(token, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(counts, F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def base62_checksum(body: Column) -> Column:
    """Six base-62 digits of the CRC-32 of a token body."""
    crc = F.crc32(body)
    digit = lambda d: F.substr(F.lit(BASE62), (F.floor(crc / F.lit(d)) % 62 + 1).cast("int"), F.lit(1))
    return F.concat(*[digit(62**k) for k in range(5, -1, -1)])


def base64_text(segment: Column) -> Column:
    """Text of a base64 or base64url segment without padding; null if it doesn't decode."""
    bare = F.regexp_extract(F.translate(segment, "-_", "+/"), r"^([A-Za-z0-9+/]*)", 1)
    cut = F.when(F.length(bare) % 4 == 1, F.left(bare, F.length(bare) - 1)).otherwise(bare)
    padded = F.rpad(cut, (F.ceil(F.length(cut) / 4) * 4).cast("int"), F.lit("="))
    return F.try_to_binary(padded, F.lit("base64")).cast("string")


def jwt_fields(token: Column, now: Column) -> Column:
    """Struct (ok, alg, exp, expired) of a web token; ``now`` is epoch seconds."""
    parts = F.split(token, r"\.")
    head, body = base64_text(F.get(parts, 0)), base64_text(F.get(parts, 1))
    exp = F.get_json_object(body, "$.exp").try_cast("bigint")
    ok = F.get_json_object(head, "$").startswith("{")
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), F.get_json_object(head, "$.alg").alias("alg"), exp.alias("exp"), F.coalesce((exp > 0) & (exp < now), F.lit(False)).alias("expired"))
