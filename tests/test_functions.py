import itertools
import random
from functools import cmp_to_key

import pytest
from pyspark.sql import functions as F

from tuffstone.functions import scoring, text, versions


def compare(a, b):
    """Order of two versions by their definition: alternating other and number runs of each part."""
    import re

    def parts(v):
        m = re.match(r"^([0-9]+):(.*)$", v, re.S)
        epoch, rest = (int(m[1]), m[2]) if m else (0, v)
        up, dash, rev = rest.rpartition("-")
        return epoch, (up if dash else rest), (rev if dash else "")

    def weight(c):
        return -1 if c == "~" else 0 if c == "" else ord(c) if c.isalpha() else ord(c) + 256

    def part(x, y):
        while x or y:
            i, j = re.match("[^0-9]*", x)[0], re.match("[^0-9]*", y)[0]
            for c, d in itertools.zip_longest(i, j, fillvalue=""):
                if weight(c) != weight(d):
                    return -1 if weight(c) < weight(d) else 1
            x, y = x[len(i) :], y[len(j) :]
            n, m = re.match("[0-9]*", x)[0], re.match("[0-9]*", y)[0]
            if int(n or 0) != int(m or 0):
                return -1 if int(n or 0) < int(m or 0) else 1
            x, y = x[len(n) :], y[len(m) :]
        return 0

    (e, u, r), (f, v, s) = parts(a), parts(b)
    return (e > f) - (e < f) or part(u, v) or part(r, s)


def test_version_key_orders_like_the_comparator(spark):
    rng = random.Random(3)
    known = ["1.0", "1.0~rc1", "1.0-1", "1:0.1", "1.0a", "1.0+b", "1.0.0", "", "0", "1.10", "1.9", "v1.2", "1.0-1~bpo", "00.1", "1.1.1m", "1.1.1n", "2:1.0-3+deb11u1", "1.0-r0"]
    made = ["".join(rng.choice("01239.ab~+-:") for _ in range(rng.randrange(1, 8))) for _ in range(150)]
    every = sorted({v for v in known + made if not v.startswith(":")})
    df = spark.createDataFrame([(v,) for v in every], "v string")
    keys = {r.v: r.k for r in df.select("v", versions.version_key(F.col("v")).alias("k")).collect()}
    for a, b in itertools.combinations(every, 2):
        got = (keys[a] > keys[b]) - (keys[a] < keys[b])
        assert got == compare(a, b), (a, b)
    assert sorted(every, key=cmp_to_key(compare))


@pytest.mark.parametrize(
    ("vector", "score"),
    [
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", 9.8),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:C/C:H/I:H/A:H", 10.0),
        ("CVSS:3.0/AV:L/AC:L/PR:L/UI:N/S:U/C:N/I:N/A:N", 0.0),
        ("CVSS:3.1/AV:N/AC:L/PR:N/UI:N/S:U/C:N/I:N/A:H", 7.5),
        ("AV:N/AC:L/Au:N/C:P/I:P/A:P", 7.5),
        ("AV:N/AC:L/Au:N/C:C/I:C/A:C", 10.0),
        ("CVSS:3.1/AV:N/AC:L", -1.0),
        ("CVSS:3.1/AV:X/AC:L/PR:N/UI:N/S:U/C:H/I:H/A:H", -1.0),
        ("", -1.0),
        (None, -1.0),
    ],
)
def test_base_scores(spark, vector, score):
    df = spark.createDataFrame([(vector,)], "v string")
    assert df.select(scoring.cvss_base_score(F.col("v"))).first()[0] == pytest.approx(score)


@pytest.mark.parametrize(
    ("glob", "path", "same"),
    [
        ("**/shadow", "shadow", True), ("**/shadow", "etc/shadow", True), ("**/shadow", "etc/shadow.bak", False), ("*.key", "a.key", True), ("*.key", "d/a.key", False),
        ("etc/**", "etc/a/b", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("**/*.pem", "x/y/z.pem", True), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True), ("a+b", "a+b", True),
    ],
)
def test_globs(spark, glob, path, same):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(F.col("p").rlike(text.glob_regex(glob))).first()[0] is same


def test_text_functions_on_nothing(spark):
    df = spark.createDataFrame([(None,), ("",), ("a",)], "t string")
    got = df.select(text.redact(F.col("t")), text.entropy(F.col("t")), text.is_placeholder(F.col("t")), text.basename(F.col("t")), text.jwt_fields(F.col("t"), F.lit(0))).collect()
    assert got[1][0] == "..." and got[1][1] == 0.0 and got[2][1] == 0.0
