"""Scores and gates of advisories as expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def metric(vector: Column, name: str) -> Column:
    """The value letter of a metric, '' if the vector has none; the first counts where one stands twice."""
    return F.regexp_extract(F.concat(F.lit("/"), F.coalesce(vector, F.lit(""))), f"/{name}:([^/])", 1)


def _weights(vector: Column, name: str, values: dict[str, float]) -> Column:
    letter = metric(vector, name)
    return reduce(lambda c, kv: c.when(letter == kv[0], kv[1]), values.items(), F.when(F.lit(False), 0.0))


# Metric weights of the published scoring systems, versions 3.x and 2.
V3 = {"AV": {"N": 0.85, "A": 0.62, "L": 0.55, "P": 0.2}, "AC": {"L": 0.77, "H": 0.44}, "UI": {"N": 0.85, "R": 0.62}}
V3_PRIVILEGES = {"U": {"N": 0.85, "L": 0.62, "H": 0.27}, "C": {"N": 0.85, "L": 0.68, "H": 0.5}}
V3_IMPACT = {"H": 0.56, "L": 0.22, "N": 0.0}
V2 = {"AV": {"N": 1.0, "A": 0.646, "L": 0.395}, "AC": {"L": 0.71, "M": 0.61, "H": 0.35}, "Au": {"N": 0.704, "S": 0.56, "M": 0.45}}
V2_IMPACT = {"N": 0.0, "P": 0.275, "C": 0.66}


def _product(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, parts)


def cvss_base_score(vector: Column) -> Column:
    """Base score of a version 3 or 2 vector; -1 for a vector that is incomplete, unknown or null.

    Version 3 scores are rounded up to a tenth in floating point.
    """
    scope = metric(vector, "S")
    privileges = F.when(scope == "C", _weights(vector, "PR", V3_PRIVILEGES["C"])).when(scope != "", _weights(vector, "PR", V3_PRIVILEGES["U"]))
    lost = 1 - _product([1 - _weights(vector, k, V3_IMPACT) for k in "CIA"])
    felt = F.when(scope == "C", (lost - 0.029) * 7.52 - F.pow(lost - 0.02, F.lit(15.0)) * 3.25).otherwise(lost * 6.42)
    ease = _product([F.lit(8.22), _weights(vector, "AV", V3["AV"]), _weights(vector, "AC", V3["AC"]), privileges, _weights(vector, "UI", V3["UI"])])
    raw = F.when(scope == "C", (felt + ease) * 1.08).otherwise(felt + ease)
    three = F.when((felt + ease).isNull(), None).when(felt <= 0, 0.0).otherwise(F.ceil(F.least(raw, F.lit(10.0)) * 10) / 10)
    hurt = (1 - _product([1 - _weights(vector, k, V2_IMPACT) for k in "CIA"])) * 10.41
    reach = _product([F.lit(20.0), *(_weights(vector, k, V2[k]) for k in ("AV", "AC", "Au"))])
    two = F.when((hurt + reach).isNull(), None).when(hurt == 0, 0.0).otherwise(F.round(F.greatest((hurt * 0.6 + reach * 0.4 - 1.5) * 1.176, F.lit(0.0)) * 10) / 10)
    score = F.when(vector.startswith("CVSS:3."), three).when(metric(vector, "Au") != "", two)
    return F.coalesce(score.cast("double"), F.lit(-1.0))


def canonical_cve(advisory: Column) -> Column:
    """The CVE number inside an advisory id, else the id."""
    return F.coalesce(F.nullif(F.regexp_extract(advisory, r"CVE-[0-9]+-[0-9]+", 0), F.lit("")), advisory)


def cvss_rank(vector: Column) -> Column:
    """Richness of a vector: 3.1, 3.0, any other, none."""
    return F.when(vector.startswith("CVSS:3.1"), 3).when(vector.startswith("CVSS:3.0"), 2).when(F.coalesce(vector, F.lit("")) != "", 1).otherwise(0)


def high_signal(vector: Column, score: Column, kev: Column, epss: Column, fork: Column, unbounded_below: Column) -> Column:
    """Whether a match is worth showing first: exploited, critical, or serious, likely and easy.

    ``score`` is the base score of ``vector``, computed once per distinct vector by the caller.
    """
    touches = lambda k: ~metric(vector, k).isin("", "N")
    easy = (metric(vector, "AC") == "L") & (touches("C") | touches("I") | ((metric(vector, "AV") == "N") & (epss >= 0.70)))
    return kev | (~(fork & unbounded_below) & ((score >= 9.0) | ((score >= 7.0) & (epss >= 0.10) & easy)))


def severity_rank(evidence: Column) -> Column:
    return F.when(evidence.startswith("[high]"), 0).when(evidence.startswith("[medium]"), 1).otherwise(2)
