"""Best representative of each group of duplicate component records.

Records of one image with the same package name and upstream version form a group. Field values are fused
by Bayesian voting: sources (the extractors) have unknown accuracies, sources that share false values depend
on each other, and a copied vote counts less. Accuracies and dependences are estimated from how often each
pattern of agreement occurs in the whole table; every value then gets a score from the set of sources that
claim it, and the value of the greatest posterior survives. The vote of a set of sources counts in full only where
its best stated confidence is full, and of values that stand equal the better ranked (more confident, then more
recent) one survives. Next to the fused values the operator names the rows of its group that stand first by
rank, field by field.

Everything is a combining aggregate over (group), (group, value) or (pattern): a group may hold any share of
the rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tuffstone.functions.text import stripped
from tuffstone.runtime import cut

FIELDS = ("version", "license")
GROUP = ["image_id", "name_key", "upstream"]
_ID_SPACE = "1000000000000000000"


def given(c: Column) -> Column:
    """Text with something in it, without outer blanks; else null."""
    return F.nullif(stripped(c), F.lit(""))


def name_key(c: Column) -> Column:
    """A package name without letter case, blanks and separators; null for none."""
    return F.nullif(F.regexp_replace(F.lower(c), r"[\s _.\-]+", ""), F.lit(""))


def bare_version(c: Column) -> Column:
    """A version in lower case without epoch and leading v."""
    return F.regexp_replace(F.lower(given(c)), r"^(?:[0-9]+:)?v?(?=[0-9])", "")


def upstream_version(c: Column) -> Column:
    """A version without epoch, leading v and packaging suffixes (``+dfsg``, ``-3+deb11u1``, ``-r4``, ``-9.el8``)."""
    return F.nullif(F.regexp_replace(bare_version(c), r"(?:\+(?:dfsg|ds|repack|git)[^-]*)?(?:-r?[0-9][0-9a-z.+~]*)?$", ""), F.lit(""))


def _rank() -> Column:
    """Smaller is better: usable confidence, then scan time, then comp_id, in one fixed-width number."""
    usable = F.col("confidence").between(0, 100)
    doubt = F.when(usable, 100 - F.col("confidence")).otherwise(101).cast("decimal(3,0)")
    age = F.coalesce(F.lit(9_000_000_000_000_000) - F.unix_micros(F.col("scanned_at").cast("timestamp")), F.lit(99_000_000_000_000_000)).cast("decimal(17,0)")
    high = (doubt * F.lit("100000000000000000").cast("decimal(18,0)")).cast("decimal(20,0)") + age
    return (high.cast("decimal(20,0)") * F.lit(_ID_SPACE).cast("decimal(19,0)")).cast("decimal(38,0)") + F.col("comp_id").cast("decimal(18,0)")


def _trust(rank: str) -> Column:
    """The confidence inside a rank in steps of ten, 0 to 10; unusable ones count as even odds."""
    doubt = (F.col(rank) / F.lit("100000000000000000000000000000000000").cast("decimal(36,0)")).cast("int")
    return F.when(doubt > 100, 5).otherwise(F.floor((100 - doubt) / 10)).cast("int")


def _row_of(rank: str) -> Column:
    """The comp_id inside a rank; 0 for none."""
    return F.coalesce((F.col(rank) % F.lit(_ID_SPACE).cast("decimal(19,0)")).cast("bigint"), F.lit(0))


@dataclass
class Sources:
    """Accuracy of each source and how likely each pair is dependent."""

    accuracy: dict[str, float]
    dependence: dict[tuple[str, str], float] = field(default_factory=dict)
    false_values: int = 10
    copy_rate: float = 0.8

    def score(self, names: list[str]) -> float:
        """Log odds for a value claimed by these sources, votes that may be copied discounted."""
        total, before = 0.0, []
        for s in sorted(names, key=lambda s: (-self.accuracy.get(s, 0.9), s)):
            a = self.accuracy.get(s, 0.9)
            alone = math.prod(1 - self.copy_rate * self.dependence.get((min(s, t), max(s, t)), 0.0) for t in before)
            total += math.log(self.false_values * a / (1 - a)) * alone
            before.append(s)
        return total


def fit(patterns: list[tuple[list[tuple[str, int]], int]], trust: dict[str, float] | None = None, rounds: int = 8, prior: float = 0.1, false_values: int = 10, copy_rate: float = 0.8) -> Sources:
    """Estimate ``Sources`` from patterns of agreement.

    A pattern lists, for one group and field, each set of sources (names joined by '|') that share a value
    and how many values they share so; its number is how many groups show it. ``trust`` gives the accuracy to
    start from (0.9 where it is silent).
    """
    return _fit(lambda model: _sums(model, patterns), trust, rounds, prior, false_values, copy_rate)


def _sums(model: Sources, patterns: Iterable[tuple[list[tuple[str, int]], int]]) -> tuple[dict, dict, dict, dict, dict]:
    """What a round of ``fit`` needs of patterns; sums of parts of them add up."""
    right, claims = defaultdict(float), defaultdict(float)
    same_true, same_false, differ = defaultdict(float), defaultdict(float), defaultdict(float)
    scores: dict[str, float] = {}
    for values, n in patterns:
        sets = [(key.split("|"), m, scores.setdefault(key, math.exp(min(60.0, model.score(key.split("|")))))) for key, m in values]
        norm = sum(m * e for _, m, e in sets) + max(0.0, model.false_values + 1 - sum(m for _, m, _ in sets))
        held: dict[str, int] = defaultdict(int)
        for members, m, e in sets:
            p = e / norm
            for s in members:
                right[s] += n * m * p
                claims[s] += n * m
                held[s] += m
            for i, s in enumerate(members):
                for t in members[i + 1 :]:
                    pair = (min(s, t), max(s, t))
                    same_true[pair] += n * m * p
                    same_false[pair] += n * m * (1 - p)
                    differ[pair] -= n * m
        present = sorted(held)
        for i, s in enumerate(present):
            for t in present[i + 1 :]:
                differ[s, t] += n * min(held[s], held[t])
    return right, claims, same_true, same_false, differ


def _fit(sums: Callable[[Sources], tuple], trust: dict[str, float] | None = None, rounds: int = 8, prior: float = 0.1, false_values: int = 10, copy_rate: float = 0.8) -> Sources:
    """``Sources`` by rounds over ``sums`` of all patterns under the model so far, from the accuracies in ``trust`` on.

    The first three rounds only seek dependence: votes counted before copies are known would make the most copied
    source the most accurate one, and later rounds could not undo that.
    """
    trust = trust or {}
    model = Sources(dict(trust), {}, false_values, copy_rate)
    for k in range(rounds):
        right, claims, same_true, same_false, differ = sums(model)
        model.accuracy = {s: min(0.99, max(0.05, (right[s] + 2.5 * trust.get(s, 0.9)) / (claims[s] + 2.5) if k >= 3 else trust.get(s, 0.9))) for s in sorted(claims)}
        model.dependence = {}
        for pair in differ:
            a, b = (model.accuracy[s] for s in pair)
            true, false = a * b, (1 - a) * (1 - b) / false_values
            other, both = max(1e-9, 1 - true - false), (a + b) / 2
            odds = math.log(prior / (1 - prior)) + same_false[pair] * math.log(((1 - both) * copy_rate + false * (1 - copy_rate)) / false)
            odds += same_true[pair] * math.log((both * copy_rate + true * (1 - copy_rate)) / true) + max(0.0, differ[pair]) * math.log(1 - copy_rate + 1e-12 * other)
            model.dependence[pair] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return model


def _folded(components: DataFrame) -> DataFrame:
    """Component rows folded to (image, name, upstream, source, version, license), with counts and best ranks.

    Repeated rows combine before the shuffle.
    """
    license_ = given(F.col("license"))
    rows = components.select(
        "image_id",
        name_key(F.col("name")).alias("name_key"),
        upstream_version(F.col("version")).alias("upstream"),
        F.coalesce(given(F.col("source")), F.lit("?")).alias("source"),
        bare_version(F.col("version")).alias("version"),
        F.regexp_replace(F.lower(license_), r"[^a-z0-9+.]+", "").alias("license"),
        "comp_id",
        _rank().alias("rank"),
    ).where("image_id is not null and name_key is not null")
    return rows.groupBy(*GROUP, "source", "version", "license").agg(F.count("*").alias("n"), F.min("comp_id").alias("first"), F.min("rank").alias("rank"))


def duplicate_groups(components: DataFrame) -> DataFrame:
    """One row per group of two or more records: counts, best ranks, and who claims what.

    ``claims`` is an array of (field, sources, trust, m, value) in order of rank: the sets of sources that share
    a value of a field with that confidence, how many values they share so and the best ranked of these; it holds
    one entry for each set of sources and step of confidence that occurs, whatever the number of records.
    Everything after the fold runs on one partitioning by image and name. Rows without version belong to the
    one upstream version of their name in the image; where the image has none of that name, they agree in
    stating none and form a group with upstream ''. Rows without image or name, and rows without version whose
    name has several upstream versions in the image, belong to no group.
    """
    rows = _folded(components).repartition("image_id", "name_key")
    by_name, by_group = Window.partitionBy("image_id", "name_key"), Window.partitionBy(*GROUP)
    least, most = F.min("upstream").over(by_name), F.max("upstream").over(by_name)
    placed = rows.withColumn("sole", F.when(least.isNull(), "").when(least == most, least)).withColumn("upstream", F.coalesce("upstream", "sole")).where("upstream is not null").drop("sole")
    several = placed.withColumn("together", F.sum("n").over(by_group)).where("together > 1").drop("together")
    # Whoever states the upstream version alone doesn't contradict a packaging suffix: it claims nothing about it.
    claimed = {"version": F.when(F.col("version") != F.col("upstream"), F.col("version")), "license": F.col("license")}
    parts = [F.struct(F.lit("").alias("field"), F.lit("").alias("value")), *[F.struct(F.lit(f).alias("field"), claimed[f].alias("value")) for f in FIELDS]]
    each = several.select(*GROUP, "source", "n", "first", "rank", *[F.when(F.col(f).isNotNull(), F.col("rank")).alias(f"{f}_rank") for f in FIELDS], F.explode(F.array(*parts)).alias("c"))
    ranks = ["rank", *[f"{f}_rank" for f in FIELDS]]
    folds = [F.sum("n").alias("n"), F.min("first").alias("first"), *[F.min(r).alias(r) for r in ranks]]
    by_value = each.where("c.value is not null").groupBy(*GROUP, "c.field", "c.value").agg(F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources"), *folds)
    by_value = by_value.withColumn("trust", _trust("rank"))
    by_sources = by_value.groupBy(*GROUP, "field", "sources", "trust").agg(F.count("*").alias("m"), F.min(F.struct("rank", "value")).alias("best"), *folds)
    whole = F.col("field") == ""
    return by_sources.groupBy(*GROUP).agg(
        F.sum(F.when(whole, F.col("n"))).alias("n_records"),
        F.min("first").alias("first_comp_id"),
        *[F.min(r).alias(r) for r in ranks],
        F.transform(
            F.array_sort(F.collect_list(F.when(~whole, F.struct("best", "field", "sources", "trust", "m")))),
            lambda c: F.struct(c["field"].alias("field"), c["sources"].alias("sources"), c["trust"].alias("trust"), c["m"].alias("m"), c["best"]["value"].alias("value")),
        ).alias("claims"),
    )


def stated_trust(components: DataFrame) -> dict[str, float]:
    """Mean usable confidence of each source as a share, within 0.3 and 0.95: what a source says of itself.

    As many numbers as there are kinds of sources come to the driver.
    """
    usable = F.avg(F.when(F.col("confidence").between(0, 100), F.col("confidence")))
    named = components.groupBy(F.coalesce(given(F.col("source")), F.lit("?")).alias("s")).agg((usable / 100).alias("a"))
    return {r.s: min(0.95, max(0.3, r.a)) for r in named.collect() if r.a is not None}


def fit_sources(groups: DataFrame, trust: dict[str, float] | None = None, max_patterns: int = 100_000, **options) -> Sources:
    """``Sources`` fitted on the agreement patterns of all ``duplicate_groups``.

    Patterns, not groups, come to the driver: a pattern is a list of source sets with counts, so there are
    few of them however many rows there are. Were there more than ``max_patterns``, they stay where they are
    and each round of the same fit sums them up in Spark; none is left out. The fit starts from the
    accuracies in ``trust``.
    """

    def shape(name: str) -> Column:
        mine = F.filter("claims", lambda c: c["field"] == name)
        return F.array_join(F.array_sort(F.transform(mine, lambda c: F.concat_ws("*", c["sources"], c["m"]))), ";")

    parts = [shape(f) for f in FIELDS]
    patterns = groups.select(F.explode(F.array(*parts)).alias("pattern")).where("pattern <> ''").groupBy("pattern").agg(F.count("*").alias("n"))
    some = patterns.limit(max_patterns + 1).collect()
    if len(some) <= max_patterns:
        return fit([(_values(r.pattern), r.n) for r in sorted(some, key=lambda r: (-r.n, r.pattern))], trust, **options)
    patterns = cut(patterns)

    def sums(model: Sources) -> tuple[dict, dict, dict, dict, dict]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                got = _sums(model, [(_values(p), n) for p, n in zip(batch.column("pattern").to_pylist(), batch.column("n").to_pylist(), strict=True)])
                rows = [(k, *(key if isinstance(key, tuple) else (key, "")), v) for k, part in enumerate(got) for key, v in part.items()]
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.string(), pa.float64()), strict=True)], ["k", "s", "t", "v"])

        out = tuple(defaultdict(float) for _ in range(5))
        for r in patterns.mapInArrow(run, "k int, s string, t string, v double").groupBy("k", "s", "t").agg(F.sum("v").alias("v")).collect():
            out[r.k][r.s if r.k < 2 else (r.s, r.t)] = r.v
        return out

    return _fit(sums, trust, **options)


def _values(pattern: str) -> list[tuple[str, int]]:
    return [(v.rpartition("*")[0], int(v.rpartition("*")[2])) for v in pattern.split(";")]


SURVIVOR = "image_id bigint, name_key string, upstream string, n_records bigint, first_comp_id bigint, keep_comp_id bigint, version_comp_id bigint, license_comp_id bigint, version string, version_posterior double, license string, license_posterior double"


def survivors(components: DataFrame, model: Sources | None = None) -> DataFrame:
    """One row ``SURVIVOR`` per group of two or more duplicate records.

    ``keep`` is the record with the highest usable confidence (0..100; null and others last), then the
    latest scan (null last), then the smallest comp_id; the two field rows are the first in that order that
    state the field, else 0. Fused values are lower-cased; versions come without epoch and leading v, with the
    packaging suffix of the greatest posterior, or as the upstream version if nobody states a suffix; a field nobody
    states is null with a null posterior. Repeated rows count as records. comp_id must lie below 10^18.
    """
    groups = cut(duplicate_groups(components))
    if model is None:
        model = fit_sources(groups, stated_trust(components))
    sent = components.sparkSession.sparkContext.broadcast(model)
    names = [c.split()[0] for c in SURVIVOR.split(", ")]
    same, last = [*GROUP, "n_records", "first_comp_id"], ["keep_comp_id", *[f"{f}_comp_id" for f in FIELDS]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple, float] = {}

        def weight(sources: str, trust: int) -> float:
            if (sources, trust) not in known:
                known[sources, trust] = math.exp(min(60.0, sent.value.score(sources.split("|")) * (0.5 + trust / 20)))
            return known[sources, trust]

        for batch in batches:
            fused: dict[str, list] = {c: [] for f in FIELDS for c in (f, f"{f}_posterior")}
            plain = zip(batch.column("upstream").to_pylist(), batch.column("version_comp_id").to_pylist(), strict=True)
            for claims, (upstream, stated) in zip(batch.column("claims").to_pylist(), plain, strict=True):
                for f in FIELDS:
                    mine = [(weight(c["sources"], c["trust"]), c["m"], c["value"]) for c in claims if c["field"] == f]
                    total = sum(w * m for w, m, _ in mine) + max(0, sent.value.false_values + 1 - sum(m for _, m, _ in mine))
                    best = max(mine, key=lambda c: c[0], default=None)  # the first of equals: claims come in order of rank
                    if best is None and f == "version" and stated:
                        fused[f].append(upstream)
                        fused[f"{f}_posterior"].append(1.0)
                        continue
                    fused[f].append(best and best[2])
                    fused[f"{f}_posterior"].append(best and best[0] / total)
            own = [pa.array(fused[c], pa.float64() if c.endswith("posterior") else pa.string()) for c in fused]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*same, *last)), *own], names)

    ids = [_row_of("rank").alias(last[0]), *[_row_of(f"{f}_rank").alias(f"{f}_comp_id") for f in FIELDS]]
    return groups.select(*same, *ids, "claims").mapInArrow(run, SURVIVOR)
