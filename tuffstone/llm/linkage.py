"""Entities matched across sources without keys: components against the products of an advisory table.

A product and its maker, in all their spellings, form an entity. Names of components are read into product
keys (case, separators, library prefix, maker prefix, sub-package and edition words, word order, clipped
role words, one typing error) and looked up in an index of the entities, which gives few candidates per
record. Each candidate becomes a vector of similarities: name, maker as told by evidence, fork or name, and
platform identifier. A regularised mixture of two Gaussians separates matched from unmatched vectors without
labels. Two entities are different things, so a record can match at most one: the expectation step shares
the evidence of all candidates of a record (transitivity). The posterior is the confidence.

Records are scored where they lie: no shuffle and no join, only the index travels.
"""

from __future__ import annotations

import json
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuffstone.runtime import cut, spread

# Words at the end of a maker's name that tell its legal form or kind.
MAKER_WORDS = ("incorporated", "foundation", "software", "networks", "systems", "project", "devices", "limited", "works", "group", "gmbh", "labs", "corp", "inc", "ltd", "llc")
# Endings of a name that tell a part, an edition or a copy of the same software.
PART_ENDS = (
    ("for", "embedded", "boards"), ("for", "embedded", "devices"), ("sdk", "copy"), ("3rd", "party"), ("third", "party"), ("patched",), ("embedded",), ("copy",), ("runtime",), ("static",),
    ("dev",), ("devel",), ("utils",), ("util",), ("tools",), ("common",), ("bin",), ("doc",), ("docs",), ("dbg",), ("debug",), ("data",), ("libs",), ("lib",), ("headers",), ("src",),
)
# Clipped spellings of words that tell the role of a program.
CLIPPED = {"agt": "agent", "crp": "crypt", "cch": "cache", "cr": "core", "rly": "relay", "ldr": "loader", "brg": "bridge", "srv": "server", "rtr": "router", "prx": "proxy", "cdc": "codec", "sh": "shell"}
ROLES = frozenset(CLIPPED.values())

MAKER_IN_EVIDENCE = re.compile(r"(?:maintainer:|maintained by|built by|\(c\)|copyright|origin|vendor:) +(.+?)[\s.;,]*$", re.IGNORECASE)
CPE = re.compile(r"^cpe:(?:2\.3:|/)[aoh]:([^:]*):([^:]*)", re.IGNORECASE)

#: Similarity where nothing is said: nearer to agreement (1) than to contradiction (0). An identifier of
#: another product contradicts the name, which counts more, so it is little worse than none.
SILENT = 0.7
#: Where the two classes start, and what two records' worth of prior holds them to: (name, maker, identifier).
UNMATCHED, MATCHED = np.array([0.95, 0.1, 0.4]), np.array([1.0, 0.85, 0.8])


def letters(text: str) -> str:
    return re.sub(r"[^a-z0-9]", "", text.lower())


def maker_key(text: str | None) -> str:
    """A maker without case, separators and legal form; '' for none."""
    key = letters(text or "")
    for word in MAKER_WORDS:
        if key.endswith(word) and len(key) - len(word) >= 3:
            return key[: -len(word)]
    return key


def product_key(text: str | None) -> str:
    key = letters(text or "")
    return key[3:] if key.startswith("lib") and len(key) >= 7 else key


def words(name: str) -> list[str]:
    """The words of a name; a change from lower to upper case begins one unless the name is all upper case."""
    name = name.replace("GmbH", "Gmbh").strip()
    if not name.isupper():
        name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    return [w for w in re.split(r"[^a-z0-9]+", name.lower()) if w]


def _core(parts: list[str]) -> list[str]:
    """Words of a name without ends that tell a part, numbers of an interface and the library prefix."""
    parts = list(parts)
    going = True
    while going and len(parts) > 1:
        going = False
        for end in PART_ENDS:
            if len(parts) > len(end) and tuple(parts[-len(end) :]) == end:
                parts, going = parts[: -len(end)], True
                break
        if not going and parts[-1].isdigit():
            parts, going = parts[:-1], True
    if parts:
        stem = re.sub(r"[0-9]+$", "", parts[-1])
        if len(stem) >= 3:
            parts[-1] = stem
        if parts[0] == "lib" and len(parts) > 1:
            parts = parts[1:]
        elif parts[0].startswith("lib") and len(parts[0]) >= 7:
            parts[0] = parts[0][3:]
    return parts


def near(a: str, b: str) -> bool:
    """One insertion, deletion, substitution or swap of neighbours apart."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def deletions(key: str) -> set[str]:
    return {key, *(key[:i] + key[i + 1 :] for i in range(len(key)))}


class Index:
    """Entities by product key, with the neighbourhood of one typing error.

    Typing errors are sought in keys of ``shortest_typo`` to ``longest_typo`` letters; a name of more than
    ``most_words`` words is one product key and nothing else.
    """

    def __init__(self, pairs: list[tuple[str, str]], shortest_typo: int = 6, longest_typo: int = 64, most_words: int = 32):
        spellings = defaultdict(set)
        for vendor, product in pairs:
            if maker_key(vendor) and product_key(product):
                spellings[maker_key(vendor), product_key(product)].add((vendor, product))
        self.spellings = {k: sorted(v) for k, v in spellings.items()}
        self.makers = defaultdict(set)
        for maker, product in spellings:
            self.makers[product].add(maker)
        self.all_makers = {m for m, _ in spellings}
        self.typos = defaultdict(set)
        self.shortest, self.longest, self.most_words = shortest_typo, longest_typo, most_words
        for product in self.makers:
            if shortest_typo <= len(product) <= longest_typo:
                for d in deletions(product):
                    self.typos[d].add(product)
        self.read: dict[str, list] = {}

    def products(self, name: str) -> list[tuple[str, float, str]]:
        """(product key, name similarity, maker told by the name) of the entities a name may mean."""
        got = self.read.get(name)
        if got is None:
            if len(self.read) > 300_000:
                self.read.clear()
            self.read[name] = got = chosen([self.lookup(name)])
        return got

    def lookup(self, name: str) -> tuple[int, list[tuple[str, bool, str, str, float]]]:
        """(stage, hits) of the first stage in which this index knows a form of the name.

        Stages are all words (0), without part words (1) and one typing error (2); a hit is (form, whether the
        form itself is a key, product key, maker told by the name, similarity).
        """
        all_words = words(name)
        if not all_words:
            return 0, []
        if len(all_words) > self.most_words:
            all_words = ["".join(all_words)]
        hits = []
        for stage, parts in enumerate((all_words, _core(all_words))):
            for k in range(len(parts)):
                rest, maker = parts[k:], maker_key("".join(parts[:k]))
                if k and len(maker) < 3:
                    continue
                stem = _core(rest)
                forms = [("".join(rest), 1.0), ("".join(stem), 1.0)]
                if len(stem) > 1 and stem[0] in ROLES:
                    forms.append(("".join([*stem[1:], stem[0]]), 0.95))
                if len(stem) > 1 and stem[-1] in CLIPPED:
                    forms.append(("".join([*stem[:-1], CLIPPED[stem[-1]]]), 0.92))
                if len(stem) > 1 and stem[0] in CLIPPED:
                    forms.append(("".join([*stem[1:], CLIPPED[stem[0]]]), 0.9))
                for form, similar in forms:
                    plain = form in self.makers
                    key = form if plain else product_key(form)
                    if key in self.makers:
                        hits.append((form, plain, key, maker, similar))
            if hits:
                return stage, hits
        stem = _core(all_words)
        for k in range(len(stem)):
            maker = maker_key("".join(stem[:k]))
            forms = {"".join(stem[k:])}
            if stem[-1] in CLIPPED and len(stem) - k > 1:
                forms.add("".join([*stem[k:-1], CLIPPED[stem[-1]]]))
            if stem[k] in ROLES and len(stem) - k > 1:
                forms.add("".join([*stem[k + 1 :], stem[k]]))
            for form in forms:
                if self.shortest <= len(form) <= self.longest + 1:
                    for product in {product for d in deletions(form) for product in self.typos.get(d, ())}:
                        if near(form, product):
                            hits.append((form, True, product, maker, 0.85))
        return 2, hits

    def candidates(self, name: str | None, evidence: str | None, cpe: str | None, fork: str | None) -> list[tuple[tuple[str, str], tuple[float, float, float]]]:
        """Entities a record may mean, each with its similarity vector (name, maker, platform identifier)."""
        products = self.products(name) if name else []
        return compared([(product, similar, by_name, self.makers[product]) for product, similar, by_name in products], evidence, cpe, fork)


def chosen(found: list[tuple[int, list[tuple[str, bool, str, str, float]]]]) -> list[tuple[str, float, str]]:
    """The products a name may mean of what ``Index.lookup`` gives for it in all blocks of the index.

    The first stage in which any block knows the name counts, a form that is a key itself stands for no other
    key, and of the products the longest are taken: one block or many give the same.
    """
    stage = min((stage for stage, hits in found if hits), default=0)
    hits = [hit for at, part in found if at == stage for hit in part]
    keys = {form for form, plain, *_ in hits if plain}
    best: dict[str, tuple[float, str]] = {}
    for form, plain, product, maker, similar in hits:
        if not plain and form in keys:
            continue
        # Of equal ones the shortest maker, then the first in order.
        if product not in best or (-similar, len(maker), maker) < (-best[product][0], len(best[product][1]), best[product][1]):
            best[product] = (similar, maker)
    longest = max((len(p) for p in best), default=0)
    return [(p, s, m) for p, (s, m) in sorted(best.items()) if len(p) == longest or s == 1.0 and not m]


def compared(products: list[tuple[str, float, str, Iterable[str]]], evidence: str | None, cpe: str | None, fork: str | None) -> list[tuple[tuple[str, str], tuple[float, float, float]]]:
    """The entities of ``products``, (product key, name similarity, maker told by the name, makers), with their vectors."""
    if not products:
        return []
    told = MAKER_IN_EVIDENCE.search(evidence) if evidence else None
    by_evidence = maker_key(told[1]) if told else ""
    by_fork = maker_key(re.sub(r"(?i)\s*sdk\s*$", "", fork)) if fork else ""
    spec = CPE.match(cpe.strip()) if cpe else None
    cpe_maker, cpe_product = (maker_key(spec[1]), product_key(spec[2])) if spec else ("", "")
    out = []
    for product, similar, by_name, makers in products:
        for maker in sorted(makers):
            hints = [h for h in (by_evidence, by_fork, by_name) if h]
            agrees = SILENT if not hints else sum(1.0 if h == maker else 0.8 if len(h) > 5 and near(h, maker) else 0.0 for h in hints) / len(hints)
            if not spec:
                platform = SILENT
            elif cpe_product != product:
                platform = SILENT - 0.1
            elif not cpe_maker:
                platform = SILENT + 0.15
            else:
                platform = 1.0 if cpe_maker == maker else 0.0
            out.append(((maker, product), (similar, round(agrees, 2), platform)))
    return out


@dataclass
class Mixture:
    """Two Gaussians over similarity vectors; class 1 is the matched one."""

    weight: float
    means: np.ndarray
    spreads: np.ndarray

    def odds(self, x: np.ndarray) -> np.ndarray:
        """Prior times density ratio, matched to unmatched, of each row of ``x``."""
        logs = []
        for mean, spread in zip(self.means, self.spreads, strict=True):
            d = x - mean
            logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(spread), d) - 0.5 * np.log(np.linalg.det(spread)))
        ratio = logs[1] - logs[0] + np.log(self.weight / (1 - self.weight))
        return np.exp(np.clip(ratio, -50, 50))


def fit(patterns: list[tuple[list[tuple[float, ...]], int]], rounds: int = 40, ridge: float = 0.01) -> Mixture:
    """Expectation maximisation without labels.

    A pattern is the list of candidate vectors of one record, its number how many records show it. In the
    expectation step the candidates of a record and the case that none matches share a mass of 1.
    Covariances are regularised by ``ridge``; the start takes each vector for the class it lies nearer to.
    """
    return _fit(lambda model: _moments(model, patterns), rounds, ridge)


def _moments(model: Mixture | None, patterns: list[tuple[list[tuple[float, ...]], int]]) -> np.ndarray:
    """Weight, sum and square sum of vectors of either class under ``model``; moments of parts of patterns add up."""
    x = np.array([v for vectors, _ in patterns for v in vectors], float).reshape(-1, 3)
    n = np.array([k for vectors, k in patterns for _ in vectors], float)
    if model is None:
        p = np.where(((x - MATCHED) ** 2).sum(1) < ((x - UNMATCHED) ** 2).sum(1), 0.95, 0.05)
    else:
        record = np.repeat(np.arange(len(patterns)), [len(vectors) for vectors, _ in patterns])
        odds = model.odds(x)
        p = odds / (1 + np.bincount(record, odds, len(patterns))[record])
    return np.array([[w.sum(), *(w @ x), *((x * w[:, None]).T @ x).ravel()] for w in (n * (1 - p), n * p)])


def _fit(moments: Callable[[Mixture | None], np.ndarray], rounds: int = 40, ridge: float = 0.01) -> Mixture:
    """``Mixture`` by rounds over the ``moments`` of all patterns under the model so far."""
    model = None
    for _ in range(rounds):
        both, means, spreads = moments(model), [], []
        total = both[:, 0].sum()
        if not total:
            return Mixture(0.5, np.array([UNMATCHED, MATCHED]), np.array([np.eye(3) * 0.05] * 2))
        for row, base in zip(both, (UNMATCHED, MATCHED), strict=True):
            weight, first, second = row[0], row[1:4], row[4:].reshape(3, 3)
            mean = (first + 2 * base) / (weight + 2)
            around = second - np.outer(first, mean) - np.outer(mean, first) + weight * np.outer(mean, mean)
            spreads.append(around / (weight + 2) + np.eye(3) * ridge)
            means.append(mean)
        model = Mixture(float(np.clip(both[1, 0] / total, 0.05, 0.95)), np.array(means), np.array(spreads))
    return model


def _index_blocks(entries: DataFrame, block: int) -> Iterator[list[tuple[str, str]]]:
    """Distinct (vendor, product) pairs in blocks of about ``block``."""
    pairs = entries.select("vendor", "product").where("vendor is not null and product is not null").distinct()
    blocks = int(pairs.count() // block) + 1
    parts = [pairs] if blocks == 1 else [pairs.where(F.pmod(F.xxhash64("vendor", "product"), F.lit(blocks)) == b) for b in range(blocks)]
    for part in parts:
        yield [(r.vendor, r.product) for r in part.collect()]


_READ = ["name", "evidence", "cpe", "fork"]


def _named(components: DataFrame, *more: str) -> DataFrame:
    return components.select(*more, *_READ).where("name is not null")


def _meant(records: DataFrame, first: Broadcast, rest: Iterable[Broadcast]) -> DataFrame:
    """``records`` that mean any product, with ``entities``: the products of their name over all blocks of the index.

    Each distinct name is looked up in each block; what the blocks know is put together by name, so a record
    sees the candidates it would see in one index.
    """
    names = cut(records.select("name").distinct())
    parts = []
    for sent in (first, *rest):

        def look(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(sent.value)
            for batch in batches:
                got = [(name, *index.lookup(name)) for name in batch.column("name").to_pylist()]
                told = []
                for name, stage, hits in got:
                    if hits:
                        entities = {key: [(m, index.spellings[m, key]) for m in index.makers[key]] for _, _, key, _, _ in hits}
                        told.append((name, json.dumps([stage, hits, entities])))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in ([n for n, _ in told], [t for _, t in told])], ["name", "told"])

        parts.append(spread(names).mapInArrow(look, "name string, told string"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for told in batch.column("told").to_pylist():
                blocks = [json.loads(t) for t in told]
                makers: dict[str, dict[str, set]] = defaultdict(lambda: defaultdict(set))
                for _, _, entities in blocks:
                    for product, known in entities.items():
                        for maker, spellings in known:
                            makers[product][maker].update(map(tuple, spellings))
                products = chosen([(stage, hits) for stage, hits, _ in blocks])
                out.append(json.dumps([(*p, [(m, sorted(v)) for m, v in sorted(makers[p[0]].items())]) for p in products]))
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(out, pa.string())], ["name", "entities"])

    told = parts[0]
    for part in parts[1:]:
        told = told.unionByName(part)
    by_name = told.groupBy("name").agg(F.collect_list("told").alias("told"))
    return records.join(cut(by_name.mapInArrow(join, "name string, entities string")), "name")


def _candidates(batch: pa.RecordBatch, index: Index | None, parsed: dict[str, tuple]) -> Iterator[tuple[list, dict]]:
    """(candidates, spellings by entity) of each row: by ``index``, or by the column ``entities`` if there is none."""
    rows = zip(*(batch.column(c).to_pylist() for c in _READ), strict=True)
    if index is not None:
        for row in rows:
            yield index.candidates(*row), index.spellings
        return
    for entities, (_, evidence, cpe, fork) in zip(batch.column("entities").to_pylist(), rows, strict=True):
        if entities not in parsed:
            if len(parsed) > 10_000:
                parsed.clear()
            products = json.loads(entities)
            parsed[entities] = [(p, s, m, [k for k, _ in makers]) for p, s, m, makers in products], {(k, p): v for p, _, _, makers in products for k, v in makers}
        products, spellings = parsed[entities]
        yield compared(products, evidence, cpe, fork), spellings


def fit_mixture(components: DataFrame, pairs: list[tuple[str, str]], max_patterns: int = 50_000) -> Mixture:
    """``Mixture`` of the candidate vectors of all records against the entities of ``pairs``."""
    return _fit_records(_named(components), components.sparkSession.sparkContext.broadcast(pairs), max_patterns)


def _fit_records(records: DataFrame, sent: Broadcast | None, max_patterns: int = 50_000) -> Mixture:
    """``Mixture`` of the candidate vectors of all records, folded to patterns in each task.

    Vectors lie on a coarse grid, so there are few patterns however many records there are; were there more
    than ``max_patterns``, they stay where they are and each round of the same fit sums them up in Spark.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, parsed, seen = sent and Index(sent.value), {}, Counter()
        for batch in batches:
            for got, _ in _candidates(batch, index, parsed):
                if got:
                    seen[";".join(sorted(",".join(map(str, v)) for _, v in got))] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["pattern", "n"])

    folded = spread(records).mapInArrow(run, "pattern string, n bigint").groupBy("pattern").agg(F.sum("n").alias("n"))
    table = cut(folded)
    some = table.limit(max_patterns + 1).collect()
    if len(some) <= max_patterns:
        return fit([(_vectors(r.pattern), r.n) for r in sorted(some, key=lambda r: (-r.n, r.pattern))])

    def moments(model: Mixture | None) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros((2, 13))
            for batch in batches:
                total += _moments(model, [(_vectors(p), n) for p, n in zip(batch.column("pattern").to_pylist(), batch.column("n").to_pylist(), strict=True)])
            yield pa.RecordBatch.from_arrays([pa.array([total.ravel().tolist()], pa.list_(pa.float64()))], ["sums"])

        return np.sum([r.sums for r in table.mapInArrow(run, "sums array<double>").collect()], axis=0).reshape(2, 13)

    return _fit(moments)


def _vectors(pattern: str) -> list[tuple[float, ...]]:
    return [tuple(map(float, v.split(","))) for v in pattern.split(";")]


MATCH = "comp_id bigint, vendor string, product string, confidence double"


def matches(components: DataFrame, entries: DataFrame, least: float = 0.5, block: int = 30_000, model: Mixture | None = None) -> DataFrame:
    """``MATCH`` rows: each record with every spelling of the one entity it means, if any.

    ``confidence`` is the posterior of the match and exceeds ``least``. Records without a name match nothing;
    other empty fields only lack evidence. A record delivered twice is matched twice, repeated advisory
    rows change nothing. The index is broadcast in blocks of about ``block`` spellings; with more than one
    block the products of each name are put together over all blocks before records are compared with them,
    for the fit as for the matches, so the number of blocks doesn't change the result.
    """
    context = components.sparkSession.sparkContext
    first, *rest = (context.broadcast(pairs) for pairs in _index_blocks(entries, block))
    records, sent = _named(components, "comp_id"), None if rest else first
    if rest:
        records = _meant(records, first, rest)
    if model is None:
        model = _fit_records(records, sent)
    mixture = context.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, parsed = sent and Index(sent.value), {}
        known: dict[tuple, float] = {}
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for comp_id, (got, spellings) in zip(batch.column("comp_id").to_pylist(), _candidates(batch, index, parsed), strict=True):
                for _, v in got:
                    if v not in known:
                        known[v] = float(mixture.value.odds(np.array([v]))[0])
                total = 1 + sum(known[v] for _, v in got)
                for entity, v in got:
                    share = known[v] / total
                    if share > least:
                        for vendor, product in spellings[entity]:
                            for column, value in zip(out, (comp_id, vendor, product, share), strict=True):
                                column.append(value)
            kinds = [pa.int64(), pa.string(), pa.string(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], [x.split()[0] for x in MATCH.split(", ")])

    return spread(records).mapInArrow(run, MATCH)
