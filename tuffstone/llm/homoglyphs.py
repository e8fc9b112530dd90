"""One consistent form for text that looks the same.

A vocabulary of the corpus' own words is laid out as a trie. Each distinct token is run through it by an
edit automaton in which look-alike letters and characters without ink cost nothing and any other
difference costs 1; the reachable word (the most frequent, then the first in order) is the canonical
spelling. Tokens that reach no word are spelled by table. Which words a token reaches depends only on how
it looks, so texts that look the same get one form whatever the vocabulary holds.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuffstone.llm import looks
from tuffstone.runtime import cut, spread

TOKEN = re.compile(r"[^\W_]+(?:[̀-ͯ]+[^\W_]*)*")
MAX_WORD = 40


class Trie:
    """Words with counts; matched by an automaton with a bounded cost."""

    def __init__(self, words: Iterable[tuple[str, int]]):
        self.root: dict = {}
        for word, n in words:
            node = self.root
            for ch in unicodedata.normalize("NFD", word):
                node = node.setdefault(ch, {})
            node[""] = (-n, word)

    def best(self, token: str, most: int = 0) -> str | None:
        """The word nearest to ``token`` at a cost of at most ``most``; None if there is none.

        At a cost of 0 only look-alikes and ignorables differ. States are (node, cost) pairs; substitution,
        insertion and deletion of a visible character cost 1 each.
        """
        states: list[tuple[dict, int]] = [(self.root, 0)]
        for ch in unicodedata.normalize("NFD", token):
            if ch in looks.IGNORABLE:
                continue
            same = looks.twins(ch)
            reached: dict[int, tuple[dict, int]] = {}
            for node, cost in states:
                steps = [(node[t], cost) for t in same if t in node]
                if cost < most:
                    steps.append((node, cost + 1))
                    for t, below in node.items():
                        if t:
                            if t not in same:
                                steps.append((below, cost + 1))
                            steps += [(below[u], cost + 1) for u in same if u in below]
                for below, c in steps:
                    if id(below) not in reached or reached[id(below)][1] > c:
                        reached[id(below)] = (below, c)
            states = list(reached.values())
            if not states:
                return None
        ends = [(cost, *node[""]) for node, cost in states if "" in node]
        ends += [(cost + 1, *below[""]) for node, cost in states if cost < most for t, below in node.items() if t and "" in below]
        return min(ends)[2] if ends else None


class Speller:
    """Canonical form of whole texts; spellings are kept for the life of a task."""

    def __init__(self, words: Iterable[tuple[str, int]], keep: int = 500_000):
        self.trie, self.known, self.keep = Trie(words), {}, keep

    def word(self, token: str) -> str:
        got = self.known.get(token)
        if got is None:
            if len(self.known) >= self.keep:
                self.known.clear()
            # The spelling by table is the same for all tokens of one look, so its length may decide.
            plain = looks.table_spelling(token)
            got = self.trie.best(token) if len(plain) <= MAX_WORD else None
            self.known[token] = got = got if got is not None else plain
        return got

    def text(self, text: str) -> str:
        return TOKEN.sub(lambda m: self.word(m[0]), looks.plain_form(text))


def is_canonical(token: str) -> bool:
    """A spelling fit for the vocabulary: the one its own look is given by table."""
    return token.isascii() or looks.table_spelling(token) == token


def vocabulary(df: DataFrame, words: int = 100_000) -> list[tuple[str, int]]:
    """The most frequent canonical tokens of ``df(text)``, at most ``words``, with their counts over all rows.

    Counts are folded within each batch before they are shuffled. A histogram of the counts finds the least
    count with which no more than ``words`` tokens remain, so what comes to the driver is bounded: tokens of
    at most 40 characters, some 5 MB. Other words are spelled by table, the same for all tokens of one look.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        fit: dict[str, bool] = {}

        def out() -> pa.RecordBatch:
            got = [(t, n) for t, n in seen.items() if fit.setdefault(t, len(t) <= MAX_WORD and is_canonical(t))]
            fit.clear()
            return pa.RecordBatch.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([n for _, n in got], pa.int64())], ["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(TOKEN.findall(looks.plain_form(text)))
            if len(seen) > 200_000:
                yield out()
                seen.clear()
        yield out()

    counted = spread(df.select("text").where(F.col("text").isNotNull())).mapInArrow(count, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))
    kept = cut(counted.where("n > 1"))
    # Exact below 4096, in fine steps above: a few thousand buckets whatever the counts.
    bucket = F.when(F.col("n") < 4096, F.col("n")).otherwise((F.log2("n") * 512).cast("bigint"))
    room, least = words, None
    for b, size in sorted(((r[0], r[1]) for r in kept.groupBy(bucket.alias("b")).count().collect()), reverse=True):
        if size > room:
            break
        room, least = room - size, b
    return [] if least is None else [(r.token, r.n) for r in kept.where(bucket >= least).orderBy(F.desc("n"), "token").collect()]


def canonical(df: DataFrame, words: int = 100_000) -> DataFrame:
    """``(doc_id, form, form_key, raw_key)`` of every row of ``df(doc_id, text)``.

    ``form`` is the consistent text; the keys are 128-bit hashes of form and raw text as hex. Null text
    gives null in all three; empty text and text without ink have the form ''. Line breaks, letter case,
    accents, digits and the number of blanks stay.
    """
    words_ = vocabulary(df, words)
    sent = df.sparkSession.sparkContext.broadcast(words_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller = Speller(sent.value)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            forms = [None if t is None else speller.text(t) for t in texts]

            def key(values: list) -> pa.Array:
                return pa.array([None if v is None else xxhash.xxh3_128_hexdigest(v.encode("utf-8", "surrogatepass")) for v in values], pa.string())

            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(forms, pa.string()), key(forms), key(texts)], ["doc_id", "form", "form_key", "raw_key"])

    return spread(df.select("doc_id", "text")).mapInArrow(run, "doc_id bigint, form string, form_key string, raw_key string")


HOT_SHARE = 1000
PARTS = 64


def _hot(counted: DataFrame, key: str) -> DataFrame:
    """The keys of ``counted(key, n)`` that hold more than a thousandth of all rows: fewer than a thousand of them."""
    total = counted.agg(F.sum("n")).first()[0] or 0
    return counted.where(F.col("n") > total / HOT_SHARE).select(key)


def _with_key_rows(rows: DataFrame, by_key: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """``rows`` joined with ``by_key`` (one row a key); rows of ``hot`` keys stay where they are."""
    few = by_key.join(F.broadcast(hot), key, "left_semi")
    return rows.join(F.broadcast(few), key).unionByName(rows.join(F.broadcast(hot), key, "left_anti").join(by_key.join(F.broadcast(hot), key, "left_anti"), key))


def look_classes(df: DataFrame, words: int = 100_000) -> DataFrame:
    """One row per document with text: ``(doc_id, class_id, n_spellings, n_links, is_canonical)``.

    ``class_id`` is the smallest doc_id of those that look the same, exact copies included; ``n_links`` counts
    the documents of the class that are other strings. Aggregates combine before the shuffle and the few classes
    that hold a large share of the rows are broadcast, so a class may hold any share of them.
    """
    docs = cut(canonical(df, words).where(F.col("form_key").isNotNull()).select("doc_id", "form_key", "raw_key"))
    by_text = docs.groupBy("form_key", "raw_key").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"))
    classes = by_text.groupBy("form_key").agg(F.min("class_id").alias("class_id"), F.count("*").alias("n_spellings"), F.sum("n_copies").alias("n"))
    copies = by_text.select("raw_key", "n_copies")
    joined = _with_key_rows(docs, classes, "form_key", _hot(classes, "form_key"))
    joined = _with_key_rows(joined, copies, "raw_key", _hot(copies.withColumnRenamed("n_copies", "n"), "raw_key"))
    return joined.select("doc_id", "class_id", "n_spellings", (F.col("n") - F.col("n_copies")).alias("n_links"), (F.col("form_key") == F.col("raw_key")).alias("is_canonical"))


def same_look_pairs(df: DataFrame, words: int = 100_000, block: int = 500) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, a < b: documents that look the same but are different strings.

    Spellings of a class are paired, not documents; copies are put back at the end, so plain copies never
    meet each other. Classes of many spellings are paired in blocks of some ``block``, and the documents of a
    spelling that holds a large share of the rows are spread over several parts. Repeated rows of one doc_id give
    no pair with themselves; texts of blanks are left out.
    """
    docs = canonical(df, words).where(F.col("form_key").isNotNull() & (F.trim("form") != "")).select("doc_id", "form_key", "raw_key")
    docs = cut(docs)
    spellings = docs.groupBy("form_key", "raw_key").agg(F.count("*").alias("n"))
    several = spellings.groupBy("form_key").agg(F.count("*").alias("k")).where("k > 1")
    mixed = cut(spellings.join(several, "form_key").withColumn("blocks", F.ceil(F.col("k") / block).cast("int")))
    mixed = mixed.withColumn("mine", F.pmod(F.xxhash64("raw_key"), F.col("blocks")).cast("int"))
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    a = mixed.select("form_key", F.col("raw_key").alias("raw_a"), F.col("mine").alias("row"), F.explode(every).alias("column"))
    b = mixed.select("form_key", F.col("raw_key").alias("raw_b"), F.col("mine").alias("column"), F.explode(every).alias("row"))
    pairs = a.join(b, ["form_key", "row", "column"]).where("raw_a < raw_b").select("raw_a", "raw_b")
    hot = _hot(mixed.select("raw_key", "n"), "raw_key").withColumn("hot", F.lit(True))
    part = F.when(F.col("hot"), F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).cast("int")).otherwise(0)
    known = docs.join(F.broadcast(hot), "raw_key", "left").withColumn("part", part)

    def side(name: str, raw: str, of: DataFrame) -> DataFrame:
        parts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(PARTS - 1))).otherwise(F.array(F.lit(0)))
        spread_ = of.join(F.broadcast(hot.withColumnRenamed("raw_key", raw)), raw, "left").withColumn("part", F.explode(parts)).drop("hot")
        return spread_.join(known.select(F.col("raw_key").alias(raw), "part", F.col("doc_id").alias(name)), [raw, "part"]).drop(raw, "part")

    both = side("y", "raw_b", side("x", "raw_a", pairs)).where("x <> y")
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
