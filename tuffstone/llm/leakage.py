"""Evaluation passages in training text, by suffix arrays of the training shards.

Each Arrow batch of documents is a shard: its words, as numbers of the evaluation vocabulary, are laid out
in one array and its suffixes sorted. Every suffix of every evaluation item is binary-searched in it for its
longest verbatim match; the order around that place gives all other places that share a run long enough to
belong to a passage, with their lengths. Documents and items that share such a run are then aligned along all
diagonals over replaced words, and the best one or two pieces in order decide. How long a run has to be follows
from the length of the item alone. Words outside the evaluation vocabulary end a suffix, so a shard keeps only
runs that can match at all.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuffstone.llm import looks
from tuffstone.runtime import spread

WORD = re.compile(r"[^\W_]+")
#: A line number or list number before its sign, as a mark at the start of a line.
LINE_MARK = re.compile(r"^[^\w\n]*[0-9]{1,6}[:.)\]|][ \n]", re.MULTILINE)
_TO_LATIN = str.maketrans(looks.LATIN_OF)
FOUND = "doc_id bigint, item_id bigint, covered int, item_words int, longest int, replaced int, pieces int, first_word int"


def words_of(text: str) -> list[str]:
    """The words of a text without regard to case, punctuation, marks, blanks and disguised characters."""
    text = looks.plain_form(text)
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.translate(_TO_LATIN))
    return WORD.findall(LINE_MARK.sub(" ", text).casefold())


#: Fewer words than these are no passage, unless they are the whole item; two of them may be interrupted.
LEAST_WORDS = 4


def least_cover(n: int, share: float) -> int:
    """Words of an item of ``n`` words that a passage has to cover."""
    return max(1, math.ceil(share * n), min(n, LEAST_WORDS))


def most_pieces(n: int) -> int:
    """Pieces a passage of an item of ``n`` words may come in."""
    return 2 if n >= 2 * LEAST_WORDS else 1


def shortest_run(n: int, share: float, replaced: float) -> int:
    """Words that follow each other unchanged in any passage that counts for an item of ``n`` words, at least.

    A cover of c words with r of them replaced in p pieces has at most r + p unchanged runs: one has
    (c - r) / (r + p) words or more. Seeking runs of this length therefore misses no passage.
    """
    covers = range(least_cover(n, share), n + 1)
    return max(1, min((-(-(c - r) // (r + most_pieces(n))) for c in covers for r in (int(replaced * c),)), default=1))


class Items:
    """Evaluation items as one array of word numbers, each item closed by a gap."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.5, replaced: float = 0.13):
        self.vocabulary: dict[str, int] = {}
        number = self.vocabulary
        self.ids = np.array([i for i, _ in items], np.int64)
        texts = [np.array([number.setdefault(w, len(number) + 1) for w in words_of(t)], np.int32) for _, t in items]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.run = np.array([shortest_run(len(t), share, replaced) for t in texts], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length + 1)])[:-1].astype(np.int64)
        self.words = np.zeros(int(self.length.sum() + len(texts)), np.int32)
        for s, t in zip(self.start, texts, strict=True):
            self.words[s : s + len(t)] = t
        self.item_at = np.repeat(np.arange(len(texts)), self.length + 1)
        #: Suffixes worth searching: those with as many words left as a run of their item needs.
        left = self.start[self.item_at] + self.length[self.item_at] - np.arange(len(self.words)) if len(texts) else np.zeros(0, np.int64)
        self.places = np.flatnonzero(left >= self.run[self.item_at]) if len(texts) else np.zeros(0, np.int64)
        self.places = self.places[self.words[self.places] > 0]


def _common(words: np.ndarray, at: np.ndarray, other: np.ndarray, there: np.ndarray, known: np.ndarray | int, most: int) -> np.ndarray:
    """How many words two suffixes have in common, ``known`` of them for sure, up to ``most``."""
    length = np.zeros(len(at), np.int64) + known
    live = np.flatnonzero(length < most)
    while len(live):
        w = words[at[live] + length[live]]
        live = live[(w == other[there[live] + length[live]]) & (w > 0)]
        length[live] += 1
        live = live[length[live] < most]
    return length


class SuffixArray:
    """Suffixes of a shard in order of their first ``depth`` words, with what neighbours have in common.

    ``words`` are numbers from 1 on; 0 is a gap, ends a suffix and sorts before every word. Ranks come from
    prefix doubling, so repeated passages cost no more than others.
    """

    def __init__(self, words: np.ndarray, depth: int):
        self.words = np.concatenate([words, np.zeros(1, words.dtype)])
        every = np.flatnonzero(words > 0)
        gaps = np.flatnonzero(self.words == 0)
        room = gaps[np.searchsorted(gaps, every)] - every
        rank = np.zeros(len(self.words), np.int64)
        first = self.words[every].astype(np.int64)
        known = 1
        while True:
            order = np.argsort(first, kind="stable")
            fresh = np.ones(len(every), bool)
            fresh[1:] = first[order][1:] != first[order][:-1]
            dense = np.cumsum(fresh)
            rank[every[order]] = dense
            if known >= depth or not len(every) or dense[-1] == len(every):
                break
            second = np.where(room > known, rank[np.minimum(every + known, len(words))], 0)
            first = rank[every] * (dense[-1] + 1) + second
            known *= 2
        self.order, self.depth = every[order], depth
        shared = _common(self.words, self.order[1:], self.words, self.order[:-1], 0, depth) if len(every) else np.zeros(0, np.int64)
        #: shared[k]: words that suffixes k - 1 and k have in common.
        self.shared = np.concatenate([[0], shared]).astype(np.int32)
        self.lowest: list[np.ndarray] | None = None

    def search(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Binary search of suffixes of ``words``: where each belongs, and what it shares with the one before and behind.

        The greater of the two is its longest match. What both ends of an interval share with a suffix is not
        compared again.
        """
        low, high = np.zeros(len(places), np.int64), np.full(len(places), len(self.order), np.int64)
        before, behind = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            middle = (low[live] + high[live]) >> 1
            at, there = self.order[middle], places[live]
            n = _common(self.words, at, words, there, np.minimum(before[live], behind[live]), self.depth)
            less = (self.words[at + n] < words[there + n]) & (n < self.depth)
            low[live[less]], before[live[less]] = middle[less] + 1, n[less]
            high[live[~less]], behind[live[~less]] = middle[~less], n[~less]
            live = live[low[live] < high[live]]
        return low, before, behind

    def least_shared(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The least of ``shared[begin:end]`` for each pair, begin < end."""
        if self.lowest is None:
            self.lowest = [self.shared]
            while (step := 1 << (len(self.lowest) - 1)) * 2 <= len(self.shared):
                last = self.lowest[-1]
                self.lowest.append(np.minimum(last[:-step], last[step:]))
        level = np.frexp((end - begin).astype(np.float64))[1] - 1
        out = np.zeros(len(begin), np.int64)
        for k in np.unique(level):
            m = level == k
            out[m] = np.minimum(self.lowest[k][begin[m]], self.lowest[k][end[m] - (1 << int(k))])
        return out


def matches(words: np.ndarray, items: Items, room: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Verbatim matches of the shard with the items that can't be longer on the left: place, item place, length.

    Each item suffix is searched for its longest match; the other places with as many common words as its item
    needs lie around that place in the suffix order, and the order tells their lengths. They come in parts of some
    ``room`` places.
    """
    least = int(items.run.min()) if len(items.run) else 1
    gaps = np.flatnonzero(np.concatenate([words == 0, [True]]))
    begins = np.concatenate([[0], gaps[:-1] + 1])
    short = (gaps - begins) < least
    words = words.copy()
    words[np.repeat(short, gaps - begins + 1)[: len(words)]] = 0
    if not len(items.places) or not words.any():
        return
    shard = SuffixArray(words, int(items.length.max()))
    place, before, behind = shard.search(items.words, items.places)
    run = items.run[items.item_at[items.places]]
    hit = np.maximum(before, behind) >= run
    there, place, before, behind, run = items.places[hit], place[hit], before[hit], behind[hit], run[hit]
    low, high = place.copy(), place.copy()
    for r in np.unique(run):
        borders = np.append(np.flatnonzero(shard.shared < r), len(shard.shared))
        m = (run == r) & (before >= r)
        low[m] = borders[np.searchsorted(borders, place[m] - 1, "right") - 1]
        m = (run == r) & (behind >= r)
        high[m] = borders[np.searchsorted(borders, place[m], "right")]
    n = high - low
    parts = np.cumsum(n) // room
    for part in np.unique(parts):
        q = np.flatnonzero(parts == part)
        k = np.repeat(q, n[q])
        j = np.repeat(low[q] - np.concatenate([[0], np.cumsum(n[q])[:-1]]), n[q]) + np.arange(n[q].sum())
        at = shard.order[j]
        left = np.where(at > 0, shard.words[at - 1], 0)
        fresh = (left == 0) | (there[k] == 0) | (left != items.words[there[k] - 1])
        k, j, at = k[fresh], j[fresh], at[fresh]
        up = j < place[k]
        length = np.where(up, before[k], behind[k])
        begin, end = np.where(up, j, place[k]) + 1, np.where(up, place[k] - 1, j) + 1
        far = end > begin
        length[far] = np.minimum(length[far], shard.least_shared(begin[far], end[far]))
        yield at, there[k], length


def _pieces(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, penalty: float) -> list[tuple[int, int, int, int]]:
    """On each diagonal the stretches (item from, item to, doc from, replaced) whose matches outweigh replacements."""
    out = []
    for d in diagonals:
        lo, hi = max(0, -d), min(len(item), len(doc) - d)
        same = doc[lo + d : hi + d] == item[lo:hi]
        score = start = best = 0.0
        begin = end = -1
        for k, s in enumerate(same):
            if score < 0 or (score == 0 and not s):
                score, start = 0.0, k
            score += 1 if s else -penalty
            if s and score >= best:
                best, begin, end = score, int(start), k + 1
        if end > begin >= 0:
            out.append((lo + begin, lo + end, lo + begin + int(d), int((~same[begin:end]).sum())))
    return out


def _diagonals(doc: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, int]:
    """Diagonals on which two words in a row agree, and how many words agree on the best two of all.

    No cover has more equal words than the second figure.
    """
    same = doc[None, :] == item[:, None]
    i, j = np.nonzero(same)
    if not len(i):
        return np.zeros(0, np.int64), 0
    counts = np.bincount(j - i + len(item))
    two = np.partition(counts, -2)[-2:] if len(counts) > 1 else counts
    i, j = np.nonzero(same[:-1, :-1] & same[1:, 1:])
    return np.unique(j - i), int(two.sum())


def best_cover(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, penalty: float, most: int = 2) -> tuple[int, int, int, int]:
    """(covered words, replaced, pieces, first document word) of the best one or two pieces in order."""
    # Of pieces with the same words the earliest serves best as the first and the latest as the second.
    earliest: dict[tuple, tuple] = {}
    latest: dict[tuple, tuple] = {}
    best = (0, 0, 0, 0)
    for a in _pieces(doc, item, diagonals, penalty):
        if a[1] - a[0] > best[0]:
            best = (a[1] - a[0], a[3], 1, a[2])
        if a[:2] not in earliest or a[2] < earliest[a[:2]][2]:
            earliest[a[:2]] = a
        if a[:2] not in latest or a[2] > latest[a[:2]][2]:
            latest[a[:2]] = a
    for a in earliest.values() if most > 1 else ():
        for b in latest.values():
            if b[2] - b[0] == a[2] - a[0] or b[1] <= a[1] or b[0] <= a[0] or b[2] <= a[2]:
                continue
            over = max(0, a[1] - b[0], a[2] + a[1] - a[0] - b[2])
            covered = a[1] - a[0] + b[1] - b[0] - over
            if over < b[1] - b[0] and covered > best[0]:
                best = (covered, a[3] + b[3], 2, a[2])
    return best


def _longest(same: np.ndarray, most: int) -> np.ndarray:
    """[m, t]: words of the longest stretch before ``t`` that begins and ends with a match and has up to m others."""
    n, other = len(same), np.flatnonzero(~same)
    ends, so_far = np.flatnonzero(same) + 1, np.cumsum(~same)
    following = np.append(np.minimum.accumulate(np.where(same, np.arange(n), n)[::-1])[::-1], n)
    out = np.zeros((most + 1, n + 1), np.int64)
    for m in range(most + 1):
        k = so_far[ends - 1] - m - 1
        begin = np.where(k >= 0, other[np.maximum(k, 0)] + 1, 0) if len(other) else np.zeros(len(ends), np.int64)
        out[m, ends] = ends - following[begin]
    return np.maximum.accumulate(out, axis=1)


def sound_cover(doc: np.ndarray, item: np.ndarray, diagonals: np.ndarray, penalty: float, replaced: float, most: int = 2) -> tuple[int, int, int, int]:
    """``best_cover`` among the parts of pieces of which at most ``replaced`` words are replaced.

    Exact, in the square of the replaced words times the item's words for each pair of pieces; needed only
    where the longest cover has too many replaced words.
    """
    pieces = _pieces(doc, item, diagonals, penalty)
    same = [doc[p[2] : p[2] + p[1] - p[0]] == item[p[0] : p[1]] for p in pieces]
    front = [_longest(x, p[3]) for x, p in zip(same, pieces, strict=True)]
    back = [_longest(x[::-1], p[3]) for x, p in zip(same, pieces, strict=True)]
    best = (0, 0, 0, 0)
    for p, x, rows in zip(pieces, same, front, strict=True):
        for m in range(p[3], -1, -1):
            covered = int(rows[m, -1])
            if m <= replaced * covered:
                if covered > best[0]:
                    at = int(np.searchsorted(rows[m], covered)) - covered
                    best = (covered, int((~x[at : at + covered]).sum()), 1, p[2] + at)
                break
    for a, x, rows in zip(pieces, same, front, strict=True) if most > 1 else ():
        for b, y, tails in zip(pieces, same, back, strict=True):
            shift = (a[2] - a[0]) - (b[2] - b[0])
            matched = a[1] - a[0] - a[3] + b[1] - b[0] - b[3]
            if not shift or matched <= best[0] * (1 - replaced):
                continue
            # The first piece ends at or before t, the second begins behind it in the item and in the document.
            t = np.arange(a[1] - a[0] + 1)
            left = b[1] - b[0] - np.clip(t + a[0] + max(0, shift) - b[0], 0, b[1] - b[0])
            for m in range(a[3] + b[3], -1, -1):
                sums = [(int((both := rows[i] + tails[m - i][left]).max()), int(both.argmax()), i) for i in range(max(0, m - b[3]), min(m, a[3]) + 1)]
                covered, split, i = max(sums)
                if m <= replaced * covered:
                    if covered > best[0]:
                        n, rest = int(rows[i, split]), int(tails[m - i, left[split]])
                        at = int(np.searchsorted(rows[i], n)) - n
                        to = len(y) - int(np.searchsorted(tails[m - i], rest)) + rest
                        best = (covered, int((~x[at : at + n]).sum() + (~y[to - rest : to]).sum()), 2, a[2] + at)
                    break
    return best


def search_shard(doc_ids: list, texts: list, items: Items, share: float, replaced: float, penalty: float) -> list[tuple]:
    """Rows of ``FOUND`` for one shard."""
    get = items.vocabulary.get
    docs = [np.array([get(w, 0) for w in words_of(t)], np.int32) if t else np.zeros(0, np.int32) for t in texts]
    length = np.array([len(d) for d in docs], np.int64)
    start = np.concatenate([[0], np.cumsum(length + 1)])[:-1].astype(np.int64)
    words = np.zeros(int(length.sum()) + len(docs), np.int32)
    for s, d in zip(start, docs, strict=True):
        words[s : s + len(d)] = d
    found = list(matches(words, items))
    if not found:
        return []
    at, there, long = (np.concatenate(x) for x in zip(*found, strict=True))
    doc, item = np.searchsorted(start, at, "right") - 1, items.item_at[there]
    diagonal = (at - start[doc]) - (there - items.start[item])
    order = np.lexsort((diagonal, item, doc))
    doc, item, diagonal, long = doc[order], item[order], diagonal[order], long[order]
    cuts = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])]))
    out = []
    for k, c in enumerate(cuts):
        end = cuts[k + 1] if k + 1 < len(cuts) else len(doc)
        n = int(items.length[item[c]])
        s = items.start[item[c]]
        doc_words, item_words, need, most = docs[doc[c]], items.words[s : s + n], least_cover(n, share), most_pieces(n)
        mine, equal = _diagonals(doc_words, item_words)
        if equal < (1 - replaced) * need:
            continue
        mine = np.union1d(mine, diagonal[c:end])
        covered, swapped, pieces, first = best_cover(doc_words, item_words, mine, penalty, most)
        if covered >= need and swapped > replaced * covered:
            covered, swapped, pieces, first = sound_cover(doc_words, item_words, mine, penalty, replaced, most)
        if covered >= need and swapped <= replaced * covered:
            out.append((doc_ids[doc[c]], int(items.ids[item[c]]), covered, n, int(long[c:end].max()), swapped, pieces, first))
    return out


def leaks(documents: DataFrame, items: DataFrame, share: float = 0.5, replaced: float = 0.13, penalty: float = 2.0, block_chars: int = 8_000_000) -> DataFrame:
    """Documents that hold a passage of an item: one row per document and item (columns ``FOUND``).

    A passage counts if it covers ``share`` of the item's words in order, in at most two pieces, with at most
    ``replaced`` of them replaced one for one (a little over one in ten, as one word in a short passage
    is); it has four words or is the whole item, and items of fewer than eight words come in one piece. Items go to the executors in blocks of ``block_chars`` characters, so what is broadcast is bounded;
    every document is held against every block. Null and empty texts hold nothing; items without words are never
    found, shorter ones are found whatever their length; a document delivered twice under one doc_id is reported once;
    items with one text are all reported.
    """
    sized = items.select("item_id", "text").where(F.col("text").isNotNull())
    total = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = int(total // block_chars) + 1
    texts = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    found = None
    for block in range(blocks):
        mine = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block) if blocks > 1 else sized
        sent = documents.sparkSession.sparkContext.broadcast([(r.item_id, r.text) for r in mine.collect()])

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            searched = Items(sent.value, share, replaced)
            for batch in batches:
                rows = search_shard(batch.column(0).to_pylist(), batch.column(1).to_pylist(), searched, share, replaced, penalty)
                kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 6]
                columns = list(zip(*rows, strict=True)) or [[]] * 8
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in FOUND.split(", ")])

        part = texts.mapInArrow(run, FOUND)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["doc_id", "item_id"])


def without_leaks(documents: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``documents`` without those in which ``leaks`` finds a passage."""
    return documents.join(leaks(documents, items, **options).select("doc_id").distinct(), "doc_id", "left_anti")
