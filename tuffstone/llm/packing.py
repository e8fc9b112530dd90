"""Items of varying length in containers of fixed capacity: minimum bin slack.

Texts are measured in tokens where they lie; only (doc_id, length) is shuffled. Items are spread over shards
of bounded size, and each shard packs the multiset of its lengths: the longest item left opens a container,
and a bitset subset-sum over the remaining lengths finds the multiset that fills the rest most closely. The
counts are read back from the stored bitsets and the pattern is repeated while the lengths last.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tuffstone.runtime import spread

#: Fixed value: how the public byte-level vocabulary splits a text before merging.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PIECE = "doc_id bigint, piece int, first_token bigint, n_tokens int, container bigint, container_tokens int"


def tokenizer(ranks: bytes, split: str = SPLIT) -> tiktoken.Encoding:
    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=split, mergeable_ranks=merges, special_tokens={})


def token_counts(documents: DataFrame, ranks_path: str = RANKS) -> DataFrame:
    """``(doc_id, n_tokens)`` of every row of ``documents(doc_id, text)``; null and empty text have 0 tokens.

    The vocabulary file, about 1 MB whatever the corpus, is read by the driver and broadcast.
    """
    sent = documents.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(sent.value).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), pa.array(n, pa.int64())], ["doc_id", "row", "n_tokens"])

    rows = spread(documents.select("doc_id", "text")).select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(run, "doc_id bigint, row bigint, n_tokens bigint")


def fill(room: int, counts: dict[int, int], lengths: list[int]) -> dict[int, int]:
    """The multiset of available lengths whose sum comes closest to ``room`` from below: length to count.

    ``lengths`` are the keys of ``counts`` in falling order. Bit s of a set says that sum s can be reached;
    the walk ends as soon as the room itself can be.
    """
    full, mask = 1 << room, (1 << (room + 1)) - 1
    sets, steps = [1], []
    for length in lengths:
        most = min(counts[length], room // length)
        part = 1
        while most > 0:
            take = min(part, most)
            sets.append((sets[-1] | sets[-1] << (length * take)) & mask)
            steps.append((length, take))
            most -= take
            part *= 2
        if sets[-1] & full:
            break
    at = sets[-1].bit_length() - 1
    used: dict[int, int] = {}
    for k in range(len(steps) - 1, -1, -1):
        if not sets[k] >> at & 1:
            length, take = steps[k]
            used[length] = used.get(length, 0) + take
            at -= length * take
    return used


def pack(lengths: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``lengths``; every length is between 1 and ``capacity``."""
    stacks: dict[int, list[int]] = {}
    for i in range(len(lengths) - 1, -1, -1):
        stacks.setdefault(lengths[i], []).append(i)
    counts = {k: len(v) for k, v in stacks.items()}
    falling = sorted(counts, reverse=True)
    out: list[list[int]] = []
    while falling:
        first = falling[0]
        counts[first] -= 1
        room = capacity - first
        use = fill(room, {k: counts[k] for k in falling if counts[k]}, [k for k in falling if counts[k] and k <= room]) if room else {}
        counts[first] += 1
        use[first] = use.get(first, 0) + 1
        times = min(counts[k] // n for k, n in use.items())
        for _ in range(times):
            out.append([stacks[k].pop() for k, n in use.items() for _ in range(n)])
        for k, n in use.items():
            counts[k] -= n * times
        falling = [k for k in falling if counts[k]]
    return out


def containers(documents: DataFrame, capacity: int = 2048, shard_items: int = 20_000, ranks_path: str = RANKS) -> DataFrame:
    """Assignment of every document to containers: rows ``PIECE``, one for each piece of a document.

    A document is cut only if it is longer than ``capacity``: into full pieces, each a container of its own,
    and a remainder that is packed like any item. Documents without tokens take no room and get no row.
    Repeated rows are items of their own. Shards hold about ``shard_items`` items whatever the size of the
    corpus and take rows by their place in the input, so no document or source can fill one; each leaves at
    most a few containers that aren't full. Equal input in equal splits gives equal containers.
    """
    shards = max(1, -(-documents.count() // shard_items))
    items = token_counts(documents, ranks_path).where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n_tokens", "descending"), ("doc_id", "ascending"), ("row", "ascending")])
        ids, sizes = table.column("doc_id").to_pylist(), table.column("n_tokens").to_pylist()
        base = (table.column("shard")[0].as_py() if len(ids) else 0) << 32
        rows, rest = [], []
        for doc, size in zip(ids, sizes, strict=True):
            whole = (size - 1) // capacity
            for piece in range(whole):
                rows.append((doc, piece, piece * capacity, capacity, base + len(rows), capacity))
            rest.append((doc, whole, whole * capacity, size - whole * capacity))
        k = len(rows)
        for members in pack([r[3] for r in rest], capacity):
            total = sum(rest[i][3] for i in members)
            rows += [(*rest[i], base + k, total) for i in members]
            k += 1
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in PIECE.split(", ")])

    # Lengths are few bytes but packing them is work, so shards aren't put together into few tasks.
    return items.repartition(shards, "shard").groupBy("shard").applyInArrow(run, PIECE)


def fill_report(packed: DataFrame, capacity: int = 2048) -> DataFrame:
    """One row: containers, tokens, the least number of containers that could hold them, share of unused room."""
    each = packed.groupBy("container").agg(F.sum("n_tokens").alias("held"))
    sums = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("held"), F.lit(0)).alias("tokens"))
    least = F.ceil(F.col("tokens") / capacity).alias("least_containers")
    unused = F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0)
    return sums.select("containers", "tokens", least, unused.alias("unused_share"))
