"""Files and advisory indexes as relations."""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def files_df(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content, length)`` of the regular files under ``root``, paths relative to it.

    Content is read only where a query uses it. The reader lists no empty files.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    bare = re.sub("^[a-z0-9]+:(?://[^/]*)?(?=/)", "", root)
    prefix = "^.*?" + re.escape((bare if bare.startswith("/") else os.path.abspath(bare)).rstrip("/")) + "/"
    return df.select(F.regexp_replace("path", prefix, "").alias("path"), "content", "length")


def text_df(df: DataFrame, path: str, text: str) -> DataFrame:
    """Any table with a path and a text column as files."""
    return df.select(F.col(path).cast("string").alias("path"), F.col(text).alias("content"))


def symlinks(spark: SparkSession, root: str) -> DataFrame:
    """``(path, target)`` of the symbolic links of a local tree; links aren't followed, unreadable folders are skipped."""
    found, stack = [], [root]
    while stack:
        try:
            entries = list(os.scandir(stack.pop()))
        except OSError:
            continue
        for e in entries:
            if e.is_symlink():
                found.append((os.path.relpath(e.path, root), os.readlink(e.path)))
            elif e.is_dir(follow_symlinks=False):
                stack.append(e.path)
    return spark.createDataFrame(sorted(found), "path string, target string")


def checksum_manifest(manifests: DataFrame) -> DataFrame:
    """``(name, sha256)`` of ``<64 hex>  [*]name`` lines in ``manifests(content)``."""
    line = manifests.select(F.explode(F.split("content", "\r?\n")).alias("l"))
    pattern = r"^([0-9A-Fa-f]{64})[ \t]+\*?(.+)$"
    return line.where(F.col("l").rlike(pattern)).select(F.regexp_extract("l", pattern, 2).alias("name"), F.lower(F.regexp_extract("l", pattern, 1)).alias("sha256"))


def verify_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(name, ok)`` of every name in a manifest: whether a file of that name has its digest; false if none has."""
    have = files.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), F.sha2("content", 256).alias("got"))
    return manifest.join(have, "name", "left").groupBy("name").agg(F.coalesce(F.max(F.col("got") == F.col("sha256")), F.lit(False)).alias("ok"))


# The layout of a compact index file.
MAGIC, HEADER = b"MOS1", 64
INDEX = "eco string, pkg string, id string, sev string, rel string, sum string, events array<struct<type:string,value:string>>"


def read_index_bytes(data: bytes) -> Iterator[tuple]:
    """Rows ``INDEX`` of a compact index; nothing from a file of another layout, no further than it is whole."""
    if len(data) < HEADER or data[:4] != MAGIC or struct.unpack_from("<I", data, 4)[0] != 1:
        return
    keys, directory, records, pool = (struct.unpack_from("<I", data, at)[0] for at in (20, 24, 28, 32))

    def text(offset: int) -> str:
        at = pool + offset
        (n,) = struct.unpack_from("<I", data, at)
        if at + 4 + n > len(data):
            raise struct.error("text beyond the end")
        return data[at + 4 : at + 4 + n].decode("utf-8", "replace")

    try:
        for k in range(keys):
            key, at, count = struct.unpack_from("<III", data, directory + 12 * k)
            eco, _, pkg = text(key).partition("\x1f")
            at += records
            for _ in range(count):
                fields = [text(o) for o in struct.unpack_from("<IIII", data, at)]
                (n,) = struct.unpack_from("<H", data, at + 16)
                events = [{"type": chr(t), "value": text(v)} for t, v in struct.iter_unpack("<BI", data[at + 18 : at + 18 + 5 * n])]
                if len(events) != n:
                    return
                at += 18 + 5 * n
                yield (eco, pkg, *fields, events)
    except struct.error:
        return


def read_index(files: DataFrame) -> DataFrame:
    """Rows ``INDEX`` of compact index files ``(path, content binary)``."""
    event = pa.list_(pa.struct([("type", pa.string()), ("value", pa.string())]))
    kinds = [pa.string()] * 6 + [event]
    names = ["eco", "pkg", "id", "sev", "rel", "sum", "events"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows: list[tuple] = []
                for row in read_index_bytes(data or b""):
                    rows.append(row)
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("content").mapInArrow(run, INDEX)


def index_bytes(rows: list[tuple], source: str = "", generated: int = 0) -> bytes:
    """A compact index of rows ``INDEX``, ordered by ecosystem and package; for indexes that one machine can ship."""
    pool, places = bytearray(), {}

    def put(text: str) -> int:
        if text not in places:
            raw = text.encode()
            places[text] = len(pool)
            pool.extend(struct.pack("<I", len(raw)) + raw)
        return places[text]

    directory, records, at = bytearray(), bytearray(), 0
    ordered = sorted(rows, key=lambda r: f"{r[0]}\x1f{r[1]}".encode())
    n_keys = 0
    while at < len(ordered):
        key = f"{ordered[at][0]}\x1f{ordered[at][1]}"
        same = at
        begin = len(records)
        while same < len(ordered) and f"{ordered[same][0]}\x1f{ordered[same][1]}" == key:
            *_, events = ordered[same]
            records += struct.pack("<IIIIH", *(put(f or "") for f in ordered[same][2:6]), len(events))
            for kind, value in events:
                records += struct.pack("<BI", ord(kind), put(value))
            same += 1
        directory += struct.pack("<III", put(key), begin, same - at)
        at, n_keys = same, n_keys + 1
    told = put(source)
    head = bytearray(HEADER)
    head[:4] = MAGIC
    struct.pack_into("<IQIIIIII", head, 4, 1, generated, len(ordered), n_keys, HEADER, HEADER + len(directory), HEADER + len(directory) + len(records), told)
    return bytes(head + directory + records + pool)
