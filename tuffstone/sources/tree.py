"""File trees on a mount that every executor shares: listing, links, ranges of large files, and what can't be read.

The listing is made by tasks, one for each entry of the root; the driver sees only these entries.
"""

from __future__ import annotations

import os
import posixpath
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "path string, kind string, length bigint, target string, error string"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = [c.split()[0] for c in LISTED.split(", ")]


def _walk(root: str, top: str) -> Iterator[tuple]:
    """Rows ``LISTED`` of ``top`` and everything below it; links aren't followed."""
    stack = [top]
    while stack:
        full = stack.pop()
        path = os.path.relpath(full, root)
        try:
            if os.path.islink(full):
                yield path, "link", None, os.readlink(full), None
            elif os.path.isdir(full):
                stack += sorted((e.path for e in os.scandir(full)), reverse=True)
            elif os.path.isfile(full):
                yield path, "file", os.path.getsize(full), None, None
        except OSError as e:
            yield path, "error", None, None, e.strerror or type(e).__name__


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """``LISTED`` rows of a tree: files (empty ones too) with their size, links with their target, errors with a reason.

    A root that is missing or can't be read is one error; devices and sockets are left out.
    """
    root = os.path.abspath(root)
    try:
        tops = [e.path for e in os.scandir(root)]
    except OSError as e:
        return spark.createDataFrame([(".", "error", None, None, e.strerror or type(e).__name__)], LISTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for top in batch.column(0).to_pylist():
                rows = list(_walk(root, top))
                columns = list(zip(*rows, strict=True)) or [[]] * len(_KINDS)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)

    starts = spark.createDataFrame([(t,) for t in sorted(tops)], "top string")
    return starts.repartition(max(1, min(len(tops), spark.sparkContext.defaultParallelism))).mapInArrow(run, LISTED)


def read_tree(listing: DataFrame, root: str, piece: int = 1 << 30, overlap: int = 1 << 16) -> DataFrame:
    """``(path, offset, content, length, error)`` of the files of a listing, in ranges of ``piece`` bytes.

    A file of up to ``piece`` bytes is one row with its whole content, an empty one a row with empty content. Ranges
    of larger files reach ``overlap`` bytes into the next one, so what lies across a border is seen whole. A file
    that can't be read is a row with a reason and null content; errors of the listing are handed on.
    """
    root = os.path.abspath(root)
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(piece).cast("bigint")))
    ranges = listing.where("kind = 'file'").select("path", "length", starts.alias("offset"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, offset in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                content = error = None
                try:
                    with open(os.path.join(root, path), "rb") as f:
                        f.seek(offset)
                        content = f.read(piece + overlap if length > piece else length)
                except OSError as e:
                    error = e.strerror or type(e).__name__
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([offset], pa.int64()), pa.array([content], pa.binary()), pa.array([length], pa.int64()), pa.array([error], pa.string())], ["path", "offset", "content", "length", "error"])

    schema = "path string, offset bigint, content binary, length bigint, error string"
    failed = listing.where("kind = 'error'").select("path", F.lit(0).cast("bigint").alias("offset"), F.lit(None).cast("binary").alias("content"), "length", "error")
    return ranges.repartition(listing.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, schema).unionByName(failed)


def unknown_roots(links: DataFrame) -> DataFrame:
    """(root) of trees whose release file can't be told from links ``(path, target)``.

    A link in place of ``etc``, or in place of its os-release to anything but the file under usr/lib of the same
    root, leaves the distribution unknown. Absolute targets count from the root.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = []
            for path, target in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts = path.split("/")
                if parts[-1] == "etc":
                    roots.append("/".join(parts[:-1]))
                if parts[-2:] == ["etc", "os-release"]:
                    root = "/".join(parts[:-2])
                    place = posixpath.join(root, target.lstrip("/")) if target.startswith("/") else posixpath.join(posixpath.dirname(path), target)
                    if posixpath.normpath(place) != posixpath.join(root, "usr/lib/os-release"):
                        roots.append(root)
            yield pa.RecordBatch.from_arrays([pa.array(roots, pa.string())], ["root"])

    return links.where("path is not null and target is not null").select("path", "target").mapInArrow(run, "root string").distinct()


def advisory_dir(environ: dict[str, str]) -> str:
    """The folder of the advisory mirror: TUFFSTONE_DB, else ``tuffstone`` in XDG_DATA_HOME, else in the home folder."""
    if environ.get("TUFFSTONE_DB"):
        return environ["TUFFSTONE_DB"]
    if environ.get("XDG_DATA_HOME"):
        return f"{environ['XDG_DATA_HOME']}/tuffstone"
    return f"{environ.get('HOME') or '.'}/.local/share/tuffstone"
