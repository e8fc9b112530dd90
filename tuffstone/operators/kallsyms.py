"""Symbol names of a kernel image, from its compressed symbol table.

The table of 256 tokens is found by its run of single digits, its index confirms it; the markers before it
bound the number of names; the count before the names settles it. Both byte orders, 32- and 64-bit.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGITS = b"".join(bytes([c, 0]) for c in b"0123456789")


def _tokens(data: bytes, at: int) -> tuple[int, int, list[bytes]] | None:
    """(start, end, tokens) of the token table whose digit run lies at ``at``."""
    start = at
    for _ in range(48):
        if start < 2 or data[start - 1] != 0:
            return None
        before = data.rfind(b"\0", max(0, start - 80), start - 1)
        if before < 0:
            before = -1 if start < 80 else None
        if before is None:
            return None
        start = before + 1
    tokens, end = [], start
    for _ in range(256):
        stop = data.find(b"\0", end, end + 80)
        if stop < 0:
            return None
        tokens.append(data[end:stop])
        end = stop + 1
    return start, end, tokens


def _index_order(data: bytes, end: int, tokens: list[bytes]) -> tuple[str, int] | None:
    """(byte order, bytes too many in the first token) by the table of token offsets; None if there is none.

    Nothing parts the first token from the markers before it, so its start is only known from the offsets.
    """
    offsets = [0]
    for t in tokens[:-1]:
        offsets.append(offsets[-1] + len(t) + 1)
    for pad in range(0, 16):
        for order in "<>":
            if end + pad + 512 <= len(data):
                told = struct.unpack_from(f"{order}256H", data, end + pad)
                extra = offsets[1] - told[1]
                if told[0] == 0 and 0 <= extra < offsets[1] and all(o - t == extra for o, t in zip(offsets[1:], told[1:], strict=True)):
                    return order, extra
    return None


def _names(data: bytes, start: int, end: int, count: int) -> tuple[list[int], int]:
    """Offsets of ``count`` names from ``start``, and where they stop; fewer if they run past ``end``."""
    out, at = [], start
    for _ in range(count):
        if at >= end:
            break
        n, at2 = data[at], at + 1
        if n & 0x80:
            n, at2 = (n & 0x7F) | data[at2] << 7, at2 + 1
        if n == 0 or at2 + n > end:
            break
        out.append(at)
        at = at2 + n
    return out, at


def decode(data: bytes) -> tuple[list[str], bool]:
    """(names, complete) of the first symbol table; ([], False) if there is none. Never raises on bad bytes."""
    at = data.find(DIGITS)
    while at >= 0:
        found = _tokens(data, at)
        index = _index_order(data, found[1], found[2]) if found else None
        if found and index:
            order, extra = index
            found[2][0] = found[2][0][extra:]
            for width in (4, 8):
                for pad in range(0, 16):
                    got = _table(data, found[0] + extra - pad, found[2], order, width)
                    if got:
                        return got, True
        at = data.find(DIGITS, at + 1)
    return [], False


def _table(data: bytes, marks_end: int, tokens: list[bytes], order: str, width: int) -> list[str] | None:
    form = f"{order}{'I' if width == 4 else 'Q'}"
    marks: list[int] = []
    at = marks_end - width
    while at >= 0 and len(marks) < 4096:
        (m,) = struct.unpack_from(form, data, at)
        if marks and m >= marks[-1]:
            return None
        marks.append(m)
        if m == 0:
            break
        at -= width
    if not marks or marks[-1] != 0:
        return None
    marks.reverse()
    last = marks[-1]
    # The names end before the markers; a block holds up to 256 names.
    for back in range(last + 2, last + 256 * 130 + 64):
        place = at - back
        if place < 0:
            break
        if place % 4:
            continue
        (count,) = struct.unpack_from(f"{order}I", data, place)
        if not (len(marks) - 1) * 256 < count <= len(marks) * 256:
            continue
        for gap in (4, 8):
            start = place + gap
            offsets, stop = _names(data, start, at, count)
            if len(offsets) == count and at - stop < 16 and all(offsets[i * 256] - start == m for i, m in enumerate(marks)):
                names = []
                for k, o in enumerate(offsets):
                    body = o + (2 if data[o] & 0x80 else 1)
                    end = offsets[k + 1] if k + 1 < count else stop
                    names.append(b"".join(tokens[b] for b in data[body:end])[1:].decode("latin-1"))
                return names
    return None


def kernel_symbols(files: DataFrame) -> DataFrame:
    """``(path, symbol, complete)`` of the kernel images of any size in ``files(path, content binary)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                names, complete = decode(data)
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(names), pa.string()), pa.array(names, pa.string()), pa.array([complete] * len(names), pa.bool_())], ["path", "symbol", "complete"])

    image = files.where(F.decode("content", "ISO-8859-1").contains("Linux version "))
    return image.select("path", "content").mapInArrow(run, "path string, symbol string, complete boolean")
