"""A small reader of DER: tag, length, value."""

from __future__ import annotations

import hashlib
from typing import NamedTuple


class Node(NamedTuple):
    tag: int
    start: int
    body: int
    end: int


# Object identifiers of key types and curves.
RSA, EC, DSA, ED25519, ED448, X25519, X448 = (bytes.fromhex(h) for h in ("2a864886f70d010101", "2a8648ce3d0201", "2a8648ce380401", "2b6570", "2b6571", "2b656e", "2b656f"))
CURVES = {bytes.fromhex("2a8648ce3d030107"): "secp256r1", bytes.fromhex("2b81040022"): "secp384r1", bytes.fromhex("2b81040023"): "secp521r1", bytes.fromhex("2b8104000a"): "secp256k1"}
MODERN = {ED25519: ("Ed25519", 256), ED448: ("Ed448", 448), X25519: ("X25519", 253), X448: ("X448", 448)}


def node(data: bytes, at: int, end: int | None = None) -> Node | None:
    """The definite-length element at ``at`` that ends within ``end``."""
    end = len(data) if end is None else end
    if at + 2 > end:
        return None
    size, body = data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or body + n > end:
            return None
        size, body = int.from_bytes(data[body : body + n], "big"), body + n
    return Node(data[at], at, body, body + size) if body + size <= end else None


def children(data: bytes, parent: Node, most: int = 4096) -> list[Node] | None:
    """The elements that fill ``parent``; None if they don't."""
    out: list[Node] = []
    at = parent.body
    while at < parent.end:
        n = node(data, at, parent.end)
        if n is None or len(out) >= most:
            return None
        out.append(n)
        at = n.end
    return out


def value(data: bytes, n: Node) -> bytes:
    return data[n.body : n.end]


def integer(data: bytes, n: Node) -> int:
    return int.from_bytes(value(data, n), "big")


def fingerprint(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()[:32]
