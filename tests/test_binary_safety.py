"""Decoders of binary formats never raise and give nothing twice on damaged input."""

import random

import pytest

from tuffstone.operators import boot, credentials, kallsyms, kernel, keys, packages, secrets
from tuffstone.plans import boot_queries, ingest_queries, kernel_queries, key_queries, package_queries
from tuffstone.sources import files as sources


def damaged(data, rng, times=60):
    """Cuts and byte flips of ``data``."""
    yield b""
    for _ in range(times):
        if not data:
            return
        cut = data[: rng.randrange(len(data) + 1)]
        yield cut
        raw = bytearray(data)
        for _ in range(rng.randrange(1, 9)):
            raw[rng.randrange(len(raw))] = rng.randrange(256)
        yield bytes(raw)


@pytest.mark.parametrize("path", [p for p, _ in boot_queries.FILES])
def test_boot(path):
    rng = random.Random(path)
    for data in damaged(dict(boot_queries.FILES)[path], rng):
        for fact in boot.decode(path, data):
            assert len(fact) == 4


def test_keys():
    rng = random.Random(1)
    for _, data in key_queries.fixture():
        for bad in damaged(data, rng, 12):
            keys.public_keys(bad)
            spans = [(f[0], f[0] + f[1]) for f in keys.raw_private_keys(bad)]
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_symbols_and_packages_and_index():
    rng = random.Random(2)
    for bad in damaged(kernel_queries.symbol_blob(kernel_queries.SYMBOLS), rng, 25):
        kallsyms.decode(bad)
        kernel.read_ikconfig(bad)
    for bad in damaged(package_queries.rpm_blob(), rng):
        packages.read_rpm_headers(bad)
    whole = sources.index_bytes([("a", "b", "c", "", "", "d", [("i", "0"), ("f", "1")])] * 3)
    assert len(list(sources.read_index_bytes(whole))) == 3
    for bad in damaged(whole, rng):
        list(sources.read_index_bytes(bad))


def test_secrets_and_configs():
    rng = random.Random(3)
    scanner = secrets.Scanner(secrets.RULES)
    for _, data in ingest_queries.rule_files():
        for bad in damaged(data, rng, 10):
            found = scanner.scan(bad)
            assert len({(f[0], f[2]) for f in found}) == len(found)
    for text in ("", "{", "[" * 100000, '{"password":' * 300, '{"password":{"a":["hunter2hunter2"]}}', '{"pin":1e400}', '{"pin":NaN}'):
        credentials.scan_config("p", text)


def test_known_answers():
    assert keys.fermat(101 * 103) == (101, 103) and keys.fermat(101 * 100003) is None
    assert {r: sum(1 << x for x in v) for r, v in keys.roca_residues().items() if r in (3, 5, 7, 11, 13)} == {3: 6, 5: 30, 7: 126, 11: 1026, 13: 5658}
    p, q = 1009, 1013
    d = 17
    assert keys.wiener(p * q, pow(d, -1, (p - 1) * (q - 1))) == d
    for curve, (prime, a, x, y) in keys.CURVE_PARAMETERS.items():
        b = (y * y - x**3 - a * x) % prime
        assert all((v * v - u**3 - a * u - b) % prime == 0 for _, u, v in keys.multiples(curve, 20))
