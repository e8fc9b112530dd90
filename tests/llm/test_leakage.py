import random

import numpy as np

from tuffstone.llm import leakage as k

rng = random.Random(8)
VOCABULARY = [f"w{i}" for i in range(300)]
ITEMS = [(i, " ".join(rng.choice(VOCABULARY) for _ in range(rng.randrange(20, 60)))) for i in range(30)]


def planted():
    """(document, item it holds or None)."""
    docs = []
    for n in range(200):
        i, text = rng.choice(ITEMS)
        words = text.split()
        share = rng.choice([0.2, 0.3, 0.65, 0.8, 1.0])
        size = int(len(words) * share)
        at = rng.randrange(len(words) - size + 1)
        part = words[at : at + size]
        for j in range(len(part) // 14):
            part[rng.randrange(len(part))] = f"other{n}{j}"
        if rng.random() < 0.4 and len(part) > 10:
            cut = len(part) // 2
            part = part[:cut] + [f"between{j}" for j in range(rng.randrange(1, 30))] + part[cut:]
        filler = [f"f{rng.randrange(5000)}" for _ in range(rng.randrange(40))]
        lines = " ".join(filler) + "\n> " + " ".join(part).upper().replace("W1", "Ｗ１") + "!\n" + " ".join(filler[:9])
        docs.append((n, lines, i if share > 0.5 else None))
    return docs


def test_planted_passages(spark):
    docs = planted()
    df = spark.createDataFrame([(n, t, 0) for n, t, _ in docs] + [(900, None, 0), (901, "", 0)], "doc_id bigint, text string, item_id int")
    items = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, "w1 w2")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in k.leaks(df, items).collect()}
    assert got == {(n, i) for n, _, i in docs if i is not None}
    # Items in several blocks give the same.
    assert {(r.doc_id, r.item_id) for r in k.leaks(df, items, block_chars=2000).collect()} == got
    clean = {r.doc_id for r in k.without_leaks(df, items).collect()}
    assert clean == ({n for n, _, _ in docs} | {900, 901}) - {n for n, _ in got}
    assert k.leaks(df.limit(0), items).count() == 0 and k.leaks(df, items.limit(0)).count() == 0


def test_line_numbers_are_marks():
    assert k.words_of("11: Every dial\n12: moves 7\n") == ["every", "dial", "moves", "7"]


def tail(words, p):
    """The words from place ``p`` to the next gap."""
    out = []
    for w in words[p:]:
        if w == 0:
            break
        out.append(int(w))
    return out


def common(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def test_suffix_array_against_loops():
    r = np.random.default_rng(2)
    words = np.concatenate([r.integers(0, 4, 400), np.tile([1, 2, 3], 40), [0], np.tile([1, 2, 3], 40)]).astype(np.int32)
    shard = k.SuffixArray(words, 12)
    tails = [tail(words, p)[:12] for p in shard.order]
    assert tails == sorted(tails) and sorted(shard.order.tolist()) == [p for p in range(len(words)) if words[p]]
    assert shard.shared[1:].tolist() == [common(a, b) for a, b in zip(tails, tails[1:])]
    asked = np.append(r.integers(1, 5, 60), 0).astype(np.int32)
    places = np.arange(49)
    at, before, behind = shard.search(asked, places)
    for p, k_, x, y in zip(places, at, before, behind, strict=True):
        mine = tail(asked, p)[:12]
        assert all(t < mine for t in tails[:k_]) and all(t >= mine for t in tails[k_:])
        assert max(x, y) == max(common(mine, t) for t in tails)


def test_matches_against_loops():
    r = np.random.default_rng(6)
    items = k.Items([(i, " ".join(f"w{x}" for x in r.integers(0, 5, n))) for i, n in enumerate((2, 7, 9, 30, 45))])
    assert items.run.tolist() == [2, 4, 3, 4, 5]
    number = [items.vocabulary.get(f"w{x}", 0) for x in range(5)] + [0]
    words = np.array([number[x] for x in r.integers(0, 6, 500)] + items.words[:-1].tolist(), np.int32)
    want = set()
    for there in np.flatnonzero(items.words):
        run = items.run[items.item_at[there]]
        for at in np.flatnonzero(words):
            n = common(tail(words, at), tail(items.words, there))
            fresh = at == 0 or there == 0 or words[at - 1] == 0 or words[at - 1] != items.words[there - 1]
            if n >= run and fresh:
                want.add((int(at), int(there), n))
    for room in (4_000_000, 7):
        got = [t for part in k.matches(words, items, room) for t in zip(*(x.tolist() for x in part), strict=True)]
        assert len(got) == len(set(got)) and set(got) == want


def test_short_items_and_large_vocabularies(spark):
    df = spark.createDataFrame([(1, "see alpha beta gamma there"), (2, "alpha then beta gamma"), (3, "alpha beta"), (4, "one two three four five six of ours")], "doc_id bigint, text string")
    few = [(1, "alpha beta gamma"), (2, "one two three four five six seven eight")]
    many = few + [(9, " ".join(f"x{i}" for i in range(40_000)))]
    for items in (few, many):
        got = {(r.doc_id, r.item_id) for r in k.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
        assert got == {(1, 1), (4, 2)}


def test_a_poor_longer_cover_hides_no_sound_one(spark):
    item = [f"v{i}" for i in range(60)]
    part = lambda a, b, swaps: ["other" if i in swaps else item[i] for i in range(a, b)]
    good, poor = part(0, 34, {8, 16, 24}), part(34, 60, {39, 41, 43, 50, 52, 54})
    docs = [(1, good + ["between", "them"] + poor), (2, good + poor), (3, poor + good), (4, part(0, 28, {8, 16}) + ["between"] + part(28, 60, set(range(30, 60, 4)))), (5, good)]
    df = spark.createDataFrame([(n, " ".join(d)) for n, d in docs], "doc_id bigint, text string")
    got = {r.doc_id: r for r in k.leaks(df, spark.createDataFrame([(7, " ".join(item))], "item_id bigint, text string")).collect()}
    assert {1, 2, 3, 5} <= got.keys()
    assert all(r[2] >= 30 and r[5] <= 0.13 * r[2] for r in got.values())


def test_sound_cover_against_loops():
    r = np.random.default_rng(4)
    for _ in range(60):
        item = np.arange(1, 15)
        cut, gap = int(r.integers(3, 12)), int(r.integers(0, 3))
        doc = np.concatenate([item[:cut], np.full(gap, 99), item[cut:]])
        doc[r.random(len(doc)) < 0.25] = 99
        diagonals = np.unique([0, gap])
        pieces = k._pieces(doc, item, diagonals, 2.0)
        parts = [(i, j, c + i - a, int((doc[c + i - a : c + j - a] != item[i:j]).sum())) for a, b, c, _ in pieces for i in range(a, b) for j in range(i + 1, b + 1) if doc[c + i - a] == item[i] and doc[c + j - 1 - a] == item[j - 1]]
        covers = [(p[1] - p[0], p[3]) for p in parts] + [(p[1] - p[0] + q[1] - q[0], p[3] + q[3]) for p in parts for q in parts if q[0] >= p[1] and q[2] >= p[2] + p[1] - p[0] and q[2] - q[0] != p[2] - p[0]]
        want = max((n for n, m in covers if m <= 0.13 * n), default=0)
        got = k.sound_cover(doc, item, diagonals, 2.0, 0.13)
        assert got[0] == want and got[1] <= 0.13 * got[0]
