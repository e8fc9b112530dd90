import random

from tuffstone.llm import packing as p


def test_fill_is_the_best_subset():
    rng = random.Random(4)
    for _ in range(200):
        items = [rng.randrange(1, 20) for _ in range(rng.randrange(0, 9))]
        room = rng.randrange(1, 50)
        counts = {k: items.count(k) for k in set(items) if k <= room}
        use = p.fill(room, counts, sorted(counts, reverse=True))
        sums = {0}
        for i in items:
            sums |= {s + i for s in sums}
        assert sum(k * n for k, n in use.items()) == max(s for s in sums if s <= room)
        assert all(n <= counts[k] for k, n in use.items())


def test_containers(spark):
    rng = random.Random(1)
    texts = ["word " * rng.randrange(0, 60) for _ in range(300)] + ["same text here"] * 100 + [None, "", "long " * 5000, "😀" * 50, "x" * 20000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, shard int")
    counts = {r.doc_id: r.n_tokens for r in p.token_counts(df).collect()}
    rows = p.containers(df, capacity=128, shard_items=150).collect()
    held = {}
    for r in rows:
        held.setdefault(r.container, []).append(r)
    assert all(sum(r.n_tokens for r in c) == c[0].container_tokens <= 128 for c in held.values())
    whole = {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.piece)):
        assert r.first_token == whole.get(r.doc_id, 0)
        whole[r.doc_id] = whole.get(r.doc_id, 0) + r.n_tokens
        assert counts[r.doc_id] > 128 or r.n_tokens == counts[r.doc_id]
    assert whole == {i: n for i, n in counts.items() if n}
    report = p.fill_report(p.containers(df, capacity=128, shard_items=150), 128).first()
    assert report.containers <= report.least_containers + 4 and report.tokens == sum(counts.values())
    empty = p.containers(df.limit(0))
    assert empty.count() == 0 and p.fill_report(empty).first().containers == 0
