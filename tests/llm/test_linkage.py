from tuffstone.llm import linkage as k

ENTRIES = [("acme_inc", "rocket_agent"), ("acmeinc", "rocket_agent"), ("acme", "netmon"), ("borax-labs", "netmon"), ("zeta", "libvulcan"), (None, "x"), ("y", None), ("acme_inc", "rocket_agent")]
RECORDS = [
    (1, "Rocket Agent", None, None, None, {"acme_inc", "acmeinc"}), (2, "rocket-agt", None, None, None, {"acme_inc", "acmeinc"}), (3, "roket-agent-dev", "dpkg; built by Acme Inc", None, None, {"acme_inc", "acmeinc"}),
    (4, "agent rocket", None, None, None, {"acme_inc", "acmeinc"}), (5, "netmon", "npm (c) Borax Labs", None, None, {"borax-labs"}), (6, "netmon", "npm (c) Third Works", None, None, set()), (7, "netmon", None, "cpe:/a:acme:netmon:1", None, {"acme"}),
    (8, "netmon", None, None, "Acme SDK", {"acme"}), (9, "vulcan3", None, None, None, {"zeta"}), (10, "libvulcan", None, "cpe:2.3:a:acme:netmon:1:*", None, {"zeta"}), (11, "rocket", None, None, None, set()), (12, None, None, None, None, set()),
    (13, "", None, None, None, set()), (14, "Acme Inc Netmon", None, None, None, {"acme"}), (15, "vulcan-crypt", None, None, None, set()), (16, "netmon", None, None, None, set()), (17, "netmon", None, "cpe:2.3:a:third:netmon:1:*", None, set()),
]


def frames(spark, times=40):
    rows = [(n + 100 * t, name, ev, cpe, fork, 0.0) for t in range(times) for n, name, ev, cpe, fork, _ in RECORDS]
    components = spark.createDataFrame(rows, "comp_id bigint, name string, evidence string, cpe string, fork string, confidence double")
    return components, spark.createDataFrame(ENTRIES, "vendor string, product string")


def test_matches(spark):
    components, entries = frames(spark)
    got = {}
    for r in k.matches(components, entries).collect():
        got.setdefault(r.comp_id, set()).add(r.vendor)
        assert 0.5 < r.confidence <= 1
    assert {n: got.get(n, set()) for n, *_ in RECORDS} == {n: makers for n, *_, makers in RECORDS}
    assert all(got[n] == got.get(n + 100) for n in got if n < 100)


def test_blocks_of_the_index_agree(spark):
    components, entries = frames(spark)
    model = k.fit_mixture(components, [(v, p) for v, p in ENTRIES if v and p])
    whole = {(r.comp_id, r.vendor, r.product) for r in k.matches(components, entries, model=model).collect()}
    parts = {(r.comp_id, r.vendor, r.product) for r in k.matches(components, entries, block=2, model=model).collect()}
    assert whole == parts


def test_many_blocks_give_the_rows_of_one(spark):
    components, entries = frames(spark)
    # Names that are exact in one block and a typing error away in others, entities of several lengths and makers.
    more = [("acme", "rocket_agents"), ("borax-labs", "roket_agent"), ("zeta", "netmonx"), ("third", "netmon"), ("acme", "mon"), ("zeta", "lib-libvulcan"), ("acme", "vulcan"), *[(f"maker{i}", f"thing{i % 7}") for i in range(40)]]
    entries = entries.unionByName(spark.createDataFrame(more, "vendor string, product string"))
    names = ["rocket agents", "roket agent", "netmonx", "acme mon", "thing3", "thing33", "maker9 thing2 dev", "liblibvulcan", "vulcan"]
    extra = [(9000 + i, n, "origin maker3" if i % 2 else None, None, None, 0.0) for i, n in enumerate(names)]
    components = components.unionByName(spark.createDataFrame(extra, components.schema))
    whole, parts = ({(r.comp_id, r.vendor, r.product): r.confidence for r in k.matches(components, entries, block=b).collect()} for b in (30_000, 10))
    assert whole.keys() == parts.keys() and any(n >= 9000 for n, *_ in whole)
    assert all(abs(whole[m] - parts[m]) < 1e-9 for m in whole)


def test_a_fit_beyond_the_bound_leaves_no_pattern_out(spark):
    components, _ = frames(spark, 3)
    pairs = [(v, p) for v, p in ENTRIES if v and p]
    whole, parts = k.fit_mixture(components, pairs), k.fit_mixture(components, pairs, max_patterns=2)
    assert abs(whole.weight - parts.weight) < 1e-9 and abs(whole.means - parts.means).max() < 1e-9 and abs(whole.spreads - parts.spreads).max() < 1e-9


def test_nothing(spark):
    components, entries = frames(spark, 1)
    assert k.matches(components.limit(0), entries).count() == 0
    assert k.matches(components, entries.limit(0)).count() == 0


def test_near():
    assert k.near("abc", "abd") and k.near("abc", "acb") and k.near("abc", "abcd") and k.near("abc", "bc")
    assert not k.near("abc", "abc") and not k.near("abc", "xbd") and not k.near("abc", "abcde")
