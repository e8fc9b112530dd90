from itertools import combinations

from tuffstone.llm import homoglyphs as h
from tuffstone.llm import looks

SAME = [
    ("Boot image 10", "Вооt imаgе 10"), ("office", "oﬃce"), ("ABC-1", "ＡＢＣ－１"), ("code", "𝚌𝚘𝚍𝚎"), ("a b", "a b"), ("a b", "a　b"), ("café", "café"), ("word", "wo​rd"),
    ("re-do", "re‐do"), ("x", "﻿x"), ("x\ny", "x\r\ny"), ("ё", "ё"),
]
OTHER = [("a", "A"), ("l", "1"), ("O", "0"), ("a b", "a  b"), ("resume", "résumé"), ("a\nb", "a b"), ("word", "worn"), ("x²", "x2"), ("ab", "ba"), ("-", "–")]


def form(text):
    return h.Speller([("boot", 5), ("код", 3)]).text(text)


def test_forms():
    for a, b in SAME:
        assert form(a) == form(b), (a, b)
    for a, b in OTHER:
        assert form(a) != form(b), (a, b)


def test_words_keep_their_script():
    assert form("привет") == "привет" and form("пpивeт") == "привет"
    speller = h.Speller([("кот", 9), ("сор", 4)])
    assert speller.text("kot") != speller.text("кот2")
    assert speller.word("cop") == speller.word("сор") == "сор"


def test_automaton_costs():
    trie = h.Trie([("boot", 2), ("boat", 9)])
    assert trie.best("bооt") == "boot" and trie.best("bxot") is None
    assert trie.best("bxot", 1) == "boot" and trie.best("bxt", 1) is None and trie.best("bot", 1) == "boat" and trie.best("boots", 1) == "boot"


def test_every_blank_and_ignorable_is_settled():
    assert all(looks.plain_form(b) == " " for b in looks.BLANKS)
    assert all(looks.plain_form(i) == "" for i in looks.IGNORABLE)


def test_pairs_against_loops(spark):
    texts = [t for pair in SAME + OTHER for t in pair] + ["same", "same", "", None, " ", "​"] + ["hot copy"] * 60 + ["hоt copy"]
    texts.append("long " * 20000)
    texts.append("lоng " * 20000)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, form string")
    got = {tuple(r) for r in h.same_look_pairs(df).collect()}
    forms = {i: form(t) for i, t, _ in rows if t is not None}
    want = {(a, b) for a, b in combinations(sorted(forms), 2) if forms[a] == forms[b] and texts[a] != texts[b] and forms[a].strip(" ")}
    assert got == want
    assert {tuple(r) for r in h.same_look_pairs(df, block=1).collect()} == want
    linked = {r.doc_id: r.n_links for r in h.look_classes(df).collect()}
    assert linked == {i: sum(forms[j] == f and texts[j] != texts[i] for j in forms) for i, f in forms.items()}
    classes = {r.doc_id: r.class_id for r in h.look_classes(df).collect()}
    assert classes == {i: min(j for j in forms if forms[j] == f) for i, f in forms.items()}
    assert h.same_look_pairs(df.limit(0)).count() == 0
