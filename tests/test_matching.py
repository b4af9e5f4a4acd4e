"""Watched names: the automaton, folding, the greedy choice, and blocks of names, each against a plain version."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import glossary, matching


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@given(st.text("abc é", max_size=14), st.text("abc é", max_size=14), st.integers(1, 2))
@settings(max_examples=300, deadline=None)
def test_automaton_tells_the_distance(term, phrase, edits):
    d = distance(phrase, term)
    assert matching.Automaton(term, edits).distance(phrase) == (d if d <= edits else None)


@given(st.lists(st.text("abcd", min_size=1, max_size=13), min_size=1, max_size=8), st.text("abcd", min_size=1, max_size=13))
@settings(max_examples=200, deadline=None)
def test_guess_is_the_first_term_in_reach(terms, phrase):
    names = matching.Names([(t, t, "glossary", i, 1, True) for i, t in enumerate(terms)], [])
    near = [(i, t, "glossary", distance(phrase, t)) for i, t in enumerate(terms) if 0 < distance(phrase, t) <= (2 if len(t) >= 10 else 1)]
    assert names.guess(phrase, 1) == min(near, default=None) and names.guess(phrase, 2) is None


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4)), unique=True, max_size=14))
@settings(max_examples=200, deadline=None)
def test_longest_hits_first_then_leftmost(hits):
    plain, words = [], set()
    for i, n in sorted(hits, key=lambda h: (-h[1], h[0])):
        if words.isdisjoint(range(i, i + n)):
            words |= set(range(i, i + n))
            plain.append((i, n))
    ranks = matching.taken(hits)
    assert [hits[k] for k in sorted(ranks, key=ranks.get)] == plain


def test_words_are_folded_as_in_columns(spark):
    words = ["Straße!", "(ΌΣΟΣ)", "ıİ", "ﬁn", "—", "'s", "Ꭰꭰᏸ", "ǅ", "a-b", "É́", *[chr(c) for c in range(0x1F00, 0x2000) if chr(c).strip()]]
    rows = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").select("i", T.fold("w").alias("f"))
    assert [r["f"] for r in rows.orderBy("i").collect()] == [matching.folded(w) for w in words]


def test_windows_are_those_of_the_columns(spark):
    texts = ["a  b\tc", "", " — x ", "-- -- y z\x1cw", "It's (The) End. Really", "one"]
    rows = spark.createDataFrame([("s", i, t) for i, t in enumerate(texts)], "source_id string, passage_idx int, text string")
    want = {(r["passage_idx"], r["i"], r["n"]): (T_strip(r["phrase"]), r["folded"]) for r in glossary.ngrams(rows, [1, 2, 3]).collect() if r["folded"]}

    class All(dict):
        def __missing__(self, phrase):
            return (matching.FORM, 0, "t", "e", 0) if phrase else None

    found = {(k, i, n): (phrase, folded) for k, t in enumerate(texts) for i, n, phrase, folded, *_ in matching.found_in(t, matching.Folds(), {n: All() for n in (1, 2, 3)})}
    assert found == want


def T_strip(text):
    return text.strip(T.EDGES)


@pytest.fixture(scope="module")
def tables(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcde") for _ in range(r.randint(3, 12)))
    terms = [" ".join(word() for _ in range(r.choice([1, 1, 2]))) for _ in range(60)]

    def spoil(t):
        i = r.randrange(len(t))
        return t[:i] + r.choice(["", "x", t[i] + "y"]) + t[i + 1 :]

    texts = [" ".join(r.choice([word(), spoil(r.choice(terms)), r.choice(terms).title(), "known form"]) for _ in range(40)) for _ in range(9)] + ["", None]
    passages = spark.createDataFrame([(f"s{i % 3}", i, t, float(i)) for i, t in enumerate(texts)], "source_id string, passage_idx int, text string, start double")
    names = spark.createDataFrame([(None if i % 3 else f"s{i % 2}", t, "title" if i % 2 else "glossary", i) for i, t in enumerate(terms)], "source_id string, term string, origin string, term_idx int")
    forms = spark.createDataFrame([(None, "known form", "Zed", "given"), ("s1", "known form", "Alpha", "given"), (None, "known", "Form", "read")], "source_id string, folded string, term string, evidence string")
    return passages, names, forms


def test_blocks_of_names_find_the_same(tables):
    passages, names, forms = tables
    whole = sorted(map(tuple, glossary.matches(*tables, [1, 2]).collect()), key=str)
    named = names.select("source_id", "term", T.fold("term").alias("folded"), "origin", F.col("term_idx").cast("long").alias("term_idx"), F.size(T.tokens("term")).alias("words"), glossary.worth_watching("term").alias("watched"))
    for block in ((7, 1 << 20), (1000, 60)):
        assert sorted(map(tuple, matching.match(passages, named, forms, [1, 2], block).collect()), key=str) == whole
    assert len(whole) > 30 and {r[7] for r in whole if r[6] == "known form"} == {"Zed", "Alpha"}


def test_nothing_to_watch(spark, tables):
    passages, names, forms = tables
    assert glossary.hits(passages, names.limit(0), forms.limit(0), [1, 2]).count() == 0
    assert glossary.hits(passages.limit(0), names, forms, [1, 2]).count() == 0
    assert glossary.propose_corrections(passages, names, forms, [1, 2]).where("wrong is null or right is null").count() == 0
