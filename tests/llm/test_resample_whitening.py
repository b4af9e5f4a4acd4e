"""Resampling and whitening against brute force, on small tables with nulls, ties, long texts and repeated rows."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lectern.llm import resample, whitening

R = random.Random(12)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features_of(text):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def drawn_plainly(docs, target, percent=5, least=20):
    """[(doc_id, text)], [text] -> sorted rows of doc_id, n_words, n_features, weight, score, rank."""
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for texts, into in (([x for _, x in docs], s), (target, t)):
        for x in texts:
            for f in features_of(x):
                into[bucket(f)] += 1
    gain = [math.floor(1000 * math.log((float(b) + 1) * (sum(s) + 10_000.0) / ((a + 1.0) * (sum(t) + 10_000.0)))) for a, b in zip(s, t)]
    rows = []
    for key, x in docs:
        f = features_of(x)
        h = int(hashlib.sha256(f"42:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in f)
        rows.append([key, len(words_of(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, *r[1:4]))
    k = percent * len(able) // 100
    ranks = {id(r): i + 1 for i, r in enumerate(able[:k])}
    return sorted(((*r, ranks.get(id(r))) for r in rows), key=str)


def prose(n):
    return " ".join(R.choice(["the", "Cat", "sat", "on", "a", "mat", "été", "東京", "x9", "tuning", "word" * 80]) + R.choice(["", "", ",", ".", "_", "\u0000", "\n"]) for _ in range(n))


@given(st.lists(st.one_of(st.text(st.sampled_from("aZ9 é東.\x00\n"), max_size=30), st.integers(1, 700).map(lambda n: "q" * n + " b")), max_size=5))
@settings(max_examples=60, deadline=None)
def test_runs_have_the_crc32_of_their_text(texts):
    ends, found = resample.runs([t.encode() for t in texts], resample._Seen(), 3)
    for k, t in enumerate(texts):
        w = words_of(t)
        assert ends[k + 1] - ends[k] == len(w)
        for n, (crc, whole) in enumerate(found, 1):
            own = [int(crc[i]) for i in range(ends[k], min(ends[k + 1], len(crc))) if whole[i]]
            assert own == [zlib.crc32(" ".join(w[i : i + n]).encode()) for i in range(len(w) - n + 1)]


def test_texts_longer_than_a_piece(monkeypatch):
    text = prose(400)
    monkeypatch.setattr(resample, "PIECE", 97)
    crc, _ = resample.runs([text.encode(), b"a" * 1000], resample._Seen(), 1)[1][0]
    assert crc.tolist() == [zlib.crc32(w.encode()) for w in [*words_of(text), "a" * 1000]]


@pytest.mark.parametrize("percent", [5, 40, 100, 0])
def test_resampling_against_brute_force(spark, percent):
    docs = [(i, prose(R.randint(0, 60))) for i in range(120)] + [(500, None), (501, ""), (None, prose(30)), (7, prose(25))] + [(9, "the cat " * 15)] * 40 + [(600 + i, "the cat " * 15) for i in range(40)] + [(999, prose(9000))]
    target = [prose(8) for _ in range(20)] + [None, ""]
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, rank string, score int").repartition(3)
    items = spark.createDataFrame([(t,) for t in target], "text string")
    out = resample.resample(frame, items, percent=percent)
    assert sorted(map(tuple, out.collect()), key=str) == drawn_plainly(docs, target, percent)
    assert out.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, prose(30))], "doc_id long, text string")
    assert resample.resample(docs, some).count() == 0
    assert resample.resample(some, docs).first()["rank"] is None
    assert sorted(map(tuple, resample.resample(some, docs, percent=100).collect())) == drawn_plainly([tuple(some.first())], [], 100)


# whitening


def plainly(rows, d):
    """[(id, vector)] -> n, {id: (x, deviation)}, covariance of the fit list in floating point."""
    kept = [(k, v) for k, v in rows if v is not None and len(v) == d and all(c is not None and math.isfinite(c) and abs(c) < 2.0**43 for c in v)]
    x = [[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept]
    n, total = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(r, total)) for r in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(r, total)] for r in x])
    return [k for k, _ in kept], n, deviation, centred


def check(spark, rows, d, k, parts=5, kind="float"):
    frame = spark.createDataFrame([(i, v, "x", 1.0) for i, v in rows], f"vec_id long, embedding array<{kind}>, n string, component double").repartition(parts)
    ids, n, deviation, centred = plainly([(i, None if v is None else [None if c is None else float(np.float32(c)) if kind == "float" else c for c in v]) for i, v in rows], d)
    out = whitening.whiten(frame, k).collect()
    assert len(out) == len(ids) * min(k, d)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = min(k, d)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n"], r["deviation"]) for r in out if r["component"] == 1) == sorted((i is None, i or 0, n, v if v < 2**63 else None) for i, v in zip(ids, deviation))
    assert all(r["identity_error"] == out[0]["identity_error"] and r["identity_error"] < 1e-9 for r in out)
    by = {}
    for r in out:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], []).append(r["whitened"])
        want = values[r["component"] - 1] / max(values.sum(), 1e-300)
        assert abs(r["explained"] - (want if want > 1e-15 else 0)) <= 1e-9
    for j in range(some):
        if values[j] <= 1e-9 * max(values[0], 1e-9):
            assert all(w == 0 for ws in by[j + 1].values() for w in ws)
            continue
        want = centred @ vectors[:, j] / math.sqrt(values[j])
        got = {i: ws[0] for i, ws in by[j + 1].items()}
        have = np.array([got[i] for i in ids])
        if len(set(ids)) == len(ids):
            assert min(np.abs(have - want).max(), np.abs(have + want).max()) < 1e-7
    return out


def test_whitening_against_an_eigendecomposition(spark):
    rng = np.random.default_rng(5)
    mix = rng.normal(size=(12, 12)) * np.geomspace(1, 0.05, 12)
    rows = [(i, (rng.normal(size=12) @ mix).tolist()) for i in range(700)]
    rows += [(800, None), (801, [None] + [0.0] * 11), (802, [math.nan] * 12), (803, [math.inf] + [0.0] * 11), (804, []), (805, [1.0] * 11), (806, [1.0] * 13), (807, [1e30] * 12), (None, [0.5] * 12)]
    check(spark, rows, 12, 8)
    check(spark, rows, 12, 8, parts=40)  # three levels of the tree at 16 a step


def test_whitening_of_large_entries_is_exact(spark):
    rng = np.random.default_rng(6)
    out = check(spark, [(i, (rng.normal(size=3) * 2.0**41 * [1, 0.3, 0.1]).tolist()) for i in range(50)], 3, 8, kind="double")
    assert all(r["deviation"] is None for r in out)


def test_whitening_without_variance_or_rows(spark):
    out = check(spark, [(1, [1.0, 2.0, 3.0])] * 5, 3, 8)
    assert {(r["whitened"], r["explained"], r["identity_error"]) for r in out} == {(0.0, 0.0, 0.0)}
    check(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(40)], 3, 8)  # of rank one
    check(spark, [(1, [0.25])], 1, 8)
    for rows in ([], [(1, None)], [(1, [])], [(1, [None])]):
        assert whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect() == []


def test_repeated_vectors_all_count(spark):
    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    out = check(spark, rows + [rows[0]] * 30, 4, 2)
    assert sum(r["vec_id"] == 0 for r in out) == 62
