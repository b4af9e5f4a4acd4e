"""The pipeline and each of its stages against plain versions that walk over words and pairs."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from test_corpus_operators import SECRET, brute_em, brute_links, brute_measures, brute_secrets, shingle_set
from tokenizers import Tokenizer

import corpus_pipeline as P
from lectern.llm import packing, quality, queries, secrets

R = random.Random(41)
LETTERS = "abcdefghijklmnoprstuvw"
VOCAB = ["".join(R.choice(LETTERS) for _ in range(R.randint(2, 9))) for _ in range(700)]
TOKENIZER = Tokenizer.from_file(packing.default_vocabulary())


def sentences(n, r=R):
    words = [r.choice(VOCAB) for _ in range(n)]
    return " ".join(w.capitalize() + ("." if i % 9 == 8 or i == n - 1 else "") for i, w in enumerate(words))


def swapped(text, k, r=R):
    words = text.split(" ")
    for i in r.sample(range(len(words)), k):
        words[i] = r.choice(VOCAB)
    return " ".join(words)


def made():
    good = [sentences(R.randint(60, 220)) for _ in range(60)]
    item, short = sentences(40), sentences(6)
    rows = [*good, good[0], good[0], swapped(good[1], 2), swapped(good[1], 3), swapped(good[2], 40), good[3] + " " + item, sentences(400) + " " + short + " " + sentences(300), f'{sentences(100)} token = "{SECRET}" done.']
    rows += [f"{good[5]}\npassword=changeme1 here.", sentences(3000), None, "", "  \n ", "too short."]
    rows += [" ".join(w + R.choice(["###", "&&&", "%%%", "***"]) for w in sentences(90).split()) for _ in range(6)]
    rows += [" ".join(w.upper().rstrip(".") + "!!" for w in sentences(90).split()) for _ in range(5)]
    rows += [" | ".join(VOCAB[R.randrange(700)] for _ in range(90)) for _ in range(5)]
    rows += [" ".join([R.choice(VOCAB)] * 200) for _ in range(4)]
    # good texts without one full stop: one bad vote each, more of them than of any junk
    rows += [sentences(100).replace(".", "") for _ in range(9)]
    ids = list(range(len(rows)))
    ids[61] = None
    return [(i, t, "en", "s", len(t or ""), "clash") for i, t in zip(ids, rows)], [(0, item), (1, short), (2, None), (3, "")]


ROWS, ITEMS = made()
KIND = "doc_id long, text string, lang string, source string, n_chars long, key string"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(ROWS, KIND).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def brute_votes(text):
    t = text or ""
    n, chars, symbols, dup, rep = brute_measures(t)
    w = [x for x in regex.split(r"[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if regex.search(r"[^\x20\x09-\x0d]", x)]
    k, ends = max(1, n), sum(c in ".?!" for c in t)

    def over(value, bad, good):
        return "b" if value >= bad else "g" if value <= good else "-"

    plain = sum(bool(regex.match(quality.PLAIN, x)) for x in w)
    line_ends = sum(bool(regex.search(quality.LINE_END, x)) for x in lines) / max(1, len(lines))
    kinds, size = len(set(w)), min(k, 1000)
    return "".join(
        [
            over(symbols / k, 0.2, 0.03),
            over(1 - plain / k, 0.3, 0.15),
            over(t.count("!") / k, 0.2, 0.05),
            over(len(regex.findall(r"\p{Lu}", t)) / max(1, chars), 0.3, 0.15),
            over(rep / k, 0.3, 0.1),
            over(dup / len(lines), 0.5, 0.1) if len(lines) >= 4 else "-",
            ("b" if line_ends <= 0.3 else "g" if line_ends >= 0.7 else "-") if len(lines) >= 3 else "-",
            ("b" if kinds <= 0.12 * size else "g" if kinds >= 0.2 * size else "-") if n >= 20 else "-",
            "b" if chars / k < 2 or chars / k > 14 else "g" if 3 <= chars / k <= 10 else "-",
            ("b" if ends / k < 0.005 or ends / k > 0.4 else "g" if 0.02 <= ends / k <= 0.3 else "-") if n >= 20 else "-",
        ]
    )


def brute_quality(rows):
    votes = [brute_votes(r[1]) for r in rows]
    long_enough = [brute_measures(r[1] or "")[0] >= 50 for r in rows]
    good = brute_em([v for v, ok in zip(votes, long_enough) if ok])
    failed = [n < 50 or 100 * rep > 50 * n for n, _, _, _, rep in (brute_measures(r[1] or "") for r in rows)]
    return [r for r, v, bad in zip(rows, votes, failed) if not bad and good[v] >= 0.5]


def brute_duplicates(rows):
    _, label = brute_links([(r[0], r[1]) for r in rows])
    classes = defaultdict(list)
    for r, k in zip(rows, label):
        classes[k].append(r)
    return [min(group, key=lambda r: (r[0] is None, r[0] or 0)) for group in classes.values()]


def brute_decontamination(rows):
    items = [s for s in (shingle_set(t) for _, t in ITEMS) if s]
    return [r for r in rows if not any(len(s & shingle_set(r[1])) >= 0.8 * len(s) - 1e-9 for s in items)]


def brute_redaction(rows, forest):
    out = []
    for r in rows:
        t = r[1]
        for a, b, _, p in reversed(brute_secrets(t or "", forest)):
            t = t[:a] + "[SECRET]" + t[b:] if p >= 0.5 else t
        out.append((r[0], t, *r[2:]))
    return out


def brute_pieces(rows):
    out = []
    for doc_id, text, *_ in rows:
        ids = [*TOKENIZER.encode(text or "", add_special_tokens=False).ids, 1]
        out += [(doc_id, at, len(ids[at : at + 2048]), zlib.crc32(np.array(ids[at : at + 2048], "<u4").tobytes()), len(ids)) for at in range(0, len(ids), 2048)]
    return out


def best_fit(lengths):
    rooms = []
    for need in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= need]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - need)
        else:
            rooms.append(2048 - need)
    return len(rooms)


def test_stages_equal_brute_force(spark, folder, tmp_path):
    forest = secrets.fit(spark)
    plain = {"quality_rules": brute_quality, "near_duplicates": brute_duplicates, "decontamination": brute_decontamination, "secret_scan": lambda rows: brute_redaction(rows, forest)}
    docs, rows = spark.read.parquet(f"{folder}/documents.parquet"), ROWS
    names, sizes = docs.columns, []
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == names
        out.write.parquet(f"{tmp_path}/{name}")
        docs, rows = spark.read.parquet(f"{tmp_path}/{name}"), plain[name](rows)
        assert Counter(map(tuple, docs.collect())) == Counter(rows), name
        sizes.append(len(rows))
    assert len(ROWS) > sizes[0] > sizes[1] > sizes[2] == sizes[3]
    kept = {r[0]: r[1] for r in rows}
    assert set(range(4, 60)) <= set(kept) and not any("###" in t or "!!" in t or SECRET in t for t in kept.values())
    placed = P.STAGES[-1][1](spark, docs, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in placed) == Counter(brute_pieces(rows))
    assert len({r["sequence_id"] for r in placed}) == best_fit([p[2] for p in brute_pieces(rows)])
    whole = P.run(spark, folder).collect()
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"]) for r in whole) == Counter((p[0], p[1], p[3]) for p in brute_pieces(rows))


def test_pipeline_of_nothing(spark, tmp_path):
    d = str(tmp_path)
    spark.createDataFrame([], KIND).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert P.run(spark, d).count() == 0


def test_queries_over_a_folder(spark, folder):
    """The registered queries themselves, on tables with null ids, empty and repeated texts and an extra column."""
    own = {name: queries.QUERIES[name](spark, folder).collect() for name in ("op2_packing", "op3_lm_scoring", "op4_secret_scan", "op5_quality_rules", "op8_ngram_jaccard_join", "op9_decontamination", "op10_license_scan")}
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in own["op2_packing"]) == Counter(brute_pieces(ROWS))
    assert Counter(r["doc_id"] for r in own["op3_lm_scoring"]) == Counter(r[0] for r in ROWS)
    forest = secrets.fit(spark)
    assert Counter((r["doc_id"], r["start"], r["end"]) for r in own["op4_secret_scan"]) == Counter((r[0], a, b) for r in ROWS for a, b, *_ in brute_secrets(r[1] or "", forest))
    kept = Counter(r[0] for r in brute_quality(ROWS))
    assert Counter(r["doc_id"] for r in own["op5_quality_rules"] if r["kept"]) == kept and len(own["op5_quality_rules"]) == len(ROWS)
    link, label = brute_links([(r[0], r[1]) for r in ROWS])
    least = {k: min((r[0] for r, x in zip(ROWS, label) if x == k and r[0] is not None), default=None) for k in set(label)}
    assert Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in own["op8_ngram_jaccard_join"]) == Counter((r[0], least[k], len(link[i])) for i, (r, k) in enumerate(zip(ROWS, label)))
    found = {(r["doc_id"], r["item_id"]) for r in own["op9_decontamination"]}
    assert found == {(r[0], k) for r in ROWS for k, t in ITEMS if shingle_set(t) and len(shingle_set(t) & shingle_set(r[1])) >= 0.8 * len(shingle_set(t)) - 1e-9}
    assert own["op10_license_scan"] == []


def test_queries_over_pages_and_conversations(spark, tmp_path):
    d = str(tmp_path)
    pages = [(1, "http://h.org/a", "<article><p>One &amp; two</p></article>", "x"), (None, None, None, "x"), (2, "no url", "", "x")]
    spark.createDataFrame(pages, "page_id long, url string, html string, host string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([(5, 0, "user", "hi", "x")], "conv_id long, turn long, role string, text string, ids string").write.parquet(f"{d}/conversations.parquet")
    assert sorted((r["page_id"] or 0, r["text"], r["n_chars"]) for r in queries.QUERIES["op7_html_extraction"](spark, d).collect()) == [(0, "", 0), (1, "One & two", 9), (2, "", 0)]
    assert Counter(r["page_id"] for r in queries.QUERIES["op1_url_filter"](spark, d).collect()) == Counter([1, None, 2])
    chats = {r["conv_id"]: r for r in queries.QUERIES["op6_chat_format"](spark, d).collect()}
    assert chats[-7]["n_turns"] == 2 and chats[-7]["loss_chars"] == len(queries.CONTROL_CASE) and chats[5]["loss_chars"] == 0
