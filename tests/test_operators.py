import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import languages as L
from lectern.functions import text as T
from lectern.functions import times as D
from lectern.functions import web as U
from lectern.operators import CUES, dedupe, glossary, markup, matching, paragraphs, parse, resolve, sections, sentences


def values(spark, expr, rows, kind="string"):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r["y"] for r in df.select("i", expr(F.col("x")).alias("y")).orderBy("i").collect()]


def test_timestamps_and_clocks(spark):
    assert values(spark, D.format_timestamp, [7.9, 307.0, 3907.4, 36000.0], "double") == ["0:07", "5:07", "1:05:07", "10:00:00"]
    assert values(spark, D.parse_clock, ["00:00:01.5", "1:02,25", "x", "99:100:00.0", "01:02:03.004"]) == [1.5, 62.25, None, None, 3723.004]
    assert values(spark, D.parse_compact_date, ["20110912", "00000000", "2011091"]) == [__import__("datetime").date(2011, 9, 12), None, None]
    assert values(spark, D.half_even, [2.5, 3.5, 2.51], "double") == ["2", "4", "3"]


def test_languages(spark):
    assert values(spark, L.primary_subtag, ["en-j3PyPqV-e1s", "EN"]) == ["en", "en"]
    assert values(spark, L.looks_like_language, ["en", "zh-Hant", "xx", "part2", "eng"]) == [True, True, False, False, True]
    df = spark.createDataFrame([("zh", "zh-Hant", "zh"), ("de", "de", "en"), ("und", "und", "fr")], "l string, r string, w string")
    assert [r[0] for r in df.select(L.matches("l", "r", "w")).collect()] == [True, False, True]


def test_sentence_ends_and_cuts(spark):
    assert values(spark, sentences.ends_sentence, ["done.", "really?", "stop!", 'said "stop."', "a comma,", "an em dash --"]) == [True] * 4 + [False] * 2
    cut = lambda t: [list(x) for x in values(spark, sentences.sentence_cuts, [t])][0]
    for text in ("e.g. Python", "Dr. Smith", "J. Smith", "U.S. Later", "3.5 million", "vs. that", "it ends. but not"):
        assert cut(text) == []
    assert cut("It ends. Now it begins.") == [2] and cut("there. 42 of them") == [1] and cut('said "stop." Then') == [2]


def test_brackets_and_labels(spark):
    read = lambda t: values(spark, lambda c: markup.read_markup(c), [t])[0]
    assert " ".join(read("it is [? a cure. ?] really")["text"].split()) == "it is a cure.(?) really"
    assert read("[? ?]")["text"] == "(?)" and read("[Music]")["text"] == "" and read("[unintelligible]")["text"] == "(inaudible)" and read("[kept]")["text"] == "[kept]"
    assert read(">> >> PROFESSOR: Hi")["named"] == "PROFESSOR" and read("Not: a label")["named"] is None


def cues(spark, rows):
    full = [(r.get("s", "a"), 0, i, r["text"], float(r.get("start", i)), float(r.get("dur", 1)), r.get("words", []), None, r.get("turn", False)) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, CUES)


def test_speakers(spark):
    def run(texts):
        out = markup.consume_markup(cues(spark, [{"text": t} for t in texts])).orderBy("cue_idx", "turn_idx").collect()
        return [(r["text"], r["speaker"], r["turn"]) for r in out]

    assert run(["ANN: Hi.", "plain", "BOB: Yes", "plain"]) == [("Hi.", "ANN", True), ("plain", "ANN", False), ("Yes", "BOB", True), ("plain", "BOB", False)]
    assert run(["ANN: Yes.", ">> I disagree."]) == [("Yes.", "ANN", True), ("I disagree.", None, True)]
    assert run(["PROFESSOR:", "next"]) == [("next", "PROFESSOR", False)]
    assert run(["a [inaudible]", "[inaudible]", "[inaudible]", "b"]) == [("a (inaudible)", None, False), ("b", None, False)]


def test_inner_turns(spark):
    text = "I agree. >> But I do not."
    words = [(w, float(i)) for i, w in enumerate(text.split())]
    timed = markup.consume_markup(cues(spark, [{"text": text, "words": words, "dur": 7}])).orderBy("turn_idx").collect()
    assert [(r["text"], r["turn"], r["start"]) for r in timed] == [("I agree.", False, 0.0), ("But I do not.", True, 3.0)]
    plain = markup.consume_markup(cues(spark, [{"text": text}])).collect()
    assert [(r["text"], r["turn"]) for r in plain] == [("I agree. But I do not.", False)]


def brute_dedupe(texts):
    seen, out = [], []
    for i, t in enumerate(texts):
        own = t.split()
        n = next((k for k in range(min(len(own), len(seen)), 0, -1) if seen[-k:] == own[:k]), 0)
        if own[n:]:
            seen += own[n:]
            out.append((i, " ".join(own[n:])))
    return out


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=6).map(" ".join), min_size=1, max_size=25))
def test_dedupe_equals_brute_force_and_its_twin(spark, texts):
    c = cues(spark, [{"text": t} for t in texts])
    for f in (dedupe.dedupe_rolling_window, dedupe.dedupe_fold):
        assert [(r["cue_idx"], r["text"]) for r in f(c).orderBy("cue_idx").collect()] == brute_dedupe(texts)


def brute_runs(rows, punctuated):
    out, run, words, wanted, prev = [], -1, 0, False, None
    for r in rows:
        if prev is not None:
            gap = r["start"] - (prev["start"] + prev["dur"])
            wanted = wanted or ((not punctuated or words >= 67.5) if gap > 1 else (punctuated and words >= 90))
            breaks = words >= 500 or ((wanted or words >= 250) if not punctuated else ((wanted or words >= 250) and prev["text"].endswith(".")))
            if r["turn"] or breaks:
                run, words, wanted = run + 1, 0, False
        else:
            run = 0
        words += len(r["text"].split())
        out.append(run)
        prev = r
    return out


@pytest.mark.parametrize("punctuated", [True, False])
def test_paragraph_fold_equals_brute_force(spark, punctuated):
    import random

    r = random.Random(5)
    rows, at = [], 0.0
    for _ in range(300):
        at += r.choice([1, 1, 1, 3])
        rows.append({"text": "w " * r.randint(1, 40) + r.choice(["end.", "on"]), "start": at, "dur": 1, "turn": r.random() < 0.02})
    c = cues(spark, rows).withColumn("piece_idx", F.lit(0)).withColumn("turn_idx", F.lit(0)).withColumn("punctuated", F.lit(punctuated))
    from pyspark.sql import Window as W

    dense = F.dense_rank().over(W.orderBy("seg", "run")) - 1
    got = [x["r"] for x in paragraphs.paragraph_runs(c).select("cue_idx", dense.alias("r")).orderBy("cue_idx").collect()]
    assert got == brute_runs(rows, punctuated)
    assert [x["run"] for x in paragraphs.runs_by_fold(c).orderBy("cue_idx").collect()] == got


def test_scanner(spark):
    text = "WEBVTT\n\n00:00:01.000 --> 00:00:02.000\nfirst\n \nsecond --> not a time\n\nignored\n00:00:03.000 --> 00:00:02.500 align:start\n<b>a &amp; b</b>\n\n00:01.0 --> bad\n00:00:05.000 --> 00:00:06.000\n"
    p = spark.createDataFrame([("a", 0, "vtt", text)], "source_id string, track_idx int, caption_format string, payload string")
    out = [(r["text"], r["start"], r["duration"]) for r in parse.parse_captions(p).orderBy("cue_idx").collect()]
    assert out == [("first second --> not a time", 1.0, 1.0), ("a & b", 3.0, 0.0)]


def test_inline_words(spark):
    text = "00:00:01.000 --> 00:00:09.000\nsaid before\nnow<00:00:02.000><c> we</c><00:00:03.500><c> go</c>\n"
    p = spark.createDataFrame([("a", 0, "vtt", text)], "source_id string, track_idx int, caption_format string, payload string")
    assert [tuple(w) for w in parse.parse_captions(p).collect()[0]["words"]] == [("now", 1.0), ("we", 2.0), ("go", 3.5)]


def test_malformed_payloads(spark):
    rows = [("a", "json3", "{"), ("b", "json3", "{}"), ("c", "xyz", ""), ("d", "json3", '{"events":[{"tStartMs":"NaN","segs":[{"utf8":"x"}]}]}'), ("e", "vtt", "")]
    p = spark.createDataFrame([(s, 0, f, t) for s, f, t in rows], "source_id string, track_idx int, caption_format string, payload string")
    assert {r["source_id"]: r["code"] for r in parse.malformed(p).collect()} == {"a": "MALFORMED_CAPTIONS", "b": "MALFORMED_CAPTIONS", "c": "UNKNOWN_CAPTION_FORMAT", "d": "MALFORMED_CAPTIONS"}


def test_glossary(spark):
    lines = "Enthralla: Entrala, In trail\nSonnet 3.5\n# note\nquad-code:quad code # x\nEnthralla\n: none".split("\n")
    terms, variants = glossary.read_glossary(spark.createDataFrame(list(enumerate(lines)), "line_idx int, line string"))
    assert [r["term"] for r in terms.orderBy("term_idx").collect()] == ["Enthralla", "Sonnet 3.5", "quad-code"]
    assert {r["folded"]: r["term"] for r in variants.collect()} == {"entrala": "Enthralla", "in trail": "Enthralla", "quad code": "quad-code"}
    p = spark.createDataFrame([("a", 0, "We met (Enthrala) and  In  trail; not Enthralla or Sonnet 4.5", 3.0), ("a", 1, "enthrala again. Entrala", 9.0)], "source_id string, passage_idx int, text string, start double")
    out = glossary.propose_corrections(p, terms.withColumn("source_id", F.lit("a")), variants.withColumn("source_id", F.lit("a")), [1, 2]).orderBy("correction_idx").collect()
    assert [(r["wrong"], r["right"], r["occurrences"], r["at"], r["confidence"]) for r in out] == [("Enthrala", "Enthralla", 2, 3.0, 0.9), ("In  trail", "Enthralla", 1, 3.0, 1.0), ("Entrala", "Enthralla", 1, 9.0, 1.0)]


def test_mined_terms(spark):
    meta = spark.createDataFrame([("a", "Introduction to Dynamic Programming | Erik Demaine: lecture one", "Open Courseware", ["Algorithms in practice"])], "source_id string, title string, channel string, chapters array<string>")
    out = [(r["term"], r["origin"]) for r in glossary.terms_from(meta).orderBy("term_idx").collect()]
    assert out == [("Dynamic Programming", "title"), ("Erik Demaine", "title"), ("Open Courseware", "channel"), ("Courseware", "channel")]


def test_as_of_ties_and_before_all(spark):
    p = spark.createDataFrame([("a", i, t) for i, t in enumerate([0.0, 5.0, 5.0, 9.0])], "source_id string, passage_idx int, start double").withColumn("end", F.col("start") + 1)
    c = spark.createDataFrame([("a", 0, "x", 5.0), ("a", 1, "y", 5.0), ("a", 2, "z", 20.0)], "source_id string, chapter_idx int, title string, start double")
    rows, secs = sections.build_sections(p, c)
    assert [r["chapter_idx"] for r in rows.orderBy("passage_idx").collect()] == [None, 1, 1, 1]
    assert [(r["title"], r["start"], r["n_passages"]) for r in secs.orderBy("section_idx").collect()] == [(None, 0.0, 1), ("y", 5.0, 3)]


def test_resolution_prefers_language_then_tier(spark):
    rows = [("a", 0, "en", "en", "asr_platform", "json3"), ("a", 1, "de", "de", "translated", "vtt"), ("b", 0, "en", "en", "manual", "srt"), ("b", 1, "en", "en-GB", "manual", "json3"), ("c", 0, "fr", "fr", "manual", "vtt")]
    t = spark.createDataFrame(rows, "source_id string, track_idx int, language string, raw_language string, tier string, caption_format string").withColumn("label", F.lit(None).cast("string"))
    got = resolve.resolve(t, ["de", "en"])
    assert {r["source_id"]: r["track_idx"] for r in got.collect()} == {"a": 1, "b": 1}
    assert [(r["source_id"], r["available"]) for r in resolve.unresolved(t, got).collect()] == [("c", ["fr — manual, vtt"])]


def test_escaping(spark):
    text = "# a [b] <c> `d` | e\\\n  == f"
    assert values(spark, T.label, [text])[0] == "# a \\[b\\] \\<c\\> \\`d\\` \\| e\\\\ == f"
    escaped = re.sub(r"([\\\[\]<>`])", r"\\\1", text)
    assert values(spark, T.body, [text])[0] == re.sub(r"(?m)^(\s*)([#~=-]+)", r"\1\\\2", escaped)
    assert values(spark, T.body_resumed, [text])[0] == re.sub(r"(?<=\n)(\s*)([#~=-]+)", r"\1\\\2", escaped)


def test_names(spark):
    assert values(spark, T.sanitise, ['a/b: "c"?..', "con", "Über  uns.", "x" * 130, "word " * 40]) == ["a b c", "con_", "Über uns", "x" * 120, ("word " * 24).strip()]


def test_urls(spark):
    assert values(spark, U.redact, ["see https://u:p@Host.org:80/x?sig=1#f, ok"]) == ["see https://host.org:80/x ok"]
    assert values(spark, U.safe_url, ["http://a.b/c", "javascript:x", "http://a b", "https:///x", None]) == ["http://a.b/c", None, None, None, None]
    assert values(spark, U.video_id, ["abcdefghijk", "https://youtu.be/abcdefghijk?list=P", "https://www.youtube.com/embed/videoseries?list=P", "https://elsewhere.org/youtube.com/watch?v=abcdefghijk"]) == ["abcdefghijk", "abcdefghijk", None, None]


REFERENCES = ["caf&eacute; &#233; &#xE9; &#8217;", "&amp;lt; &ampfoo; &notit; &notin; &nbsp;|&hellip;", "&#0; &#x80; &#xD800; &#x110000; &#11; &#xFFFE; &#99999999999; &#x0000041;", "&bogus; & &; &#; &#x; &&amp", "&CounterClockwiseContourIntegral;&acE;&NotEqualTilde;", "plain", "", "&eacute&eacute;&copy2024 &Aacutex"]


def test_all_character_references(spark):
    import html

    assert values(spark, T.unescape, REFERENCES) == [html.unescape(t) for t in REFERENCES]
    names = [f"&{k} x" for k in html.entities.html5]
    assert values(spark, T.unescape, names) == [html.unescape(t) for t in names]


def test_references_in_captions(spark):
    rows = [("a", 0, "vtt", "WEBVTT\n\n00:01.000 --> 00:02.000\n<i>caf&eacute;</i> &#8217;t &lt;b&gt;\n"), ("b", 0, "srt", "1\n00:00:01,000 --> 00:00:02,000\ncaf&eacute; &hellip;\n")]
    out = {r["source_id"]: r["text"] for r in parse.parse_captions(spark.createDataFrame(rows, "source_id string, track_idx int, caption_format string, payload string")).collect()}
    assert out == {"a": "café ’t <b>", "b": "café …"}


def test_casefold_is_unicode_s(spark):
    letters = [chr(c) for c in range(1, 0x1E944) if not 0xD800 <= c < 0xE000 and chr(c).casefold() != chr(c)] + ["ı", "ΌΣΟΣ", "Straße", "ς", "i̇"]
    cherokee = lambda c: 0x13A0 <= ord(c[0]) <= 0x13FF or 0xAB70 <= ord(c[0]) <= 0xABBF
    got = values(spark, T.casefold, letters)
    wrong = [a for a, b in zip(letters, got) if b != a.casefold() and not cherokee(a)]
    assert wrong == []


@given(st.text(alphabet="abc ", min_size=6, max_size=14), st.lists(st.tuples(st.integers(0, 2), st.integers(0, 20), st.sampled_from("abcx")), max_size=2))
@settings(max_examples=12, deadline=None)
def test_terms_within_reach_share_a_part(term, edits):
    phrase = term
    for kind, at, letter in edits[: 2 if len(term) >= matching.LONG else 1]:
        i = at % (len(phrase) + 1)
        phrase = phrase[:i] + (letter if kind != 1 else "") + phrase[i + (kind != 0) :]
    if not phrase:
        return
    found = matching.Names([(term, term, "glossary", 0, 1, True)], [])
    assert any(0 in table.get(phrase[span], ()) for span, table in found.plan(1, len(phrase)))


def test_hits_equal_brute_force(spark):
    import random

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcd") for _ in range(r.randint(4, 11)))
    names = [" ".join(word() for _ in range(r.choice([1, 1, 2, 3]))) for _ in range(40)]

    def spoil(t):
        for _ in range(r.randint(0, 3)):
            i = r.randrange(len(t))
            t = t[:i] + r.choice(["", "a", "bd", " "]) + t[i + r.randint(0, 1) :]
        return t

    texts = [" ".join(r.choice([word(), spoil(r.choice(names)), r.choice(names)]) for _ in range(30)) for _ in range(12)]
    source = lambda k: f"s{k % 2}"
    passages = spark.createDataFrame([(source(k), k, t, float(k)) for k, t in enumerate(texts)], "source_id string, passage_idx int, text string, start double")
    rows = [(None if i % 3 == 0 else f"s{i % 2}", t, "chapter" if i % 4 else "glossary", i) for i, t in enumerate(names)]
    forms = [(None, "aa bb", "Known", "given"), ("s1", texts[1].split()[0], "Own", "given")]
    lengths = [1, 2, 3]
    out = glossary.hits(passages, spark.createDataFrame(rows, "source_id string, term string, origin string, term_idx int"), spark.createDataFrame(forms, "source_id string, folded string, term string, evidence string"), lengths)

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    expected = set()
    for k, t in enumerate(texts):
        w = t.split()
        own = [x for x in rows if x[0] in (None, source(k))]
        for n in lengths:
            for i in range(len(w) - n + 1):
                phrase = " ".join(w[i : i + n])
                form = next((f for f in forms if f[0] in (None, source(k)) and f[1] == phrase), None)
                if form:
                    expected.add((k, i, n, form[2], 0))
                elif phrase not in [x[1] for x in own]:
                    for _, term, origin, _ in own:
                        if len(term.split()) != n or len(term) < 6:
                            continue
                        d = distance(phrase, term)
                        a, b = sorted((phrase, term), key=len)
                        if 0 < d <= (2 if len(term) >= 10 else 1) and not (origin != "glossary" and b in (a + "s", a + "es", a + "'s", a + "’s")):
                            expected.add((k, i, n, term, d))
                            break
    assert {(x["passage_idx"], x["i"], x["n"], x["term"], x["distance"]) for x in out.collect()} == expected and len(expected) > 15
