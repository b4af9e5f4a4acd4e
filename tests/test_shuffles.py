"""What wide columns cost: how often texts are shuffled, and that the plans which spare it say the same."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lectern.operators import TRACK, dedupe, paragraphs, sections, sentences, whole
from lectern.plans import outcome, queries, queries_sources, render
from lectern.plans.surrogates import sums_before
from lectern.sources import documents, files, store, stores


def shuffles_of(df, column: str) -> int:
    """How many exchanges of the plan a column passes through."""
    plan = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    return sum(f"{column}#" in x for x in re.findall(r"\) Exchange\nInput \[\d+\]: \[(.*)\]", plan))


@pytest.fixture(scope="module")
def cues(spark):
    word = lambda t, i: F.struct(t.alias("text"), (F.col("start") + i / 10).alias("start"))
    rows = spark.range(900).select((F.col("id") % 3).cast("string").alias("source_id"), F.lit(0).alias("track_idx"), F.floor(F.col("id") / 3).cast("int").alias("cue_idx"), F.lit(0).alias("piece_idx"), F.lit(0).alias("turn_idx"), F.concat(F.lit("one two three four five six seven eight nine "), F.col("id").cast("string"), F.when(F.col("id") % 2 == 0, ".").otherwise("")).alias("text"), (F.col("id") * 1.5).alias("start"), F.lit(1.0).alias("duration"))
    return rows.withColumn("words", F.transform(F.split("text", " "), word)).withColumn("speaker", F.lit("S")).withColumn("turn", F.col("cue_idx") % 50 == 0).withColumn("punctuated", F.col("source_id") != "1").cache()


@pytest.mark.parametrize("chunk", [paragraphs.CHUNK, 40])
def test_fold_is_runs_and_passages(cues, chunk):
    """passages by their openings are those by a join with every cue's run, also of tracks in chunks."""
    joined = paragraphs.passages_of(cues.join(paragraphs.paragraph_runs(cues), [*TRACK, *paragraphs.ORDER]), ["seg", "run"])
    folded = paragraphs.fold(cues, chunk)
    assert sorted(map(tuple, folded.collect())) == sorted(map(tuple, joined.collect()))


def test_texts_of_passages_are_shuffled_once(spark, cues):
    """the way from cues to JSON lines under sections moves a text once, and never the words' times."""
    passages = paragraphs.fold(cues).drop("track_idx")
    chapters = spark.createDataFrame([("0", 0, "a", 20.0), ("0", 1, "b", 90.0), ("1", 0, "c", 0.0)], "source_id string, chapter_idx int, title string, start double")
    passages, secs = sections.build_sections(passages, chapters)
    lectures = passages.groupBy("source_id").agg(F.max("end").alias("duration")).select("source_id", F.lit("T").alias("title"), F.lit("C").alias("channel"), F.lit("https://example.org/").alias("url"), F.lit("manual").alias("tier"), F.lit("en").alias("language"))
    lines = render.jsonl(lectures, secs, passages)
    assert shuffles_of(lines, "text") == 1
    assert shuffles_of(lines, "words") == 0
    assert {r.source_id: r.text.count("\n") + 1 for r in lines.collect()} == {r.source_id: r["count"] for r in passages.groupBy("source_id").count().collect()}


def test_running_sums_of_long_arrays(spark):
    for n in (0, 1, 256, 257, 1000):
        values = list(range(1, n + 1))
        got = spark.createDataFrame([(values,)], "v array<long>").select(sums_before(F.col("v"))).first()[0]
        assert got == [sum(values[:i]) for i in range(n)]


def test_dedupe_shuffles_texts_once(cues):
    """windows move once, words as times only; words that are not the text's tokens keep their own."""
    rows = cues.where("cue_idx < 4").withColumn("words", F.when(F.col("cue_idx") == 1, F.transform("words", lambda w: F.struct(F.lit("x").alias("text"), w["start"].alias("start")))).otherwise(F.col("words")))
    out = dedupe.dedupe_rolling_window(rows)
    assert shuffles_of(out, "text") == 1
    assert shuffles_of(out, "words") == 0
    was = {(r.source_id, r.cue_idx): r.words for r in rows.collect()}
    for r in out.collect():
        assert r.words == (was[r.source_id, r.cue_idx] if len(r.text.split()) == 10 else [])


def test_a_folder_is_listed_by_tasks(spark, tmp_path):
    """the driver holds no list of a folder's files."""
    for name in ("a.txt", "b.txt", "_hidden", ".too"):
        (tmp_path / name).write_text(name)
    (tmp_path / "below").mkdir()
    found = files.listing(spark, str(tmp_path))
    assert "FileScan" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.path, r.name, r.length) for r in found.collect()) == [(f"file:{tmp_path}/{n}", n, 5) for n in ("a.txt", "b.txt")]
    assert {r.name: r.hash for r in outcome.existing_files(spark, str(tmp_path)).collect()} == {n: outcome.text_hash(n) for n in ("a.txt", "b.txt")}


def test_lectures_in_rows_are_folded_as_cues_are(spark, cues):
    """a lecture that is one row has the passages and sections of the same cues dealt by source; nothing of it is shuffled."""
    cues = cues.withColumn("speaker", F.when(F.col("cue_idx") % 3 > 0, F.concat(F.lit("S"), F.col("cue_idx").cast("string"))))
    chapters = spark.createDataFrame([("0", 0, "a", 20.0), ("0", 1, "b", 90.0), ("0", 2, "c", 90.0), ("1", 0, "d", 0.0)], "source_id string, chapter_idx int, title string, start double")
    told, secs = sections.build_sections(paragraphs.fold(cues).drop("track_idx"), chapters)
    fields = ["passage_idx", "section_idx", "section", "text", "start", "end", "speaker", "turn"]
    expected = told.join(secs.select("source_id", "section_idx", F.col("title").alias("section")), ["source_id", "section_idx"]).select("source_id", *fields)
    end = F.col("start") + F.col("duration")
    cue = F.struct("cue_idx", "text", F.size(F.split("text", " ")).cast("long").alias("n"), "start", paragraphs.speech_end(F.col("words"), end).alias("spoken"), paragraphs.passage_end(F.col("words"), end).alias("stop"), sentences.ends_sentence("text").alias("ended"), "speaker", "turn")
    rows = cues.groupBy("source_id").agg(F.first("punctuated").alias("punctuated"), F.array_sort(F.collect_list(cue)).alias("cues"))
    listed = chapters.groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("chapter_idx", "title", "start"))).alias("chapters"))
    rows = rows.join(listed, "source_id", "left").unionByName(spark.createDataFrame([("none", True, [])], "source_id string, punctuated boolean, chapters array<struct<chapter_idx:int,title:string,start:double>>"), allowMissingColumns=True)
    got = whole.passages(rows)
    assert sorted(map(str, got.select("source_id", F.inline("passages")).collect())) == sorted(map(str, expected.collect()))


def test_json_lines_of_documents_shuffle_nothing(spark, tmp_path):
    """texts of documents become JSON lines where they are; odd documents have the lines that their records have."""
    texts = [None, "", "\n \n", "one", "a\n\n b  c.\nd?", "\n".join(f"line {i} with some words in it" + "." * (i % 3 == 0) for i in range(700)), '"q" \\ é  x\ty']
    spark.createDataFrame([*enumerate(texts), (None, "lost")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    lines = queries.O4_json_lines(spark, str(tmp_path))
    assert "Exchange" not in lines._jdf.queryExecution().executedPlan().toString()
    told = {r.id: r for r in lines.collect()}
    records = {r.id: r for r in queries.W6_passage_records(spark, str(tmp_path)).collect()}
    assert told.keys() == records.keys() and len(told) > 30
    for k, r in told.items():
        assert (r.start_ms, r.end_ms) == (records[k].start_ms, records[k].end_ms)
        assert {c: json.loads(r.json)[c] for c in ("section", "speaker", "turn", "text", "timestamp")} == {c: records[k][c] for c in ("section", "speaker", "turn", "text", "timestamp")}


def test_word_times_of_documents_are_read_in_order(spark, tmp_path):
    """a document's windows are deduped where they are; the cues are those by a shuffle, of odd documents too."""
    spoken = random.Random(3)
    texts = [None, "", " \n\u2003 ", "one", "a a a a a a a a a a a a", "a b " * 40, " ".join(spoken.choice("abc") for _ in range(700)), "x\u00a0y\u2028z \x1c w\tv  u t s r q p o n m", *(" ".join(f"w{i}-{k}" for k in range(i)) for i in (4, 5, 6, 9, 10, 11, 5000))]
    spark.createDataFrame([*enumerate(texts), (None, "lost and found again by and by")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.R3_word_times(spark, str(tmp_path))
    assert "hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    word = lambda t, i: F.struct(t.alias("text"), (F.col("start") + i).alias("start"))
    rows = queries._windowed(spark, str(tmp_path)).withColumn("words", F.transform(F.split("text", " "), word))
    expected = dedupe.dedupe_rolling_window(rows)
    assert sorted(map(str, dedupe.dedupe_in_order(rows).collect())) == sorted(map(str, expected.collect()))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select("source_id", "cue_idx", F.size("words").alias("n_timed")).collect()))


def test_overlaps_of_periodic_words():
    """places looked at one by one, and borders after these, find the longest overlap."""
    spoken = random.Random(5)
    for _ in range(3000):
        tail, head = ([spoken.choice("ab") for _ in range(spoken.randrange(14))] for _ in range(2))
        plain = max(n for n in range(len(tail) + 1) if n <= len(head) and tail[len(tail) - n :] == head[:n])
        assert dedupe._overlap(tail, head) == plain


def test_the_driver_holds_no_names_of_a_folder(spark, tmp_path, monkeypatch):
    """what the sink wrote is listed once and never broadcast, no step of the driver makes a list of a folder's files."""
    spark.createDataFrame([*((i, f"text {i}") for i in range(50)), (50, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    found = queries_sources.O7_documents_sink(spark, str(tmp_path))
    assert plan(found).count("MapInArrow") == 1 and "Broadcast" not in plan(found)
    assert {r.name: (r.hash, r.length) for r in found.collect()} == {f"d{i}.txt": (outcome.text_hash(t), len(t)) for i, t in [*((i, f"text {i}") for i in range(50)), (50, "")]}
    folder = tmp_path / "held"
    folder.mkdir()
    assert not store.there(spark, str(folder)) and not store.there(spark, str(folder / "none"))
    (folder / "d1.txt").write_text("there before")
    assert store.there(spark, str(folder)) and store.there(spark, f"file:{folder}")
    docs = spark.createDataFrame([("d1.txt", "x")], "name string, text string")
    assert "BroadcastHashJoin" not in plan(outcome.plan_outputs(docs, outcome.existing_files(spark, str(folder))))
    monkeypatch.setattr(stores.Store, "names", lambda *_: pytest.fail("a list of names"))
    for exclusive, left in (("true", "there before"), ("false", "new")):
        writer = documents.DocumentWriter({"path": str(folder), "exclusive": exclusive}, ["name", "text"])
        task = folder / writer.job / "0-0"
        task.mkdir(parents=True)
        for k in range(300):
            (task / f"d{k}.txt").write_text("new")
        writer.commit([documents.Written(str(task), 300), None])
        assert sorted(p.name for p in folder.iterdir()) == sorted(f"d{k}.txt" for k in range(300)) and (folder / "d1.txt").read_text() == left
    writer = documents.DocumentWriter({"path": str(folder)}, ["name", "text"])
    (folder / writer.job / "0-0").mkdir(parents=True)
    with pytest.raises(OSError):
        writer.commit([documents.Written(str(folder / writer.job / "0-0"), 1)])
    writer.abort([])
    assert not (folder / writer.job).exists()
