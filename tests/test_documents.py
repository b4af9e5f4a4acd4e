import json

import pytest
from pyspark.sql import functions as F

from lectern.plans import fetch, outcome, render
from lectern.sources import files, metadata, store
from lectern.sources.providers import folder_provider, listing_provider
from lectern.sources.registry import Registry, UnknownName, default_parsers, default_renderers, provider_for
from lectern.streaming import pauses

VTT = "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nANN: Welcome to Dynamic Programing.\n\n00:00:02.000 --> 00:00:04.000\nIt is # fine [Music] here.\n\n00:00:09.000 --> 00:00:10.000\n>> A question?\n"


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "talk.en.vtt").write_text(VTT)
    (tmp_path / "talk.auto.en.json3").write_text('{"events":[{"tStartMs":0,"dDurationMs":1000,"segs":[{"utf8":"automatic"}]}]}')
    (tmp_path / "broken.en.json3").write_text("{")
    (tmp_path / "french.fr.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nBonjour\n")
    (tmp_path / "silent.en.vtt").write_text("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\n[Music]\n")
    (tmp_path / "bytes.en.vtt").write_bytes(b"WEBVTT\n\n\xff\xfe")
    (tmp_path / "notes.md").write_text("no caption")
    return str(tmp_path)


def test_listing(spark, folder):
    t = {(r["source_id"], r["track_idx"]): (r["tier"], r["raw_language"], r["caption_format"]) for r in files.tracks(files.listing(spark, folder)).collect()}
    assert t[("talk", 0)] == ("asr_platform", "en", "json3") and t[("talk", 1)] == ("manual", "en", "vtt") and ("notes", 0) not in t
    assert files.nothing_to_read(files.listing(spark, folder), "x").count() == 0


def test_first_marker_wins(spark):
    names = ["lec.auto.en.raw.vtt", "lec.en.fr.manual.whisper.srt", "lec.vtt", "lec.2024.part2.vtt", "lec.txt"]
    d = spark.createDataFrame([(n,) for n in names], "name string").select(files.describe(F.col("name")).alias("d")).collect()
    assert [(r["d"]["tier"], r["d"]["raw_language"]) if r["d"] else None for r in d] == [("asr_platform", "en"), ("manual", "en"), ("manual", "und"), ("manual", "und"), None]


def test_fetch_end_to_end(spark, folder):
    glossary = spark.createDataFrame([(0, "Dynamic Programming")], "line_idx int, line string")
    out = fetch.fetch(spark, fetch.Request(folder, glossary=glossary))
    failed = {r["source_id"]: r["failure"]["code"] for r in out.failures.collect()}
    assert failed == {"broken": "MALFORMED_CAPTIONS", "french": "TRACK_NOT_FOUND", "silent": "EMPTY_TRANSCRIPT", "bytes": "INPUT_UNREADABLE"}
    text = {r["source_id"]: r["text"] for r in out.documents.collect()}
    assert list(text) == ["talk"]
    assert "**[0:00]** **ANN:** Welcome to Dynamic Programing [Dynamic Programming]. It is # fine here." in text["talk"]
    assert "**[0:09]** — A question?" in text["talk"] and "| Dynamic Programing | Dynamic Programming | 1 | 0.90 | glossary |" in text["talk"]
    code = outcome.exit_code(out.documents, out.failures).collect()[0]
    assert code["exit_code"] == outcome.EXIT_PARTIAL
    with pytest.raises(ValueError):
        fetch.fetch(spark, fetch.Request(folder, budget=3))


def mined(spark):
    return spark.createDataFrame([("a", "Mined Name", "title", 0)], "source_id string, term string, origin string, term_idx int")


def codes(failures):
    return {r["source_id"]: r["code"] for r in failures.collect()}


def test_corrections_are_refused_whole(spark, folder):
    table = spark.createDataFrame([("Programing", "Programming", None), (None, "x", None)], "wrong string, right string, evidence string")
    _, variants, failed = fetch.names(spark, fetch.Request(folder, corrections=table), mined(spark))
    assert codes(failed) == {"corrections": "MALFORMED_CORRECTIONS"} and variants.count() == 0
    fine = fetch.fetch(spark, fetch.Request(folder, corrections=table.limit(1), glossary=spark.createDataFrame([(i, f"Dynamic Programming{i}") for i in range(2001)], "line_idx int, line string")))
    assert "Programing [Programming]" in fine.documents.collect()[0]["text"] and fine.corrections.collect()[0]["evidence"] == "given"
    assert {r["source_id"]: r["failure"]["code"] for r in fine.failures.collect()}["glossary"] == "PAYLOAD_TOO_LARGE"


def test_ceilings_and_order_of_names(spark, folder, monkeypatch):
    lines = spark.createDataFrame([(0, "Mined Name: mint nam"), (1, "Other: oter")], "line_idx int, line string")
    table = spark.createDataFrame([("Oter", "Otter", None), ("fine", "five", None)], "wrong string, right string, evidence string")
    request = fetch.Request(folder, glossary=lines, corrections=table)
    terms, variants, failed = fetch.names(spark, request, mined(spark))
    assert {(r["source_id"], r["term"], r["origin"]) for r in terms.collect()} == {(None, "Mined Name", "glossary"), (None, "Other", "glossary")}
    assert {(r["folded"], r["term"], r["evidence"]) for r in variants.collect()} == {("mint nam", "Mined Name", "glossary"), ("oter", "Otter", "given"), ("fine", "five", "given")} and failed.count() == 0
    monkeypatch.setattr(fetch.glossary, "MAX_CORRECTIONS", 1)
    terms, variants, failed = fetch.names(spark, request, mined(spark))
    assert codes(failed) == {"corrections": "PAYLOAD_TOO_LARGE"} and {r["folded"] for r in variants.collect()} == {"mint nam", "oter"}


def stored(spark, payload):
    video = lambda i, **more: json.dumps({"id": i, "title": f"Talk {i}", "webpage_url": f"https://www.youtube.com/watch?v={i}", "channel": "Chan", "language": "en", "subtitles": {"en": [{"ext": "vtt", "url": f"u-{i}"}]}, "automatic_captions": {}, "chapters": [{"title": "Open", "start_time": 0}], **more})
    rows = [("https://www.youtube.com/watch?v=v1", video("v1")), ("v2", video("v2")), ("v3", '{"id": "v3"}'), ("v4", video("v4", subtitles={})), ("https://www.youtube.com/playlist?list=PL", json.dumps({"id": "PL", "entries": [{"id": k} for k in ("v1", "v2", "v3", "v4", "v9")]}))]
    listings = spark.createDataFrame(rows, "source string, json string")
    captions = spark.createDataFrame([("u-v1", payload)], "ref string, payload string")
    return listing_provider(listings, captions)


def test_addresses_go_through_their_provider(spark, folder):
    own = [stored(spark, VTT), folder_provider()]
    out = fetch.fetch(spark, fetch.Request("https://www.youtube.com/playlist?list=PL", providers=own))
    failed = {(r["source_id"], r["failure"]["code"]) for r in out.failures.collect()}
    assert failed == {("v2", "ACQUISITION_FAILED"), ("v3", "TRANSPORT_CONTRACT_CHANGED"), ("v4", "NO_CAPTIONS_AVAILABLE"), ("v9", "LECTURE_UNAVAILABLE")}
    text = out.documents.collect()[0]["text"]
    assert text.startswith("# Talk v1\n\n*Chan · [watch](https://www.youtube.com/watch?v=v1)") and "## Open" in text
    assert fetch.Request(folder, providers=own).provider().name == "local" and fetch.Request("https://x.invalid/", providers=own).provider().name == "youtube"
    assert codes(own[1].list(spark, folder + "/nothing").failures) == {folder + "/nothing": "LECTURE_UNAVAILABLE"}
    assert codes(own[0].list(spark, "https://x.invalid/").failures) == {"https://x.invalid/": "LECTURE_UNAVAILABLE"}
    with pytest.raises(UnknownName):
        fetch.fetch(spark, fetch.Request(folder, providers=own[:1]))


def test_stored_payloads_come_first(spark, tmp_path):
    ask = lambda payload: fetch.fetch(spark, fetch.Request("https://www.youtube.com/watch?v=v1", providers=[stored(spark, payload)], cache=str(tmp_path / "store"), renderer="plain"))
    assert "Welcome" in ask(VTT).documents.collect()[0]["text"]
    again = ask(None)  # the transport has nothing any more
    assert "Welcome" in again.documents.collect()[0]["text"] and again.failures.count() == 0


def test_only_chosen_files_are_opened(spark, folder):
    tracks = files.tracks(files.listing(spark, folder))
    read = files.payloads(spark, tracks.where("source_id = 'talk' and tier = 'manual'"), folder)
    assert [r["path"].rsplit("/", 1)[-1] for r in spark.read.format("binaryFile").load([r["ref"] for r in read.select("ref").collect()]).select("path").collect()] == ["talk.en.vtt"]
    assert "talk.auto.en.json3" not in str(read._jdf.queryExecution().executedPlan()) and read.count() == 1


def test_atomic_write_claims_and_cleans_up(tmp_path, monkeypatch):
    path = tmp_path / "deep" / "a.md"
    assert outcome.atomic_write(str(path), "one", overwrite=False) is None and path.read_text() == "one"
    assert outcome.atomic_write(str(path), "two", overwrite=False) == "OUTPUT_EXISTS" and path.read_text() == "one"
    tried, real = [], outcome.os.replace

    def busy(a, b):
        tried.append(a)
        if len(tried) < 4:
            raise PermissionError
        real(a, b)

    monkeypatch.setattr(outcome.os, "replace", busy)
    assert outcome.atomic_write(str(path), "three") is None and path.read_text() == "three" and len(tried) == 4
    monkeypatch.setattr(outcome.os, "replace", lambda a, b: (_ for _ in ()).throw(PermissionError()))
    assert outcome.atomic_write(str(tmp_path / "deep" / "b.md"), "x", overwrite=False) == "OUTPUT_UNWRITABLE"
    assert [f.name for f in (tmp_path / "deep").iterdir()] == ["a.md"]


def lecture(spark, budget_words=30):
    lect = spark.createDataFrame([("s", "A *title*", "https://e.org/w?v=1", "Chan", 125.0, "youtube", "manual", "en", "vtt", "ab" * 32)], "source_id string, title string, url string, channel string, duration double, provider string, tier string, language string, caption_format string, content_hash string").withColumn("published", F.lit("2011-09-12").cast("date")).withColumn("retrieved_at", F.lit("2024-05-06 00:00:00").cast("timestamp"))
    secs = spark.createDataFrame([("s", 0, "One | two", 0.0, 60.0), ("s", 1, None, 60.0, 3700.5)], "source_id string, section_idx int, title string, start double, end double")
    rows = [("s", 0, 0, "word " * budget_words + "x", 0.0, 30.0, "ANN", True), ("s", 1, 0, "# second", 30.0, 60.0, None, True), ("s", 2, 1, "third", 3600.0, 3700.5, "ANN", False)]
    return lect, secs, spark.createDataFrame(rows, "source_id string, passage_idx int, section_idx int, text string, start double, end double, speaker string, turn boolean")


def test_renderers(spark):
    lect, secs, p = lecture(spark)
    fixes = spark.createDataFrame([("s", 0, "SECOND", "minute", 30.0, 0.9, "title", 2)], "source_id string, correction_idx int, wrong string, right string, at double, confidence double, evidence string, occurrences int")
    md = render.markdown(lect, secs, p, fixes).collect()[0]["text"]
    assert md.startswith("# A *title*\n\n*Chan · 12 September 2011 · [watch](https://e.org/w?v=1) · human-written captions (en)*\n\n## One \\| two\n\n**[0:00](https://e.org/w?v=1&t=0)** **ANN:** word")
    assert "**[0:30](https://e.org/w?v=1&t=30)** — \\# second [minute]\n\n**[1:00:00](https://e.org/w?v=1&t=3600)** third\n\n## Corrections" in md and md.endswith("|\n") and not md.endswith("\n\n")
    cite = render.citation(lect).collect()[0]["text"]
    assert cite == "Chan. (2011, September 12). A *title* [Video]. YouTube. https://e.org/w?v=1\n\nTranscript retrieved 6 May 2024 from human-written captions (en, vtt). Content hash: abababababab."
    lines = render.jsonl(lect, secs, p).collect()[0]["text"].split("\n")
    first = json.loads(lines[0])
    assert list(first) == ["id", "source_id", "title", "channel", "section", "speaker", "turn", "text", "start", "end", "timestamp", "url", "tier", "language"]
    assert json.loads(lines[2])["section"] is None and first["id"] == "s:0"
    assert render.plain(p).collect()[0]["text"].endswith("\n\n# second\n\nthird")


def test_context_budget(spark):
    lect, secs, p = lecture(spark)
    whole = render.context(lect, secs, p, 10_000).collect()[0]["text"]
    assert "## Omitted" not in whole and "### One \\| two\n\n[0:00] ANN: word" in whole and "2. (untitled) — 1:00–1:01:40 (1 words)" in whole
    short = render.context(lect, secs, p, 130).collect()[0]["text"]
    assert "## Omitted" in short and "third" not in short.split("<<<QUOTED TRANSCRIPT BEGINS>>>")[1]


def test_names_are_distinct(spark):
    docs = spark.createDataFrame([(0, "Talk", "a"), (1, "talk", "A"), (2, "Talk", "b"), (3, "?", "?"), (4, "", "")], "doc_idx int, title string, source_id string")
    names = [r["name"] for r in outcome.file_names(docs, "md").orderBy("doc_idx").collect()]
    assert names == ["Talk (a).md", "talk (A 2).md", "Talk (b).md", "lecture.md", "lecture (2).md"] and len({n.lower() for n in names}) == 5


def test_outputs(spark, tmp_path):
    (tmp_path / "same").write_text("x")
    (tmp_path / "other").write_text("y")
    docs = spark.createDataFrame([("same", "x"), ("other", "x"), ("new", "x")], "name string, text string")
    plan = outcome.plan_outputs(docs, outcome.existing_files(spark, str(tmp_path)))
    done = {r["name"]: (r["action"], r["code"]) for r in outcome.write_outputs(plan, str(tmp_path)).collect()}
    assert done == {"same": ("unchanged", None), "other": ("refused", "OUTPUT_EXISTS"), "new": ("write", None)} and (tmp_path / "new").read_text() == "x" and (tmp_path / "other").read_text() == "y"


def test_envelope(spark):
    bad = outcome.failures(spark.createDataFrame([("https://u:p@x.org/?sig=1", "ACQUISITION_FAILED", "at https://x.org/?sig=2")], "source_id string, code string, detail string"), detail="detail")
    docs = spark.createDataFrame([("a", "text")], "source_id string, text string")
    none = spark.createDataFrame([], "name string")
    out = json.loads(outcome.envelope(docs, none, bad, bad.limit(0)).collect()[0]["json"])
    assert out["ok"] is False and out["results"] == ["text"] and out["errors"][0]["code"] == "ACQUISITION_FAILED" and "sig" not in json.dumps(out)


def test_version_gate(spark):
    lect, _, _ = lecture(spark)
    lines = outcome.to_json(lect.select("source_id", "title"))
    old = spark.createDataFrame([('{"v":9,"source_id":"x"}',), ("{}",)], "json string")
    fine, bad = outcome.from_json(lines.union(old), "source_id:string,title:string")
    assert [r["source_id"] for r in fine.collect()] == ["s"] and bad.count() == 2


def test_store(spark, tmp_path):
    folder = str(tmp_path / "cache")
    rows = spark.createDataFrame([("a", "1", '{"x":1}'), ("a", "2", "{broken")], "s string, k string, value string")
    store.write(rows, folder, "s", "k")
    wanted = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "1")], "s string, k string")
    assert {(r["s"], r["k"]): r["value"] for r in store.read_listings(spark, wanted, folder, "s", "k").collect()} == {("a", "1"): '{"x":1}', ("a", "2"): None, ("b", "1"): None}
    assert store.read(spark, wanted, None, "s", "k").where("value is not null").count() == 0


def test_metadata(spark):
    info = {"id": "v1", "title": "", "channel": None, "uploader": "U", "upload_date": "00000000", "duration": "NaN", "chapters": [{"title": "a", "start_time": None}, {"title": "b", "start_time": 3}], "subtitles": {}}
    rows = spark.createDataFrame([("s", json.dumps(info)), ("t", "{}"), ("u", "no")], "source string, json string")
    infos = metadata.read_info(rows)
    m = metadata.meta(infos).where("source_id = 'v1'").collect()[0]
    assert (m["title"], m["channel"], m["published"], m["duration"]) in [("v1", "U", None, None)]
    assert [(r["chapter_idx"], r["title"], r["start"]) for r in metadata.chapters(infos).collect()] == [(0, "b", 3.0)]
    assert {r["source"]: r["detail"] for r in metadata.contract_broken(infos).collect()} == {"t": "no id", "u": "not JSON"}
    said = spark.createDataFrame([("ERROR: Private video",), ("Please report this issue: private video",), ("odd",)], "m string").select(metadata.classify(F.col("m")).alias("c"))
    assert [r["c"] for r in said.collect()] == ["LECTURE_UNAVAILABLE", "TRANSPORT_CONTRACT_CHANGED", "ACQUISITION_FAILED"]


def test_fallback(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "source string")
    live = spark.createDataFrame([("a", "{}")], "source string, json string")
    failed = spark.createDataFrame([("b", "ACQUISITION_FAILED"), ("c", "NO_CAPTIONS_AVAILABLE"), ("d", "REGION_BLOCKED")], "source string, code string")
    stored = spark.createDataFrame([("a", "old"), ("b", "old"), ("c", "old")], "source string, json string")
    out = {r["source"]: (r["json"], r["stale_reason"], r["code"]) for r in metadata.with_fallback(wanted, live, failed, stored).collect()}
    assert out == {"a": ("{}", None, None), "b": ("old", "ACQUISITION_FAILED", None), "c": (None, None, "NO_CAPTIONS_AVAILABLE"), "d": (None, None, "REGION_BLOCKED")}


def test_registry():
    r = Registry("thing", "NO_THING")
    r.register("a", "b")(1)
    assert r.get("b") == 1 and r.names() == ["a", "b"]
    with pytest.raises(ValueError):
        r.add("a", 2)
    with pytest.raises(UnknownName):
        r.get("c")
    assert "subrip" in default_parsers() and "md" in default_renderers()
    assert provider_for("x/y", {"local": lambda s: "/" in s, "remote": lambda s: True}) == "local"


def test_streaming_fold_equals_batch(spark, tmp_path):
    rows = [("a", i, f"word {i}.", float(2 * i), 2.0 * i + 1, 2.0 * i + 0.5, None, i % 4 == 0, True) for i in range(9)]
    schema = "source_id string, cue_idx int, text string, start double, end double, speech double, speaker string, turn boolean, ended boolean"
    for k, part in enumerate((rows[:5], rows[5:], [("a", 99, None, 0.0, 0.0, 0.0, None, False, False)])):
        spark.createDataFrame(part, schema).coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "in"))
    q = pauses.paragraphs(stream).writeStream.format("memory").queryName("passages").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    out = [r["text"] for r in spark.table("passages").orderBy("start").collect()]
    assert out == ["word 0. word 1. word 2. word 3.", "word 4. word 5. word 6. word 7.", "word 8."]


def test_streaming_pauses(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 01:00:00"), (1, "2024-01-01 12:00:00"), (2, "2024-01-09 00:00:00")]
    spark.createDataFrame(rows, "user_id int, t string").select("user_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user_id int, ts timestamp").parquet(str(tmp_path / "in"))
    q = pauses.pause_paragraphs(stream, "user_id", "ts").writeStream.format("memory").queryName("pauses").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["user_id"], r["n"]) for r in spark.table("pauses").orderBy("start").collect()] == [(1, 2), (1, 1)]
