"""Caption files as a data source, documents as a transactional sink, on paths with and without a scheme."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from lectern.operators.parse import MAX_PAYLOAD
from lectern.plans import outcome
from lectern.sources import captions, documents, files, stores

VTT = "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nHello.\n"


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in put"
    d.mkdir()
    for k in range(12):
        (d / f"talk{k}.en.vtt").write_bytes(b"\xef\xbb\xbf" + VTT.replace("\n", "\r\n").encode())
        (d / f"talk{k}.auto.de.SRT").write_text(f"1\n00:00:00,000 --> 00:00:01,000\nHallo {k}\n")
    (d / "notes.txt").write_text("no caption")
    (d / "vtt").write_text("no name")
    (d / "empty.vtt").write_text("")
    (d / "bad.vtt").write_bytes(b"\xff\xfe")
    (d / "below").mkdir()
    (d / "below" / "deep.vtt").write_text(VTT)
    return d


@pytest.mark.parametrize("scheme", ["", "file://", "file:"])
def test_captions_are_read_by_slices(spark, folder, scheme):
    found = captions.captions(spark, f"{scheme}{folder}", slices=5, most=60)
    rows = {r["name"]: r for r in found.collect()}
    assert len(rows) == 26 and {r["stem"] for r in rows.values()} == {f"talk{k}" for k in range(12)} | {"empty", "bad"}
    assert rows["talk3.en.vtt"]["payload"] == VTT and rows["talk3.en.vtt"]["length"] == len(VTT) + 3 + VTT.count("\n")
    assert (rows["bad.vtt"]["payload"], rows["bad.vtt"]["code"]) == (None, "INPUT_UNREADABLE") and rows["empty.vtt"]["payload"] == ""
    assert rows["talk3.auto.de.SRT"]["caption_format"] == "srt"
    listed = files.tracks(captions.captions(spark, str(folder), payloads=False))
    assert listed.where("source_id = 'talk7'").orderBy("track_idx").select("language", "tier").collect() == [("de", "asr_platform"), ("en", "manual")]


def test_ceiling_counts_what_is_read(spark, folder, tmp_path):
    rows = captions.captions(spark, str(folder), most=20).where("code = 'PAYLOAD_TOO_LARGE'")
    assert rows.count() == 24 and rows.where("payload is not null").count() == 0
    grown = tmp_path / "grown.en.vtt"
    grown.write_bytes(b"x" * (MAX_PAYLOAD + 1))
    listing = spark.createDataFrame([("grown", 0, str(grown), 5), ("gone", 0, str(tmp_path / "gone.vtt"), 5), ("long", 0, "nowhere", MAX_PAYLOAD + 1)], "source_id string, track_idx int, ref string, length long")
    read = {r["source_id"]: (r["payload"], r["code"]) for r in files.payloads(spark, listing, str(tmp_path)).collect()}
    assert read == {"grown": (None, "PAYLOAD_TOO_LARGE"), "gone": (None, "INPUT_UNREADABLE"), "long": (None, "PAYLOAD_TOO_LARGE")}


def test_filters_reach_the_listing(spark, folder):
    found = captions.captions(spark, str(folder)).where("stem in ('talk1', 'talk2') and caption_format = 'vtt' and length > 3")
    assert sorted(r["name"] for r in found.collect()) == ["talk1.en.vtt", "talk2.en.vtt"]
    reader = captions.CaptionReader({"path": str(folder), "slices": "7"})
    left = StringStartsWith(("name",), "t")
    assert list(reader.pushFilters([In(("stem",), ("talk1", "talk2")), left, EqualTo(("caption_format",), "vtt")])) == [left]
    assert {p.k for p in reader.partitions()} == {captions.share_of(s, 7) for s in ("talk1", "talk2")}
    assert sorted(n for p in reader.partitions() for _, _, n, _ in reader.files(p)) == ["talk1.en.vtt", "talk2.en.vtt"]
    none = captions.CaptionReader({"path": str(folder)})
    assert list(none.pushFilters([EqualTo(("stem",), "a"), EqualTo(("stem",), "b")])) == [] and none.partitions() == []
    assert captions.captions(spark, str(folder / "nowhere")).count() == 0
    with pytest.raises(ValueError):
        captions.CaptionReader({})


def tree(path):
    return sorted(os.path.join(d, f)[len(str(path)) + 1 :] for d, _, names in os.walk(path) for f in names)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_documents_are_written_whole(spark, tmp_path, scheme):
    to = tmp_path / "o ut"
    rows = spark.createDataFrame([(f"d{i}.md", None if i == 5 else f"text é {i}\r\n" * i) for i in range(40)], "name string, text string").repartition(6)
    documents.write_documents(rows, f"{scheme}{to}")
    assert tree(to) == sorted(f"d{i}.md" for i in range(40)) and (to / "d5.md").read_bytes() == b"" and (to / "d7.md").read_bytes() == ("text é 7\r\n" * 7).encode()
    documents.write_documents(rows.limit(0), str(tmp_path / "none"))
    assert tree(tmp_path / "none") == []


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    (tmp_path / "d1.md").write_text("before")
    rows = spark.range(0, 60, 1, 6).select(F.concat(F.lit("d"), "id", F.lit(".md")).alias("name"), F.when(F.col("id") == 59, F.raise_error(F.lit("lost"))).otherwise("after").alias("text"))
    with pytest.raises(Exception):
        documents.write_documents(rows, str(tmp_path))
    assert tree(tmp_path) == ["d1.md"] and (tmp_path / "d1.md").read_text() == "before" and os.listdir(tmp_path) == ["d1.md"]
    for name in ("", "a/b", "..", documents.WRITING + "x", None):
        with pytest.raises(Exception):
            documents.write_documents(spark.createDataFrame([("ok", "t"), (name, "t")], "name string, text string").coalesce(1), str(tmp_path))
    assert tree(tmp_path) == ["d1.md"]
    with pytest.raises(ValueError, match="viewfs"):
        documents.write_documents(rows, "viewfs://x/y")


class Attempt:
    def __init__(self, partition, attempt):
        self.partitionId, self.taskAttemptId = lambda: partition, lambda: attempt


def test_only_attempts_that_count_are_committed(tmp_path, monkeypatch):
    writer = documents.DocumentWriter({"path": str(tmp_path)}, ["name", "text"])
    written = []
    for partition, attempt, text in ((0, 1, "lost"), (0, 2, "kept"), (1, 3, "other")):
        monkeypatch.setattr(documents.TaskContext, "get", lambda p=partition, a=attempt: Attempt(p, a))
        names = [f"n{partition}"] + (["n-lost"] if text == "lost" else [])
        written.append(writer.write(iter([pa.RecordBatch.from_arrays([pa.array(names), pa.array([text] * len(names))], ["name", "text"])])))
    assert not [f for f in os.listdir(tmp_path) if not f.startswith(documents.WRITING)]
    writer.commit(written[1:])
    assert tree(tmp_path) == ["n0", "n1"] and (tmp_path / "n0").read_text() == "kept"
    again = documents.DocumentWriter({"path": str(tmp_path), "exclusive": "true"}, ["name", "text"])
    monkeypatch.setattr(documents.TaskContext, "get", lambda: Attempt(0, 1))
    message = again.write(iter([pa.RecordBatch.from_arrays([pa.array(["n0", "n9"]), pa.array(["late", "new"])], ["name", "text"])]))
    again.commit([message, None])
    assert (tmp_path / "n0").read_text() == "kept" and (tmp_path / "n9").read_text() == "new" and tree(tmp_path) == ["n0", "n1", "n9"]
    again.write(iter([]))
    again.abort([None])
    assert tree(tmp_path) == ["n0", "n1", "n9"]


def test_outcomes_follow_what_the_folder_holds(spark, tmp_path, monkeypatch):
    plan = spark.createDataFrame([("new", "x", "write"), ("late", "x", "write"), ("same", "x", "unchanged"), ("other", "x", "refused")], "name string, text string, action string")
    (tmp_path / "late").write_text("somebody else's")
    done = {r["name"]: r["code"] for r in outcome.write_outputs(plan, str(tmp_path), overwrite=False).collect()}
    assert done == {"new": None, "late": "OUTPUT_EXISTS", "same": None, "other": "OUTPUT_EXISTS"} and (tmp_path / "late").read_text() == "somebody else's"
    blocked = tmp_path / "file"
    blocked.write_text("no folder")
    assert [r["code"] for r in outcome.write_outputs(plan.limit(1), str(blocked / "in")).collect()] == ["OUTPUT_UNWRITABLE"]


def test_schemes():
    assert stores.scheme_of("/a:b/c") == "file" and stores.scheme_of("C:/x") == "file" and stores.scheme_of("s3a://b/k") == "s3a"
    assert stores.open_store("file:/tmp/a b").root == "/tmp/a b" and stores.open_store("file:///tmp/x").local
    assert not stores.reachable("viewfs://c/x") and stores.reachable("hdfs://n/x")
