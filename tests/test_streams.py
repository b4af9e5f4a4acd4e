"""Streams against tables: rolling windows with state, batches with dead letters, listings that stand in for others."""

import json
import os
import random


from lectern.operators import dedupe
from lectern.streaming import intake, rolling

R = random.Random(14)
CUES = "source_id string, track_idx int, cue_idx int, text string, start double, duration double, words array<struct<text:string,start:double>>, speaker string, turn boolean"


def cues_of(name, n):
    said, rows = [], []
    for k in range(n):
        new = [f"w{R.randint(0, 40)}" for _ in range(R.randint(0, 4))]
        text = " ".join((said[-R.randint(1, 5) :] if said else []) + new)
        said += new
        rows.append((name, 0, k, text, float(k), 1.0, [(w, float(k)) for w in text.split()], None, False))
    return rows


def test_a_stream_is_deduplicated_as_a_table_after_a_restart(spark, tmp_path):
    rows = [r for name, n in (("a", 60), ("b", 45), ("c", 3)) for r in cues_of(name, n)]
    batches = [[r for r in rows if r[2] // 15 == k] for k in range(4)]
    schema = spark.createDataFrame([], CUES).schema
    os.makedirs(tmp_path / "in")

    def arrive(k, again=()):
        spark.createDataFrame([*batches[k], *again], CUES).coalesce(1).write.mode("append").json(str(tmp_path / "in" / str(k)))

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        q = rolling.dedupe_rolling_window(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()

    arrive(0)
    run()
    arrive(1, again=batches[0][:7])  # some arrive twice
    run()
    for k in (2, 3):
        arrive(k)
        run()
    got = sorted((r["source_id"], r["cue_idx"], r["text"], r["start"], len(r["words"])) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    table = dedupe.dedupe_rolling_window(spark.createDataFrame(rows, CUES))
    assert got == sorted((r["source_id"], r["cue_idx"], r["text"], r["start"], len(r["words"])) for r in table.collect()) and len(got) > 60


class Value:
    """Stands in for a state that may have expired."""

    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


def test_a_silent_track_is_forgotten():
    value = Value()
    processor = rolling._Dedupe(keep=3, idle_ms=5)
    processor.init(type("Handle", (), {"getValueState": lambda self, name, schema, ttl: value if ttl == 5 else None})())
    row = lambda k, text: dict(zip([c.split(" ")[0] for c in CUES.split(", ")][:9], ("a", 0, k, text, 0.0, 1.0, None, None, False)))
    read = lambda *rows: [r["text"] for r in processor.handleInputRows(("a", 0), iter(rows), None)]
    assert read(row(1, "b c"), row(0, "a b")) == ["a b", "c"] and read(row(2, "b c d e"), row(1, "b c")) == ["d e"]
    assert value.held == (["c", "d", "e"], 2)
    value.held = None  # expired
    assert read(row(0, "d e f")) == ["d e f"]


class Refused(Exception):
    code = "REGION_BLOCKED"


def load(ref):
    kind = ref.rsplit("/", 1)[-1]
    if kind == "blocked":
        raise Refused("not here")
    if kind == "strange":
        raise ZeroDivisionError("who knows")
    if kind == "none":
        return None
    return "{" if kind == "broken" else f"WEBVTT\n\n00:01.000 --> 00:02.000\n{ref}\n"


def test_one_rows_trouble_is_its_own(spark, tmp_path):
    kinds = ["fine", "blocked", "strange", "none", "broken", "good"]
    for k in range(3):
        rows = [(f"s{k}{kind}", 0, "json3" if kind == "broken" else "vtt", f"{k}/{kind}") for kind in kinds]
        spark.createDataFrame(rows, "source_id string, track_idx int, caption_format string, ref string").coalesce(1).write.json(str(tmp_path / "in" / str(k)))
    schema = "source_id string, track_idx int, caption_format string, ref string"

    def run(checkpoint):
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
        intake.intake(stream, load, str(tmp_path / "out"), str(checkpoint)).awaitTermination()

    run(tmp_path / "cp")
    commits = tmp_path / "cp" / "commits"
    for name in ("2", ".2.crc"):  # as if the driver was lost before the last batch was noted as done
        if (commits / name).exists():
            (commits / name).unlink()
    run(tmp_path / "cp")
    cues = spark.read.parquet(str(tmp_path / "out" / "cues"))
    assert sorted(r["text"] for r in cues.collect()) == sorted(f"{k}/{kind}" for k in range(3) for kind in ("fine", "good"))
    letters = spark.read.parquet(str(tmp_path / "out" / "dead_letters"))
    want = [(f"{k}/{kind}", code) for k in range(3) for kind, code in (("blocked", "REGION_BLOCKED"), ("strange", "ACQUISITION_FAILED"), ("none", "ACQUISITION_FAILED"), ("broken", "MALFORMED_CAPTIONS"))]
    assert sorted((r["ref"], r["code"]) for r in letters.collect()) == sorted(want)
    assert letters.where("code = 'ACQUISITION_FAILED' and detail like 'ZeroDivisionError: who knows'").count() == 3


def test_the_newest_stored_listing_stands_in(spark, tmp_path):
    batches = [[("a", json.dumps({"v": 1})), ("b", None)], [("a", None), ("a", None), ("b", json.dumps({"v": 2}))], [("a", json.dumps({"v": 3})), ("b", None)], [("a", None), ("b", None), ("c", None)]]
    for k, rows in enumerate(batches):
        spark.createDataFrame([(k, *r) for r in rows], "k int, source string, json string").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    for _ in range(2):
        stream = spark.readStream.schema("k int, source string, json string").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        intake.last_known_good(stream, str(tmp_path / "cache"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = [sorted((r["source"], r["json"], r["stale"]) for r in spark.read.parquet(str(tmp_path / "out" / f"batch={k}")).collect()) for k in range(4)]
    one, two, three = (json.dumps({"v": v}) for v in (1, 2, 3))
    assert got == [[("a", one, False), ("b", None, False)], [("a", one, True), ("a", one, True), ("b", two, False)], [("a", three, False), ("b", two, True)], [("a", three, True), ("b", two, True), ("c", None, False)]]


def test_payloads_beyond_the_ceiling(spark, monkeypatch):
    monkeypatch.setattr(intake, "MAX_PAYLOAD", 5)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, ref string")
    out = {r["k"]: (r["payload"], r["code"]) for r in intake.loaded(rows, lambda ref: "x" * (6 if ref else 2)).collect()}
    assert out[2] == ("xx", None) and out[1][0] in (None, "xxxxxx")  # a worker may have the module's own ceiling
    assert intake.loaded(rows.where("k > 5"), load).count() == 0
