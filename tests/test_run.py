import json

import pytest

from lectern.plans import run as R
from lectern.plans.fetch import Request

VTT = "WEBVTT\n\n00:00:00.000 --> 00:00:02.000\nWelcome to Dynamic Programing.\n"


@pytest.fixture()
def folder(tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "talk.en.vtt").write_text(VTT)
    (d / "talk.auto.de.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\nHallo\n")
    (d / "bad.en.json3").write_text("{")
    return str(d)


def test_output_and_report_do_not_mix(spark, folder):
    out = R.run(spark, [Request(folder, renderer="plain"), Request(folder, budget=3), Request("https://x.org/w")])
    text = out.output.first()["text"]
    assert text == "Welcome to Dynamic Programing." and out.exit_code == 2
    said = [r["line"] for r in out.report.collect()]
    assert sorted(x.split(":")[0] for x in said) == ["CONFIG_ERROR", "MALFORMED_CAPTIONS", "UNKNOWN_PROVIDER"] and not any(x in text for x in said)
    whole = json.loads(out.envelope.first()["json"])
    assert whole["ok"] is False and whole["results"] == [text] and len(whole["errors"]) == 3


def test_files_are_written_once(spark, folder, tmp_path):
    to = str(tmp_path / "out")
    first = R.run(spark, [Request(folder, renderer="plain")], to)
    assert [(r["name"], r["action"]) for r in first.files.collect()] == [("talk.txt", "write")] and first.output.first()["text"] == ""
    assert (tmp_path / "out" / "talk.txt").read_text() == "Welcome to Dynamic Programing."
    (tmp_path / "out" / "other.txt").write_text("kept")
    other = R.run(spark, [Request(folder, languages=["de"], renderer="plain")], to)
    assert other.files.first()["code"] == "OUTPUT_EXISTS" and other.exit_code == 1 and "OUTPUT_EXISTS" in "".join(r["line"] for r in other.report.collect())
    assert R.run(spark, [Request(folder, languages=["de"], renderer="plain")], to, overwrite=True).files.first()["code"] is None
    assert (tmp_path / "out" / "talk.txt").read_text() == "Hallo"


def test_references(spark, tmp_path):
    path = tmp_path / "g.txt"
    path.write_text("﻿Dynamic Programming: dynamo program\n# note\n", encoding="utf-8")
    assert [tuple(r) for r in R.glossary_lines(spark, str(path)).collect()] == [(0, "Dynamic Programming: dynamo program"), (1, "# note")]
    with pytest.raises(R.Refused, match="PAYLOAD_TOO_LARGE"):
        R.read_reference(spark, str(path), 10)
    path.write_bytes(b"\xff\xfe\x00")
    with pytest.raises(R.Refused, match="INPUT_UNREADABLE"):
        R.glossary_lines(spark, str(path))


def test_corrections_file(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps([{"wrong": "quad code", "right": "quadcode"}, {"wrong": 5, "right": "five"}, "text", {"wrong": "a", "right": "b", "evidence": "read"}]))
    assert [tuple(r) for r in R.corrections_records(spark, str(path)).collect()] == [("quad code", "quadcode", None), (None, "five", None), (None, None, None), ("a", "b", "read")]
    for bad in ("{}", "no json", ""):
        path.write_text(bad)
        with pytest.raises(R.Refused, match="MALFORMED_CORRECTIONS"):
            R.corrections_records(spark, str(path))


def test_names_and_listing(spark, folder):
    assert R.tiers_of(["manual", "asr_local"]) == ["manual", "asr_local"] and R.tiers_of([]) is None and R.budgeted() == ["context"]
    with pytest.raises(R.Refused):
        R.tiers_of(["best"])
    lines = {r["source_id"]: r["line"] for r in R.listing(spark, Request(folder)).collect()}
    assert lines["talk"] == "talk: de, en\n  de — asr_platform, srt\n  en — manual, vtt"


def test_sources_of_one_name_stay_apart(spark, tmp_path):
    for name, said in (("one", "First."), ("two", "Second.")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "week.en.vtt").write_text(VTT.replace("Welcome to Dynamic Programing.", said))
    requests = [Request(str(tmp_path / "two"), renderer="plain"), Request(str(tmp_path / "one"), renderer="plain"), Request(str(tmp_path / "one"), renderer="jsonl")]
    out = R.run(spark, requests, str(tmp_path / "out"))
    assert out.exit_code == 0 and sorted(r["name"] for r in out.files.collect()) == ["week (2).txt", "week (3).jsonl", "week.txt"]
    assert [(tmp_path / "out" / n).read_text() for n in ("week.txt", "week (2).txt")] == ["Second.", "First."] and '"First."' in (tmp_path / "out" / "week (3).jsonl").read_text()
    text = R.run(spark, requests[:2]).output.first()["text"]
    assert text == "Second.\n\n\nFirst."


def test_separators_follow_the_renderers(spark):
    from lectern.plans import render

    rows = [(0, "b", "jsonl", "1"), (0, "a", "jsonl", "0"), (1, "a", "plain", "x"), (2, "a", "plain", "y"), (3, "a", "jsonl", "2")]
    out = render.render_several(spark.createDataFrame(rows, "request int, source_id string, renderer string, text string"), ["request", "source_id"])
    assert out.first()["text"] == "0\n1\n\n\nx\n\n\ny\n\n\n2"
