"""Tracks longer than a chunk: folded and deduplicated in parts that give what one stream gives."""

import random

import numpy as np
import pytest

from lectern.operators import dedupe, paragraphs

R = random.Random(4)
CUE = "source_id string, track_idx int, cue_idx int, piece_idx int, turn_idx int, text string, start double, duration double, words array<struct<text:string,start:double>>, speaker string, turn boolean, punctuated boolean"


def track(name, n, punctuated, words, pauses, turns):
    rows, at = [], 0.0
    for k in range(n):
        text = " ".join("w" for _ in range(R.randint(*words))) + R.choice(["", "", "."])
        at += R.choice(pauses)
        rows.append((name, 0, k, 0, 0, text, at, 1.0, [], None, R.random() < turns, punctuated))
        at += 1.0
    return rows


TRACKS = [("a", 900, True, (1, 9), [0, 0, 0, 2.0], 0.01), ("b", 700, False, (1, 3), [0], 0), ("c", 650, True, (5, 60), [0, 3.0], 0.2), ("d", 30, True, (1, 5), [0], 0), ("e", 800, False, (0, 4), [0] * 40 + [1.5], 0.003), ("f", 400, True, (1, 1), [0], 0), ("g", 300, True, (900, 1200), [0], 0)]


def plain_run(rows):
    out, words, wanted, seg, run, last, said = [], 0, False, 0, 0, None, False
    for r in rows:
        n = len(r[5].split())
        if last is None:
            seg = int(r[10])
        elif r[10]:
            seg, run, words, wanted = seg + 1, 0, 0, False
        else:
            closes, wanted = paragraphs.fold_step(r[6] - last, words, wanted, False, r[11], said)
            if closes:
                run, words, wanted = run + 1, 0, False
        out.append((r[0], r[2], seg, run))
        words, last, said = words + n, r[6] + r[7], r[5].endswith(".")
    return out


@pytest.mark.parametrize("chunk", [7, 64, 100_000])
def test_paragraphs_of_chunks_are_those_of_the_stream(spark, chunk):
    rows = [track(*t) for t in TRACKS]
    frame = spark.createDataFrame([r for t in rows for r in t], CUE).repartition(3)
    got = sorted((r["source_id"], r["cue_idx"], r["seg"], r["run"]) for r in paragraphs.paragraph_runs(frame, chunk).collect())
    assert got == sorted(x for t in rows for x in plain_run(t))


def test_closings_are_those_of_single_steps():
    for _ in range(200):
        size = R.randint(1, 60)
        n = np.array([R.choice([0, 1, 5, 40, 300]) for _ in range(size)])
        late, ended, turn = (np.array([R.random() < p for _ in range(size)]) for p in (0.1, 0.3, 0.05))
        for punctuated in (True, False):
            close, _ = paragraphs.closings(n, late, ended, turn, punctuated)
            for i in range(size):
                words, wanted, at = n[i], False, i + 1
                while at < size and not turn[at]:
                    closes, wanted = paragraphs.fold_step(2.0 if late[at] else 0.0, words, wanted, False, punctuated, ended[at])
                    if closes:
                        break
                    words, at = words + n[at], at + 1
                assert close[i] == at


def rolling(name, n, vocabulary, repeat):
    """Cues that say again the last words of the ones before, now and then the same line over and over."""
    said, rows = [], []
    for k in range(n):
        new = [R.choice(vocabulary) for _ in range(R.randint(0, 4))]
        old = said[-R.randint(0, 5) :] if said and R.random() < 0.8 else []
        text = " ".join(old + new) if R.random() > repeat else " ".join(["la"] * R.randint(1, 3))
        said += new
        rows.append((name, 0, k, text, float(k), 1.0, [(w, float(k)) for w in text.split()], None, False))
    return rows


def plain_dedupe(rows):
    longest, tail, out = max(len(r[3].split()) for r in rows), [], []
    for r in rows:
        words = r[3].split()
        most = next((n for n in range(min(len(tail), len(words)), 0, -1) if tail[-n:] == words[:n]), 0)
        fresh = words[most:]
        if fresh:
            tail = [*tail, *fresh][-longest:]
            out.append((r[0], r[2], " ".join(fresh), len(words) if len(words) == len(fresh) else 0))
    return out


@pytest.mark.parametrize("chunk,before", [(50, 10), (40, 0), (100_000, 400)])
def test_chunks_are_deduplicated_as_one_stream(spark, chunk, before):
    words = [f"w{i}" for i in range(300)]
    tracks = [rolling("a", 330, words, 0), rolling("b", 260, ["x", "y"], 0.1), rolling("c", 200, ["la"], 0.5), rolling("d", 20, words, 0), rolling("e", 210, words, 0.9)]
    frame = spark.createDataFrame([r for t in tracks for r in t], "source_id string, track_idx int, cue_idx int, text string, start double, duration double, words array<struct<text:string,start:double>>, speaker string, turn boolean").repartition(4)
    got = sorted((r["source_id"], r["cue_idx"], r["text"], len(r["words"])) for r in dedupe.dedupe_rolling_window(frame, chunk, before).collect())
    assert got == sorted(x for t in tracks for x in plain_dedupe(t))
