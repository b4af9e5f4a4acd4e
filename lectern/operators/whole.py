"""Lectures that are a row each: cues and chapters in, passages under their sections out.

What :mod:`paragraphs` and :mod:`sections` do with rows that are dealt by source, for
sources that lie in one row already, as a document does with its lines: no text is
shuffled or written between steps. A task holds a batch of rows at a time. Cues that come
one a row go the other way, which cuts long tracks into chunks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from lectern.operators.paragraphs import fold_step
from lectern.sources.shared import workers_see_package

_PASSAGES = "array<struct<passage_idx:int,section_idx:int,section:string,text:string,start:double,end:double,speaker:string,turn:boolean>>"


def openings(sizes: list[int], punctuated: list[bool], start: list[float], spoken: list[float], n: list[int], ended: list[bool], turn: list[bool]) -> tuple[list[int], list[int]]:
    """(the cues at which a paragraph opens, how many of them each track has) for tracks of so many cues, one after another."""
    opened, held, at = [], [], 0
    for size, is_punctuated in zip(sizes, punctuated):
        before, words, wanted, last, said = len(opened), 0, False, 0.0, False
        for i in range(at, at + size):
            closes = i == at or turn[i]
            if not closes:
                closes, wanted = fold_step(start[i] - last, words, wanted, False, is_punctuated, said)
            if closes:
                opened.append(i)
                words, wanted = 0, False
            words, last, said = words + n[i], spoken[i], ended[i]
        held.append(len(opened) - before)
        at += size
    return opened, held


def sections_at(starts: np.ndarray, opens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the passages of a lecture (the chapter each is in, -1 before all; its section: runs of one chapter). Of chapters that open together the last counts."""
    order = opens.argsort(kind="stable")
    place = opens[order].searchsorted(starts, "right")
    chapter = np.concatenate([[-1], order])[place]
    return chapter, np.cumsum(np.diff(chapter, prepend=chapter[:1]) != 0)


def passages(lectures: DataFrame) -> DataFrame:
    """source_id, passages: lectures(source_id, punctuated, cues, chapters) folded into paragraphs under their chapters; those without cues go.

    cues: in order, each with text, n (its words), start, spoken (where its last word
    begins), stop, ended (whether it ends a sentence), speaker, turn; only a speaker may be
    null. chapters: in order, each with title and start.
    """
    workers_see_package(lectures.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.greater(pc.list_value_length(batch.column("cues")), 0))
            if not batch.num_rows:
                continue
            listed, chapters = batch.column("cues"), batch.column("chapters")
            sizes, cues, named = pc.list_value_length(listed).to_pylist(), listed.flatten(), chapters.flatten()
            of = {k: cues.field(k) for k in ("text", "n", "start", "spoken", "stop", "ended", "speaker", "turn")}
            opened, held = openings(sizes, batch.column("punctuated").to_pylist(), *[of[k].to_pylist() for k in ("start", "spoken", "n", "ended", "turn")])
            at = np.array([*opened, len(cues)], np.int64)
            bounds = np.concatenate([[0], np.cumsum(held)])
            text = pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), of["text"]), " ")
            start, stop = of["start"].to_numpy()[at[:-1]], of["stop"].to_numpy()[at[1:] - 1]
            opens, first = named.field("start").to_numpy(), 0
            titles, numbers, under = [], [], []
            for k, many in enumerate(pc.list_value_length(chapters).fill_null(0).to_pylist()):
                chapter, section = sections_at(start[bounds[k] : bounds[k + 1]], opens[first : first + many])
                titles.append(np.where(chapter < 0, -1, chapter + first))
                numbers.append(np.arange(len(chapter)))
                under.append(section)
                first += many
            places = np.concatenate(titles)
            title = named.field("title").take(pa.array(places, pa.int64(), mask=places < 0))
            where = pa.array(at[:-1])
            columns = [pa.array(np.concatenate(numbers), pa.int32()), pa.array(np.concatenate(under), pa.int32()), title, text, pa.array(start), pa.array(np.maximum(start, stop)), of["speaker"].take(where), of["turn"].take(where)]
            made = pa.StructArray.from_arrays(columns, ["passage_idx", "section_idx", "section", "text", "start", "end", "speaker", "turn"])
            yield pa.RecordBatch.from_arrays([batch.column("source_id"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made)], ["source_id", "passages"])

    return lectures.select("source_id", "punctuated", "cues", "chapters").mapInArrow(run, f"source_id string, passages {_PASSAGES}")
