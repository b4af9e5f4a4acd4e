"""Cues -> paragraphs: what to do with a track, and the fold that closes paragraphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.languages import tiers
from lectern.functions.text import n_tokens
from lectern.operators import TRACK
from lectern.operators.dedupe import dedupe_rolling_window
from lectern.operators.markup import consume_markup
from lectern.operators.sentences import cut_at, ends_sentence, punctuated, sentence_cuts
from lectern.operators.words import packed, unpacked
from lectern.sources.shared import cut, workers_see_package

WORD_TAIL, GAP, TARGET, MOST = 1.0, 1.0, 90, 250
PAUSE_FLOOR, CEILING = 0.75, 2


def speech_end(words: Column, end: Column) -> Column:
    return F.when(F.size(words) > 0, F.element_at(words, -1)["start"]).otherwise(end)


def passage_end(words: Column, end: Column) -> Column:
    return F.least(end, speech_end(words, end) + WORD_TAIL)


def policy_for(tracks: DataFrame, cues: DataFrame) -> DataFrame:
    """source_id, track_idx, dedupe, punctuated: by the track's kind, and by measuring its text where there is enough."""
    measured = punctuated(cues).select(*TRACK, F.col("punctuated").alias("measured"))
    rows = tracks.join(F.broadcast(tiers(tracks.sparkSession)), "tier").join(measured, TRACK, "left")
    return rows.select(*TRACK, ((F.col("tier") == "asr_platform") & (F.col("caption_format") != "json3")).alias("dedupe"), F.coalesce("measured", "assume_punctuated").alias("punctuated"))


def fold_step(gap: float, words: int, wanted: bool, turn: bool, is_punctuated: bool, ended: bool) -> tuple[bool, bool]:
    """(whether the paragraph closes before this cue, whether a break is wanted from now on)."""
    if gap > GAP:
        wanted = wanted or not is_punctuated or words >= TARGET * PAUSE_FLOOR
    else:
        wanted = wanted or (is_punctuated and words >= TARGET)
    if words >= MOST * CEILING:
        closes = True
    elif not is_punctuated:
        closes = wanted or words >= MOST
    else:
        closes = (wanted or words >= MOST) and ended
    return turn or closes, wanted


def gap_before(start: Column, end_of_speech: Column) -> Column:
    """How long nobody spoke before a cue; null for a track's first."""
    w = W.partitionBy(*TRACK).orderBy("cue_idx", "piece_idx", "turn_idx")
    return start - F.lag(end_of_speech).over(w)


ORDER = ["cue_idx", "piece_idx", "turn_idx"]
#: A longer track is folded in chunks of so many cues.
CHUNK = 100_000
_STATE = "struct<seg:long,run:int,words:long,wanted:boolean,last:double,said:boolean>"
_KEYS = [*TRACK, "chunk"]


def paragraph_runs(cues: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """cues(..., cue_idx, piece_idx, turn_idx, punctuated) -> adds run: which paragraph of its segment a cue is in, and seg.

    A turn closes whatever is open and begins a segment. Tracks are dealt over the tasks
    and pass through each in order as one stream, which holds a few numbers. A track of
    more than ``chunk`` cues is cut into chunks by its cues' ordinals, which are dealt like
    tracks: where a chunk's stream starts is told beforehand by :func:`entries`.
    """
    return _streamed(_facts(cues, chunk))[0]


_FACTS = ["start", "spoken", "n", "ended", "turn", "punctuated"]


def _facts(cues: DataFrame, chunk: int, **more: Column) -> DataFrame:
    """What the fold asks of a cue, and more columns, as a table: texts are looked at once."""
    key = [F.col(c).cast("int").alias(c) for c in ("track_idx", *ORDER)]
    end = F.col("start") + F.col("duration")
    facts = cues.select("source_id", *key, F.floor(F.col("cue_idx") / chunk).cast("int").alias("chunk"), "start", speech_end(F.col("words"), end).alias("spoken"), n_tokens("text").alias("n"), ends_sentence("text").alias("ended"), F.coalesce("turn", F.lit(False)).alias("turn"), "punctuated", *[c.alias(name) for name, c in more.items()])
    return cut(facts, "facts")


def _streamed(facts: DataFrame, openings: bool = False) -> tuple[DataFrame, bool]:
    """paragraph_runs, and whether any track is cut into chunks; with openings only the cues at which a paragraph or a chunk begins."""
    workers_see_package(facts.sparkSession)
    facts = facts.select(*_KEYS, *ORDER, *_FACTS)
    none = F.lit(None).cast(_STATE)
    chunked = bool(facts.agg(F.max("chunk")).first()[0])
    if chunked:
        long = facts.where("chunk > 0").select(*TRACK).distinct()
        told = cut(entries(facts.join(long, TRACK, "left_semi")), "entries")
        placed = facts.join(told, _KEYS, "left")
    else:
        placed = facts.withColumn("entry", none)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, seg, current, words, wanted, last, said = None, 0, 0, 0, False, 0.0, False
        for batch in batches:
            segs, runs, opened, before = [], [], [], (seg, current)
            for source, track, part, start, spoken, n, ended, turn, is_punctuated, entry in zip(*[batch.column(c).to_pylist() for c in (*_KEYS, "start", "spoken", "n", "ended", "turn", "punctuated", "entry")]):
                first = now != (source, track, part)
                if first:
                    now = (source, track, part)
                    if entry is not None:
                        seg, current, words, wanted, last, said = (entry[c] for c in ("seg", "run", "words", "wanted", "last", "said"))
                if first and entry is None:
                    seg, current, words, wanted = int(turn), 0, 0, False
                elif turn:
                    seg, current, words, wanted = seg + 1, 0, 0, False
                else:
                    closes, wanted = fold_step(start - last, words, wanted, False, bool(is_punctuated), bool(said))
                    if closes:
                        current, words, wanted = current + 1, 0, False
                if openings and (first or (seg, current) != before):
                    opened.append(len(segs))
                before = (seg, current)
                segs.append(seg)
                runs.append(current)
                words, last, said = words + n, spoken, ended
            out = pa.RecordBatch.from_arrays([*[batch.column(c) for c in (*TRACK, *ORDER)], pa.array(segs, pa.int64()), pa.array(runs, pa.int32())], [*TRACK, *ORDER, "seg", "run"])
            yield out.take(pa.array(opened, pa.int64())) if openings else out

    in_order = placed.repartition(*_KEYS).sortWithinPartitions(*_KEYS, *ORDER)
    return in_order.mapInArrow(run, "source_id string, track_idx int, cue_idx int, piece_idx int, turn_idx int, seg long, run int"), chunked


def closings(n: np.ndarray, late: np.ndarray, ended: np.ndarray, turn: np.ndarray, is_punctuated: bool) -> tuple[np.ndarray, np.ndarray]:
    """For a paragraph that opens at each cue of a stretch: the cue at which it closes (the stretch's size if at none), and where a break is wanted.

    late: whether more than GAP lies before a cue; ended: whether the cue before it ends a
    sentence; turn: whether another speaker begins. As fold_step has it.
    """
    size = len(n)
    said = np.concatenate([[0], np.cumsum(n)])[:size]  # words before each cue
    at = np.arange(size)

    def following(mask: np.ndarray) -> np.ndarray:
        """By place, the first place from it on where mask holds."""
        return np.concatenate([np.minimum.accumulate(np.where(mask, at, size)[::-1])[::-1], [size]])

    reached = lambda words: np.searchsorted(said, said + words, "left")
    closes = np.minimum(following(turn)[at + 1], reached(MOST * CEILING))
    if not is_punctuated:
        return np.minimum(closes, np.minimum(following(late)[at + 1], reached(MOST))), np.full(size, size)
    wanted = np.minimum(following(late)[reached(TARGET * PAUSE_FLOOR)], following(~late)[reached(TARGET)])
    return np.minimum(closes, following(ended)[np.minimum(wanted, reached(MOST))]), wanted


def exits(n: np.ndarray, late: np.ndarray, ended: np.ndarray, turn: np.ndarray, is_punctuated: bool) -> list[np.ndarray]:
    """For a paragraph that opens at each cue of a stretch, how things stand at the end: segments begun, run, words, wanted. A run counts from the opening one where no segment begins."""
    size = len(n)
    close, wanted = closings(n, late, ended, turn, is_punctuated)
    total = int(n.sum())
    said = np.concatenate([[0], np.cumsum(n)])[:size]
    segs, runs, opens = [0] * (size + 1), [0] * (size + 1), list(range(size)) + [size]
    for i, (j, new) in enumerate(zip(close[::-1].tolist(), turn[np.minimum(close, size - 1)][::-1].tolist())):
        i = size - 1 - i
        if j < size:
            opens[i] = opens[j]
            segs[i] = segs[j] + new
            runs[i] = runs[j] + (not new and not segs[j])
    last = np.array(opens[:size], np.int64)  # where the paragraph opens that is open at the end
    return [np.array(segs[:size], np.int64), np.array(runs[:size], np.int64), total - said[last], wanted[last] < size]


_SUMMARY = "source_id string, track_idx int, chunk int, punctuated boolean, start double, last double, said boolean, n array<long>, late array<boolean>, ended array<boolean>, turn array<boolean>, segs array<long>, runs array<long>, words array<long>, wanted array<boolean>"


def summaries(facts: DataFrame) -> DataFrame:
    """A row a chunk: its cues up to where any paragraph that was open before must have closed, and what becomes of one that opens at each of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def done() -> pa.RecordBatch:
            source, track, part, is_punctuated = now
            start, spoken, n, said, turn = (np.concatenate([h[k] for h in held]) for k in range(5))
            late, ended = np.zeros(len(n), bool), np.zeros(len(n), bool)
            late[1:], ended[1:] = start[1:] - spoken[:-1] > GAP, said[:-1]
            head = int(np.searchsorted(np.cumsum(n) - n, MOST * CEILING)) + 1
            arrays = [x[:head].tolist() for x in (n, late, ended, turn, *exits(n, late, ended, turn, is_punctuated))]
            values = [source, track, part, is_punctuated, float(start[0]), float(spoken[-1]), bool(said[-1]), *arrays]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names)

        for batch in batches:
            columns = [batch.column(c) for c in ("start", "spoken", "n", "ended", "turn")]
            columns = [c.fill_null(False if pa.types.is_boolean(c.type) else 0).to_numpy(zero_copy_only=False) for c in columns]
            keys = list(zip(*[batch.column(c).to_pylist() for c in (*_KEYS, "punctuated")]))
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at]:
                    end += 1
                key = (*keys[at][:3], bool(keys[at][3]))
                if now is not None and key != now:
                    yield done()
                    held = []
                now = key
                held.append([c[at:end] for c in columns])
                at = end
        if held:
            yield done()

    flag, number = pa.list_(pa.bool_()), pa.list_(pa.int64())
    types = [pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.float64(), pa.float64(), pa.bool_(), number, flag, flag, flag, number, number, number, flag]
    names = [c.split(" ")[0] for c in _SUMMARY.split(", ")]
    return facts.repartition(*_KEYS).sortWithinPartitions(*_KEYS, *ORDER).mapInArrow(run, _SUMMARY)


def entries(facts: DataFrame) -> DataFrame:
    """source_id, track_idx, chunk, entry: how things stand before each chunk but the first, from the chunks' summaries in order.

    A summary has at most as many cues as hold MOST * CEILING words, so of a track only that
    much a chunk passes through one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for batch in batches:
            keys, out = [], []
            for row in batch.to_pylist():
                key = (row["source_id"], row["track_idx"])
                fresh = key != now
                if not fresh:
                    keys.append((*key, row["chunk"]))
                    out.append(dict(state))
                now = key
                if fresh:
                    state, opened = {"seg": int(row["turn"][0]), "run": 0, "words": 0, "wanted": False}, 0
                else:
                    opened = None
                    for j, (n, late, ended, turn) in enumerate(zip(row["n"], row["late"], row["ended"], row["turn"])):
                        if j == 0:
                            late, ended = row["start"] - state["last"] > GAP, state["said"]
                        if turn:
                            state |= {"seg": state["seg"] + 1, "run": 0}
                        else:
                            closes, state["wanted"] = fold_step(GAP + 1 if late else 0.0, state["words"], state["wanted"], False, row["punctuated"], ended)
                            if not closes:
                                state["words"] += n
                                continue
                            state["run"] += 1
                        opened = j
                        break
                if opened is not None:
                    begun = row["segs"][opened]
                    state |= {"seg": state["seg"] + begun, "run": row["runs"][opened] + (0 if begun else state["run"]), "words": row["words"][opened], "wanted": row["wanted"][opened]}
                state |= {"last": row["last"], "said": row["said"]}
            columns = list(zip(*keys)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([*[pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int32()))], pa.array(out, kind)], [*_KEYS, "entry"])

    kind = pa.struct([("seg", pa.int64()), ("run", pa.int32()), ("words", pa.int64()), ("wanted", pa.bool_()), ("last", pa.float64()), ("said", pa.bool_())])
    return summaries(facts).repartition(*TRACK).sortWithinPartitions(*_KEYS).mapInArrow(run, f"source_id string, track_idx int, chunk int, entry {_STATE}")


def runs_by_fold(cues: DataFrame) -> DataFrame:
    """The same runs as one expression a track: the twin that paragraph_runs is tested against."""
    order = ["cue_idx", "piece_idx", "turn_idx"]
    w = W.partitionBy(*TRACK).orderBy(*order)
    end = F.col("start") + F.col("duration")
    facts = cues.select(*TRACK, *order, "turn", F.coalesce(gap_before(F.col("start"), speech_end(F.col("words"), end)), F.lit(0.0)).alias("gap"), n_tokens("text").alias("n"), F.coalesce(F.lag(ends_sentence("text")).over(w), F.lit(False)).alias("ended"), "punctuated")
    rows = F.array_sort(F.collect_list(F.struct(*order, "turn", "gap", "n", "ended", "punctuated")))
    kind = "array<struct<cue_idx:int,piece_idx:int,turn_idx:int,run:int>>"
    start = F.struct(F.lit(0).alias("words"), F.lit(False).alias("wanted"), F.lit(-1).alias("run"), F.array().cast(kind).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        wants = F.when(x["gap"] > GAP, ~x["punctuated"] | (acc["words"] >= TARGET * PAUSE_FLOOR)).otherwise(x["punctuated"] & (acc["words"] >= TARGET))
        wanted = acc["wanted"] | wants
        over = acc["words"] >= MOST
        closes = x["turn"] | (acc["words"] >= MOST * CEILING) | F.when(x["punctuated"], (wanted | over) & x["ended"]).otherwise(wanted | over) | (acc["run"] < 0)
        run = F.when(closes, acc["run"] + 1).otherwise(acc["run"])
        row = F.struct(x["cue_idx"].alias("cue_idx"), x["piece_idx"].alias("piece_idx"), x["turn_idx"].alias("turn_idx"), run.alias("run"))
        return F.struct((F.when(closes, 0).otherwise(acc["words"]) + x["n"]).alias("words"), F.when(closes, False).otherwise(wanted).alias("wanted"), run.alias("run"), F.concat(acc["out"], F.array(row)).alias("out"))

    return facts.groupBy(*TRACK).agg(F.aggregate(rows, start, step)["out"].alias("o")).select(*TRACK, F.inline("o"))


def passages_of(cues: DataFrame, runs: list[str]) -> DataFrame:
    """Cues with run columns -> passages: text in order, first start, last end, first speaker and turn; adds passage_idx."""
    end = F.col("start") + F.col("duration")
    return _gathered(cues.withColumn("stop", passage_end(F.col("words"), end)), runs)


def _gathered(cues: DataFrame, runs: list[str]) -> DataFrame:
    """passages_of for cues whose passage would end at stop."""
    order = F.struct(*ORDER)
    rows = F.array_sort(F.collect_list(F.struct(*ORDER, "text")))
    out = cues.groupBy(*TRACK, *runs).agg(
        F.array_join(F.transform(rows, lambda x: x["text"]), " ").alias("text"),
        F.min_by("start", order).alias("start"),
        F.max_by("stop", order).alias("end"),
        F.min_by("speaker", order).alias("speaker"),
        F.min_by("turn", order).alias("turn"),
    )
    idx = F.row_number().over(W.partitionBy(*TRACK).orderBy(*runs)) - 1
    return out.select(*TRACK, idx.alias("passage_idx"), "text", "start", F.greatest("end", "start").alias("end"), "speaker", "turn")


def fold(cues: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Cues as paragraph_runs takes them -> passages, dealt by source.

    Only the cues that open a paragraph come back from the stream. They meet the cues in one
    sort of a source, so texts are shuffled once, without their words' times; a track that is
    cut into chunks meets them chunk by chunk, and its paragraphs are shuffled once more.
    """
    stop = passage_end(F.col("words"), F.col("start") + F.col("duration"))
    facts = _facts(cues, chunk, text=F.col("text"), stop=stop, speaker=F.col("speaker"), turned=F.col("turn"))
    opened, chunked = _streamed(facts, openings=True)
    own = facts.select(*_KEYS, *ORDER, F.lit(1).alias("side"), "text", "start", "stop", "speaker", F.col("turned").alias("turn"))
    marks = opened.select(*TRACK, F.floor(F.col("cue_idx") / chunk).cast("int").alias("chunk"), *ORDER, F.lit(0).alias("side"), F.struct("seg", "run").alias("at"))
    dealt = own.unionByName(marks, allowMissingColumns=True).repartition(*(_KEYS if chunked else ["source_id"]))
    w = W.partitionBy(*(_KEYS if chunked else TRACK)).orderBy(*ORDER, "side").rowsBetween(W.unboundedPreceding, 0)
    placed = dealt.withColumn("at", F.last("at", ignorenulls=True).over(w)).where("side = 1")
    return _gathered(placed.select(*TRACK, *ORDER, "text", "start", "stop", "speaker", "turn", F.col("at.seg").alias("seg"), F.col("at.run").alias("run")), ["seg", "run"])


def reflow(cues: DataFrame, policy: DataFrame) -> DataFrame:
    """Cues and their tracks' policy(dedupe, punctuated) -> passages. Stages run in this order on the tracks that want them."""
    names = cues.columns
    slim = cues.withColumn("p", packed(F.col("words"), F.col("text"))).select(*[c for c in names if c != "words"], "p.*")
    own = slim.join(policy.select(*TRACK, "dedupe", "punctuated"), TRACK).withColumn("words", unpacked(F.col("starts"), F.col("loose"), F.col("text")))
    deduped = dedupe_rolling_window(own.where("dedupe").select(*names)).join(policy.select(*TRACK, "punctuated"), TRACK)
    own = own.where("not dedupe").select(*names, "punctuated").unionByName(deduped.select(*names, "punctuated"))
    split = cut_at(own, F.when(F.col("punctuated"), sentence_cuts("text")).otherwise(F.array().cast("array<int>")))
    return fold(consume_markup(split, ["punctuated"]))
