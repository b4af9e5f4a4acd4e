"""Streams: paragraphs ended by pauses, and the paragraph fold with its state kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.paragraphs import fold_step


def pause_paragraphs(events: DataFrame, key: str, at: str, gap: str = "6 hours", late: str = "1 day") -> DataFrame:
    """key, start, end, n: runs of events with no pause longer than gap; rows later than ``late`` are not waited for."""
    rows = events.withWatermark(at, late)
    out = rows.groupBy(F.session_window(at, gap).alias("s"), key).agg(F.count("*").alias("n"), F.min(at).alias("start"), F.max(at).alias("end"))
    return out.select(key, "start", "end", "n")


PASSAGE = "source_id string, text string, start double, end double, speaker string, turn boolean"
STATE = "texts array<string>, start double, end double, speech double, speaker string, turn boolean, words int, wanted boolean, ended boolean, open boolean"


def paragraphs(cues: DataFrame, punctuated: bool = True) -> DataFrame:
    """cues(source_id, cue_idx, text, start, end, speech, speaker, turn, ended) in order -> passages as they close.

    A source's open paragraph is its state; each batch goes on with it. ``ended`` tells
    whether the cue ends a sentence and ``speech`` when its last word starts. A row with
    a null text closes the source.
    """

    def run(key, batches, state: GroupState):
        import pandas as pd

        s = dict(zip([f.split(" ")[0] for f in STATE.split(", ")], state.get)) if state.exists else {"open": False}
        out = []

        def close():
            out.append((key[0], " ".join(s["texts"]), s["start"], max(min(s["end"], s["speech"] + 1.0), s["start"]), s["speaker"], s["turn"]))

        for pdf in batches:
            for c in pdf.sort_values("cue_idx", kind="stable").itertuples():
                if c.text is None:
                    if s["open"]:
                        close()
                    s = {"open": False}
                    continue
                if s["open"]:
                    closes, s["wanted"] = fold_step(c.start - s["speech"], s["words"], s["wanted"], bool(c.turn), punctuated, s["ended"])
                    if closes:
                        close()
                        s = {"open": False}
                if not s["open"]:
                    s = {"texts": [], "start": c.start, "speaker": c.speaker, "turn": bool(c.turn), "words": 0, "wanted": False, "open": True}
                s |= {"texts": [*s["texts"], c.text], "end": c.end, "speech": c.speech, "words": s["words"] + len(c.text.split()), "ended": bool(c.ended)}
        if s["open"]:
            state.update((s["texts"], float(s["start"]), float(s["end"]), float(s["speech"]), s["speaker"], s["turn"], s["words"], bool(s["wanted"]), s["ended"], True))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=[f.split(" ")[0] for f in PASSAGE.split(", ")])

    return cues.groupBy("source_id").applyInPandasWithState(run, PASSAGE, STATE, "append", GroupStateTimeout.NoTimeout)


def with_last_known(stream: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Stream rows with the stored value where their own is null; adds stale."""
    j = stream.join(known.select(key, F.col("value").alias("__known")), key, "left")
    return j.withColumn("stale", F.col("value").isNull() & F.col("__known").isNotNull()).withColumn("value", F.coalesce("value", "__known")).drop("__known")
