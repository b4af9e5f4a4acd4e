"""Rolling-window captions as they arrive: what a cue repeats of its track's last words goes."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

from lectern.operators import TRACK, WORDS
from lectern.operators.dedupe import _fresh
from lectern.sources.shared import workers_see_package

OUT = f"source_id string, track_idx int, cue_idx int, text string, start double, duration double, words {WORDS}, speaker string, turn boolean"
#: Words of a track that its state holds.
KEEP = 4_096
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Dedupe(StatefulProcessor):
    def __init__(self, keep: int, idle_ms: int | None):
        self.keep, self.idle_ms = keep, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.said = handle.getValueState("said", "words array<string>, last int", self.idle_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: TimerValues) -> Iterator[Row]:
        found = self.said.get() if self.said.exists() else None
        tail, last = (list(found[0]), found[1]) if found else ([], -1)
        for row in sorted(rows, key=lambda r: r["cue_idx"]):
            if row["cue_idx"] <= last:  # a cue that was read before
                continue
            last = row["cue_idx"]
            fresh = _fresh(tail, row["text"])
            if fresh:
                tail = [*tail, *fresh][-self.keep :]
                words = row["words"] or []
                yield Row(source_id=key[0], track_idx=key[1], cue_idx=last, text=" ".join(fresh), start=row["start"], duration=row["duration"], words=words if len(words) == len(fresh) else [], speaker=row["speaker"], turn=row["turn"])
        self.said.update((tail, last))

    def close(self) -> None:
        pass


def dedupe_rolling_window(cues: DataFrame, keep: int = KEEP, idle_ms: int | None = None) -> DataFrame:
    """A stream of cues without the words that their track has just said, as operators.dedupe has it for a table.

    State is the last ``keep`` words of a track and the ordinal of its last cue. With
    ``idle_ms`` it goes once a track has been silent for so long; Spark then runs batches
    without data too, so such a query goes on until it is stopped. What comes out is what a table of the same
    cues gives as long as cues arrive in order from batch to batch and none has more than
    ``keep`` words. A cue that arrives again, or after a later one, is left out.
    """
    spark = cues.sparkSession
    workers_see_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    names = [c.strip().split(" ")[0] for c in OUT.replace(WORDS, "w").split(",")]
    return cues.select(*names).groupBy(*TRACK).transformWithState(_Dedupe(keep, idle_ms), OUT, "append", "processingTime" if idle_ms else "none")
