"""Captions as they arrive: loaded, parsed, and put aside where something is wrong with them.

A batch leaves its cues and its dead letters in a folder of its own, named by the batch
and written over if the batch is repeated, so each is there exactly once whatever is lost
in between. What goes wrong with one row, foreseen or not, costs that row alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lectern.operators import TRACK, parse
from lectern.operators.parse import MAX_PAYLOAD
from lectern.sources import store
from lectern.sources.shared import cut, workers_see_package

#: What says why a payload could not be had: an exception with a ``code``, else this one.
UNFORESEEN = "ACQUISITION_FAILED"
TOLD = 300


def loaded(rows: DataFrame, load: Callable[[str], str], ref: str = "ref") -> DataFrame:
    """rows with payload, code and detail: what ``load`` makes of each row's ref, in the tasks; whatever it raises becomes the row's code."""
    workers_see_package(rows.sparkSession)
    at, names = rows.columns.index(ref), [*rows.columns, "payload", "code", "detail"]

    def one(value: str | None) -> tuple[str | None, str | None, str | None]:
        try:
            payload = load(value)
            if not isinstance(payload, str):
                raise TypeError(f"{type(payload).__name__} is no text")
            payload.encode()
            return (None, "PAYLOAD_TOO_LARGE", None) if len(payload) > MAX_PAYLOAD else (payload, None, None)
        except Exception as e:  # the last resort: one row's trouble is that row's
            return None, getattr(e, "code", None) if isinstance(getattr(e, "code", None), str) else UNFORESEEN, f"{type(e).__name__}: {e}"[:TOLD]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # a payload may be as large as the ceiling
                part = batch.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array([x], pa.string()) for x in one(part.column(at)[0].as_py())]], names)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(run, f"{kinds}, payload string, code string, detail string")


def read_batch(rows: DataFrame, load: Callable[[str], str]) -> tuple[DataFrame, DataFrame]:
    """rows(source_id, track_idx, caption_format, ref) -> (cues, dead letters: source_id, track_idx, ref, code, detail)."""
    got = cut(loaded(rows.select(*TRACK, "caption_format", "ref"), load), "payloads")
    fine = got.where("code is null")
    broken = parse.malformed(fine).join(got.select(*TRACK, "ref"), TRACK)
    letters = got.where("code is not null").select(*TRACK, "ref", "code", "detail").unionByName(broken.select(*TRACK, "ref", "code", "detail"))
    return parse.parse_captions(fine), letters


def intake(stream: DataFrame, load: Callable[[str], str], folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts reading a stream of (source_id, track_idx, caption_format, ref) into ``folder``: cues and dead_letters, a folder a batch."""

    def each(batch: DataFrame, batch_id: int) -> None:
        cues, letters = read_batch(batch, load)
        cues.write.mode("overwrite").parquet(f"{folder}/cues/batch={batch_id}")
        letters.write.mode("overwrite").parquet(f"{folder}/dead_letters/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def last_known_good(stream: DataFrame, cache: str, folder: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Starts reading a stream of (source, json; null where a listing could not be had) into ``folder``: source, json, stale.

    A listing that came is stored and passed on; for one that did not the newest stored one
    stands in, as the store is when the batch begins, also where another batch or another
    query has just put it there. Where none is stored, json is null. Of several rows of a
    source in a batch each is answered.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        rows = cut(batch.select("source", "json"), "listings")
        live = rows.where("json is not null")
        missing = rows.where("json is null").select("source")
        store.write(live.groupBy("source").agg(F.max("json").alias("value")), cache, "source")
        known = store.read_listings(batch.sparkSession, missing.distinct(), cache, "source")
        held = missing.join(known, "source").select("source", F.col("value").alias("json"), F.col("value").isNotNull().alias("stale"))
        live.withColumn("stale", F.lit(False)).unionByName(held).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
