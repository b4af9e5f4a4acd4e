"""Caption files in a folder: which lectures and tracks there are, and their payloads.

A name is ``stem[.tier][.language].format``; the first part that means something wins.
Listing reads no payload: ``content`` is pruned from the scan.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.languages import FORMATS, UNKNOWN, looks_like_language, primary_subtag
from lectern.operators.parse import MAX_PAYLOAD
from lectern.sources.captions import payloads_of, share_of
from lectern.sources.shared import hadoop, workers_see_package
from lectern.sources.store import there
from lectern.sources.stores import open_store, reachable

#: Names that a task hands on at once.
BATCH = 10_000
#: Parts of a file name that tell a track's tier.
TIER_MARKERS = {"manual": "manual", "human": "manual", "auto": "asr_platform", "asr": "asr_platform", "whisper": "asr_local", "transcribed": "asr_local", "translated": "translated"}


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, length of the files of one folder, not of those below it."""
    if dealt_out(spark, folder):
        return dealt_listing(spark, folder).select("path", "name", "length")
    files = spark.read.format("binaryFile").load(folder)
    return files.select("path", F.substring_index("path", "/", -1).alias("name"), "length")


def dealt_out(spark: SparkSession, folder: str) -> bool:
    """Whether tasks can list a folder: it is one, no pattern, is there, and they reach it."""
    return reachable(folder) and not re.search(r"[*?\[{]", folder) and there(spark, folder)


def dealt_listing(spark: SparkSession, folder: str, hashed: bool = False) -> DataFrame:
    """path, name, length, hash (null unless asked for) of a folder's files but those that Spark takes for hidden.

    Each task lists the folder for itself and keeps its share by the names' hash, so the
    driver holds no list of files, as it does for Spark's own reader. The planner takes the
    listing for as small as the numbers it is made from: join it with a hint, or it is broadcast.
    """
    workers_see_package(spark)
    slices = spark.sparkContext.defaultParallelism
    at, fs = hadoop(spark, folder)
    base = fs.makeQualified(at).toString().rstrip("/")
    kinds = {"path": pa.string(), "name": pa.string(), "length": pa.int64(), "hash": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = open_store(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds.values())], list(kinds))

        for part in batches:
            for k in part.column("id").to_pylist():
                rows = []
                for name, length in store.each(wanted=lambda name: name[0] not in "._" and share_of(name, slices) == k):
                    rows.append((f"{base}/{name}", name, length, store.sha256(store.at(name)) if hashed else None))
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
                if rows:
                    yield batch(rows)

    return spark.range(0, slices, 1, slices).mapInArrow(run, "path string, name string, length long, hash string")


def describe(name: Column) -> Column:
    """struct<stem, tier, language, caption_format> of a file name; null if it is no caption."""
    parts = F.split(name, r"\.")
    middle = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(1)))
    middle = F.when(F.size(parts) > 2, middle).otherwise(F.array().cast("array<string>"))
    marks = F.create_map(*[F.lit(x) for kv in TIER_MARKERS.items() for x in kv])
    is_mark = lambda p: F.lower(p).isin(*TIER_MARKERS)
    tier = marks[F.lower(F.get(F.filter(middle, is_mark), F.lit(0)))]
    lang = F.get(F.filter(middle, lambda p: ~is_mark(p) & looks_like_language(p)), F.lit(0))
    fmt = F.lower(F.element_at(parts, -1))
    return F.when((F.size(parts) >= 2) & fmt.isin(*FORMATS), F.struct(F.get(parts, F.lit(0)).alias("stem"), F.coalesce(tier, F.lit("manual")).alias("tier"), F.coalesce(lang, F.lit(UNKNOWN)).alias("raw_language"), fmt.alias("caption_format")))


def tracks(files: DataFrame) -> DataFrame:
    """files(path, name, length) -> tracks: a lecture per stem, its tracks in name order; other files form none."""
    rows = files.withColumn("d", describe(F.col("name"))).where("d is not null")
    idx = F.row_number().over(W.partitionBy("d.stem").orderBy("name")) - 1
    return rows.select(F.col("d.stem").alias("source_id"), idx.alias("track_idx"), primary_subtag(F.col("d.raw_language")).alias("language"), F.col("d.raw_language").alias("raw_language"), F.col("d.tier").alias("tier"), F.col("d.caption_format").alias("caption_format"), F.lit(None).cast("string").alias("label"), F.col("path").alias("ref"), "length")


def expand(files: DataFrame) -> DataFrame:
    """source_id: the lectures of a folder, in name order."""
    return tracks(files).select("source_id").distinct().orderBy("source_id")


def of_stem(files: DataFrame, stem: str) -> DataFrame:
    """The files that a stem names, as ``week-03`` does ``week-03.en.vtt``."""
    return files.where(F.col("name").startswith(stem + "."))


def nothing_to_read(files: DataFrame, source: str) -> DataFrame:
    """One failure row if a folder has no caption file: no files at all and none readable are told apart."""
    n = files.agg(F.count("*").alias("n"), F.count(describe(F.col("name"))).alias("readable"))
    return n.where("readable = 0").select(F.lit(source).alias("source_id"), F.when(F.col("n") == 0, "LECTURE_UNAVAILABLE").otherwise("NO_CAPTIONS_AVAILABLE").alias("code"))


#: Bytes of payloads by which chosen files are dealt over tasks.
TASK_BYTES = 128 * 1024 * 1024


def payloads(spark: SparkSession, chosen: DataFrame, folder: str) -> DataFrame:
    """chosen tracks with payload, content_hash and code: UTF-8 without its mark, line ends as newlines.

    Only the chosen files are opened, by the tasks that their rows lie in; no list of them
    is made. A file over its ceiling is not read: its length in the listing tells, and again
    the bytes that come of it, in chunks. It, or one that is not UTF-8 or is gone, has a code
    instead of a payload. In a file system that only the JVM reaches the folder's captions
    are scanned for them.
    """
    large = chosen.where(F.col("length") > MAX_PAYLOAD).select(*chosen.columns, F.lit(None).cast("string").alias("payload"), F.lit(None).cast("string").alias("content_hash"), F.lit("PAYLOAD_TOO_LARGE").alias("code"))
    small = chosen.where(F.col("length") <= MAX_PAYLOAD)
    if reachable(folder):
        size = small.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
        read = payloads_of(small.repartition(max(spark.sparkContext.defaultParallelism, size // TASK_BYTES + 1), "ref"))
    else:
        of_captions = "*.{" + ",".join([*FORMATS, *map(str.upper, FORMATS)]) + "}"
        content = spark.read.format("binaryFile").option("pathGlobFilter", of_captions).load(folder).where(F.col("length") <= MAX_PAYLOAD).select(F.col("path").alias("ref"), "content")
        raw = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string"))
        text = F.regexp_replace(F.regexp_replace(raw, "^\ufeff", ""), "\r\n?", "\n")
        read = small.join(content, "ref", "left").select(*chosen.columns, text.alias("payload"), F.when(F.col("content").isNull() | text.isNull(), "INPUT_UNREADABLE").alias("code"))
    return read.select(*chosen.columns, "payload", F.sha2("payload", 256).alias("content_hash"), "code").unionByName(large)
