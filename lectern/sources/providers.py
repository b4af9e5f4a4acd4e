"""Providers: what lists the lectures of a source and loads the captions that were chosen.

A provider says which sources it handles, lists their tracks without reading captions,
and loads chosen tracks as payloads(tracks..., payload, content_hash, code). Another
kind of source is another Provider; a request takes them in order.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators.parse import MAX_PAYLOAD
from lectern.operators.resolve import tracks_from_listing
from lectern.sources import files, metadata
from lectern.sources.store import there


@dataclass(frozen=True)
class Listing:
    tracks: DataFrame
    failures: DataFrame  # source_id, code
    meta: DataFrame | None = None
    chapters: DataFrame | None = None


@dataclass(frozen=True)
class Provider:
    name: str
    handles: Callable[[str], bool]
    list: Callable[[SparkSession, str], Listing]
    load: Callable[[SparkSession, DataFrame, str], DataFrame]
    #: Whether loading costs enough for the store to be asked first.
    remote: bool = False


def folder_provider() -> Provider:
    """Caption files in a folder of any file system: a path, or a path with a scheme that is no web address."""

    def listed(spark: SparkSession, source: str) -> Listing:
        found = files.listing(spark, source) if there(spark, source) else spark.createDataFrame([], "path string, name string, length long")
        return Listing(files.tracks(found), files.nothing_to_read(found, source))

    return Provider("local", lambda source: not source.startswith(("http://", "https://")), listed, files.payloads)


def listing_provider(listings: DataFrame, captions: DataFrame, name: str = "youtube") -> Provider:
    """Web addresses, from listings(source, json) and captions(ref, payload) that some transport has brought.

    A listing with entries is a playlist; its recordings are listed under their ids or
    watch addresses.
    """

    def listed(spark: SparkSession, source: str) -> Listing:
        infos = metadata.read_info(listings)
        mine = infos.where(F.col("source") == source)
        many = mine.where("info.entries is not null")
        entries, refused = metadata.expand_playlists(many)
        named = entries.select("video_id").distinct()
        lectures = infos.join(named, F.col("info.id") == F.col("video_id"), "left_semi").union(mine.where("info.entries is null"))
        missing = named.join(infos, F.col("info.id") == F.col("video_id"), "left_anti").select(F.col("video_id").alias("source_id"), F.lit("LECTURE_UNAVAILABLE").alias("code"))
        none = spark.range(1).join(mine.select(F.lit(0).alias("id")).limit(1), "id", "left_anti").select(F.lit(source).alias("source_id"), F.lit("LECTURE_UNAVAILABLE").alias("code"))
        broken = metadata.contract_broken(lectures)
        fine = lectures.join(broken, "source", "left_anti")
        tracks = tracks_from_listing(fine.select(F.col("info.id").alias("source_id"), F.col("info.language").alias("language"), "info.subtitles", "info.automatic_captions"))
        failures = refused.select(F.col("source").alias("source_id"), "code").union(broken.select(F.coalesce("source", F.lit("")), "code")).union(missing).union(none)
        bare = fine.select(F.col("info.id").alias("source_id")).join(tracks, "source_id", "left_anti").select("source_id", F.lit("NO_CAPTIONS_AVAILABLE").alias("code"))
        return Listing(tracks, failures.union(bare), metadata.meta(fine).drop("language"), metadata.chapters(fine).drop("end"))

    def load(spark: SparkSession, chosen: DataFrame, source: str) -> DataFrame:
        rows = chosen.join(captions.select("ref", "payload"), "ref", "left")
        large = F.octet_length("payload") > MAX_PAYLOAD
        code = F.when(F.col("payload").isNull(), "ACQUISITION_FAILED").when(large, "PAYLOAD_TOO_LARGE")
        text = F.when(~large, F.regexp_replace(F.regexp_replace("payload", "^\ufeff", ""), "\r\n?", "\n"))
        return rows.select(*chosen.columns, text.alias("payload"), F.sha2(text, 256).alias("content_hash"), code.alias("code"))

    return Provider(name, lambda source: source.startswith(("http://", "https://")), listed, load, remote=True)
