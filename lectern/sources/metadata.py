"""Metadata of remote lectures from their stored JSON: forgiving about details, strict about shape.

Nothing here reaches a network. A listing is a JSON document that some earlier step has
fetched; a stored listing stands in where none could be.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.times import finite_or_null, parse_compact_date

MAX_PLAYLIST = 500
_ENTRY = "array<struct<ext:string,url:string,name:string>>"
INFO = f"struct<id:string,title:string,webpage_url:string,channel:string,uploader:string,upload_date:string,release_date:string,duration:string,language:string,chapters:array<struct<title:string,start_time:string,end_time:string>>,subtitles:map<string,{_ENTRY}>,automatic_captions:map<string,{_ENTRY}>,entries:array<struct<id:string,url:string,title:string>>>"

#: Phrases of failure messages, the broken transport first, and their codes.
BROKEN = ("please report this issue", "confirm you are on the latest version", "unable to extract player response", "unable to extract yt initial data", "unable to extract video data", "signature extraction failed", "nsig extraction failed")
PHRASES = [
    ("confirm your age", "AGE_RESTRICTED"), ("age-restricted", "AGE_RESTRICTED"), ("inappropriate for some users", "AGE_RESTRICTED"),
    ("available in your country", "REGION_BLOCKED"), ("blocked it in your country", "REGION_BLOCKED"),
    ("video unavailable", "LECTURE_UNAVAILABLE"), ("video is unavailable", "LECTURE_UNAVAILABLE"), ("this video is not available", "LECTURE_UNAVAILABLE"), ("private video", "LECTURE_UNAVAILABLE"), ("has been removed", "LECTURE_UNAVAILABLE"),
]


def classify(message):
    """The code of a transport's failure message."""
    low = F.lower(message)
    out = F.lit("ACQUISITION_FAILED")
    for phrase, code in reversed(PHRASES):
        out = F.when(F.contains(low, F.lit(phrase)), code).otherwise(out)
    for phrase in reversed(BROKEN):
        out = F.when(F.contains(low, F.lit(phrase)), "TRANSPORT_CONTRACT_CHANGED").otherwise(out)
    return out


def read_info(listings: DataFrame) -> DataFrame:
    """listings(source, json) -> source, info; unreadable JSON gives a null info."""
    return listings.select("source", F.from_json("json", INFO).alias("info"), F.expr("try_parse_json(json)").alias("raw"))


def meta(infos: DataFrame) -> DataFrame:
    """source_id, title, url, channel, published, duration, language: every field optional."""
    i = F.col("info")
    blank = lambda c: F.nullif(c, F.lit(""))
    return infos.where("info is not null").select(F.coalesce(i["id"], F.lit("")).alias("source_id"), F.coalesce(blank(i["title"]), i["id"], F.lit("")).alias("title"), i["webpage_url"].alias("url"), F.coalesce(blank(i["channel"]), i["uploader"]).alias("channel"), parse_compact_date(F.coalesce(blank(i["upload_date"]), i["release_date"])).alias("published"), finite_or_null(i["duration"]).alias("duration"), i["language"].alias("language"))


def chapters(infos: DataFrame) -> DataFrame:
    """source_id, chapter_idx, title, start, end: chapters that have a start."""
    rows = infos.select(F.col("info.id").alias("source_id"), F.posexplode("info.chapters").alias("i", "c")).withColumn("start", finite_or_null(F.col("c.start_time"))).where("start is not null")
    return rows.select("source_id", (F.row_number().over(W.partitionBy("source_id").orderBy("i")) - 1).alias("chapter_idx"), F.coalesce("c.title", F.lit("")).alias("title"), "start", finite_or_null(F.col("c.end_time")).alias("end"))


def contract_broken(infos: DataFrame) -> DataFrame:
    """source, code, detail: listings whose caption groups are absent, which is not the same as empty."""
    absent = lambda name: F.expr(f"variant_get(raw, '$.{name}') is null")
    detail = F.when(F.col("raw").isNull(), "not JSON").when(absent("id"), "no id").when(absent("subtitles") & absent("automatic_captions"), "neither group of captions")
    return infos.select("source", F.lit("TRANSPORT_CONTRACT_CHANGED").alias("code"), detail.alias("detail")).where("detail is not null")


def expand_playlists(infos: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(source, position, video_id) of playlists, and failures(source, code): too large or empty ones are refused whole."""
    n = F.size(F.coalesce("info.entries", F.array().cast("array<struct<id:string,url:string,title:string>>")))
    fine = infos.where(n.between(1, MAX_PLAYLIST)).select("source", F.posexplode("info.entries").alias("position", "e")).select("source", "position", F.col("e.id").alias("video_id")).where("video_id is not null")
    bad = infos.where(~n.between(1, MAX_PLAYLIST)).select("source", F.when(n == 0, "PLAYLIST_EMPTY").otherwise("PLAYLIST_TOO_LARGE").alias("code"))
    return fine, bad


def with_fallback(wanted: DataFrame, live: DataFrame, failures: DataFrame, stored: DataFrame) -> DataFrame:
    """source, json, stale_reason, code: the live listing, else the stored one with the reason, else the failure.

    Only failures of the source allow the stored listing; failures of its captions do not.
    """
    from_source = ~F.col("code").isin("NO_CAPTIONS_AVAILABLE", "TRACK_NOT_FOUND", "MALFORMED_CAPTIONS", "EMPTY_TRANSCRIPT", "PAYLOAD_TOO_LARGE")
    j = wanted.join(live.select("source", F.col("json").alias("l")), "source", "left").join(failures.select("source", "code"), "source", "left").join(stored.select("source", F.col("json").alias("s")), "source", "left")
    use = F.when(F.col("l").isNull() & from_source, F.col("s"))
    return j.select("source", F.coalesce("l", use).alias("json"), F.when(use.isNotNull(), F.col("code")).alias("stale_reason"), F.when(F.col("l").isNull() & use.isNull(), F.coalesce("code", F.lit("ACQUISITION_FAILED"))).alias("code"))
