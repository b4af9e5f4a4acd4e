"""Which track of a source to read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.languages import TIERS, format_rank, matches
from lectern.functions.text import col

MAX_LISTED = 12


def resolve(tracks: DataFrame, languages: list[str], tiers: list[str] | None = None) -> DataFrame:
    """The best track of each source: by wanted language, then tier, then format, then listing order.

    The first language with a track of any allowed tier wins outright. A source with none
    has no row; see :func:`unresolved`.
    """
    allowed = tiers if tiers is not None else [t for t, *_ in sorted(TIERS, key=lambda t: t[1])]
    lang = F.lit(None).cast("int")
    for k, want in reversed(list(enumerate(languages))):
        lang = F.when(matches("language", "raw_language", F.lit(want)), k).otherwise(lang)
    tier = F.lit(None).cast("int")
    for k, name in reversed(list(enumerate(allowed))):
        tier = F.when(F.col("tier") == name, k).otherwise(tier)
    ranked = tracks.withColumn("lang_rank", lang).withColumn("tier_rank", tier).where("lang_rank is not null and tier_rank is not null")
    key = F.struct("lang_rank", "tier_rank", format_rank("caption_format").alias("f"), "track_idx")
    return ranked.groupBy("source_id").agg(F.min_by(F.struct(*tracks.columns), key).alias("t")).select("t.*")


def describe(language: str = "raw_language", tier: str = "tier", fmt: str = "caption_format", label: str = "label"):
    name = F.when(F.coalesce(col(label), F.lit("")) != "", F.concat(F.lit(' "'), col(label), F.lit('"'))).otherwise("")
    return F.concat(col(language), name, F.lit(" — "), col(tier), F.lit(", "), col(fmt))


def unresolved(tracks: DataFrame, found: DataFrame) -> DataFrame:
    """source_id, code, available: a failure row per source without a track that fits, with what it has."""
    return tracks.join(found.select("source_id"), "source_id", "left_anti").groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("track_idx", describe().alias("d")))), lambda x: x["d"]).alias("all")).select("source_id", F.lit("TRACK_NOT_FOUND").alias("code"), listed(F.col("all"), MAX_LISTED).alias("available"))


def listed(lines, most: int):
    """The first lines, and how many more there are."""
    return F.when(F.size(lines) <= most, lines).otherwise(F.concat(F.slice(lines, 1, most), F.array(F.concat(F.lit("... and "), (F.size(lines) - most).cast("string"), F.lit(" more")))))


def formats(tracks: DataFrame) -> DataFrame:
    """source_id, formats: distinct and sorted."""
    return tracks.groupBy("source_id").agg(F.array_sort(F.collect_set("caption_format")).alias("formats"))


def languages(tracks: DataFrame) -> DataFrame:
    """source_id, languages: distinct, in the order first listed."""
    first = tracks.groupBy("source_id", "language").agg(F.min("track_idx").alias("i"))
    return first.groupBy("source_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "language"))), lambda x: x["language"]).alias("languages"))


def tracks_from_listing(info: DataFrame) -> DataFrame:
    """info(source_id, language, subtitles, automatic_captions: map<lang, array<struct<ext, url, name>>>) -> tracks, in listing order."""
    from lectern.functions.languages import FORMATS, UNKNOWN, primary_subtag, tier_for

    spoken = F.lower(F.coalesce(F.nullif("language", F.lit("")), F.lit(UNKNOWN)))
    parts = []
    for k, (name, against) in enumerate([("subtitles", F.lit(None).cast("string")), ("automatic_captions", spoken)]):
        entries = info.select("source_id", against.alias("spoken"), F.posexplode(F.map_entries(name)).alias("i", "e")).select("source_id", "spoken", "i", F.col("e.key").alias("raw_language"), F.posexplode("e.value").alias("j", "x"))
        parts.append(entries.select("source_id", F.struct(F.lit(k).alias("k"), "i", "j").alias("at"), "raw_language", tier_for("raw_language", "spoken").alias("tier"), F.col("x.ext").alias("caption_format"), F.col("x.url").alias("ref"), F.col("x.name").alias("label")))
    from pyspark.sql import Window as W

    rows = parts[0].union(parts[1]).where(F.col("caption_format").isin(*FORMATS) & (F.coalesce("ref", F.lit("")) != ""))
    return rows.select("source_id", (F.row_number().over(W.partitionBy("source_id").orderBy("at")) - 1).alias("track_idx"), primary_subtag("raw_language").alias("language"), "raw_language", "tier", "caption_format", "label", "ref")
