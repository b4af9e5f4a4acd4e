"""Passages under chapters: an as-of join, then runs of the same chapter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def chapter_at(passages: DataFrame, chapters: DataFrame) -> DataFrame:
    """passages(source_id, passage_idx, start, ...) with chapter_idx: the last chapter that starts no later; null before all.

    Both sides go through one sort per source and a running last value, so the work is
    linear in both. Chapters that start together: the later in their own order. Passages
    that are dealt by source already stay where they are.
    """
    a = passages.withColumns({"__side": F.lit(1), "__idx": F.col("passage_idx").cast("long")})
    b = chapters.select("source_id", "start", F.lit(0).alias("__side"), F.col("chapter_idx").cast("long").alias("__idx"), F.col("chapter_idx").cast("long").alias("__chapter")).repartition("source_id")
    w = W.partitionBy("source_id").orderBy("start", "__side", "__idx").rowsBetween(W.unboundedPreceding, 0)
    found = a.unionByName(b, allowMissingColumns=True).withColumn("chapter_idx", F.last("__chapter", ignorenulls=True).over(w).cast("int"))
    return found.where("__side = 1").drop("__side", "__idx", "__chapter")


def build_sections(passages: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(passages with section_idx, sections(source_id, section_idx, title, start, end, n_passages)).

    A section is a run of passages under one chapter; without chapters a source has one untitled section.
    """
    w = W.partitionBy("source_id").orderBy("passage_idx")
    rows = chapter_at(passages, chapters)
    changed = F.when(F.row_number().over(w) == 1, 0).otherwise((~F.col("chapter_idx").eqNullSafe(F.lag("chapter_idx").over(w))).cast("int"))
    rows = rows.withColumn("changed", changed).withColumn("section_idx", F.sum("changed").over(w).cast("int")).drop("changed")
    runs = rows.groupBy("source_id", "section_idx").agg(F.first("chapter_idx").alias("chapter_idx"), F.min_by("start", "passage_idx").alias("first"), F.max_by("end", "passage_idx").alias("end"), F.count("*").alias("n_passages"))
    named = runs.join(chapters.select("source_id", "chapter_idx", "title", F.col("start").alias("opens")), ["source_id", "chapter_idx"], "left")
    return rows, named.select("source_id", "section_idx", "title", F.coalesce("opens", "first").alias("start"), "end", "n_passages")


def between(passages: DataFrame, start: float, end: float) -> DataFrame:
    """Passages that overlap an open range; sections without any are gone with them."""
    return passages.where((F.col("start") < end) & (F.col("end") > start))
