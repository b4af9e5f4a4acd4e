"""Stored payloads and listings: a Parquet table by key, spread by the key's first two characters.

A miss is a missing row; a damaged listing counts as one. ``None`` for a folder turns the
store off. Values are added, never changed; the newest of a key counts.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.web import cache_key
from lectern.sources.shared import hadoop

SCHEMA = "key string, value string, at timestamp, prefix string"
SETTING = "LECTERN_CACHE"


def default_folder() -> str | None:
    """From the environment; unset means the user's cache folder, empty means no store."""
    found = os.environ.get(SETTING)
    if found is not None:
        return found or None
    return os.path.join(os.environ.get("XDG_CACHE_HOME", os.path.expanduser("~/.cache")), "lectern")


def there(spark: SparkSession, folder: str | None) -> bool:
    """Whether a folder of any file system has something in it."""
    if not folder:
        return False
    at, fs = hadoop(spark, folder)
    if not fs.exists(at):
        return False
    if fs.makeQualified(at).toUri().getScheme() != "file":
        return fs.listStatusIterator(at).hasNext()
    # of a mounted folder the JVM would hold a status of every file
    path = at.toUri().getPath()
    if not os.path.isdir(path):
        return True
    with os.scandir(path) as found:
        return next(found, None) is not None


def write(values: DataFrame, folder: str | None, *key: str) -> None:
    """Adds values(key columns..., value); addresses with signatures must not be among them. Null values are not stored."""
    if folder:
        rows = values.where("value is not null").select(cache_key(*key).alias("key"), "value", F.current_timestamp().alias("at")).withColumn("prefix", F.left("key", F.lit(2)))
        rows.write.mode("append").partitionBy("prefix").parquet(folder)


def read(spark: SparkSession, wanted: DataFrame, folder: str | None, *key: str) -> DataFrame:
    """wanted with value, null where nothing is stored. Only values of wanted keys are shuffled."""
    keyed = wanted.withColumn("__key", cache_key(*key))
    if not there(spark, folder):
        return keyed.withColumn("value", F.lit(None).cast("string")).drop("__key")
    keys = keyed.select(F.col("__key"), F.left("__key", F.lit(2)).alias("prefix")).distinct()
    stored = spark.read.schema(SCHEMA).parquet(folder).withColumnRenamed("key", "__key").join(keys, ["prefix", "__key"], "left_semi")
    newest = stored.groupBy("__key").agg(F.max_by("value", F.struct("at", "value")).alias("value"))
    return keyed.join(newest, "__key", "left").drop("__key")


def read_listings(spark: SparkSession, wanted: DataFrame, folder: str | None, *key: str) -> DataFrame:
    """As read, with what is no JSON object counted as a miss."""
    found = read(spark, wanted, folder, *key)
    return found.withColumn("value", F.when(F.expr("try_parse_json(value)").isNotNull() & F.col("value").rlike(r"^\s*\{"), F.col("value")))
