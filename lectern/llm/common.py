"""What the corpus operators share: reading, cutting lineage, words, shingles and MinHash.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D, with A-Z lowered.
A shingle is a window of ``n`` consecutive words, held as a 64-bit hash. A text with
at least one word but fewer than ``n`` has one shingle made of all of them; a text
without words (null included) has none.
"""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
SIMILAR = 0.8
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words whose hashes a worker remembers before it starts anew.
MEMO = 300_000
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package by its path; a cluster may ship it with --py-files instead."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    workers_see_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names. Only a local session, whose tasks run where the driver does, gets one of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back, so that lost executors repeat nothing before it.

    The application's tables go when the driver's file system closes; :func:`drop` deletes one before that.
    """
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.cut_path = path
    folder, fs = _hadoop(spark, own)
    fs.deleteOnExit(folder)
    return found


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def drop(*tables: DataFrame) -> None:
    """Deletes tables that :func:`cut` returned and nothing reads any more."""
    for df in tables:
        at, fs = _hadoop(df.sparkSession, df.cut_path)
        fs.delete(at, True)


#: A key with more than this share of a join's rows is hot; there are at most as many hot keys as its inverse.
HOT_SHARE, HOT_ROWS = 1 / 5_000, 1_000


def hot_keys(counts: DataFrame, keys: list[str]) -> list:
    """counts(keys, n) -> the keys that hold over HOT_SHARE of all rows, at most 1 / HOT_SHARE."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return counts.where(F.col("n") >= max(HOT_ROWS, total * HOT_SHARE)).select(*keys).collect()


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined with right, which has at most one row a key, without any hot key in one task.

    Rows of left with hot keys stay where they are and meet right's rows by broadcast;
    all others meet by a shuffle. counts(keys, n) are left's, where they are known.
    """
    hot = hot_keys(left.groupBy(*keys).agg(F.count("*").alias("n")) if counts is None else counts, keys)
    if not hot:
        return left.join(right, keys, how)
    named = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*keys).schema))
    of_hot = F.broadcast(right.join(named, keys, "left_semi"))
    return left.join(named, keys, "left_semi").join(of_hot, keys, how).unionByName(left.join(named, keys, "left_anti").join(right, keys, how))


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row, also where body uses it inside a lambda."""
    return F.transform(F.array(value), body)[0]


def as_bytes(text: Column) -> Column:
    """UTF-8 bytes; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit("")).cast("binary")


def copy_key(text: Column) -> Column:
    """16 bytes that rows share if and only if their texts are equal; null counts as empty."""
    return F.unhex(F.md5(as_bytes(text)))


def row_key(doc_id: Column, key: Column) -> Column:
    """16 bytes that rows share if and only if doc_id (null included) and copy_key agree."""
    return F.unhex(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("~")), F.lit(":"), F.hex(key)).cast("binary")))


def words_of(data: bytes | None) -> list[bytes]:
    return data.translate(LOWER).split() if data else []


class Hashes(dict):
    """Word -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = Hashes()
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def _odd(i: int) -> np.uint64:
    return _ODD[i % len(_ODD)] + np.uint64(2 * (i // len(_ODD)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x = x * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(32))


def shingles(data: bytes | None, n: int = SHINGLE) -> np.ndarray:
    """Hashes of all windows of n words in order, repeats included."""
    words = words_of(data)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out += h[i : len(h) - k + 1 + i] * _odd(i)
    return _mix(out)


class MinHash:
    """count min-wise values of 32 bits, from multiply-add permutations of shingle hashes."""

    def __init__(self, count: int, seed: int = 20240607):
        rng = np.random.default_rng(seed)
        self.a = (rng.integers(0, 2**31, count, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
        self.b = rng.integers(0, 2**32, count, dtype=np.uint32)[:, None]

    def values(self, hashes: np.ndarray) -> np.ndarray:
        """count x len(hashes)."""
        out = (hashes >> np.uint64(32)).astype(np.uint32)[None, :] * self.a
        out += self.b
        out ^= out >> np.uint32(15)
        out *= np.uint32(0x2C1B3C6D)
        return out

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for i in range(0, len(hashes), 8192):
            np.minimum(out, self.values(hashes[i : i + 8192]).min(axis=1), out=out)
        return out
