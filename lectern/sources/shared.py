"""Tables between the steps of a request, in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def workers_see_package(spark: SparkSession) -> None:
    """Python workers import this package by its path; a cluster may ship it with --py-files instead."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session, whose tasks run where the driver does, gets a folder of its own."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="lectern-")
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def hadoop(spark: SparkSession, path: str):
    """(path, file system) of the JVM for any kind of folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def cut(df: DataFrame, name: str) -> DataFrame:
    """df, written once and read back: later steps plan against a table, and lost executors repeat nothing before it.

    The application's tables go when the driver's file system closes.
    """
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/lectern-{spark.sparkContext.applicationId}"
    path = f"{own}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    folder, fs = hadoop(spark, own)
    fs.deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame) -> DataFrame:
    """df over all cores where it is smaller than an input split for each of them.

    A small file often is one row group, and so one task's. What is larger stays where
    it is; the size is that which the plan tells without running.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    split = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * split else df
