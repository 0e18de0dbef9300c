"""Intermediate tables that several later steps read: in the checkpoint folder, or in memory and on disk until released."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_held: list[DataFrame] = []


def keep(df: DataFrame) -> DataFrame:
    """df computed once: in the checkpoint folder and without lineage if there is one; else, in one process only, persisted until `release`."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder and not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    if spark.sparkContext.getCheckpointDir():
        return df.checkpoint()
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    _held.append(df.persist())
    return _held[-1]


def large(df: DataFrame) -> DataFrame:
    """df for a join, by sorting both sides. Spark's estimates miss what exploding adds and take rows derived from a small file for a small table, which would be broadcast through the driver."""
    return df.hint("merge")


def release(spark: SparkSession) -> None:
    """Forget what was persisted in this session; a frame that is still used is computed anew. Frames of stopped sessions are gone already."""
    while _held:
        df = _held.pop()
        if df.sparkSession is spark:
            df.unpersist()
