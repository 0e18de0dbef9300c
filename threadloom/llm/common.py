"""What the operators of this subpackage share: the shared folder, cut points, row keys, typed projections."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, from spark.checkpoint.dir; a temporary one only where that is unset and all executors are in this process (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        context = spark.sparkContext
        current = context._jsc.sc().getCheckpointDir()
        if not current.isDefined():
            if not context.master.startswith("local[") and context.master != "local":
                raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="threadloom-"))
            current = context._jsc.sc().getCheckpointDir()
        found = current.get()
    return found.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/threadloom/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: lineage ends there and no executor's loss undoes it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession, older_hours: float = 48) -> int:
    """Remove the tables below the shared folder that were last written `older_hours` ago or earlier, and so belong to no running job; returns how many.

    A result reads its tables whenever it is evaluated, so only the caller knows when they may go.
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/threadloom")
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(root):
        return 0
    old = [x.getPath() for x in files.listStatus(root) if x.getModificationTime() <= time.time() * 1000 - older_hours * 3_600_000]
    for path in old:
        files.delete(path, True)
    return len(old)


def text_of(column: str) -> Column:
    """A text column as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Columns that tell rows apart even if ids repeat or are null; equal keys mean equal rows."""
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_of(text_col), F.col(id_col)).alias("row_key")]


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["row_key"].eqNullSafe(b["row_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def keep_rows(df: DataFrame, keys: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df's rows whose key is in keys (doc_id, row_key), whatever df's other columns are called."""
    right = keys.select(F.col("doc_id").alias("__keep_doc"), F.col("row_key").alias("__keep_row"))
    doc, row = row_key(id_col, text_col)
    return df.join(right, doc.eqNullSafe(F.col("__keep_doc")) & (row == F.col("__keep_row")), "left_semi")


def keep_marked(df: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """df's rows that marked (doc_id, row_key, keep) keeps, one of rows equal in id and text."""
    kept = cut(marked.filter("keep").groupBy("doc_id", "row_key").agg(F.count("*").alias("n")), "kept")
    once = keep_rows(df, kept, id_col, text_col)
    if kept.filter("n > 1").isEmpty():
        return once
    # rows equal in id and text: the first of each
    single, several = keep_rows(df, kept.filter("n = 1"), id_col, text_col), keep_rows(df, kept.filter("n > 1"), id_col, text_col)
    first = F.row_number().over(Window.partitionBy(*row_key(id_col, text_col)).orderBy(F.lit(0)))
    return single.unionByName(several.withColumn("__place", first).filter("__place = 1").drop("__place"))
