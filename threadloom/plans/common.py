"""Tables and SQL that several modules of queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.sources.mail import MAIL_SQL, mail_lines, read, text_lines

LINES_SQL = "WITH RECURSIVE x AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents), lines AS (SELECT doc_id, unnest(xs) AS plain, generate_subscripts(xs, 1)::INT AS line_no FROM x)"
#: Trimmed as the library trims: space separators and tabs.
TRIM = "regexp_replace({}, '^[\\p{{Zs}}\\t]+|[\\p{{Zs}}\\t]+$', '', 'g')"


def mail(s: SparkSession, d: str) -> DataFrame:
    return mail_lines(read(s, d, "conversations"))


def doc_lines(s: SparkSession, d: str) -> DataFrame:
    return text_lines(read(s, d, "documents"), "doc_id", "text")


def in_order(order: str, value: str) -> Column:
    """An aggregate: values joined by line feeds in the order of another column."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), "\n")


#: Line items with places that do not repeat within an order.
NUMBERED = "(SELECT l_orderkey, l_partkey, l_quantity, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice))::INT AS l_linenumber FROM lineitem)"


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """df dealt by a key to tasks of about so many rows, so that a task's memory does not grow with the table, and at least one for each core."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows)), key)


def numbered(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return dealt(read(s, d, "lineitem"), "l_orderkey", 200_000).withColumn("l_linenumber", F.row_number().over(w))


def nation_grid(s: SparkSession, d: str) -> DataFrame:
    """The nations of a region in rows of two, cells of equal first letters alike."""
    k = F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")) - 1
    cells = read(s, d, "nation").select(F.col("n_regionkey").alias("table_id"), k.alias("k"), F.substring("n_name", 1, 1).alias("cell_id"))
    return cells.select("table_id", F.expr("int(k div 2)").alias("row"), (F.col("k") % 2).alias("col"), "cell_id")


__all__ = ["LINES_SQL", "MAIL_SQL", "NUMBERED", "TRIM", "dealt", "doc_lines", "in_order", "mail", "nation_grid", "numbered", "read"]
