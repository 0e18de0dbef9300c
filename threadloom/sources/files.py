"""Files and parses as sources: recursive scans, a fallback source, one parser a format."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.functions.text import file_hash
from threadloom.operators.keeping import keep, large


def scan(spark: SparkSession, folder: str, extension: str = "pdf") -> DataFrame:
    """(path, length, modified, sha256, content) of all files below a folder with the extension, in either case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter(F.lower("path").endswith(f".{extension.lower()}"))
    return files.select("path", "length", F.col("modificationTime").alias("modified"), file_hash(F.col("content")).alias("sha256"), "content")


def with_fallback(documents: DataFrame, primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Line tables of one schema: of each of documents (doc_id) the primary's lines, or the fallback's where the primary has none, and which it was."""
    have = primary.select("doc_id").distinct()
    first = primary.join(documents, "doc_id", "left_semi").withColumn("reader", F.lit("primary"))
    rest = fallback.join(documents, "doc_id", "left_semi").join(have, "doc_id", "left_anti").withColumn("reader", F.lit("fallback"))
    return first.unionByName(rest)


def parse_all(lines: DataFrame, formats: DataFrame, parsers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The messages of documents by the parser of their format (doc_id, format), with the format; formats without a parser give none.

    Lines are computed once and kept with their parser's name: parsers read their input several times, and what made the lines would run anew for each.
    """
    told = formats.filter(F.col("format").isin(*parsers)).select("doc_id", F.col("format").alias("parser")).distinct()
    kept = keep(lines.join(large(told), "doc_id").select(*lines.columns, "parser"))
    out = None
    for name, parse in sorted(parsers.items()):
        own = parse(kept.filter(F.col("parser") == name).drop("parser")).withColumn("format", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def stacked_documents(parts: list[DataFrame], order: str = "page") -> DataFrame:
    """Documents (doc_id, page, ...) one behind the other as one: part, place, and the columns; a part's pages keep their order."""
    out = None
    for k, d in enumerate(parts):
        own = d.withColumn("part", F.lit(k))
        out = own if out is None else out.unionByName(own)
    return out
