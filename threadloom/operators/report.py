"""Reports over a corpus: one row a document, two parses compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "—"


def worst_similarity(diffs: DataFrame) -> DataFrame:
    """(doc_id, worst): the least similarity of a document's messages, 1 without any."""
    return diffs.groupBy("doc_id").agg(F.coalesce(F.min("similarity"), F.lit(1.0)).alias("worst"))


def severity_counts(rows: DataFrame) -> DataFrame:
    """(errors, warnings, total), one row."""
    return rows.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"), F.count("*").alias("total"))


def corpus_report(files: DataFrame, left: DataFrame, right: DataFrame, compared: DataFrame) -> DataFrame:
    """(file, format, heur_message_count, ai_message_count, subject_match, worst_body_sim, severity, note) for files (doc_id, file, format), counts (doc_id, messages) of either parse, and (doc_id, subject_mismatch, worst, severity, note).

    A document that a parse lacks is a warning that says so.
    """
    side = lambda d, n: d.select("doc_id", F.col("messages").cast("int").alias(n))
    full = files.join(side(left, "l"), "doc_id", "left").join(side(right, "r"), "doc_id", "left").join(compared, "doc_id", "left")
    missing = F.when(F.col("l").isNull() & F.col("r").isNull(), F.concat(F.lit("both engines unavailable (format="), "format", F.lit(")"))).when(F.col("l").isNull(), F.concat(F.lit("no heuristic for format="), "format")).when(F.col("r").isNull(), "ai unavailable")
    return full.select(
        "file", "format", F.col("l").alias("heur_message_count"), F.col("r").alias("ai_message_count"), F.when(missing.isNotNull(), F.lit(False)).otherwise(~F.col("subject_mismatch")).alias("subject_match"),
        F.when(missing.isNotNull(), 0.0).otherwise(F.coalesce("worst", F.lit(1.0))).alias("worst_body_sim"), F.when(missing.isNotNull(), "warning").otherwise(F.col("severity")).alias("severity"), F.coalesce(missing, "note").alias("note"),
    )


def count_text(count: Column) -> Column:
    return F.coalesce(count.cast("string"), F.lit(NONE))


def markdown_rows(rows: DataFrame) -> DataFrame:
    """(file, value): each row of a report as a row of a Markdown table."""
    fields = ("file", "format", F.concat(count_text(F.col("heur_message_count")), F.lit("/"), count_text(F.col("ai_message_count"))), F.when(F.col("subject_match"), "match").otherwise(NONE), F.format_string("%.2f", "worst_body_sim"), "severity", "note")
    return rows.select("file", F.concat(F.lit("| "), F.concat_ws(" | ", *fields), F.lit(" |")).alias("value"))


def markdown(rows: DataFrame, title: str) -> DataFrame:
    """(part, file, value): a whole report as lines, to be written in the order of part and file."""
    spark = rows.sparkSession
    head = [(0, "", f"# {title}"), (1, "", ""), (2, "", "| File | Format | Msgs (h/ai) | Subject | Worst body sim | Severity | Note |"), (3, "", "|------|--------|-------------|---------|----------------|----------|------|"), (5, "", "")]
    ends = severity_counts(rows).select(F.lit(6).alias("part"), F.lit("").alias("file"), F.format_string("Errors: %d  Warnings: %d  Total: %d", "errors", "warnings", "total").alias("value"))
    return spark.createDataFrame(head, "part int, file string, value string").unionByName(markdown_rows(rows).select(F.lit(4).alias("part"), "file", "value")).unionByName(ends)


def json_rows(rows: DataFrame) -> DataFrame:
    """(file, value): each row as JSON, keys in alphabetical order."""
    return rows.select("file", F.to_json(F.struct(*sorted(rows.columns))).alias("value"))


def single(rows: DataFrame) -> DataFrame:
    """(file, value): each row as a block of labelled lines."""
    lines = [F.concat(F.lit(f"{label:<11}"), value) for label, value in (
        ("File:", F.col("file")), ("Format:", F.col("format")), ("Messages:", F.concat(F.lit("heur="), count_text(F.col("heur_message_count")), F.lit("  ai="), count_text(F.col("ai_message_count")))),
        ("Subject:", F.when(F.col("subject_match"), "match").otherwise("MISMATCH")), ("Body sim:", F.format_string("%.2f", "worst_body_sim")), ("Severity:", F.col("severity")), ("Note:", F.col("note")),
    )]
    return rows.select("file", F.concat_ws("\n", *lines).alias("value"))
