"""The JSON path: payloads of a model, journal rows, style replay by alignment, and messages buried in bodies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trim_ws
from threadloom.operators.segment import backfill_to
from threadloom.operators.stacked import OUTLOOK

SCHEMA = "subject string, messages array<struct<from_name:string,from_email:string,date:string,to:string,cc:string,bcc:string,body:string>>"
#: Cells of the alignment table beyond which the greedy way is taken, and how far that looks ahead.
CELLS, AHEAD = 4_000_000, 64


def extract_json(raw: Column) -> Column:
    """From the first brace to the last."""
    return F.regexp_extract(raw, r"(?s)(\{.*\})", 1)


def decode(df: DataFrame, raw: str = "raw") -> DataFrame:
    """df with payload and error: null, "no JSON object found", or "decode: ..." when a required field is missing."""
    text = extract_json(F.col(raw))
    parsed = df.withColumn("payload", F.when(text != "", F.from_json(text, SCHEMA)))
    incomplete = F.exists("payload.messages", lambda m: m["from_name"].isNull() | m["from_email"].isNull() | m["date"].isNull() | m["to"].isNull() | m["body"].isNull())
    error = F.when(text == "", "no JSON object found").when(F.col("payload.subject").isNull(), "decode: subject").when(F.col("payload.messages").isNull(), "decode: messages").when(incomplete, "decode: message field")
    return parsed.withColumn("error", error).withColumn("payload", F.when(F.col("error").isNull(), F.col("payload")))


def reconcile(parts: DataFrame) -> DataFrame:
    """(doc_id, chunk, payload) to (doc_id, subject, messages): all chunks' messages in order, the first chunk's subject."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk", F.col("payload.messages").alias("m"))))
    return parts.groupBy("doc_id").agg(F.min_by("payload.subject", "chunk").alias("subject"), F.flatten(F.transform(ordered, lambda x: x["m"])).alias("messages"))


def journal(rows: DataFrame, raw: str = "raw", at: Column | None = None) -> DataFrame:
    """One JSON line per row of (doc_id, format, severity, diff, raw): time, hash of the source, format, severity, diff and the source's first 1024 characters. `diff` may be any column; without one it is left out."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    diff = [F.col("diff")] if "diff" in rows.columns else []
    entry = F.to_json(F.struct("doc_id", stamp.alias("ts"), F.sha2(raw, 256).alias("source_sha256"), "format", "severity", *diff, F.substring(raw, 1, 1024).alias("raw_text_excerpt_first_1k")))
    return rows.select(entry.alias("value"))


def append_journal(entries: DataFrame, folder: str) -> None:
    entries.write.mode("append").text(folder)


def clear_journal(spark: SparkSession, folder: str) -> None:
    """An empty journal."""
    spark.createDataFrame([], "value string").write.mode("overwrite").text(folder)


def answer_log(answers: DataFrame, at: Column | None = None) -> DataFrame:
    """One JSON line per answer (attempt, raw, response), keys in alphabetical order: lengths, the first 500 characters of the input and 8000 of the output."""
    stamp = F.date_format(F.current_timestamp() if at is None else at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.struct("attempt", F.length("raw").alias("input_chars"), F.substring("raw", 1, 500).alias("input_excerpt"), F.substring("response", 1, 8000).alias("output"), F.length("response").alias("output_chars"), stamp.alias("ts"))
    return answers.select(F.to_json(entry).alias("value"))


def align(body: str, source: str) -> list[int]:
    """For each character of body the place in source that it comes from, or -1: a longest common subsequence, or greedily beyond CELLS.

    Of equally long ones it is that which, from the ends on, takes equal characters at once and else passes over the body's
    first. A row of lengths is one whole number with a bit for each character of the source, unset where the length grows, so
    a row follows from the one before by an addition, and a length is a count of bits.
    """
    n, m = len(body), len(source)
    if body == source:
        return list(range(n))
    if n * m > CELLS:
        out, at = [], 0
        for ch in body:
            hit = source.find(ch, at, at + AHEAD)
            out.append(hit)
            at = hit + 1 if hit >= 0 else at
        return out
    places: dict[str, int] = {}
    for j, ch in enumerate(source):
        places[ch] = places.get(ch, 0) | 1 << j
    full = (1 << m) - 1
    row = full
    rows = [row]
    for ch in body:
        equal = row & places.get(ch, 0)
        row = (row + equal | row - equal) & full
        rows.append(row)
    length = lambda i, j: j - (rows[i] & (1 << j) - 1).bit_count()
    out, i, j = [-1] * n, n, m
    while i > 0 and j > 0:
        if body[i - 1] == source[j - 1]:
            out[i - 1] = j - 1
            i, j = i - 1, j - 1
        elif length(i - 1, j) >= length(i, j - 1):
            i -= 1
        else:
            j -= 1
    return out


def style_replay(df: DataFrame, body: str, source: str) -> DataFrame:
    """df with aligned: the share of the body's characters that the source has in order."""

    @F.pandas_udf("double")
    def share(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sum(k >= 0 for k in align(p, q)) / len(p) if p else 1.0 for p, q in zip(x, y, strict=True)], dtype=float)

    return df.withColumn("aligned", share(F.coalesce(body, F.lit("")), F.coalesce(source, F.lit(""))))


# The rows of a forwarded block, and how many rows below its sender are looked at, for its fields and to accept it.
SENT, TO, SUBJECT, SENDER = r"(?U)^Sent:\s*(.+)$", r"(?U)^To:\s*(.+)$", r"(?U)^Subject:\s*(.+)$", r"(?U)^From:\s*(.+?)\s*<([^>]+)>\s*$"
FIELD_ROWS, SIGN_ROWS = 5, 4


def split_embedded(messages: DataFrame) -> DataFrame:
    """(doc_id, idx, from_name, from_email, date_raw, to, cc, bcc, body) with messages buried in bodies as messages of their own.

    A boundary is a reply preface, or a sender's row with a sent, to or subject row among the next four. Such a block goes on
    to its subject row at most; its inner rows are never boundaries, so all lines are judged alike, in windows. What stands
    above the first boundary stays with the message, even if that is nothing. idx counts from 1 again, and an empty `to`
    becomes the sender before. Null bodies and fields other than cc and bcc count as empty; no messages give none.
    """
    p, blank, none = F.col("p"), F.lit(""), F.lit(None).cast("string")
    mine, w = Window.partitionBy("doc_id", "idx"), Window.partitionBy("doc_id", "idx").orderBy("pos")
    fields = [F.coalesce(c, blank).alias(c) for c in ("from_name", "from_email", "date_raw", "to")]
    lines = messages.select("doc_id", "idx", *fields, "cc", "bcc", F.posexplode(F.split(F.coalesce("body", blank), "\n", -1)).alias("pos", "plain")).withColumn("p", trim_ws(F.col("plain")))
    code = F.when(p.rlike(SENT), "s").when(p.rlike(TO), "t").when(p.rlike(SUBJECT), "j").when(p == "", "b").otherwise("x")
    near = w.rowsBetween(1, FIELD_ROWS)
    seen = lines.withColumn("code", code).withColumns({"codes": F.array_join(F.collect_list("code").over(near), ""), "below": F.collect_list("p").over(near)})
    reply = p.rlike(OUTLOOK.parts)
    forward = ~reply & p.rlike(SENDER) & F.substring("codes", 1, SIGN_ROWS).rlike("[stj]")
    block = F.regexp_replace(F.regexp_extract("codes", "^[stb]*j?", 0), "b+$", "")
    last = lambda kind, pattern: F.coalesce(trim_ws(F.regexp_extract(F.expr(f"try_element_at(below, nullif(length(rows) - locate('{kind}', reverse(rows)) + 1, length(rows) + 1))"), pattern, 1)), blank)
    told = seen.withColumns({"own": F.when(reply, "reply").when(forward, "forward"), "rows": block}).withColumn(
        "head",
        F.when(F.col("own") == "reply", F.struct(F.regexp_extract(p, OUTLOOK.parts, 2).alias("from_name"), F.regexp_extract(p, OUTLOOK.parts, 3).alias("from_email"), F.regexp_extract(p, OUTLOOK.parts, 1).alias("date_raw"), blank.alias("to"), none.alias("cc"), none.alias("bcc"), F.lit(1).alias("height")))
        .when(F.col("own") == "forward", F.struct(trim_ws(F.regexp_extract(p, SENDER, 1)).alias("from_name"), trim_ws(F.regexp_extract(p, SENDER, 2)).alias("from_email"), last("s", SENT).alias("date_raw"), last("t", TO).alias("to"), none.alias("cc"), none.alias("bcc"), (F.length("rows") + 1).alias("height"))),
    )
    # place 0 is the message itself; it is there even if its first line is a boundary
    parts = told.select("doc_id", "idx", "pos", "plain", "head", F.sum(F.col("own").isNotNull().cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("part"), F.struct("from_name", "from_email", "date_raw", "to", "cc", "bcc").alias("whole"))
    spots = F.when((F.row_number().over(w) == 1) & (F.col("part") == 1), F.array(F.struct(F.lit(0).alias("part"), F.lit(False).alias("real")), F.struct(F.lit(1).alias("part"), F.lit(True).alias("real")))).otherwise(F.array(F.struct(F.col("part").cast("int").alias("part"), F.lit(True).alias("real"))))
    each = parts.withColumn("spot", spots).select("doc_id", "idx", "pos", "plain", "head", "whole", F.explode("spot").alias("spot")).select("*", F.col("spot.part").alias("part"), F.col("spot.real").alias("real"))
    grouped = each.withColumn("first", F.min("pos").over(Window.partitionBy("doc_id", "idx", "part"))).withColumn("height", F.max(F.when(F.col("part") > 0, F.col("head.height"))).over(Window.partitionBy("doc_id", "idx", "part")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("real") & (F.col("pos") >= F.col("first") + F.coalesce("height", F.lit(0))), F.struct("pos", "plain")))), lambda x: x["plain"]), "\n")
    merged = grouped.groupBy("doc_id", "idx", "part").agg(F.first("head", True).alias("head"), F.first("whole").alias("whole"), body.alias("body"))
    meta = lambda c: F.when(F.col("part") == 0, F.col(f"whole.{c}")).otherwise(F.col(f"head.{c}")).alias(c)
    order = Window.partitionBy("doc_id").orderBy("idx", "part")
    out = merged.select("doc_id", F.row_number().over(order).alias("place"), *(meta(c) for c in ("from_name", "from_email", "date_raw", "to", "cc", "bcc")), "body").withColumnRenamed("place", "idx")
    kept = out.withColumns({"said": F.col("to"), "name": F.col("from_name"), "email": F.col("from_email"), "to": trim_ws(F.col("to")), "from_name": trim_ws(F.col("from_name")), "from_email": trim_ws(F.col("from_email"))})
    filled = backfill_to(kept).withColumn("to", F.when((trim_ws(F.col("said")) == "") & (F.col("to") != ""), F.col("to")).otherwise(F.col("said")))
    return filled.select("doc_id", "idx", F.col("name").alias("from_name"), F.col("email").alias("from_email"), "date_raw", "to", "cc", "bcc", "body")
