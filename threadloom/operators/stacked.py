"""Stacked formats: a header with a row for each field, older messages quoted below it, each behind a reply preface or a header block.

Everything is window expressions within a document by line number. Documents without a header yield no messages; `headless`
lists them. Null lines count as empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import STAMP, trim_ws
from threadloom.operators.search import first_holding
from threadloom.operators.segment import backfill_to, by_line, is_header, of_block


def row(label: str) -> str:
    """The pattern of a labelled row, its value in group 1."""
    return rf"(?U)^(?:{label})\s+(.+?)\s*$"


def sender(label: str) -> str:
    """The pattern of a row with a name and an address in brackets."""
    return rf"(?U)^{label}\s+(.+?)\s+<([^>]+)>\s*$"


# What the formats call their rows, how they introduce a reply, and how many rows a header may have.
TIME = r"\d{1,2}:\d{2}(?::\d{2})?\s*"
ZONE = r"(?:\s+[A-Z]{2,5})?"
FORWARD = sender("From:")


@dataclass(frozen=True)
class Style:
    top: str
    rows: dict[str, str]
    height: int
    reply: str
    parts: str
    sent: str
    nameless: str | None = None  # a sender's row without an address
    fallback: str | None = None  # the date of a reply preface that `parts` does not fit
    fill_to: bool = False


OUTLOOK = Style(
    top=sender("From"), rows={"date_raw": row("Sent|Date"), "to": row("To"), "cc": row("Cc")}, height=6, reply=r"(?U)^On\s+.+?<.+@.+>\s+wrote:\s*$",
    parts=rf"(?U)^On\s+(.+?{TIME}(?:AM|PM|am|pm)?{ZONE}),?\s+(.+?)\s+<([^>]+)>\s+wrote:\s*$", sent=row("Sent:"), fill_to=True,
)
APPLE = Style(
    top=sender("From:"), rows={"subject": row("Subject:"), "date_raw": row("Date:"), "to": row("To:"), "cc": row("Cc:"), "bcc": row("Bcc:")}, height=8, reply=rf"(?U)^On\s+.+?,?\s+at\s+{TIME}(?:AM|PM)?{ZONE},?\s+.+?<[^>]+>\s+wrote:\s*$",
    parts=rf"(?U)^On\s+(.+?{TIME}(?:AM|PM)?{ZONE}),\s+(.+?)\s+<([^>]+)>\s+wrote:\s*$", sent=row("(?:Sent|Date):"), nameless=row("From:"), fallback=r"(?U)^On\s+(.+?wrote)\b",
)


def some(condition: Column, window) -> Column:
    return F.coalesce(F.max(condition.cast("int")).over(window), F.lit(0)) == 1


def located(lines: DataFrame, style: Style) -> DataFrame:
    """lines with p, the trimmed text, and k, the distance from the header's first row (negative above it, null without one)."""
    p = F.col("p")
    base = lines.withColumn("p", trim_ws(F.coalesce("plain", F.lit("")))).withColumn("n", F.row_number().over(by_line()))
    begins = p.rlike(style.top)
    if style.nameless:
        near = p.rlike(style.rows["subject"]) | p.rlike(style.rows["date_raw"]) | p.rlike(style.rows["to"])
        begins = (begins | p.rlike(style.nameless)) & some(near, by_line().rowsBetween(1, 5))
    first = F.min(F.when(F.col("begins"), F.col("n"))).over(Window.partitionBy("doc_id"))
    return base.withColumn("begins", begins).withColumn("k", F.col("n") - first)


def headed(lines: DataFrame, style: Style) -> DataFrame:
    """located with stop, the k of the first line that is no header row, and start, the k of the first body line."""
    p, k = F.col("p"), F.col("k")
    above = by_line().rowsBetween(Window.unboundedPreceding, -1)
    is_row = p.rlike(style.top)
    for pattern in style.rows.values():
        is_row = is_row | p.rlike(pattern)
    if style.nameless:
        is_row = is_row | (p.rlike(style.nameless) & ~some((k >= 0) & p.rlike(style.nameless), above))
    found = located(lines, style).withColumn("is_row", is_row)
    end = F.min(F.when((k >= 0) & ~F.col("is_row"), F.struct("k", (p == "").alias("blank")))).over(Window.partitionBy("doc_id"))
    ended = found.withColumn("end", end)
    within = F.col("end.k") < style.height
    return ended.withColumns({"stop": F.when(within, F.col("end.k")).otherwise(style.height), "start": F.when(within, F.col("end.k") + F.col("end.blank").cast("int")).otherwise(style.height)}).drop("end", "is_row", "begins")


def last_value(pattern: str, group: int, order: str, within: Column) -> Column:
    """The value of the last row that fits the pattern."""
    p = F.col("p")
    return F.max_by(F.regexp_extract(p, pattern, group), F.when(within & p.rlike(pattern), F.col(order)))


def top_fields(found: DataFrame, style: Style) -> DataFrame:
    """The header's fields, one row a document; the last of equal labels holds."""
    inside = (F.col("k") >= 0) & (F.col("k") < F.col("stop"))
    name, email = last_value(style.top, 1, "k", inside), last_value(style.top, 2, "k", inside)
    if style.nameless:
        name = F.coalesce(name, last_value(style.nameless, 1, "k", inside))
    named = {c: last_value(style.rows[c], 1, "k", inside) if c in style.rows else F.lit(None).cast("string") for c in ("subject", "date_raw", "to", "cc", "bcc")}
    blank = F.lit("")
    return found.filter(inside).groupBy("doc_id").agg(
        F.lit(1).alias("idx"), F.coalesce(name, blank).alias("from_name"), F.coalesce(email, blank).alias("from_email"), F.coalesce(named["date_raw"], blank).alias("date_raw"),
        F.coalesce(named["to"], blank).alias("to"), named["cc"].alias("cc"), named["bcc"].alias("bcc"), named["subject"].alias("subject"),
    )


def split_inline(body: DataFrame, style: Style) -> DataFrame:
    """Body lines with idx (1: before the first boundary), pos in the block, and kind of the block: reply, forward or null."""
    p = F.col("p")
    forward = p.rlike(FORWARD) & some(p.rlike(style.sent) | p.rlike(row("To:")) | p.rlike(row("Subject:")), by_line().rowsBetween(1, 4))
    flagged = body.withColumn("own", F.when(p.rlike(style.reply), "reply").when(forward, "forward"))
    blocks = flagged.withColumn("idx", (1 + F.sum(F.col("own").isNotNull().cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0))).cast("int"))
    return blocks.withColumns({"pos": F.row_number().over(of_block().orderBy("line_no")), "kind": F.first("own").over(of_block().orderBy("line_no"))}).drop("own")


def inline_fields(blocks: DataFrame, style: Style) -> DataFrame:
    """Fields of the messages behind boundaries, a row each; a forward's rows count up to its subject."""
    p, blank, none = F.col("p"), F.lit(""), F.lit(None).cast("string")
    scanned = F.col("subject_pos").isNull() | (F.col("pos") < F.col("subject_pos"))
    fits = p.rlike(style.parts)
    part = lambda g: F.max(F.when((F.col("pos") == 1) & fits, F.regexp_extract(p, style.parts, g)))
    date = part(1)
    if style.fallback:
        date = F.coalesce(date, F.max(F.when(F.col("pos") == 1, F.regexp_extract(p, style.fallback, 1))))
    pick = lambda reply, forward: F.coalesce(F.when(F.first("kind") == "reply", reply).otherwise(forward), blank)
    return blocks.filter("idx > 1").groupBy("doc_id", "idx").agg(
        pick(part(2), last_value(FORWARD, 1, "pos", scanned)).alias("from_name"), pick(part(3), last_value(FORWARD, 2, "pos", scanned)).alias("from_email"),
        pick(date, last_value(style.sent, 1, "pos", scanned)).alias("date_raw"), pick(blank, last_value(row("To:"), 1, "pos", scanned)).alias("to"), none.alias("cc"), none.alias("bcc"),
    )


def messages(lines: DataFrame, style: Style) -> DataFrame:
    """doc_id, idx, from_name, from_email, date_raw, to, cc, bcc, n_body, body."""
    found = headed(lines, style)
    blocks = split_inline(found.filter("k >= start"), style)
    subject_at = F.min(F.when((F.col("kind") == "forward") & F.col("p").rlike(row("Subject:")), F.col("pos"))).over(of_block())
    blocks = blocks.withColumn("subject_pos", subject_at)
    fields = top_fields(found, style).drop("subject").unionByName(inline_fields(blocks, style))
    after = F.when(F.col("kind") == "forward", F.coalesce("subject_pos", F.lit(1))).when(F.col("kind") == "reply", 1).otherwise(0)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("plain", F.lit("")).alias("t")))), lambda x: x["t"]), "\n")
    body = blocks.filter(F.col("pos") > after).groupBy("doc_id", "idx").agg(F.count("*").alias("n_body"), text.alias("body"))
    full = fields.join(body, ["doc_id", "idx"], "left").withColumns({"n_body": F.coalesce("n_body", F.lit(0)), "body": F.coalesce("body", F.lit(""))})
    return backfill_to(full) if style.fill_to else full


def subjects(lines: DataFrame, style: Style, bold: str | None = None) -> DataFrame:
    """(doc_id, subject) of documents with a header: its subject row, else the last bold line above it, else the last line above it, else empty."""
    found = headed(lines, style)
    above = (F.col("k") < 0) & (F.col("p") != "")
    last = lambda c: F.max_by("p", F.when(c, F.col("k")))
    picks = ([last(above & F.col(bold))] if bold else []) + [last(above)]
    per = found.filter("k is not null").groupBy("doc_id").agg(F.coalesce(*picks, F.lit("")).alias("other"))
    return per.join(top_fields(found, style).select("doc_id", "subject"), "doc_id", "left").select("doc_id", F.coalesce("subject", "other").alias("subject"))


def headless(lines: DataFrame, style: Style) -> DataFrame:
    """doc_id of documents without a header."""
    return located(lines, style).groupBy("doc_id").agg(F.max("k").alias("k")).filter("k is null").select("doc_id")


def fold_headers(lines: DataFrame, reach: int = 6) -> DataFrame:
    """lines (doc_id, line_no, plain) with each split one-line header, a sender whose stamp stands up to `reach` lines below, made one line.

    Only blank lines and continuations may stand between; they stay, below the merged line. Of senders that reach the same
    stamp the first takes it; senders of different stamps never overlap, as none looks beyond the next stamp.
    """
    p, w = F.col("p"), by_line()
    go_on = (p == "") | p.rlike("^(?:To:|Cc:|Bcc:|<)") | (p.contains("@") & ~p.rlike("[.:]$"))
    base = lines.withColumns({"p": trim_ws(F.coalesce("plain", F.lit(""))), "n": F.row_number().over(w)})
    coded = base.withColumn("code", F.when(p.rlike(f"^{STAMP}$"), "s").when(go_on, "c").otherwise("x"))
    ahead = F.regexp_extract(F.array_join(F.collect_list("code").over(w.rowsBetween(1, reach)), ""), "^c*s", 0)
    opens = p.rlike(r"(?U)^.+?\s+<[^>]+@[^>]+>") & ~is_header(p) & (F.length("ahead") > 0)
    aimed = coded.withColumns({"ahead": ahead, "next": F.collect_list(F.coalesce("plain", F.lit(""))).over(w.rowsBetween(1, reach))}).withColumn("aim", F.when(opens, F.col("n") + F.length("ahead")))
    before = aimed.withColumn("taken", F.coalesce(F.max("aim").over(w.rowsBetween(-reach, -1)), F.lit(0)))
    merged = F.concat(F.coalesce("plain", F.lit("")), F.lit(" "), F.expr("try_element_at(next, length(ahead))"))
    first = F.col("aim").isNotNull() & (F.col("aim") > F.col("taken"))
    return before.filter("not (code = 's' and taken = n)").select("doc_id", "line_no", F.when(first, merged).otherwise(F.col("plain")).alias("plain"))


def first_pages(headings: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, idx, page): the first page of the document whose text contains the heading; headings found nowhere are absent."""
    return first_holding(headings.withColumnRenamed("heading", "needle"), pages, ["doc_id", "idx"], ["page"])
