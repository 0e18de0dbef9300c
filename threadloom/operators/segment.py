"""From lines to messages: segmentation, header fields, cleaning. Every window runs within a document by line number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import STAMP, trim_ws

HIDDEN = "[Quoted text hidden]"
# Fixed patterns: a reply's introduction, and the first row of a forwarded message.
REPLY = r"(?U)^On\s+\w{3},?\s+.+?<.+@.+>\s+wrote:\s*$"
FORWARD = r"(?U)^From:\s+.+<.+@.+>"


def by_line():
    return Window.partitionBy("doc_id").orderBy("line_no")


def of_block():
    return Window.partitionBy("doc_id", "idx")


def in_block():
    return of_block().orderBy("pos")


def is_header(plain: Column) -> Column:
    """Ends in a full stamp, and starts with a name and an address."""
    return plain.rlike(rf"(?U)\s+{STAMP}\s*$") & F.regexp_replace(plain, rf"(?U)\s+{STAMP}\s*$", "").rlike(r"(?U)^.+?\s+<[^>]+>")


def is_forward(plain: Column, window=None) -> Column:
    """A From row with an address, and a Sent row among itself and the next four lines."""
    return plain.rlike(FORWARD) & (F.max(plain.startswith("Sent:").cast("int")).over((window or by_line()).rowsBetween(0, 4)) == 1)


def segment(lines: DataFrame, header: Column | None = None) -> DataFrame:
    """lines with idx, the ordinal of the block (0: preamble), and pos, the place in it."""
    flag = is_header(F.col("plain")) if header is None else header
    marked = lines.withColumn("idx", F.sum(flag.cast("int")).over(by_line().rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return marked.withColumn("pos", F.row_number().over(of_block().orderBy("line_no")))


def header_fields(blocks: DataFrame) -> DataFrame:
    """Per message: doc_id, idx, from_name, from_email, date_raw, inline_to."""
    p = F.col("plain")
    lead = F.regexp_replace(p, rf"(?U)\s+{STAMP}\s*$", "")
    rest = trim_ws(F.regexp_replace(lead, r"(?U)^.+?\s+<[^>]+>", ""))
    return blocks.filter("idx > 0 and pos = 1").select(
        "doc_id", "idx", trim_ws(F.regexp_extract(p, r"(?U)^(.+?)\s+<", 1)).alias("from_name"), F.regexp_extract(p, "<([^>]+)>", 1).alias("from_email"), F.regexp_extract(p, f"(?U)({STAMP})\\s*$", 1).alias("date_raw"), trim_ws(F.regexp_replace(rest, "^To:", "")).alias("inline_to")
    )


def header_rows(blocks: DataFrame) -> DataFrame:
    """Rows To, Cc and Bcc under a header, with folded continuations: (doc_id, idx, pos, label, value); the first other line ends them."""
    p = F.col("plain")
    label = F.regexp_extract(p, "^(To|Cc|Bcc):", 1)
    folds = p.contains("<") | p.contains("@")
    body = blocks.filter("idx > 0 and pos > 1").withColumn("label", F.when(label != "", label))
    carried = F.last("label", ignorenulls=True).over(in_block().rowsBetween(Window.unboundedPreceding, 0))
    marked = body.withColumn("carried", carried)
    other = ~(F.col("label").isNotNull() | (folds & F.col("carried").isNotNull()))
    ended = marked.withColumn("stop", F.min(F.when(other, F.col("pos"))).over(of_block())).filter("stop is null or pos < stop")
    return ended.select("doc_id", "idx", "pos", F.col("carried").alias("label"), trim_ws(F.regexp_replace(p, "^(To|Cc|Bcc):", "")).alias("value"))


def recipients(blocks: DataFrame) -> DataFrame:
    """(doc_id, idx, to, cc): joined rows; null where there is none."""
    rows = header_rows(blocks)
    joined = lambda k: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == k, F.struct("pos", "value")))), lambda x: x["value"]), " ")
    full = rows.groupBy("doc_id", "idx").agg(joined("To").alias("to"), joined("Cc").alias("cc"))
    return full.select("doc_id", "idx", F.nullif("to", F.lit("")).alias("to"), F.nullif("cc", F.lit("")).alias("cc"))


def bodies(blocks: DataFrame) -> DataFrame:
    """Body lines (doc_id, idx, pos, plain): header rows off, the quoted tail cut, hidden-quote markers dropped, blank ends trimmed, in this order."""
    rows = header_rows(blocks).select("doc_id", "idx", "pos")
    body = blocks.filter("idx > 0 and pos > 1").join(rows, ["doc_id", "idx", "pos"], "left_anti")
    tail = F.col("plain").rlike(REPLY) | is_forward(F.col("plain"), in_block())
    cut = body.withColumn("tail", tail).withColumn("cut", F.min(F.when(F.col("tail"), F.col("pos"))).over(of_block())).filter("cut is null or pos < cut")
    kept = cut.filter(trim_ws(F.col("plain")) != HIDDEN)
    full = F.when(trim_ws(F.col("plain")) != "", F.col("pos"))
    ends = kept.withColumns({"a": F.min(full).over(of_block()), "b": F.max(full).over(of_block())})
    return ends.filter("pos between a and b").select("doc_id", "idx", "pos", "plain")


def messages(lines: DataFrame) -> DataFrame:
    """doc_id, idx, from_name, from_email, date_raw, to, cc, n_body, body."""
    blocks = segment(lines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "plain"))), lambda x: x["plain"]), "\n")
    body = bodies(blocks).groupBy("doc_id", "idx").agg(F.count("*").alias("n_body"), text.alias("body"))
    full = header_fields(blocks).join(recipients(blocks), ["doc_id", "idx"], "left").join(body, ["doc_id", "idx"], "left")
    return full.select("doc_id", "idx", "from_name", "from_email", "date_raw", F.coalesce("to", "inline_to").alias("to"), "cc", F.coalesce("n_body", F.lit(0)).alias("n_body"), F.coalesce("body", F.lit("")).alias("body"))


def backfill_to(found: DataFrame) -> DataFrame:
    """An empty `to` becomes the sender of the message before."""
    order = Window.partitionBy("doc_id").orderBy("idx")
    name, email = F.lag("from_name").over(order), F.lag("from_email").over(order)
    sender = F.when(F.coalesce(email, F.lit("")) == "", F.lit("")).when(name == "", email).otherwise(F.concat(name, F.lit(" <"), email, F.lit(">")))
    return found.withColumn("to", F.when(F.col("to") == "", F.coalesce(sender, F.lit(""))).otherwise(F.col("to")))


def subjects(blocks: DataFrame) -> DataFrame:
    """(doc_id, subject): the longest candidate of the preamble, the first of equal ones."""
    p = trim_ws(F.col("plain"))
    some = blocks.filter("idx = 0").filter((p != "") & ~p.endswith("messages") & ~p.contains("@"))
    best = some.groupBy("doc_id").agg(F.max_by(p, F.struct(F.length(p), -F.col("line_no"))).alias("subject"))
    return blocks.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("subject", F.lit("(No subject)")).alias("subject"))


def expected_count(lines: DataFrame) -> DataFrame:
    """(doc_id, expected): the first line that says how many messages there are, anywhere."""
    n = F.regexp_extract(trim_ws(F.col("plain")), r"^(\d{1,9}) messages$", 1)
    return lines.filter(n != "").groupBy("doc_id").agg(F.min_by(n.cast("int"), "line_no").alias("expected"))
