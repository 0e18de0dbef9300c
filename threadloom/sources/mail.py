"""Line tables: the unit that all operators on threads take, (doc_id, line_no, plain)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STAMP_FORMAT = "EEE, MMM d, yyyy 'at' h:mm a"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_lines(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A text column split at line feeds, empty lines kept."""
    parts = F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n", -1)).alias("pos", "plain")
    return df.select(F.col(id_col).alias("doc_id"), parts).select("doc_id", (F.col("pos") + 1).alias("line_no"), "plain")


def mail_lines(conversations: DataFrame) -> DataFrame:
    """Conversations as printed mail threads: preamble, one-line headers, bodies, and what printing adds."""
    c, none = F.col, F.array().cast("array<string>")
    only = lambda cond, *xs: F.when(cond, F.array(*(F.lit(x) for x in xs))).otherwise(none)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + 60 * (97 * c("conv_id") + 13 * c("turn"))), STAMP_FORMAT)
    header = F.concat(F.initcap("role"), F.lit(" "), c("conv_id"), F.lit(" <"), c("role"), F.lit("."), c("conv_id"), F.lit("@example.com>     "), stamp)
    whole = Window.partitionBy("conv_id")
    counted = conversations.withColumns({"n": F.count("*").over(whole), "first": F.min("turn").over(whole)})
    preamble = F.when(c("turn") == c("first"), F.array(F.concat(F.lit("Thread "), c("conv_id"), F.lit(" about printed mail")), F.concat(c("n"), F.lit(" messages")))).otherwise(none)
    lines = F.concat(
        preamble, F.array(header), only(c("turn") % 5 == 2, "To: Team <team@example.com>", "Cc: Lead <lead@example.com>"), F.split(F.coalesce("text", F.lit("")), "\n", -1),
        only(c("turn") % 3 == 1, "[Quoted text hidden]"), only(c("turn") % 4 == 3, "On Mon, Jan 1, 2024 at 1:00 PM Bot <bot@example.com> wrote:", "quoted line"), only(c("conv_id") % 5 == 0, "https://mail.google.com/mail/u/0/?ui=2", "1/3"),
    )
    each = counted.select("conv_id", "turn", F.posexplode(lines).alias("pos", "plain"))
    return each.select(c("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "pos")).alias("line_no"), "plain")


#: The same lines in DuckDB.
MAIL_SQL = """counted AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, min(turn) OVER (PARTITION BY conv_id) AS first FROM conversations),
whole AS (SELECT conv_id, turn, (CASE WHEN turn = first THEN ['Thread ' || conv_id || ' about printed mail', n || ' messages'] ELSE [] END)
 || [upper(role[1]) || lower(role[2:]) || ' ' || conv_id || ' <' || role || '.' || conv_id || '@example.com>     ' || strftime(TIMESTAMP '2024-01-01' + to_minutes((97 * conv_id + 13 * turn)::INT), '%a, %b %-d, %Y at %-I:%M %p')]
 || (CASE WHEN turn % 5 = 2 THEN ['To: Team <team@example.com>', 'Cc: Lead <lead@example.com>'] ELSE [] END) || string_split(coalesce(text, ''), chr(10))
 || (CASE WHEN turn % 3 = 1 THEN ['[Quoted text hidden]'] ELSE [] END) || (CASE WHEN turn % 4 = 3 THEN ['On Mon, Jan 1, 2024 at 1:00 PM Bot <bot@example.com> wrote:', 'quoted line'] ELSE [] END)
 || (CASE WHEN conv_id % 5 = 0 THEN ['https://mail.google.com/mail/u/0/?ui=2', '1/3'] ELSE [] END) AS xs FROM counted),
each AS (SELECT conv_id, turn, unnest(xs) AS plain, generate_subscripts(xs, 1) AS pos FROM whole),
lines AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, pos))::INT AS line_no, plain FROM each)"""


def stacked_lines(conversations: DataFrame, colons: bool) -> DataFrame:
    """Conversations as threads with a stacked header, rows labelled with or without colons; older turns behind reply prefaces (even places) and header blocks (odd ones)."""
    c, k = F.col, F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + 60 * (97 * c("conv_id") + 13 * c("turn"))), STAMP_FORMAT)
    sender = F.concat(F.initcap("role"), F.lit(" "), c("conv_id"), F.lit(" <"), c("role"), F.lit("."), c("conv_id"), F.lit("@example.com>"))
    say = lambda label, value: F.concat(F.lit(label + (": " if colons else " ")), value)
    team, topic = F.lit("Team <team@example.com>"), F.concat(F.lit("Thread "), c("conv_id"))
    top = [F.lit("Printed thread"), F.lit(""), say("From", sender), *([say("Subject", topic)] if colons else []), say("Date", stamp), say("To", team), F.lit("")]
    reply = [F.concat(F.lit("On "), stamp, F.lit(", " if colons else " "), sender, F.lit(" wrote:"))]
    block = [F.concat(F.lit("From: "), sender), F.concat(F.lit("Sent: "), stamp), F.concat(F.lit("To: "), team), F.concat(F.lit("Subject: "), topic)]
    lead = F.when(c("k") == 1, F.array(*top)).when(c("k") % 2 == 0, F.array(*reply)).otherwise(F.array(*block))
    each = conversations.withColumn("k", k).select("conv_id", "k", F.posexplode(F.concat(lead, F.split(F.coalesce("text", F.lit("")), "\n", -1))).alias("pos", "plain"))
    return each.select(c("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("k", "pos")).alias("line_no"), "plain")
