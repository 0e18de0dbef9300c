"""What printing adds: whole lines and inline fragments, per format; and which format a document has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trim_ws

# Fixed patterns of the formats' print artefacts; white space and digits are those of Unicode.
LINES = {
    "gmail": (
        r"^https://mail\.google\.com/.*$",
        r"^\d{1,2}/\d{1,2}/\d{2}, \d{1,2}:\d{2} (AM|PM)\s+Gmail.*",
        r"^Gmail\s*-\s*.+$",
        r"^\d{1,2}/\d{1,2}/\d{2},\s*\d{1,2}:\d{2}\s*(AM|PM)\s*$",
        r"^\d+/\d+$",
        r"^[…]\s*\d+/\d+$",
    ),
    "outlook": (
        r"^\d{1,2}/\d{1,2}/\d{2,4},?\s*\d{1,2}:\d{2}\s*(AM|PM)\s+Mail\s*-\s*.+\s*-\s*Outlook$",
        r"^https?://outlook\.(live|office)\.com/.*",
        r"^Outlook\s*$",
        r"^\d+/\d+\s*$",
    ),
    "apple": (r"^Page\s+\d+\s+of\s+\d+\s*$", r"^\d+\s*/\s*\d+\s*$", r"^[\s–—-]+$"),
}
INLINE = (r"(?U)\d{1,2}/\d{1,2}/\d{2},\s*\d{1,2}:\d{2}\s*(?:AM|PM)\s*", r"(?U)Gmail\s*-\s*[^\n]+?\s\d+\s", r"(?U)[A-Z][\w&;\s\-]+;\s*line\s+\d+\s")
#: What a text with a match of the last pattern, which looks far ahead, has in any case.
SUBJECT_END = r"(?U);\s*line\s+\d+\s"
#: (format, points, pattern, length of the head searched or 0 for all).
SIGNS = (
    ("gmail", 3, r"mail\.google\.com", 0), ("outlook", 3, r"outlook\.(live|office)\.com", 0), ("protonMail", 3, r"mail\.proton\.me", 0), ("yahoo", 3, r"mail\.yahoo\.com", 0),
    ("gmail", 2, r"\bGmail\s*[-–]\s*", 400), ("outlook", 2, r"\bOutlook\b", 400), ("yahoo", 2, r"Yahoo\s+Mail", 400), ("protonMail", 2, r"Proton\s*Mail", 400),
    ("gmail", 1, r"\b\w{3},\s+\w{3}\s+\d{1,2},\s+\d{4}\s+at\s+\d{1,2}:\d{2}\s*(AM|PM)", 0), ("outlook", 1, r"\b\w{3}\s+\d{1,2}/\d{1,2}/\d{4}\s+\d{1,2}:\d{2}\s*(AM|PM)", 0),
    ("appleMail", 1, r"\b\w+\s+\d{1,2},\s+\d{4}\s+at\s+\d{1,2}:\d{2}(:\d{2})?\s*(AM|PM)", 0),
)


def is_chrome(plain: Column, form: str) -> Column:
    hit = F.lit(False)
    for pattern in LINES[form]:
        hit = hit | trim_ws(plain).rlike(f"(?U){pattern}")
    return hit


def dropped(plain: Column, form: str) -> Column:
    """Whether a line is one of the format's whole-line artefacts; blank ones are none."""
    return (trim_ws(plain) != "") & is_chrome(plain, form)


def drop_chrome(lines: DataFrame, form: str = "gmail") -> DataFrame:
    """Without the format's whole-line artefacts; blank lines stay."""
    return lines.filter(~dropped(F.col("plain"), form))


def strip_inline(text: Column) -> Column:
    """Without the fragments, then two spaces as one."""
    for pattern in INLINE[:2]:
        text = F.regexp_replace(text, pattern, "")
    text = F.when(text.rlike(SUBJECT_END), F.regexp_replace(text, INLINE[2], "")).otherwise(text)
    return F.replace(text, F.lit("  "), F.lit(" "))


def detect_format(texts: DataFrame) -> DataFrame:
    """(doc_id, text) to (doc_id, format, score): most points, unknown when none or on a tie. Each sign counts once."""
    points = [F.when((F.substring("text", 1, head) if head else F.col("text")).rlike(f"(?U){pattern}"), n).otherwise(0).alias("p") for _, n, pattern, head in SIGNS]
    forms = sorted({s[0] for s in SIGNS})
    total = {f: sum((p for p, s in zip(points, SIGNS, strict=True) if s[0] == f), F.lit(0)) for f in forms}
    scored = texts.select("doc_id", *(total[f].alias(f) for f in forms)).withColumn("score", F.greatest(*forms))
    ties = sum(((F.col(f) == F.col("score")).cast("int") for f in forms), F.lit(0))
    best = F.coalesce(*(F.when(F.col(f) == F.col("score"), F.lit(f)) for f in forms))
    return scored.select("doc_id", F.when((F.col("score") == 0) | (ties > 1), "unknown").otherwise(best).alias("format"), F.col("score").cast("int").alias("score"))


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """Lines that differ from the line before."""
    before = F.lag("plain").over(Window.partitionBy("doc_id").orderBy("line_no"))
    return lines.filter(~F.col("plain").eqNullSafe(before))
