"""Links between a printed original and the cleaned document: anchors on both sides, and where links lead.

Pages are (doc_id, page, start, height, text) or, where heights inside a page matter, hits (doc_id, page, y, needle). Text
is searched in pages of the same document only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trim_ws
from threadloom.operators.keeping import keep
from threadloom.operators.runs import of
from threadloom.operators.search import first_holding, holding

# A date's, a body line's and a fragment's least length, and how much of the line is looked for.
LEAST_DATE, LEAST_LINE, NEEDLE, LEAST_FRAGMENT = 8, 25, 60, 6
COLUMN_X, CELL_HEIGHT, STRIP_Y, STRIP_HEIGHT, PAD, CELL_PAD = 70.0, 18.0, 700.0, 14.0, 1.5, 2.0


def first_lines(needles: DataFrame, lines: DataFrame) -> DataFrame:
    """needles (doc_id, idx, needle, low, high) with the first line (doc_id, page, y, text) of pages low to high that has the needle: (doc_id, idx, page, y)."""
    return keep(first_holding(needles, lines, ["doc_id", "idx"], ["page", "y"], "low", "high"))


def message_starts(messages: DataFrame, original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(doc_id, idx, l_page, l_y, r_page, r_y): where a message's date first stands in the original and its numbered heading in the cleaned document, of messages found on both sides.

    A heading that is not found is looked for by its date, from the page of the first heading that is.
    """
    date = trim_ws(F.coalesce("date_raw", F.lit("")))
    far = F.lit(2**31 - 1)
    named = messages.select("doc_id", "idx", F.when(F.length(date) >= LEAST_DATE, date).otherwise("").alias("date"), trim_ws(F.concat(F.col("idx"), F.lit(". "), "from_name")).alias("heading"))
    every = lambda c: named.select("doc_id", "idx", F.col(c).alias("needle"), F.lit(0).alias("low"), far.alias("high"))
    left = first_lines(every("date"), original)
    headed = first_lines(every("heading"), cleaned)
    opening = headed.groupBy("doc_id").agg(F.min_by("page", "idx").alias("low"))
    others = named.join(headed.select("doc_id", "idx"), ["doc_id", "idx"], "left_anti").join(opening, "doc_id", "left").select("doc_id", "idx", F.col("date").alias("needle"), F.coalesce("low", F.lit(0)).alias("low"), far.alias("high"))
    right = headed.unionByName(first_lines(others, cleaned))
    return left.withColumnsRenamed({"page": "l_page", "y": "l_y"}).join(right.withColumnsRenamed({"page": "r_page", "y": "r_y"}), ["doc_id", "idx"])


def anchors(messages: DataFrame, body: DataFrame, original: DataFrame, cleaned: DataFrame) -> DataFrame:
    """(doc_id, idx, kind, left, right): heights of messages on both sides, and of the first body line of 25 characters that both sides have between this message and the next.

    Lines (doc_id, page, y, text) have heights that count through the document; body has (doc_id, idx, pos, plain).
    """
    starts = message_starts(messages, original, cleaned)
    heads = starts.select("doc_id", "idx", F.lit("heading").alias("kind"), F.col("l_y").alias("left"), F.col("r_y").alias("right"))
    w, far = Window.partitionBy("doc_id").orderBy("idx"), F.lit(2**31 - 1)
    spans = starts.withColumns({"l_high": F.greatest(F.col("l_page") + 1, F.coalesce(F.lead("l_page").over(w), far)), "r_high": F.greatest(F.col("r_page") + 1, F.coalesce(F.lead("r_page").over(w), far))})
    p = trim_ws(F.coalesce("plain", F.lit("")))
    spans = keep(spans)
    lines = body.filter(F.length(p) >= LEAST_LINE).select("doc_id", "idx", "pos", F.substring(p, 1, NEEDLE).alias("needle")).join(spans, ["doc_id", "idx"])
    hits = lambda side, low, high: first_lines(lines.select("doc_id", F.struct("idx", "pos").alias("idx"), "needle", F.col(low).alias("low"), F.col(high).alias("high")), side)
    both = hits(original, "l_page", "l_high").select("doc_id", "idx", F.col("y").alias("left")).join(hits(cleaned, "r_page", "r_high").select("doc_id", "idx", F.col("y").alias("right")), ["doc_id", "idx"])
    first = both.groupBy("doc_id", F.col("idx.idx").alias("idx")).agg(F.min(F.struct("idx.pos", "left", "right")).alias("at"))
    return heads.unionByName(first.select("doc_id", "idx", F.lit("line").alias("kind"), "at.left", "at.right"))


def link_boxes(hits: DataFrame, headings: DataFrame) -> DataFrame:
    """(doc_id, page, needle, target, x, y, w, h): boxes that link to a message's page, from hits (doc_id, page, needle, x, y, w, h) and headings (doc_id, idx, page).

    `[n]` links everywhere, `n.` on all pages but the message's own, a bare `n` in the first column of the index's pages (from
    the heading of the index to the page before the first message), and `Index` in the strip on top of later pages to page 0.
    """
    target = headings.select("doc_id", "idx", F.col("page").alias("target"))
    first = headings.filter("idx = 1").select("doc_id", F.col("page").alias("first_page"))
    index = hits.filter("needle = 'Index of Communications'").groupBy("doc_id").agg(F.min("page").alias("index_page"), F.collect_set("page").alias("index_pages"))
    named = hits.withColumns({"idx": F.regexp_extract("needle", r"^\[?([0-9]{1,9})[\].]?$", 1).try_cast("int"), "kind": F.when(F.col("needle").rlike(r"^\[[0-9]+\]$"), "bracketed").when(F.col("needle").rlike(r"^[0-9]+\.$"), "dotted").when(F.col("needle").rlike("^[0-9]+$"), "bare")})
    full = named.join(target, ["doc_id", "idx"]).join(first, "doc_id", "left").join(index, "doc_id", "left")
    in_index = F.col("index_page").isNotNull() & (F.array_contains("index_pages", F.col("page")) | ((F.col("page") >= F.col("index_page")) & (F.col("page") < F.coalesce("first_page", F.lit(2**31 - 1)))))
    keep = (F.col("kind") == "bracketed") | ((F.col("kind") == "dotted") & (F.col("page") != F.col("target"))) | ((F.col("kind") == "bare") & in_index & (F.col("x") <= COLUMN_X) & (F.col("h") <= CELL_HEIGHT))
    pad = F.when(F.col("kind") == "bare", CELL_PAD).otherwise(PAD)
    strip = hits.filter((F.col("needle") == "Index") & (F.col("page") > 0) & (F.col("y") >= STRIP_Y) & (F.col("h") <= STRIP_HEIGHT)).select("doc_id", "page", "needle", F.lit(0).alias("target"), "x", "y", "w", "h", F.lit(CELL_PAD).alias("pad"))
    boxes = full.filter(keep).select("doc_id", "page", "needle", "target", "x", "y", "w", "h", pad.alias("pad")).unionByName(strip)
    return boxes.select("doc_id", "page", "needle", "target", (F.col("x") - F.col("pad")).alias("x"), (F.col("y") - F.col("pad")).alias("y"), (F.col("w") + 2 * F.col("pad")).alias("w"), (F.col("h") + 2 * F.col("pad")).alias("h"))


def underlined_fragments(runs: Column) -> Column:
    """The texts of neighbouring underlined runs put together, trimmed, without empty ones."""
    marked = F.transform(of(runs), lambda r: F.when(F.coalesce(r["underline"], F.lit(False)), F.coalesce(r["text"], F.lit(""))))
    start = F.array().cast("array<string>")

    def add(found: Column, text: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(F.concat(last, text)))
        return F.when(text.isNotNull() & last.isNotNull(), grown).otherwise(F.concat(found, F.array(text)))

    return F.filter(F.transform(F.aggregate(marked, start, add), lambda x: F.regexp_replace(x, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda x: x.isNotNull() & (x != ""))


def halves(fragments: DataFrame) -> DataFrame:
    """fragments (doc_id, idx, text, low, high) and what they come to when cut, again and again, at the space next to their middle: (doc_id, idx, text, low, high, above), above being the texts that were cut. Pieces have six characters at least.

    Only fragments are read, so the rounds, one a halving, are small.
    """
    clean = lambda d: d.withColumn("text", F.regexp_replace("text", r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")).filter(F.length("text") >= LEAST_FRAGMENT)
    level = keep(clean(fragments.select("doc_id", "idx", "text", "low", "high")).withColumn("above", F.array().cast("array<string>")))
    out = level
    while not level.isEmpty():
        spaces = F.filter(F.sequence(F.lit(0), F.length("text") - 1), lambda i: F.substring("text", i + 1, F.lit(1)) == " ")
        middle = F.array_min(F.transform(spaces, lambda i: F.struct(F.abs(i - F.floor(F.length("text") / 2).cast("int")).alias("away"), i.alias("at"))))["at"]
        cut = level.withColumn("at", middle).filter("at is not null")
        parts = F.explode(F.array(F.substring("text", F.lit(1), F.col("at")), F.substring("text", F.col("at") + 2, F.length("text"))))
        level = keep(clean(cut.select("doc_id", "idx", "low", "high", F.concat("above", F.array("text")).alias("above"), parts.alias("text"))).select(*level.columns))
        out = out.unionByName(level)
    return out


def fragment_lines(fragments: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc_id, idx, text, page, y): every line (doc_id, page, y, text) of pages low to high that has a fragment (doc_id, idx, text, low, high).

    What no line has is cut at the space next to its middle and looked for in halves, down to six characters. All pieces are
    looked for at once; those of a piece that was found don't count.
    """
    own = ["doc_id", "idx", "text", "low", "high"]
    pieces = keep(halves(fragments))
    spots = lines.select("doc_id", "page", "y", F.col("text").alias("line"))
    near = holding(pieces.select(*own).distinct(), spots, "text", "line").filter((F.col("page") >= F.col("low")) & (F.col("page") < F.col("high")))
    found = keep(near.select(*own, "page", "y"))
    whole = found.select("doc_id", "idx", F.col("text").alias("over"), "low", "high").distinct()
    under = pieces.withColumn("over", F.explode("above")).join(whole, ["doc_id", "idx", "over", "low", "high"], "left_semi").select(*own, "above").distinct()
    wanted = pieces.join(under, [*own, "above"], "left_anti").select(*own)
    return found.join(wanted, own).select("doc_id", "idx", "text", "page", "y")
