"""From positioned glyphs, text chunks and drawn paths to styled lines.

Tables: glyphs (doc_id, page, pos, code, weight, italic, font, size, x, y, height), chunks (doc_id, page, x, y, text), paths
(doc_id, page, x0, y0, x1, y1, points, filled), where y grows upward. Windows run within a page; marks meet lines in bands of
heights, so a crowded page is not paired with itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trim_ws
from threadloom.operators.geometry import upper_median
from threadloom.operators.keeping import keep, large
from threadloom.operators.runs import run

PAGE = ["doc_id", "page"]
# Fixed values, in points and shares.
Y_TOLERANCE, BULLET_REACH, LEAST_BAND, BAND, GAP, HEIGHT_GAP = 3.0, 40.0, 4.0, 0.6, 1.55, 1.0
BODY_SIZE, DEFAULT_SIZE, DEFAULT_GAP, DEFAULT_HEIGHT, BOLD = 12.0, 14.0, 14.0, 12.0, 600


def base_font(font: Column) -> Column:
    """A font's name without the tag of a subset."""
    return F.regexp_replace(font, "^[A-Z]{6}\\+", "")


def with_base_fonts(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """rows (doc_id, font) with base: what (doc_id, alias, base) says of the font, else its own name."""
    known = aliases.select("doc_id", F.col("alias").alias("font"), base_font(F.col("base")).alias("base")).dropDuplicates(["doc_id", "font"])
    return rows.join(known, ["doc_id", "font"], "left").withColumn("base", F.coalesce("base", base_font(F.col("font"))))


def font_style(font: Column, weight: Column, italic: Column) -> tuple[Column, Column]:
    """(bold, italic): by the name if it tells either, else by weight and flag."""
    low = F.lower(F.coalesce(font, F.lit("")))
    bold, slanted = low.rlike("bold|heavy|black|demi"), low.rlike("italic|oblique")
    told = bold | slanted
    return F.when(told, bold).otherwise(F.coalesce(weight >= BOLD, F.lit(False))), F.when(told, slanted).otherwise(F.coalesce(italic, F.lit(False)))


def moved(matrix: Column, x: Column, y: Column) -> tuple[Column, Column]:
    """A point under an affine matrix (a, b, c, d, e, f)."""
    m = lambda k: F.element_at(matrix, k)
    return m(1) * x + m(3) * y + m(5), m(2) * x + m(4) * y + m(6)


def shapes(paths: DataFrame) -> DataFrame:
    """(doc_id, page, kind, x, y, x0, x1, radius): small filled dots are bullets, thin horizontal strokes or bands underlines; other paths are neither."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    dot = F.col("filled") & (w > 0.5) & (w < 14) & (h > 0.5) & (h < 14) & (F.greatest(w, h) / F.greatest(F.lit(0.001), F.least(w, h)) < 1.7)
    rule = (h < 1.5) & (w > 4) & (F.col("filled") | (F.col("points") == 2))
    kind = F.when(dot, "bullet").when(rule, "underline")
    return paths.withColumn("kind", kind).filter("kind is not null").select(*PAGE, "kind", ((F.col("x0") + F.col("x1")) / 2).alias("x"), ((F.col("y0") + F.col("y1")) / 2).alias("y"), "x0", "x1", F.when(F.col("kind") == "bullet", F.greatest(w, h) / 2).alias("radius"))


def glyph_lines(glyphs: DataFrame) -> DataFrame:
    """Glyphs with line, from 1 in each page: line ends close a line, other controls but tabs go, empty lines have no number."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    closed = glyphs.withColumn("rough", F.sum(F.col("code").isin(10, 13).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    kept = closed.filter((F.col("code") == 9) | (F.col("code") >= 32))
    return kept.withColumn("line", F.dense_rank().over(Window.partitionBy(*PAGE).orderBy("rough"))).drop("rough")


def underlined(glyphs: DataFrame, underlines: DataFrame) -> DataFrame:
    """Glyphs of numbered lines with `under`: whether an underline of their page lies at or below their line's baseline, by 1.2 heights at most, and spans their x, a point's breadth aside."""
    first = F.first(F.struct("y", "height")).over(Window.partitionBy(*PAGE, "line").orderBy("pos"))
    at = keep(glyphs.withColumn("base", first))
    u = underlines.select(*PAGE, F.col("x0").alias("u0"), F.col("x1").alias("u1"), F.col("y").alias("uy"))
    # lines meet the marks of their heights first, glyphs only those of their line
    lines = at.select(*PAGE, "line", F.col("base.y").alias("high"), (F.col("base.y") - 1.2 * F.col("base.height")).alias("low")).distinct()
    marks = by_height(lines, "low", "high").join(large(u.withColumn("_band", F.floor(F.col("uy") / HEIGHT_BAND))), [*PAGE, "_band"]).filter((F.col("uy") >= F.col("low")) & (F.col("uy") <= F.col("high"))).select(*PAGE, "line", "u0", "u1")
    near = (F.col("x") >= F.col("u0") - 1) & (F.col("x") <= F.col("u1") + 1)
    hit = at.select(*PAGE, "line", "pos", "x").join(large(marks), [*PAGE, "line"]).filter(near).select(*PAGE, "pos").distinct().withColumn("under", F.lit(True))
    return at.drop("base").join(large(hit), [*PAGE, "pos"], "left").withColumn("under", F.coalesce("under", F.lit(False)))


#: Ranges of heights meet in bands of this height.
HEIGHT_BAND = 16.0


def by_height(rows: DataFrame, low: str, high: str) -> DataFrame:
    """rows once for each band of heights that they reach into."""
    return rows.filter(F.col(low) <= F.col(high)).withColumn("_band", F.explode(F.sequence(F.floor(F.col(low) / HEIGHT_BAND), F.floor(F.col(high) / HEIGHT_BAND))))


def styled_lines(glyphs: DataFrame) -> DataFrame:
    """(doc_id, page, line, plain, runs, x, y, height) of numbered glyphs: neighbours of one style, font and size are a run. Reads `under` where it is there."""
    bold, italic = font_style(F.col("font"), F.col("weight"), F.col("italic"))
    under = F.col("under") if "under" in glyphs.columns else F.lit(False)
    w = Window.partitionBy(*PAGE, "line").orderBy("pos")
    marked = glyphs.withColumns({"_s": F.struct(bold.alias("bold"), italic.alias("italic"), under.alias("under"), "font", "size")})
    fresh = F.when(F.lag("_s").over(w).eqNullSafe(F.col("_s")), 0).otherwise(1)
    part = marked.withColumn("_f", fresh).withColumn("_r", F.sum("_f").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    in_order = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", c.alias("c")))), lambda x: x["c"]), "")
    runs = part.groupBy(*PAGE, "line", "_r").agg(in_order(F.chr(F.col("code"))).alias("text"), F.first("_s").alias("s"), F.min_by(F.struct("x", "y", "height"), "pos").alias("at"))
    whole = runs.groupBy(*PAGE, "line").agg(F.array_sort(F.collect_list(F.struct("_r", "text", "s"))).alias("rs"), F.min_by("at", "_r").alias("at"))
    made = F.transform("rs", lambda r: run(r["text"], bold=r["s"]["bold"], italic=r["s"]["italic"], underline=r["s"]["under"], font_size=r["s"]["size"]))
    return whole.select(*PAGE, "line", F.array_join(F.transform("rs", lambda r: r["text"]), "").alias("plain"), made.alias("runs"), F.col("at.x").alias("x"), F.col("at.y").alias("y"), F.col("at.height").alias("height"))


def with_bullets(lines: DataFrame, bullets: DataFrame) -> DataFrame:
    """lines with is_bullet: whether a dot of the page stands at their height, left of them, within reach."""
    b = bullets.select(*PAGE, F.col("x").alias("bx"), F.col("y").alias("by"), F.floor(F.col("y") / HEIGHT_BAND).alias("_band"))
    reach = F.greatest(F.col("height") * BAND, F.lit(LEAST_BAND))
    near = (F.abs(F.col("by") - F.col("y")) <= reach) & (F.col("bx") < F.col("x")) & (F.col("x") - F.col("bx") < BULLET_REACH)
    spots = lines.select(*PAGE, "line", "x", "y", "height", (F.col("y") - reach).alias("_low"), (F.col("y") + reach).alias("_high"))
    hit = by_height(spots, "_low", "_high").join(large(b), [*PAGE, "_band"]).filter(near).select(*PAGE, "line").distinct().withColumn("is_bullet", F.lit(True))
    return lines.join(large(hit), [*PAGE, "line"], "left").withColumn("is_bullet", F.coalesce("is_bullet", F.lit(False)))


def chunk_lines(chunks: DataFrame) -> DataFrame:
    """(doc_id, page, line, text, x, y): chunks from the top down are one line while each lies within the tolerance of the one before; its text runs by x, its y is the mean."""
    down = Window.partitionBy(*PAGE).orderBy(F.desc("y"), "x", "text")
    fresh = F.coalesce((F.lag("y").over(down) - F.col("y") > Y_TOLERANCE).cast("int"), F.lit(1))
    placed = chunks.withColumn("_f", fresh).withColumn("line", F.sum("_f").over(down.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "text"))), lambda c: c["text"]), "")
    return placed.groupBy(*PAGE, "line").agg(text.alias("text"), F.min("x").alias("x"), F.avg("y").alias("y"))


def with_indents(lines: DataFrame, scanned: DataFrame) -> DataFrame:
    """lines with x of the scanned line (see chunk_lines) nearest in height on their page, if that is within their height, else their own; of equally near ones the upper."""
    spot = F.struct(F.col("y").alias("y"), F.col("x").alias("x"))
    marks = scanned.groupBy(*PAGE, "y").agg(F.min("x").alias("x")).select(*PAGE, "y", F.lit(0).alias("asked"), F.lit(None).cast(lines.schema["line"].dataType).alias("line"), spot.alias("spot"))
    both = marks.unionByName(lines.select(*PAGE, "y", F.lit(1).alias("asked"), "line", F.lit(None).cast(marks.schema["spot"].dataType).alias("spot")))
    side = lambda order: F.last("spot", True).over(Window.partitionBy(*PAGE).orderBy(order, "asked").rowsBetween(Window.unboundedPreceding, 0))
    beside = both.withColumns({"_under": side(F.asc("y")), "_over": side(F.desc("y"))}).filter("asked = 1")
    away = lambda c: F.abs(F.col(f"{c}.y") - F.col("y"))
    upper = F.col("_under").isNull() | (F.col("_over").isNotNull() & (away("_over") <= away("_under")))
    best = beside.select(*PAGE, "line", F.when(upper, F.struct(away("_over").alias("d"), F.col("_over.x").alias("x"))).otherwise(F.struct(away("_under").alias("d"), F.col("_under.x").alias("x"))).alias("best"))
    return lines.join(large(best), [*PAGE, "line"], "left").withColumn("x", F.when(F.col("best.d") <= F.greatest("height", F.lit(6.0)), F.col("best.x")).otherwise(F.col("x"))).drop("best")


def headerish(plain: Column) -> Column:
    t = trim_ws(F.coalesce(plain, F.lit("")))
    return t.rlike("^(?:To:|Cc:|Bcc:|<)") | (t.contains("@") & t.contains("<"))


def gap_blanks(lines: DataFrame, by: str = "baselines") -> DataFrame:
    """lines (doc_id, page, line, plain, y, height) with blank ones where a page leaves room, numbered anew.

    By baselines, room is more than 1.55 times the page's upper median gap (of gaps over a point) and the next line does not
    start in lower case; by heights, more than one median height between a line's bottom and the next one's top. Beside
    lines of a header there is never room.
    """
    w = Window.partitionBy(*PAGE).orderBy("line")
    gaps = lines.withColumns({"up": F.lag("y").over(w), "up_height": F.lag("height").over(w), "up_plain": F.lag("plain").over(w)})
    if by == "baselines":
        gaps = gaps.withColumn("gap", F.col("up") - F.col("y"))
        median = upper_median(gaps.filter("gap > 1"), PAGE, "gap", "median")
        room = (F.col("gap") > F.coalesce("median", F.lit(DEFAULT_GAP)) * GAP) & ~F.col("plain").rlike("^\\p{Ll}")
    else:
        gaps = gaps.withColumn("gap", F.col("up") - F.col("up_height") / 2 - F.col("y") - F.col("height") / 2)
        median = upper_median(gaps, PAGE, "height", "median")
        room = F.col("gap") > F.coalesce("median", F.lit(DEFAULT_HEIGHT)) * HEIGHT_GAP
    full = gaps.join(large(median), PAGE, "left").withColumn("blank", F.coalesce(room & ~headerish(F.col("up_plain")) & ~headerish(F.col("plain")), F.lit(False)))
    both = F.when(F.col("blank"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(False)))
    each = full.select(*PAGE, "line", F.posexplode(both).alias("_k", "_blank"), "plain", "y")
    number = F.row_number().over(Window.partitionBy(*PAGE).orderBy("line", "_k"))
    return each.select(*PAGE, number.alias("line"), F.when(F.col("_blank"), "").otherwise(F.col("plain")).alias("plain"), F.when(~F.col("_blank"), F.col("y")).alias("y"))


def size_scale(glyphs: DataFrame) -> DataFrame:
    """(doc_id, size, scale): the document's most frequent rounded size, the least of equally frequent ones, and what makes it the body size."""
    counted = glyphs.filter("code > 32").groupBy("doc_id", F.round("size").alias("_v")).agg(F.count("*").alias("_n"))
    best = counted.groupBy("doc_id").agg(F.max_by("_v", F.struct("_n", -F.col("_v"))).alias("size"))
    return glyphs.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.coalesce("size", F.lit(DEFAULT_SIZE)).alias("size"), (F.lit(BODY_SIZE) / F.coalesce("size", F.lit(DEFAULT_SIZE))).alias("scale"))


def document_lines(pages: DataFrame) -> DataFrame:
    """Page lines as a document's line table (doc_id, line_no, plain, indent and the other columns): pages in order; an indent counts from the leftmost line with text."""
    rest = [c for c in pages.columns if c not in ("doc_id", "page", "line", "plain", "x")]
    left = F.min(F.when(trim_ws(F.col("plain")) != "", F.col("x"))).over(Window.partitionBy("doc_id"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "line"))
    return pages.select("doc_id", number.alias("line_no"), "plain", F.greatest(F.lit(0.0), F.coalesce(F.col("x") - left, F.lit(0.0))).alias("indent"), *rest)


