"""Positions on pages: clusters, gaps, band joins, interpolation, boxes. Keys are documents, pages or whatever groups rows.

Medians and bands are counted by value and by range, so that a key with very many rows is never gathered in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.keeping import keep


def upper_median(rows: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """(keys, out): of each key's values the upper of the two middle ones; nulls do not count."""
    counted = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy(*keys))
    return counted.withColumn("_c", upto).withColumn("_t", total).filter("_c > _t div 2").groupBy(*keys).agg(F.min("_v").alias(out))


def dominant(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, mode): the most frequent rounded value, the smallest of equal ones."""
    counted = df.groupBy(*keys, F.round(value).alias("v")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(F.max_by("v", F.struct("n", -F.col("v"))).alias("mode"))


def cluster(df: DataFrame, keys: list[str], value: str, gap: float, tie: str) -> DataFrame:
    """df with cluster: neighbours in the order of value stay together while the gap is at most `gap`."""
    w = Window.partitionBy(*keys).orderBy(value, tie)
    fresh = F.coalesce((F.col(value) - F.lag(value).over(w) > gap).cast("int"), F.lit(1))
    return df.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("fresh")


def islands(df: DataFrame, keys: list[str], order: list[str], same: str) -> DataFrame:
    """df with island: runs of equal values of `same` along the order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    fresh = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("fresh")


def band_semi(lines: DataFrame, marks: DataFrame, key: str, value: str, band: float, own: str) -> DataFrame:
    """Lines with a mark of the same key, another one than themselves by `own`, whose value is at most `band` away; null values have none.

    Marks are counted by ranges of that width, so pairs never arise: a mark in the line's own range is near enough, and of
    the two ranges beside it the nearest value decides. A mark of the line's own id has the line's own value.
    """
    at = lambda c: F.floor(c / band).cast("long")
    some = marks.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).alias("_v"), F.col(own).alias("_o"))
    ranges = some.groupBy("_k", at(F.col("_v")).alias("_b")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    beside = F.explode(F.array(*(F.struct((F.col("_b") - k).alias("_r"), F.lit(k).alias("_side")) for k in (-1, 0, 1)))).alias("_e")
    near = ranges.select("_k", "_n", "_lo", "_hi", beside).groupBy("_k", F.col("_e._r").alias("_r")).agg(
        F.max(F.when(F.col("_e._side") == 0, F.col("_n"))).alias("_n"), F.max(F.when(F.col("_e._side") == -1, F.col("_hi"))).alias("_below"), F.max(F.when(F.col("_e._side") == 1, F.col("_lo"))).alias("_above")
    )
    ids = some.groupBy("_k", F.col("_o").alias("_i")).agg(F.count("*").alias("_mine"))
    full = lines.join(near, (lines[key] == near["_k"]) & (at(lines[value]) == near["_r"]), "left").drop("_k").join(ids, (lines[key] == ids["_k"]) & (lines[own] == ids["_i"]), "left")
    hit = (F.coalesce("_n", F.lit(0)) > F.coalesce("_mine", F.lit(0))) | (lines[value] - F.col("_below") <= band) | (F.col("_above") - lines[value] <= band)
    return full.filter(hit).select(*(lines[c] for c in lines.columns))


def interpolate(points: DataFrame, anchors: DataFrame, key: str) -> DataFrame:
    """points (key, x) with y between the anchors (key, x, y) around x; keys without anchors give nothing.

    Beyond an end the slope of the last segment goes on, ahead of the first anchor down to 0 at most; a single anchor's y
    holds everywhere; a segment counts as one wide at least. Every anchor carries its neighbours, so one window serves.
    """
    order = Window.partitionBy(key).orderBy("x", "y")
    spot = F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    known = anchors.select(key, "x", "y", F.struct(spot.alias("at"), F.lag(spot).over(order).alias("before"), F.lead(spot).over(order).alias("after")).alias("own"), F.lit(0).alias("asked")).drop("y")
    both = points.select(key, "x", F.lit(None).cast(known.schema["own"].dataType).alias("own"), F.lit(1).alias("asked")).unionByName(known)
    w = Window.partitionBy(key).orderBy("x", "asked")
    p, n = F.last("own", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("own", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    j = both.withColumns({"p": p, "n": n}).filter("asked = 1 and (p is not null or n is not null)")
    early, late = F.col("p").isNull() | (F.col("p.before").isNull() & (F.col("p.at.x") == F.col("x"))), F.col("n").isNull()
    first = F.when(F.col("p").isNull(), F.col("n.at")).when(late, F.coalesce("p.before", "p.at")).otherwise(F.col("p.at"))
    second = F.when(F.col("p").isNull(), F.coalesce("n.after", "n.at")).when(late, F.col("p.at")).otherwise(F.col("n.at"))
    seg = j.select(key, "x", first.alias("a"), second.alias("b"), F.when(late & F.col("p").isNotNull(), F.col("p.at")).otherwise(first).alias("base"), early.alias("early"))
    y = F.col("base.y") + (F.col("x") - F.col("base.x")) * (F.col("b.y") - F.col("a.y")) / F.greatest(F.lit(1.0), F.col("b.x") - F.col("a.x"))
    return seg.select(key, "x", F.when(F.col("a.x") == F.col("b.x"), F.col("a.y")).when(F.col("early"), F.greatest(F.lit(0.0), y)).otherwise(y).alias("y"))


def page_of(points: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """points (key, at) with page and inside, the height left on it: of pages (key, page, start, stop), as page_starts gives them, the one that holds the height; below the last page none."""
    w = Window.partitionBy(key).orderBy("_h", "_p").rowsBetween(Window.unboundedPreceding, 0)
    marks = pages.select(key, F.col("start").alias("_h"), F.lit(0).alias("_p"), F.struct("page", "start", "stop").alias("own"), F.lit(None).cast("double").alias("at"))
    both = points.select(key, F.col("at").cast("double").alias("_h"), F.lit(1).alias("_p"), F.lit(None).cast(marks.schema["own"].dataType).alias("own"), F.col("at").cast("double").alias("at")).unionByName(marks)
    found = both.withColumn("own", F.last("own", True).over(w)).filter("_p = 1")
    inside = F.col("at") < F.col("own.stop")
    return found.select(key, "at", F.when(inside, F.col("own.page")).alias("page"), F.when(inside, F.col("at") - F.col("own.start")).alias("inside"))


def box_union(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, w, h): the least box around each key's boxes (keys, x, y, w, h)."""
    edges = boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"))
    return edges.select(*keys, "x", "y", (F.col("x1") - F.col("x")).alias("w"), (F.col("y1") - F.col("y")).alias("h"))


def page_starts(pages: DataFrame, key: str, order: str, height: str) -> DataFrame:
    """pages with start and stop: cumulative heights."""
    w = Window.partitionBy(key).orderBy(order)
    start = F.coalesce(F.sum(height).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return pages.withColumn("start", start).withColumn("stop", start + F.col(height))


def cells_of(low: Column, high: Column, size: Column) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def coverings(boxes: DataFrame, keys: list[str], share: float) -> DataFrame:
    """(keys, over, under): of boxes (keys, _number, x, y, w, h) those of which more than `share` lies inside an earlier one.

    Candidates meet in the cells of a grid as wide and high as the keys' boxes are on average: the cells of the earlier box
    and, as what covers half of a box or more covers its middle, the later one's middle; for smaller shares all its cells.
    """
    spot = lambda c: F.col(f"_b{c}")
    sized = boxes.select(*keys, "_number", *(F.col(c).cast("double").alias(f"_b{c}") for c in "xywh")).filter("_bw > 0 and _bh > 0 and _bx is not null and _by is not null")
    mean = sized.groupBy(*keys).agg(F.greatest(F.avg("_bw"), F.lit(1.0)).alias("_cw"), F.greatest(F.avg("_bh"), F.lit(1.0)).alias("_ch"))
    placed = sized.join(mean, keys)
    middle = share >= 0.5
    side = lambda at, size, cell, point: cells_of(spot(at) + spot(size) / 2, spot(at) + spot(size) / 2, F.col(cell)) if point else cells_of(spot(at), spot(at) + spot(size), F.col(cell))
    dealt = lambda point: placed.withColumn("_i", F.explode(side("x", "w", "_cw", point))).withColumn("_j", F.explode(side("y", "h", "_ch", point))).drop("_cw", "_ch")
    over = dealt(False).select(*keys, "_i", "_j", F.col("_number").alias("over"), *(spot(c).alias(f"_o{c}") for c in "xywh"))
    common = lambda at, size: F.least(F.col(f"_o{at}") + F.col(f"_o{size}"), spot(at) + spot(size)) - F.greatest(F.col(f"_o{at}"), spot(at))
    a, b = common("x", "w"), common("y", "h")
    inside = (F.col("over") < F.col("_number")) & (a > 0) & (b > 0) & (a * b > share * F.greatest(F.lit(1.0), spot("w") * spot("h")))
    found = dealt(middle).join(over, [*keys, "_i", "_j"]).filter(inside).select(*keys, "over", F.col("_number").alias("under"))
    return found if middle else found.distinct()


def undominated(boxes: DataFrame, keys: list[str], order: list[str], share: float = 0.5) -> DataFrame:
    """boxes (keys, x, y, w, h) without those of which more than `share` lies inside one kept box of the same keys; wider boxes go first, equal ones by `order`.

    The choice is greedy. It is made in rounds over the table of coverings: boxes that no open one covers are kept, what
    they cover goes, and so do its own coverings; a chain of boxes takes as many rounds as it has links. An area counts as 1
    at least. Boxes without a size or place cover nothing and are kept.
    """
    wide = F.coalesce(F.col("w").cast("double"), F.lit(0.0))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(wide.desc(), *order, "x", "y", "h"))
    numbered = keep(boxes.withColumn("_number", number))
    edges, dropped = keep(coverings(numbered, keys, share)), None
    while not edges.isEmpty():
        free = edges.select(*keys, "over").distinct().join(edges.select(*keys, F.col("under").alias("over")).distinct(), [*keys, "over"], "left_anti")
        gone = keep(edges.join(free, [*keys, "over"], "left_semi").select(*keys, F.col("under").alias("_number")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        edges = keep(edges.join(gone.withColumnRenamed("_number", "over"), [*keys, "over"], "left_anti").join(gone.withColumnRenamed("_number", "under"), [*keys, "under"], "left_anti").select(*keys, "over", "under"))
    kept = numbered if dropped is None else numbered.join(dropped, [*keys, "_number"], "left_anti")
    return kept.select(boxes.columns)
