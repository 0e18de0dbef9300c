"""Marks on crowded pages, and dominance of boxes, against all pairs."""

import random

from pyspark.sql import functions as F

from threadloom.operators import geometry, glyphs

LINES = "doc_id int, page int, line int, x double, y double, height double"


def test_bullets_and_indents_as_all_pairs_find_them(spark):
    rng = random.Random(5)
    lines = [(1, p, i, rng.randrange(0, 80) / 2, rng.randrange(-40, 160) / 2, rng.choice([0.0, 4.0, 10.0, 60.0])) for p in range(6) for i in range(80)]
    dots = [(1, p, rng.randrange(0, 80) / 2, rng.randrange(-40, 160) / 2) for p in range(5) for _ in range(30)]
    frame, marks = spark.createDataFrame(lines, LINES), spark.createDataFrame(dots, "doc_id int, page int, x double, y double")
    got = {(r.page, r.line): r.is_bullet for r in glyphs.with_bullets(frame, marks).collect()}
    assert got == {(p, i): any(q == p and abs(by - y) <= max(0.6 * h, 4) and bx < x and x - bx < 40 for _, q, bx, by in dots) for _, p, i, x, y, h in lines}
    indents = {(r.page, r.line): r.x for r in glyphs.with_indents(frame, marks).collect()}
    for _, p, i, x, y, h in lines:
        near = min(((abs(by - y), -by, bx) for _, q, bx, by in dots if q == p), default=None)
        assert indents[p, i] == (near[2] if near and near[0] <= max(h, 6) else x)


def test_underlines_of_a_crowded_page(spark):
    """A page of 100,000 glyphs in 1,000 lines and 10,000 marks."""
    each = spark.range(100_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), F.col("id").alias("pos"), (F.col("id") / 100).cast("int").alias("line"), (F.col("id") % 100 * 6).cast("double").alias("x"), (-14.0 * (F.col("id") / 100).cast("int")).alias("y"), F.lit(10.0).alias("height"))
    marks = spark.range(10_000).select(F.lit(1).alias("doc_id"), F.lit(1).alias("page"), (F.col("id") % 10 * 60 + 2).cast("double").alias("x0"), (F.col("id") % 10 * 60 + 23).cast("double").alias("x1"), (-14.0 * (F.col("id") / 10).cast("int") - F.when(F.col("id") % 2 == 0, 1).otherwise(13)).alias("y"))
    found = glyphs.underlined(each, marks)
    # marks of even numbers lie just below a line, those of odd ones below its reach and above the next line
    assert found.filter("under").count() == 1000 * 5 * 4
    assert found.filter("under and (x % 120 < 1 or x % 120 > 24)").count() == 0


def undominated_by_hand(boxes, share):
    kept = []
    for b in sorted(boxes, key=lambda b: (-(b[5] or 0), b[2])):
        def covers(k, b=b):
            if None in k[3:] or None in b[3:]:
                return False
            w, h = (min(k[a] + k[a + 2], b[a] + b[a + 2]) - max(k[a], b[a]) for a in (3, 4))
            return w > 0 and h > 0 and w * h > share * max(1, b[5] * b[6])
        if not any(covers(k) for k in kept):
            kept.append(b)
    return kept


def test_dominance_in_rounds(spark):
    rng = random.Random(9)
    boxes = [(1, p, i, float(rng.randrange(-20, 60)), float(rng.randrange(40)), float(rng.choice([0, 1, 4, 9, 60])), float(rng.choice([0.5, 2, 8]))) for p in range(8) for i in range(60)]
    boxes += [(1, 50, i, 0.4 * i, 0.0, 1.0 + (40 - i) / 100, 2.0) for i in range(40)] + [(1, 51, 1, None, 1.0, 3.0, 3.0), (1, 51, 2, 1.0, 1.0, None, 3.0)]
    frame = spark.createDataFrame(boxes, "doc_id int, page int, n int, x double, y double, w double, h double")
    for share in (0.5, 0.2):
        got = sorted((r.page, r.n) for r in geometry.undominated(frame, ["doc_id", "page"], ["n"], share).collect())
        assert got == sorted((b[1], b[2]) for p in {b[1] for b in boxes} for b in undominated_by_hand([b for b in boxes if b[1] == p], share))
