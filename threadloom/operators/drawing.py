"""What a page's drawing tokens put where: text and paths under nested transformations.

Tokens are (doc_id, page, pos, op, args: array<double>, name, text) in the order of pos: operators with their numbers, the
name of a font or a shown text (strings of an array put together). No file is read here. A token takes its last numbers; one
that has too few is passed over. Null texts show nothing.

A saved state is a scope, opened by `q` and closed by `Q` (one more than were opened does nothing). A task streams the tokens of
its pages in order and holds the matrices of the scopes that are open, a batch of rows and no more, so nothing is kept, joined
or dealt again. Text positions are running sums since the last absolute one; paths are groups of points between painting
tokens, which are streamed after the token that paints them, as its transformation holds for them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from threadloom.operators.glyphs import moved

# The numbers that operators take, and which of them paint.
NUMBERS = {"cm": 6, "Tm": 6, "m": 2, "l": 2, "c": 6, "v": 4, "y": 4, "re": 4, "Td": 2, "TD": 2, "TL": 1, "Tf": 1, '"': 2}
FILLS, STROKES, NEXT_LINE, SHOWS = ("f", "F", "f*", "B", "b", "B*", "b*"), ("s", "S"), ("T*", "'", '"'), ("Tj", "TJ", "'", '"')
IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
PAGE = ["doc_id", "page"]
#: What a streamed row does: opens or closes a scope, changes its matrix, asks for it, or adds points to the path that asked last.
OPENS, CLOSES, CHANGES, ASKS, ADDS = 1, 2, 3, 4, 5


def identity() -> Column:
    return F.array(*(F.lit(x) for x in IDENTITY))


def complete(tokens: DataFrame) -> DataFrame:
    """Tokens that have the numbers they need, and of these the last ones."""
    need = F.lit(0)
    for op, n in NUMBERS.items():
        need = F.when(F.col("op") == op, n).otherwise(need)
    given = F.coalesce("args", F.array().cast("array<double>"))
    kept = tokens.withColumns({"args": given, "_need": need}).filter(F.size("args") >= F.col("_need"))
    last = F.when(F.size("args") == F.col("_need"), F.col("args")).otherwise(F.slice("args", F.size("args") - F.col("_need") + 1, F.col("_need")))
    return kept.select(*PAGE, "pos", "op", last.alias("args"), "name", "text")


def total(*terms: tuple) -> float | None:
    """A sum of products; null if any number is."""
    found = 0.0
    for x, y in terms:
        if x is None or y is None:
            return None
        found += x * y
    return found


def product(first: Sequence, then: Sequence) -> list:
    """The matrix of one transformation followed by another one."""
    a, b, c, d, e, f = first
    p, q, r, s, t, u = then
    try:
        return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]
    except TypeError:  # nulls
        return [total((a, p), (b, r)), total((a, q), (b, s)), total((c, p), (d, r)), total((c, q), (d, s)), total((e, p), (f, r), (t, 1.0)), total((e, q), (f, s), (u, 1.0))]


class Scopes:
    """The open scopes of a page: the matrix that holds and those that were saved."""

    def __init__(self) -> None:
        self.saved, self.now = [], IDENTITY

    def take(self, step: int, numbers: Sequence) -> None:
        if step == OPENS:
            self.saved.append(self.now)
        elif step == CHANGES:
            self.now = numbers if self.now is IDENTITY else product(numbers, self.now)
        elif self.saved:
            self.now = self.saved.pop()


def values(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(name).to_numpy(zero_copy_only=False).tolist()


def listed(column: pa.Array) -> list:
    """The numbers of all lists of a column, one after another."""
    flat = column.flatten()
    return flat.to_pylist() if flat.null_count else flat.to_numpy().tolist()


def in_steps(rows: DataFrame, *order: str) -> DataFrame:
    """rows (step, ...) sorted by `order` in each page, with `fresh`, whether a page begins."""
    return rows.withColumn("fresh", F.row_number().over(Window.partitionBy(*PAGE).orderBy(*order)) == 1).sortWithinPartitions(*PAGE, *order)


def under_scopes(rows: DataFrame) -> DataFrame:
    """The rows that ask of rows (doc_id, page, pos, step, numbers, ...), with the matrix (ctm) that holds there; numbers are those of `cm`, else null."""
    kept = [c for c in rows.columns if c not in ("step", "numbers")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes = Scopes()
        for batch in batches:
            numbers, at, asked, found = listed(batch.column("numbers")), 0, [], []
            for k, (fresh, step) in enumerate(zip(values(batch, "fresh"), values(batch, "step"), strict=True)):
                if fresh:
                    scopes = Scopes()
                if step == ASKS:
                    asked.append(k)
                    found += scopes.now
                else:
                    scopes.take(step, numbers[at : at + 6])
                    at += 6 * (step == CHANGES)
            matrices = pa.ListArray.from_arrays(pa.array(range(0, len(found) + 1, 6), pa.int32()), pa.array(found, pa.float64()))
            yield pa.record_batch([*(batch.column(c).take(pa.array(asked, pa.int64())) for c in kept), matrices], names=[*kept, "ctm"])

    return in_steps(rows, "pos").mapInArrow(run, T.StructType([*(rows.schema[c] for c in kept), T.StructField("ctm", T.ArrayType(T.DoubleType()))]))


def lesser(x: float | None, y: float | None) -> float | None:
    """As `min` has it: nulls are left out, no number is the largest."""
    return y if x is None or (y is not None and (y < x or x != x)) else x


def greater(x: float | None, y: float | None) -> float | None:
    return y if x is None or (y is not None and (y > x or y != y)) else x


def bounded(rows: DataFrame) -> DataFrame:
    """(doc_id, page, pos, filled, points, x0, y0, x1, y1) of rows (doc_id, page, at, later, pos, step, numbers, filled, points): where the points of paths lie, under the matrix of the row that asks just before them. `points` tells how many a path has; numbers are those of `cm` or coordinates of points, else null."""
    kept, box = {"doc_id": "doc_id", "page": "page", "at": "pos", "filled": "filled", "points": "points"}, ["x0", "y0", "x1", "y1"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scopes, matrix, left, spread = Scopes(), None, 0, None
        for batch in batches:
            numbers, at, ended, found = listed(batch.column("numbers")), 0, [], []
            sizes = pc.fill_null(pc.list_value_length(batch.column("numbers")), 0).to_pylist()
            for k, (fresh, step, size, points) in enumerate(zip(values(batch, "fresh"), values(batch, "step"), sizes, values(batch, "points"), strict=True)):
                if fresh:
                    scopes = Scopes()
                if step == ADDS:
                    a, b, c, d, e, f = matrix
                    for i in range(at, at + size, 2):
                        x, y = numbers[i : i + 2]
                        try:
                            px, py = a * x + c * y + e, b * x + d * y + f
                        except TypeError:  # nulls
                            px, py = total((a, x), (c, y), (e, 1.0)), total((b, x), (d, y), (f, 1.0))
                        x0, y0, x1, y1 = spread
                        spread = lesser(x0, px), lesser(y0, py), greater(x1, px), greater(y1, py)
                    left -= size // 2
                    if not left:
                        ended.append(k)
                        found.append(spread)
                elif step == ASKS:
                    matrix, left, spread = scopes.now, points, (None,) * 4
                else:
                    scopes.take(step, numbers[at : at + size])
                at += size
            which = pa.array(ended, pa.int64())
            yield pa.record_batch([*(batch.column(c).take(which) for c in kept), *(pa.array([x[i] for x in found], pa.float64()) for i in range(4))], names=[*kept.values(), *box])

    fields = [*(T.StructField(name, rows.schema[c].dataType) for c, name in kept.items()), *(T.StructField(c, T.DoubleType()) for c in box)]
    return in_steps(rows, "at", "later", "pos").mapInArrow(run, T.StructType(fields))


def text_chunks(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, pos, x, y, font, text): shown texts, where they start, and the name of their font."""
    order = Window.partitionBy(*PAGE).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    arg, op = (lambda k: F.element_at("args", k)), F.col("op")
    ready = complete(tokens)
    leading = F.coalesce(F.last(F.when(op == "TL", arg(1)).when(op == "TD", -arg(2)), True).over(order), F.lit(0.0))
    moves = op.isin("Td", "TD")
    dx, dy = F.when(moves, arg(1)).otherwise(0.0), F.when(moves, arg(2)).when(op.isin(*NEXT_LINE), -F.col("_l")).otherwise(0.0)
    summed = ready.withColumn("_l", leading).withColumns({"_x": F.sum(dx).over(order), "_y": F.sum(dy).over(order), "font": F.last(F.when(op == "Tf", F.coalesce("name", F.lit(""))), True).over(order)})
    fixed = F.last(F.when(op.isin("BT", "Tm"), F.struct(F.when(op == "Tm", F.col("args")).otherwise(identity()).alias("m"), F.col("_x").alias("x"), F.col("_y").alias("y"))), True).over(order)
    placed = summed.withColumn("_at", fixed)
    x, y = F.col("_x") - F.coalesce("_at.x", F.lit(0.0)), F.col("_y") - F.coalesce("_at.y", F.lit(0.0))
    u, v = moved(F.coalesce("_at.m", identity()), x, y)
    shown = op.isin(*SHOWS) & F.col("text").isNotNull() & ((op != "TJ") | (F.col("text") != ""))
    step = F.when(op == "q", OPENS).when(op == "Q", CLOSES).when(op == "cm", CHANGES).when(shown, ASKS)
    steps = placed.withColumn("step", step).filter("step is not null").select(*PAGE, "pos", "step", F.when(op == "cm", F.col("args")).alias("numbers"), u.alias("u"), v.alias("v"), F.coalesce("font", F.lit("")).alias("font"), "text")
    px, py = moved(F.col("ctm"), F.col("u"), F.col("v"))
    return under_scopes(steps).select(*PAGE, "pos", px.alias("x"), py.alias("y"), "font", "text")


def painted_paths(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, pos, x0, y0, x1, y1, points, filled): painted paths, as `glyphs.shapes` takes them.

    A path is what was drawn since the last one was painted or given up and, in that, since the last point that a line
    starts from or the last rectangle; a closed path goes back to the point that its line started from.
    """
    arg, op = (lambda k: F.element_at("args", k)), F.col("op")
    ready = complete(tokens)
    paints = op.isin(*FILLS, *STROKES)
    order = Window.partitionBy(*PAGE).orderBy("pos")
    drawn = ready.filter(op.isin("q", "Q", "cm", "m", "l", "c", "v", "y", "re", "h", "n") | paints)
    parted = drawn.withColumn("path", F.coalesce(F.sum((paints | (op == "n")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy(*PAGE, "path").orderBy("pos")
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    start = F.last(F.when(op == "m", F.struct(arg(1).alias("x"), arg(2).alias("y"))), True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    fresh = F.last(F.when(op.isin("m", "re"), F.col("pos")), True).over(whole)
    paint = F.last(F.when(paints, F.struct("pos", op.isin(*FILLS).alias("filled"))), True).over(whole)
    known = parted.withColumns({"start": start, "from": fresh, "paint": paint})
    low = [F.least(arg(k), arg(k) + arg(k + 2)) for k in (1, 2)]
    high = [F.greatest(arg(k), arg(k) + arg(k + 2)) for k in (1, 2)]
    corners = F.array(low[0], low[1], high[0], low[1], high[0], high[1], low[0], high[1])
    end = F.array(F.element_at("args", -2), F.element_at("args", -1))
    added = F.when(op == "re", corners).when(op.isin("m", "l", "c", "v", "y"), end).when((op == "h") & F.col("start").isNotNull(), F.array("start.x", "start.y"))
    live = F.col("paint").isNotNull() & (F.col("from").isNull() | (F.col("pos") >= F.col("from")))
    numbers = F.when(op == "cm", F.col("args")).when(live, added)
    step = F.when(op == "q", OPENS).when(op == "Q", CLOSES).when(op == "cm", CHANGES).when(paints, ASKS).when(F.col("numbers").isNotNull(), ADDS)
    steps = known.withColumn("numbers", numbers).withColumn("step", step).filter("step is not null")
    adds = F.col("step") == ADDS
    counted = steps.withColumn("points", F.coalesce(F.sum(F.when(adds, F.size("numbers") / 2)).over(whole), F.lit(0)).cast("int")).filter((F.col("step") != ASKS) | (F.col("points") > 0))
    at = F.when(adds, F.col("paint.pos")).otherwise(F.col("pos"))
    return bounded(counted.select(*PAGE, at.alias("at"), adds.alias("later"), "pos", "step", "numbers", F.col("paint.filled").alias("filled"), "points")).select(*PAGE, "pos", "x0", "y0", "x1", "y1", "points", "filled")
