"""Rules that go on from where they stopped, as pointers: chains followed by doubling, trees folded to the root, nearest smaller values by blocks.

Rounds are jobs whose tables are kept; a chain or path of n steps takes log2(n) of them. No group is gathered but blocks of BLOCK rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.operators.keeping import keep, large

BLOCK = 64


def reached(steps: DataFrame, first: DataFrame, key: str) -> DataFrame:
    """(key, at): from first (key, at) on, all places that steps (key, at, next) lead to, the first ones included. Nexts lie further on, or are null."""
    jump = keep(steps.filter("next is not null").select(key, "at", "next"))
    found = new = first.select(key, "at")
    while True:
        new = keep(found.join(large(jump), [key, "at"]).select(key, F.col("next").alias("at")))
        if new.isEmpty():
            return found
        found = keep(found.unionByName(new))
        jump = keep(jump.join(large(jump.select(key, F.col("at").alias("next"), F.col("next").alias("further"))), [key, "next"]).select(key, "at", F.col("further").alias("next")))


def greedy_starts(rows: DataFrame, key: str, room: Column) -> DataFrame:
    """(key, at): where groups begin if each goes on until a row that may start one does not fit: rows (key, at, size: long, may_start), groups of less than `room`.

    A row that starts a group points to the next start, the first row whose running sum reaches the room from there: an as-of
    lookup on sums.
    """
    order = Window.partitionBy(key).orderBy("at")
    summed = rows.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("stop") - F.col("size"))
    first = F.row_number().over(order) == 1
    whole = summed.withColumns({"first": first, "reach": F.greatest(F.col("start") + room, F.col("stop") + 1)})
    kept = keep(whole.filter("first or may_start"))
    marks = kept.filter("may_start").select(key, F.col("stop").alias("v"), F.lit(1).alias("kind"), "at", F.col("at").alias("mark"))
    asked = kept.select(key, F.col("reach").alias("v"), F.lit(0).alias("kind"), "at", F.lit(None).cast(kept.schema["at"].dataType).alias("mark"))
    down = Window.partitionBy(key).orderBy(F.desc("v"), F.desc("kind"), F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    steps = marks.unionByName(asked).withColumn("next", F.last("mark", True).over(down)).filter("kind = 0")
    return reached(steps, kept.filter("first"), key)


def with_starts(rows: DataFrame, key: str, room: int) -> DataFrame:
    """rows (key, at, size: long, may_start, many, ...) with `begins`, whether a group begins there (see greedy_starts); many is how many rows the key has.

    Keys of at most BLOCK rows are folded, each in a row of its own; the others follow pointers.
    """
    some_large = not rows.filter(F.col("many") > BLOCK).isEmpty()
    kept = keep(rows) if some_large else rows  # a table is only worth writing where it is read again
    rest = [c for c in rows.columns if c != key]
    listed = kept.filter(F.col("many") <= BLOCK).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "size", "may_start", F.struct(*(c for c in rest if c not in ("at", "size", "may_start"))).alias("rest")))).alias("rows"))
    state = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("flags"))

    def step(done: Column, x: Column) -> Column:
        begins = (F.size(done["flags"]) == 0) | (x["may_start"] & (done["used"] + x["size"] >= room))
        return F.struct(F.when(begins, x["size"]).otherwise(done["used"] + x["size"]).alias("used"), F.concat(done["flags"], F.array(begins)).alias("flags"))

    flagged = listed.select(key, F.inline(F.arrays_zip("rows", F.aggregate("rows", state, step, lambda done: done["flags"]).alias("begins"))))
    small = flagged.select(key, "rows.at", "rows.size", "rows.may_start", "rows.rest.*", "begins")
    if not some_large:
        return small.select(*rows.columns, "begins")
    many = kept.filter(F.col("many") > BLOCK)
    starts = greedy_starts(many.select(key, "at", "size", "may_start"), key, F.lit(room).cast("long"))
    return small.select(*rows.columns, "begins").unionByName(many.join(large(starts.withColumn("begins", F.lit(True))), [key, "at"], "left").withColumn("begins", F.coalesce("begins", F.lit(False))))


def to_root(nodes: DataFrame, keys: list[str], combine: Callable[[Column, Column], Column]) -> DataFrame:
    """nodes (keys, node, up, value) with the values from each node to its root combined, own first: (keys, node, value). What hangs on no root is absent."""
    done = nodes.filter("up is null").select(*keys, "node", "value")
    left, rounds = keep(nodes.select(*keys, "node", "up", "value")), 0
    most = left.count().bit_length()
    while rounds <= most and not left.filter("up is not null").isEmpty():
        above = left.select(*keys, F.col("node").alias("up"), F.col("up").alias("over"), F.col("value").alias("more"))
        still = left.filter("up is not null").join(large(above), [*keys, "up"]).select(*keys, "node", F.col("over").alias("up"), combine(F.col("value"), F.col("more")).alias("value"))
        left, rounds = keep(left.filter("up is null").unionByName(still)), rounds + 1
    return left.filter("up is null").select(*keys, "node", "value") if rounds else done


def block_rows(values: DataFrame, key: str) -> DataFrame:
    """(key, block, rows, least) of values (key, n, v, row), n counting from 0."""
    return values.groupBy(key, F.floor(F.col("n") / BLOCK).alias("block")).agg(F.array_sort(F.collect_list(F.struct("n", "v", "row"))).alias("rows"), F.min("v").alias("least"))


def last_below(blocks: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, n, v, found): of asked (key, n, v) the row, in the last block before block n that has one, whose value is smaller than v and that is the last of these."""
    upper = keep(block_rows(blocks.select(key, F.col("block").alias("n"), F.col("least").alias("v"), F.lit(0).alias("row")), key))
    own = asked.withColumn("block", F.floor(F.col("n") / BLOCK))
    near = own.join(large(upper), [key, "block"]).withColumn("block_found", F.try_element_at(F.filter("rows", lambda r: (r["n"] < F.col("n")) & (r["v"] < F.col("v"))), F.lit(-1))["n"])
    near = keep(near.select(key, "n", "v", "block", "block_found"))
    some = near.filter("block_found is not null").select(key, "n", "v", "block_found")
    open_ones = near.filter("block_found is null and block > 0").select(key, F.col("block").alias("n"), "v").distinct()
    if not open_ones.isEmpty():
        far = last_blocks(upper, open_ones, key).select(key, F.col("n").alias("block"), "v", F.col("found").alias("block_found"))
        some = some.unionByName(near.filter("block_found is null").drop("block_found").join(large(far), [key, "block", "v"]).select(key, "n", "v", "block_found"))
    inside = some.join(large(blocks.select(key, F.col("block").alias("block_found"), "rows")), [key, "block_found"])
    return inside.select(key, "n", "v", F.try_element_at(F.filter("rows", lambda r: r["v"] < F.col("v")), F.lit(-1)).alias("found"))


def last_blocks(upper: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """(key, n, v, found): the number of the row that last_below finds among blocks of blocks."""
    return last_below(upper, asked, key).select(key, "n", "v", F.col("found.n").alias("found"))


def nearest_smaller(values: DataFrame, key: str) -> DataFrame:
    """values (key, n, v, row), n counting from 0, with found: the row of the last n before whose value is smaller, or null.

    Inside a block it is looked for in the block; else in the last earlier block whose least value is smaller, and that block
    is found the same way among blocks of blocks.
    """
    several = not values.filter(F.col("n") >= BLOCK).isEmpty()
    blocks = keep(block_rows(values, key)) if several else block_rows(values, key)
    last = lambda x, i: F.try_element_at(F.filter(F.slice("rows", F.lit(1), i), lambda y: y["v"] < x["v"]), F.lit(-1))["row"]
    each = F.transform("rows", lambda x, i: F.struct(x["n"].alias("n"), x["v"].alias("v"), x["row"].alias("row"), last(x, i).alias("found")))
    inside = blocks.select(key, "block", F.inline(each))
    if not several:
        return inside.drop("block")
    asked = inside.filter("found is null and block > 0").select(key, F.col("block").alias("n"), "v").distinct()
    far = last_below(blocks, asked, key).select(key, F.col("n").alias("block"), "v", F.col("found.row").alias("far"))
    return inside.join(large(far), [key, "block", "v"], "left").select(key, "n", "v", "row", F.coalesce("found", "far").alias("found"))
