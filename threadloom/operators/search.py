"""Which lines hold which texts: a positional index of grams, joined on each text's rarest ones, then verified."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.keeping import keep

#: (least length of a text, characters of a gram): a line is cut into grams, so a text of twice a gram's length less one covers a whole one.
LEVELS = ((15, 8), (7, 4), (3, 2), (1, 1))
#: Grams of a text are compared for rarity as far as here; the whole text is verified.
LOOKED_AT = 256


def gram_size(length: Column) -> Column:
    size = F.lit(None).cast("int")
    for least, gram in reversed(LEVELS):
        size = F.when(length >= least, gram).otherwise(size)
    return size


def line_grams(lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, size, gram, line_key, at): every line of distinct lines (doc_id, line_key, text) cut into grams of its document's sizes."""
    grams = F.lit(None).cast("array<string>")
    for _, size in LEVELS:
        grams = F.when(F.col("size") == size, F.regexp_extract_all("text", F.lit(f"(?s).{{{size}}}"), F.lit(0))).otherwise(grams)
    each = lines.join(sizes, "doc_id").select("doc_id", "size", "line_key", F.posexplode(grams).alias("k", "gram"))
    return each.select("doc_id", "size", F.xxhash64("gram").alias("gram"), "line_key", (F.col("k") * F.col("size")).alias("at"))


def rarest_grams(needles: DataFrame, index: DataFrame) -> DataFrame:
    """(doc_id, needle_key, size, gram, offset): of distinct needles (doc_id, needle_key, needle, size) the neighbouring offsets, as many as a gram has characters, whose grams the document has least often; wherever the needle stands, a line's gram begins at one of them."""
    places = F.sequence(F.lit(0), F.least(F.length("needle"), F.lit(LOOKED_AT)) - F.col("size"))
    own = needles.select("doc_id", "needle_key", "size", F.explode(F.transform(places, lambda i: F.struct(i.alias("offset"), F.xxhash64(F.substring("needle", i + 1, F.col("size"))).alias("gram")))).alias("g")).select("doc_id", "needle_key", "size", "g.*")
    counts = index.join(own.select("doc_id", "size", "gram").distinct(), ["doc_id", "size", "gram"], "left_semi").groupBy("doc_id", "size", "gram").agg(F.count("*").alias("n"))
    known = own.join(counts, ["doc_id", "size", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    row = known.groupBy("doc_id", "needle_key", "size").agg(F.array_sort(F.collect_list(F.struct("offset", "gram", "n"))).alias("all"))
    starts = F.sequence(F.lit(0), F.size("all") - F.col("size"))
    cost = F.transform(starts, lambda i: F.struct(F.aggregate(F.slice("all", i + 1, F.col("size")), F.lit(0).cast("long"), lambda s, g: s + g["n"]).alias("n"), i.alias("i")))
    chosen = row.withColumn("best", F.array_min(cost))
    # a gram that no line has rules its offset out
    return chosen.select("doc_id", "needle_key", "size", F.explode(F.filter(F.slice("all", F.col("best.i") + 1, F.col("size")), lambda g: g["n"] > 0)).alias("g")).select("doc_id", "needle_key", "size", "g.gram", "g.offset")


def holding(needles: DataFrame, lines: DataFrame, needle: str = "needle", text: str = "text") -> DataFrame:
    """needles (doc_id, `needle`, ...) joined with the lines (doc_id, `text`, ...) of their document that contain them; empty and null texts are found nowhere. Other columns must differ in name.

    Equal needles and equal lines of a document are looked up once. Candidates are lines whose grams stand where the needle
    puts them, so their number follows the rarest part of a needle, not all lines of a document.
    """
    asked = needles.filter(F.col(needle) != "").withColumn("needle_key", F.xxhash64(needle))
    given = lines.filter(F.col(text).isNotNull()).withColumn("line_key", F.xxhash64(text))
    one = keep(asked.select("doc_id", "needle_key", F.col(needle).alias("needle")).distinct().withColumn("size", gram_size(F.length("needle"))))
    index = keep(line_grams(given.select("doc_id", "line_key", F.col(text).alias("text")).distinct(), one.select("doc_id", "size").distinct()))
    found = rarest_grams(one, index).join(index, ["doc_id", "size", "gram"]).filter("at >= offset").select("doc_id", "needle_key", "line_key").distinct()
    return asked.join(found, ["doc_id", "needle_key"]).join(given, ["doc_id", "line_key"]).filter(F.contains(text, needle)).drop("needle_key", "line_key")


def first_holding(needles: DataFrame, lines: DataFrame, keys: list[str], place: list[str], low: str | None = None, high: str | None = None) -> DataFrame:
    """(keys, place): the first place, by `place`'s columns, of the lines that hold a needle (keys, needle), from page `low` to before page `high`."""
    near = holding(needles, lines)
    if low is not None:
        near = near.filter((F.col("page") >= F.col(low)) & (F.col("page") < F.col(high)))
    return near.groupBy(*keys).agg(F.min(F.struct(*place)).alias("at")).select(*keys, *(F.col(f"at.{c}").alias(c) for c in place))

