"""Tables, contents, lists and pages as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import roman
from threadloom.operators.keeping import keep, large
from threadloom.operators.pointers import greedy_starts, nearest_smaller, to_root, with_starts


def merge_spans(cells: DataFrame) -> DataFrame:
    """(table_id, row, col, cell_id) to nodes (table_id, row, col, colspan, rowspan, cell_id): equal neighbours in a row, then equal ranges below each other."""
    w = Window.partitionBy("table_id", "row").orderBy("col")
    run = F.sum(F.when((F.lag("cell_id").over(w) == F.col("cell_id")) & (F.lag("col").over(w) == F.col("col") - 1), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    flat = cells.withColumn("run", run).groupBy("table_id", "row", "run", "cell_id").agg(F.min("col").alias("col"), F.count("*").cast("int").alias("colspan"))
    v = Window.partitionBy("table_id", "col", "colspan", "cell_id").orderBy("row")
    down = flat.withColumn("part", F.col("row") - F.row_number().over(v))
    return down.groupBy("table_id", "col", "colspan", "cell_id", "part").agg(F.min("row").alias("row"), F.count("*").cast("int").alias("rowspan")).select("table_id", "row", "col", "colspan", "rowspan", "cell_id")


def column_offsets(columns: DataFrame, width: float) -> DataFrame:
    """(table_id, col, share) with x and w: shares of the width, summed from the left."""
    total = F.sum("share").over(Window.partitionBy("table_id"))
    before = F.coalesce(F.sum("share").over(Window.partitionBy("table_id").orderBy("col").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return columns.withColumns({"x": before / total * width, "w": F.col("share") / total * width})


def row_heights(cells: DataFrame) -> DataFrame:
    """cells (table_id, row, height) with the height of the tallest cell of the row."""
    return cells.withColumn("row_height", F.max("height").over(Window.partitionBy("table_id", "row")))


def grid_slice(cells: DataFrame, rows: tuple[int | None, int | None] = (None, None), cols: tuple[int | None, int | None] = (None, None)) -> DataFrame:
    """The cells of rows and columns from the first number to before the second; none is no limit."""
    for name, (low, high) in (("row", rows), ("col", cols)):
        cells = cells if low is None else cells.filter(F.col(name) >= low)
        cells = cells if high is None else cells.filter(F.col(name) < high)
    return cells


def grid_sections(cells: DataFrame, headers: int = 1, footers: int = 0, header_cols: int = 0) -> DataFrame:
    """cells (table_id, row, col) with section: header, footer, column_header or content."""
    last = F.max("row").over(Window.partitionBy("table_id"))
    section = F.when(F.col("row") < headers, "header").when(F.col("row") > last - footers, "footer").when(F.col("col") < header_cols, "column_header").otherwise("content")
    return cells.withColumn("section", section)


#: Heights are compared as whole numbers of this part of a unit, so sums are exact.
PARTS = 1_000_000


def page_split(rows: DataFrame, page_height: float, header: float = 0.0, slices: bool = False) -> DataFrame:
    """(doc_id, seq, height) as (doc_id, seq, part, height, page, y, error): rows fill pages in order, and every page begins with a header.

    A row fits if it ends above the page's end. One that does not is moved to the next page or, with `slices`, cut at the
    end, its rest going on as further parts. Without slices a row that no page holds has the error "cell too big" and no
    place. A header that leaves no room makes every row too big.
    """
    room = round((page_height - header) * PARTS)
    order = Window.partitionBy("doc_id").orderBy("seq", "height", "size")
    sized = rows.select("doc_id", F.col("seq").cast("int").alias("seq"), F.col("height").cast("double").alias("height"), F.round(F.col("height") * PARTS).cast("long").alias("size"))
    none = {"part": F.lit(0), "page": F.lit(None).cast("int"), "y": F.lit(None).cast("double"), "error": F.lit("cell too big")}
    out = ["doc_id", "seq", "part", "height", "page", "y", "error"]
    if room <= 0:
        return sized.withColumns(none).select(out)
    stop = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    fixed = lambda size: size.cast("double") / PARTS
    if slices:
        placed = sized.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("size"))
        page = F.sequence(F.expr(f"start div {room}"), F.when(F.col("size") > 0, F.expr(f"(stop - 1) div {room}")).otherwise(F.expr(f"start div {room}")))
        cut = placed.select("*", F.posexplode(page).alias("part", "p"))
        top = F.greatest("start", F.col("p") * room)
        whole = F.when((F.col("part") == 0) & (F.col("stop") <= (F.col("p") + 1) * room), F.col("height")).otherwise(fixed(F.least("stop", (F.col("p") + 1) * room) - top))
        return cut.select("doc_id", "seq", "part", whole.alias("height"), (F.col("p") + 1).cast("int").alias("page"), (header + fixed(top - F.col("p") * room)).alias("y"), F.lit(None).cast("string").alias("error"))
    flow = sized.filter(F.col("size") < room).withColumns({"at": F.row_number().over(order), "stop": stop, "may_start": F.lit(True), "many": F.count("*").over(Window.partitionBy("doc_id"))})
    begun = with_starts(flow, "doc_id", room)
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("begins"), F.col("stop") - F.col("size")), True).over(so_far)
    placed = begun.withColumns({"part": F.lit(0), "page": F.sum(F.col("begins").cast("int")).over(so_far).cast("int"), "y": header + fixed(F.col("stop") - F.col("size") - top), "error": F.lit(None).cast("string")})
    return placed.select(out).unionByName(sized.filter(F.col("size") >= room).withColumns(none).select(out))


def grouped_pages(rows: DataFrame, page_height: float, header: float = 0.0) -> DataFrame:
    """(doc_id, seq, height, group) as (doc_id, seq, group, page, y, error): rows of one group, which are neighbours, stay together on a page; a group that no page holds is laid out row by row, as are rows without a group."""
    room = round((page_height - header) * PARTS)
    order = Window.partitionBy("doc_id").orderBy("seq")
    fresh = F.when(F.col("group").isNotNull() & F.lag("group").over(order).eqNullSafe(F.col("group")), 0).otherwise(1)
    sized = rows.withColumn("size", F.round(F.col("height") * PARTS).cast("long")).withColumn("unit", F.sum(fresh).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = Window.partitionBy("doc_id", "unit")
    kept = keep(sized.withColumn("fits", F.sum("size").over(whole) < room).withColumns({"lead": F.when(F.col("fits"), F.min("seq").over(whole)).otherwise(F.col("seq")), "above": F.when(F.col("fits"), F.sum("size").over(whole.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).otherwise(0)}))
    units = kept.groupBy("doc_id", F.col("lead").alias("seq")).agg((F.sum("size").cast("double") / PARTS).alias("height"))
    placed = page_split(units, page_height, header).select("doc_id", F.col("seq").alias("lead"), "page", F.col("y").alias("top"), "error")
    return kept.join(large(placed), ["doc_id", "lead"]).select("doc_id", "seq", "group", "page", (F.col("top") + F.col("above").cast("double") / PARTS).alias("y"), "error")


def column_pages(rows: DataFrame, page_height: float, header: float = 0.0) -> DataFrame:
    """(doc_id, section, col, seq, height) as (doc_id, section, col, seq, page, y): columns of a section fill pages side by side, and a section begins on the page after the longest column of the one before."""
    flow = rows.select(F.struct("doc_id", "section", "col").alias("doc_id"), "seq", "height")
    placed = page_split(flow, page_height, header).select("doc_id.*", "seq", "page", "y")
    pages = placed.groupBy("doc_id", "section").agg(F.coalesce(F.max("page"), F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("doc_id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return placed.join(large(pages.withColumn("before", before)), ["doc_id", "section"]).select("doc_id", "section", "col", "seq", (F.col("before") + F.col("page")).cast("int").alias("page"), "y")


def text_pages(lines: DataFrame, chars: int, per_page: int) -> DataFrame:
    """(doc_id, line_no, plain) as (doc_id, line_no, part, page, row, plain): lines broken after `chars` characters, rows numbered on pages of `per_page`; an empty line takes a row."""
    text = F.coalesce("plain", F.lit(""))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / chars).cast("int") - 1, F.lit(0))), lambda k: F.substring(text, k * chars + 1, F.lit(chars)))
    each = lines.select("doc_id", "line_no", F.posexplode(parts).alias("part", "plain"))
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "part")) - 1
    return each.withColumn("n", n).select("doc_id", "line_no", "part", F.expr(f"int(n div {per_page}) + 1").alias("page"), (F.col("n") % per_page + 1).cast("int").alias("row"), "plain")


#: Lines of at most so many words are broken in their own row, longer ones by pointers.
FOLDED = 20_000


def word_lines(lines: DataFrame, width: int, advances: dict[str, int], other: int, per_page: int) -> DataFrame:
    """(doc_id, line_no, plain) as (doc_id, line_no, part, page, row, plain): lines broken between words where the next word would pass `width`, on pages of `per_page` rows; no word is cut.

    Characters are as wide as `advances` says, others `other`. A word wider than a line has one of its own. A break takes the
    place of one space; other spaces stay.
    """
    known = F.create_map(*(F.lit(x) for pair in advances.items() for x in pair)) if advances else None
    wide = (lambda c: F.coalesce(F.try_element_at(known, c), F.lit(other))) if advances else (lambda c: F.lit(other))
    measured = lambda word: F.aggregate(F.filter(F.split(word, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s + wide(c))
    space = advances.get(" ", other)
    words = F.transform(F.split(F.coalesce("plain", F.lit("")), " ", -1), lambda w: F.struct(w.alias("word"), (measured(w) + space).alias("size")))
    split = lines.withColumn("_n", F.size(F.split(F.coalesce("plain", F.lit("")), " ", -1)))
    # a line is folded in its row, which notes only where parts begin
    line = split.filter(F.col("_n") <= FOLDED).select("doc_id", "line_no", words.alias("words"))
    begun = F.struct(F.lit(0).alias("at"), F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))

    def step(done: Column, w: Column) -> Column:
        begins = (done["at"] == 0) | (done["used"] + w["size"] > width + space)
        return F.struct((done["at"] + 1).alias("at"), F.when(begins, w["size"]).otherwise(done["used"] + w["size"]).alias("used"), F.when(begins, F.concat(done["starts"], F.array(done["at"]))).otherwise(done["starts"]).alias("starts"))

    placed = line.withColumn("starts", F.aggregate("words", begun, step, lambda done: done["starts"]))
    cut = F.transform("starts", lambda a, i: F.array_join(F.transform(F.slice("words", a + 1, F.coalesce(F.try_element_at("starts", i + 2), F.size("words")) - a), lambda w: w["word"]), " "))
    whole = placed.select(F.struct("doc_id", "line_no").alias("line"), F.posexplode(cut).alias("part", "plain"))
    longest = split.filter(F.col("_n") > FOLDED).select(F.struct("doc_id", "line_no").alias("line"), F.posexplode(words).alias("at", "w"))
    each = keep(longest.select("line", "at", "w.word", "w.size", F.lit(True).alias("may_start")))
    starts = greedy_starts(each.drop("word"), "line", F.lit(width + space + 1).cast("long")).withColumn("begins", F.lit(1))
    part = F.sum(F.coalesce("begins", F.lit(0))).over(Window.partitionBy("line").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) - 1
    broken = each.join(large(starts), ["line", "at"], "left").withColumn("part", part.cast("int")).groupBy("line", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda x: x["word"]), " ").alias("plain"))
    rows = whole.unionByName(broken).select("line.doc_id", "line.line_no", "part", "plain")
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no", "part")) - 1
    return rows.withColumn("n", n).select("doc_id", "line_no", "part", F.expr(f"int(n div {per_page}) + 1").alias("page"), (F.col("n") % per_page + 1).cast("int").alias("row"), "plain")


#: The containers of a page by region.
REGIONS = {"header": ("headerLeft", "headerCenter", "headerRight"), "content": ("contentLeft", "contentCenter", "contentRight"), "footer": ("footerLeft", "footerCenter", "footerRight")}


def with_region(objects: DataFrame) -> DataFrame:
    """objects (container) with region: header, content or footer; null for containers of another name."""
    region = F.lit(None).cast("string")
    for name, containers in REGIONS.items():
        region = F.when(F.col("container").isin(*containers), name).otherwise(region)
    return objects.withColumn("region", region)


def page_objects(objects: DataFrame, pages: DataFrame) -> DataFrame:
    """Content objects (doc_id, page, container, ...) and, on each page (doc_id, page), the document's header and footer objects, which have no page of their own."""
    placed = with_region(objects)
    own = placed.filter("region = 'content'")
    repeated = placed.filter("region in ('header', 'footer')").drop("page").join(pages.select("doc_id", "page").distinct(), "doc_id")
    return own.unionByName(repeated.select(own.columns))


def toc_tree(headings: DataFrame) -> DataFrame:
    """(doc_id, pos, level) with parent: the pos of the last earlier heading of a smaller level, null at the top. Levels may be any numbers."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")) - 1
    level = F.col("level").cast("int")
    found = nearest_smaller(headings.select("doc_id", n.alias("n"), level.alias("v"), F.struct("pos", level.alias("level")).alias("row")), "doc_id")
    return found.select("doc_id", "row.pos", "row.level", F.col("found.pos").alias("parent"))


def list_flatten(items: DataFrame) -> DataFrame:
    """(list_id, item_id, parent_id, ord, content) as (list_id, item_id, level, number, content), however deep; items without content do not add depth, and those that hang on no item are absent."""
    numbered = keep(items.withColumn("number", F.row_number().over(Window.partitionBy("list_id", "parent_id").orderBy("ord"))))
    nodes = numbered.select("list_id", F.col("item_id").alias("node"), F.col("parent_id").alias("up"), F.when(F.col("content") == "", 0).otherwise(1).alias("value"))
    levels = to_root(nodes, ["list_id"], lambda own, above: own + above)
    return numbered.join(large(levels.select("list_id", F.col("node").alias("item_id"), F.col("value").alias("level"))), ["list_id", "item_id"]).filter("content <> ''").select("list_id", "item_id", "level", "number", "content")


def page_labels(pages: DataFrame, first: int = 1, style: str | Callable[[Column, Column], Column] = "default", hidden: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, page) with total and label, for pages from `first` that are not hidden; style is default, roman, or a function of page and total."""
    full = pages.withColumn("total", F.count("*").over(Window.partitionBy("doc_id")).cast("int"))
    if callable(style):
        label = style(F.col("page"), F.col("total"))
    else:
        label = F.concat_ws(" / ", roman(F.col("page")), roman(F.col("total"))) if style == "roman" else F.format_string("%d / %d", "page", "total")
    return full.filter((F.col("page") >= first) & ~F.col("page").isin(*hidden) if hidden else F.col("page") >= first).withColumn("label", label)


def validate_grid(cells: DataFrame) -> DataFrame:
    """(table_id, error) for tables whose rows have different numbers of cells, or none with content."""
    rows = cells.groupBy("table_id", "row").agg(F.count("*").alias("n"), F.count("cell_id").alias("full"))
    return rows.groupBy("table_id").agg(F.min("n").alias("a"), F.max("n").alias("b"), F.sum("full").alias("full")).select("table_id", F.when(F.col("full") == 0, "empty").when(F.col("a") != F.col("b"), "ragged").otherwise("ok").alias("error"))
