"""Queries on pages: glyphs, marks, positions, grids and page breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.operators import drawing, geometry, glyphs, layout, runs
from threadloom.plans.common import LINES_SQL, NUMBERED, dealt, doc_lines, nation_grid, numbered, read
from threadloom.plans.registry import query

C = F.col


def customer_glyphs(s: SparkSession, d: str) -> DataFrame:
    """Three lines a customer: the name, digits in a bold font; the segment, slanted; and a control character ahead of a word."""
    text = F.concat("c_name", F.lit("\n"), "c_mktsegment", F.lit("\r\n"), F.chr(F.lit(7)), F.lit(" tail"))
    each = dealt(read(s, d, "customer"), "c_custkey", 10_000).select(C("c_custkey").alias("doc_id"), F.length("c_name").alias("a"), F.length("c_mktsegment").alias("b"), F.posexplode(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    line = F.when(C("pos") <= C("a"), 0).when(C("pos") <= C("a") + 1 + C("b"), 1).otherwise(2)
    return each.select("doc_id", F.lit(1).alias("page"), "pos", F.ascii("ch").alias("code"), F.lit(400).alias("weight"), (line == 1).alias("italic"), F.when(C("ch").rlike("[0-9]"), "ABCDEF+Arial-BoldMT").otherwise("Helvetica").alias("font"), F.lit(9.75).alias("size"), (50.0 + 6 * C("pos")).alias("x"), (700.0 - 14 * line).alias("y"), F.lit(10.0).alias("height"))


@query("""SELECT c_custkey AS doc_id, 1 AS page, 1 AS line, 1 AS place, regexp_extract(c_name, '^[^0-9]*') AS text, false AS bold, false AS italic FROM customer UNION ALL SELECT c_custkey, 1, 1, 2, regexp_extract(c_name, '[0-9]+$'), true, false FROM customer
UNION ALL SELECT c_custkey, 1, 2, 1, c_mktsegment, false, true FROM customer UNION ALL SELECT c_custkey, 1, 3, 1, ' tail', false, false FROM customer""")
def glyph_lines(s: SparkSession, d: str) -> DataFrame:
    lines = glyphs.styled_lines(glyphs.glyph_lines(customer_glyphs(s, d)))
    return lines.select("doc_id", "page", "line", F.posexplode("runs").alias("k", "r")).select("doc_id", "page", "line", (C("k") + 1).alias("place"), "r.text", "r.bold", "r.italic")


@query("SELECT c_custkey AS doc_id, 1 AS line, c_name AS plain, c_name[1:c_custkey % 9 + 1] AS underlined FROM customer UNION ALL SELECT c_custkey, 2, c_mktsegment, '' FROM customer UNION ALL SELECT c_custkey, 3, ' tail', '' FROM customer")
def glyph_underlines(s: SparkSession, d: str) -> DataFrame:
    """An underline below the first characters of a name, and one too far below the second line."""
    marks = read(s, d, "customer").select(C("c_custkey").alias("doc_id"), F.lit(1).alias("page"), F.explode(F.array(F.struct(F.lit(50.0).alias("x0"), (50.0 + 6 * (C("c_custkey") % 9)).alias("x1"), F.lit(695.0).alias("y")), F.struct(F.lit(50.0).alias("x0"), F.lit(900.0).alias("x1"), F.lit(673.0).alias("y")))).alias("m")).select("doc_id", "page", "m.*")
    lines = glyphs.styled_lines(glyphs.underlined(glyphs.glyph_lines(customer_glyphs(s, d)), marks))
    return lines.select("doc_id", "line", "plain", runs.plain(F.filter("runs", lambda r: r["underline"])).alias("underlined"))


def customer_paths(s: SparkSession, d: str) -> DataFrame:
    kind = C("c_custkey") % 6
    box = lambda *xs: F.struct(*(F.lit(v).alias(n) for n, v in zip(("x0", "y0", "x1", "y1", "points", "filled"), xs, strict=True)))
    drawn = F.when(kind == 0, box(30.0, 698.0, 34.0, 702.0, 4, True)).when(kind == 1, box(30.0, 698.0, 34.0, 702.0, 4, False)).when(kind == 2, box(50.0, 695.0, 80.0, 695.5, 2, False)).when(kind == 3, box(50.0, 695.0, 70.0, 696.0, 4, True)).when(kind == 4, box(50.0, 695.0, 70.0, 700.0, 4, True)).otherwise(box(30.0, 600.0, 33.0, 604.0, 4, True))
    return read(s, d, "customer").select(C("c_custkey").alias("doc_id"), F.lit(1).alias("page"), drawn.alias("b")).select("doc_id", "page", "b.*")


@query("""SELECT c_custkey AS doc_id, CASE c_custkey % 6 WHEN 0 THEN 'bullet' WHEN 5 THEN 'bullet' ELSE 'underline' END AS kind, CASE c_custkey % 6 WHEN 0 THEN 32.0 WHEN 5 THEN 31.5 WHEN 2 THEN 65.0 ELSE 60.0 END::DOUBLE AS x, CASE c_custkey % 6 WHEN 0 THEN 700.0 WHEN 5 THEN 602.0 WHEN 2 THEN 695.25 ELSE 695.5 END::DOUBLE AS y, CASE c_custkey % 6 WHEN 0 THEN 2.0 WHEN 5 THEN 2.0 END::DOUBLE AS radius
FROM customer WHERE c_custkey % 6 NOT IN (1, 4)""")
def path_shapes(s: SparkSession, d: str) -> DataFrame:
    return glyphs.shapes(customer_paths(s, d)).select("doc_id", "kind", "x", "y", "radius")


@query("SELECT c_custkey AS doc_id, l AS line, c_custkey % 6 = 0 AND l = 1 AS is_bullet FROM customer, (VALUES (1), (2), (3)) v(l)")
def bullet_lines(s: SparkSession, d: str) -> DataFrame:
    lines = glyphs.styled_lines(glyphs.glyph_lines(customer_glyphs(s, d)))
    return glyphs.with_bullets(lines, glyphs.shapes(customer_paths(s, d)).filter("kind = 'bullet'")).select("doc_id", "line", "is_bullet")


@query("SELECT c_custkey AS doc_id, p * 3 + l AS line_no, CASE l WHEN 1 THEN c_name WHEN 2 THEN c_mktsegment ELSE ' tail' END AS plain, (CASE l WHEN 1 THEN 0 WHEN 2 THEN 6 * (length(c_name) + 1) ELSE 6 * (length(c_name) + length(c_mktsegment) + 4) END)::DOUBLE AS indent FROM customer, (VALUES (0), (1)) w(p), (VALUES (1), (2), (3)) v(l)")
def document_lines(s: SparkSession, d: str) -> DataFrame:
    """Two pages alike as one line table."""
    page = glyphs.styled_lines(glyphs.glyph_lines(customer_glyphs(s, d))).select("doc_id", "page", "line", "plain", "x")
    return glyphs.document_lines(page.withColumn("page", F.explode(F.array(F.lit(1), F.lit(2)))))


CHUNKS = "(SELECT l_orderkey AS doc_id, l_quantity AS y, (l_partkey % 500)::DOUBLE AS x, l_linenumber::VARCHAR AS text FROM " + NUMBERED + ")"


def order_chunks(s: SparkSession, d: str) -> DataFrame:
    return numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), (C("l_partkey") % 500).cast("double").alias("x"), C("l_quantity").alias("y"), C("l_linenumber").cast("string").alias("text"))


CHUNK_LINES = f"""WITH f AS (SELECT *, CASE WHEN lag(y) OVER w - y <= 3 THEN 0 ELSE 1 END AS fresh FROM {CHUNKS} WINDOW w AS (PARTITION BY doc_id ORDER BY y DESC, x, text)), g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY y DESC, x, text) AS line FROM f), scanned AS (SELECT doc_id, line::INT AS line, string_agg(text, '' ORDER BY x, text) AS text, min(x) AS x, avg(y) AS y FROM g GROUP BY doc_id, line)"""


@query(CHUNK_LINES + " SELECT doc_id, line, text, x, round(y, 6) AS y FROM scanned")
def chunk_lines(s: SparkSession, d: str) -> DataFrame:
    return glyphs.chunk_lines(order_chunks(s, d)).select("doc_id", "line", "text", "x", F.round("y", 6).alias("y"))


@query(CHUNK_LINES + f""", l AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, (l_partkey % 60)::DOUBLE AS y, (l_linenumber * 2)::DOUBLE AS height, 1000.0::DOUBLE AS x FROM {NUMBERED}), b AS (SELECT l.doc_id, l.line, l.x, l.height, arg_min(s.x, (abs(s.y - l.y), -s.y)) AS sx, min(abs(s.y - l.y)) AS away FROM l JOIN scanned s USING (doc_id) GROUP BY ALL)
SELECT doc_id, line, CASE WHEN away <= greatest(height, 6) THEN sx ELSE x END AS x FROM b""")
def nearest_line(s: SparkSession, d: str) -> DataFrame:
    lines = numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), C("l_linenumber").alias("line"), (C("l_partkey") % 60).cast("double").alias("y"), (C("l_linenumber") * 2).cast("double").alias("height"), F.lit(1000.0).alias("x"))
    return glyphs.with_indents(lines, glyphs.chunk_lines(order_chunks(s, d))).select("doc_id", "line", "x")


GAPS = f"""WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS line, CASE l_partkey % 6 WHEN 0 THEN 'To: x' WHEN 1 THEN 'lower' WHEN 2 THEN 'é' ELSE 'Upper' END AS plain, 800 - sum(5 + l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS y, (8 + l_partkey % 3)::DOUBLE AS height FROM {NUMBERED}),
g AS (SELECT *, lag(y) OVER w AS up, lag(height) OVER w AS up_height, lag(plain) OVER w AS up_plain FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY line))"""
OUT = """, each AS (SELECT doc_id, line, plain, y, unnest(CASE WHEN blank THEN [true, false] ELSE [false] END) AS b, generate_subscripts(CASE WHEN blank THEN [true, false] ELSE [false] END, 1) AS k FROM j) SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY line, k))::INT AS line, CASE WHEN b THEN '' ELSE plain END AS plain FROM each"""


def gap_lines(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber").rowsBetween(Window.unboundedPreceding, 0)
    k = C("l_partkey") % 6
    return numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), C("l_linenumber").alias("line"), F.when(k == 0, "To: x").when(k == 1, "lower").when(k == 2, "é").otherwise("Upper").alias("plain"), (800 - F.sum(5 + C("l_quantity")).over(w)).alias("y"), (8 + C("l_partkey") % 3).cast("double").alias("height"))


@query(GAPS + """, m AS (SELECT doc_id, list_sort(list(up - y))[count(*) // 2 + 1] AS median FROM g WHERE up - y > 1 GROUP BY doc_id), j AS (SELECT g.*, coalesce(up - y > coalesce(median, 14) * 1.55 AND plain NOT IN ('lower', 'é', 'To: x') AND up_plain <> 'To: x', false) AS blank FROM g LEFT JOIN m USING (doc_id))""" + OUT)
def gap_blank_injection(s: SparkSession, d: str) -> DataFrame:
    return glyphs.gap_blanks(gap_lines(s, d)).select("doc_id", "line", "plain")


@query(GAPS + """, m AS (SELECT doc_id, list_sort(list(height))[count(*) // 2 + 1] AS median FROM g GROUP BY doc_id), j AS (SELECT g.*, coalesce(up - up_height / 2 - y - height / 2 > median AND plain <> 'To: x' AND up_plain <> 'To: x', false) AS blank FROM g JOIN m USING (doc_id))""" + OUT)
def gap_blank_by_height(s: SparkSession, d: str) -> DataFrame:
    return glyphs.gap_blanks(gap_lines(s, d), by="heights").select("doc_id", "line", "plain")


@query("WITH c AS (SELECT l_suppkey AS doc_id, round(8 + l_quantity / 10) AS v, count(*) AS n FROM lineitem GROUP BY ALL), m AS (SELECT doc_id, arg_max(v, (n, -v)) AS size FROM c GROUP BY doc_id) SELECT doc_id, size, round(12 / size, 6) AS scale FROM m")
def size_scale(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "lineitem").select(C("l_suppkey").alias("doc_id"), F.lit(65).alias("code"), (8 + C("l_quantity") / 10).alias("size"))
    return glyphs.size_scale(rows).select("doc_id", "size", F.round("scale", 6).alias("scale"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_type WHEN p_partkey % 3 = 1 THEN 'F' || p_partkey ELSE 'Abc+x' END AS base, (2 * p_size + 5)::DOUBLE AS x, (p_size * 0.5 + p_partkey)::DOUBLE AS y FROM part")
def font_bases(s: SparkSession, d: str) -> DataFrame:
    """Fonts by alias, by their own tagged name, and one whose plus sign is no tag; and a point moved."""
    k = C("p_partkey") % 3
    part = read(s, d, "part")
    rows = part.select("p_partkey", F.lit(1).alias("doc_id"), F.when(k == 2, "Abc+x").otherwise(F.concat(F.when(k == 1, "ABCDEF+").otherwise(""), F.lit("F"), "p_partkey")).alias("font"), C("p_size").cast("double").alias("w"))
    aliases = part.filter(k == 0).select(F.lit(1).alias("doc_id"), F.concat(F.lit("F"), "p_partkey").alias("alias"), F.concat(F.lit("QWERTY+"), "p_type").alias("base"))
    matrix = F.array(F.lit(2.0), F.lit(0.5), F.lit(0.0), F.lit(1.0), F.lit(5.0), F.lit(0.0))
    x, y = glyphs.moved(matrix, C("w"), C("p_partkey").cast("double"))
    return glyphs.with_base_fonts(rows, aliases).select("p_partkey", "base", x.alias("x"), y.alias("y"))


@query("""WITH c AS (SELECT p_brand, round(p_retailprice / 100) AS v, count(*) AS n FROM part GROUP BY ALL), m AS (SELECT p_brand, arg_max(v, (n, -v)) AS mode FROM c GROUP BY p_brand), u AS (SELECT p_brand, list_sort(list(p_size)) AS xs FROM part GROUP BY p_brand)
SELECT p_brand, mode, xs[len(xs) // 2 + 1] AS median_size FROM m JOIN u USING (p_brand)""")
def dominant_size(s: SparkSession, d: str) -> DataFrame:
    part = read(s, d, "part").withColumn("price", C("p_retailprice") / 100)
    return geometry.dominant(part, ["p_brand"], "price").join(geometry.upper_median(part, ["p_brand"], "p_size", "median_size"), "p_brand").select("p_brand", "mode", "median_size")


@query("SELECT l.event_id FROM events l SEMI JOIN events m ON l.user_id = m.user_id AND abs(l.value - m.value) <= 0.5 AND l.event_id <> m.event_id")
def band_semi_join(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events")
    return geometry.band_semi(e, e, "user_id", "value", 0.5, "event_id").select("event_id")


@query("""WITH a AS (SELECT user_id, event_id::DOUBLE AS x, value AS y FROM events WHERE event_id % 4 = 0), p AS (SELECT user_id, event_id::DOUBLE AS x FROM events WHERE event_id % 4 <> 0 AND user_id IN (SELECT user_id FROM a)),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY x) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM a), q AS (SELECT p.user_id, p.x, (SELECT count(*) FROM a WHERE a.user_id = p.user_id AND a.x <= p.x) AS c FROM p),
z AS (SELECT q.*, n.n, least(greatest(c, 1), greatest(n.n - 1, 1)) AS k FROM q JOIN (SELECT user_id, count(*) AS n FROM a GROUP BY user_id) n USING (user_id)),
y AS (SELECT z.user_id, z.x, z.c, CASE WHEN b.x IS NULL THEN a.y ELSE a.y + (z.x - a.x) * (b.y - a.y) / (b.x - a.x) END AS y, b.x IS NULL AS one FROM z JOIN r a ON a.user_id = z.user_id AND a.k = z.k LEFT JOIN r b ON b.user_id = z.user_id AND b.k = z.k + 1)
SELECT user_id, x, round(CASE WHEN c = 0 AND NOT one THEN greatest(0, y) ELSE y END + 0.0000003, 4) AS y FROM y""")
def anchor_interpolate(s: SparkSession, d: str) -> DataFrame:
    e = read(s, d, "events").select("user_id", C("event_id").cast("double").alias("x"), C("value").alias("y"))
    return geometry.interpolate(e.filter("x % 4 <> 0"), e.filter("x % 4 = 0"), "user_id").withColumn("y", F.round(C("y") + 0.0000003, 4))


@query("SELECT o_custkey, o_orderkey, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS start, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS stop FROM orders")
def page_lookup(s: SparkSession, d: str) -> DataFrame:
    found = geometry.page_starts(read(s, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice")
    return found.select("o_custkey", "o_orderkey", F.round("start", 2).alias("start"), F.round("stop", 2).alias("stop"))


@query(f"""WITH p AS (SELECT l_orderkey, l_linenumber AS page, l_quantity AS h, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS stop FROM {NUMBERED}), q AS (SELECT l_orderkey, (l_linenumber * 17.0)::DOUBLE AS at FROM {NUMBERED})
SELECT q.l_orderkey, q.at, p.page, q.at - (p.stop - p.h) AS inside FROM q LEFT JOIN p ON p.l_orderkey = q.l_orderkey AND q.at >= p.stop - p.h AND q.at < p.stop""")
def height_to_page(s: SparkSession, d: str) -> DataFrame:
    rows = numbered(s, d)
    pages = geometry.page_starts(rows.select("l_orderkey", C("l_linenumber").alias("page"), C("l_quantity").alias("h")), "l_orderkey", "page", "h")
    return geometry.page_of(rows.select("l_orderkey", (C("l_linenumber") * 17.0).alias("at")), pages, "l_orderkey")


@query(f"SELECT l_orderkey, min(l_quantity) AS x, min(l_partkey)::DOUBLE AS y, max(l_quantity + l_linenumber) - min(l_quantity) AS w, (max(l_partkey + 3) - min(l_partkey))::DOUBLE AS h FROM {NUMBERED} GROUP BY l_orderkey")
def box_union(s: SparkSession, d: str) -> DataFrame:
    boxes = numbered(s, d).select("l_orderkey", C("l_quantity").alias("x"), C("l_partkey").cast("double").alias("y"), C("l_linenumber").cast("double").alias("w"), F.lit(3.0).alias("h"))
    return geometry.box_union(boxes, ["l_orderkey"])


GRID = "WITH c AS (SELECT n_regionkey AS table_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS k, left(n_name, 1) AS cell_id FROM nation), g AS (SELECT table_id, (k // 2)::INT AS row, (k % 2)::INT AS col, cell_id FROM c)"


@query(GRID + """, a AS (SELECT *, row_number() OVER (PARTITION BY table_id, row ORDER BY col) - row_number() OVER (PARTITION BY table_id, row, cell_id ORDER BY col) AS run FROM g), f AS (SELECT table_id, row, cell_id, min(col) AS col, count(*)::INT AS colspan FROM a GROUP BY table_id, row, cell_id, run),
v AS (SELECT *, row - row_number() OVER (PARTITION BY table_id, col, colspan, cell_id ORDER BY row) AS part FROM f) SELECT table_id, min(row) AS row, col, colspan, count(*)::INT AS rowspan, cell_id FROM v GROUP BY table_id, col, colspan, cell_id, part""")
def grid_spans(s: SparkSession, d: str) -> DataFrame:
    return layout.merge_spans(nation_grid(s, d))


@query(GRID + " SELECT g.table_id, row, col, cell_id, CASE WHEN row < 1 THEN 'header' WHEN row = last THEN 'footer' WHEN col < 1 THEN 'column_header' ELSE 'content' END AS section FROM g JOIN (SELECT table_id, max(row) AS last FROM g GROUP BY table_id) USING (table_id) WHERE row >= 0 AND col < 1 OR row = 1")
def grid_slice(s: SparkSession, d: str) -> DataFrame:
    """The first column, and the second row, of a grid in sections."""
    cells = layout.grid_sections(nation_grid(s, d), headers=1, footers=1, header_cols=1)
    return layout.grid_slice(cells, rows=(0, None), cols=(None, 1)).union(layout.grid_slice(cells, rows=(1, 2), cols=(1, None)))


@query(f"SELECT l_orderkey AS table_id, (l_linenumber // 2)::INT AS row, l_linenumber AS col, l_quantity AS height, max(l_quantity) OVER (PARTITION BY l_orderkey, l_linenumber // 2) AS row_height FROM {NUMBERED}")
def row_heights(s: SparkSession, d: str) -> DataFrame:
    return layout.row_heights(numbered(s, d).select(C("l_orderkey").alias("table_id"), F.expr("int(l_linenumber div 2)").alias("row"), C("l_linenumber").alias("col"), C("l_quantity").alias("height")))


@query(f"""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, CASE WHEN l_partkey % 20 = 0 THEN 120.0 ELSE l_quantity END AS h FROM {NUMBERED}),
p AS (SELECT doc_id, 0 AS seq, 0.0::DOUBLE AS height, 1 AS page, 0.0::DOUBLE AS y, 10.0::DOUBLE AS next, NULL::VARCHAR AS error, 1 AS open FROM (SELECT DISTINCT doc_id FROM r)
UNION ALL SELECT r.doc_id, r.seq, r.h, CASE WHEN 10 + r.h >= 100 THEN NULL WHEN p.next + r.h >= 100 THEN p.open + 1 ELSE p.open END, CASE WHEN 10 + r.h >= 100 THEN NULL WHEN p.next + r.h >= 100 THEN 10 ELSE p.next END, CASE WHEN 10 + r.h >= 100 THEN p.next WHEN p.next + r.h >= 100 THEN 10 + r.h ELSE p.next + r.h END, CASE WHEN 10 + r.h >= 100 THEN 'cell too big' END, CASE WHEN 10 + r.h < 100 AND p.next + r.h >= 100 THEN p.open + 1 ELSE p.open END FROM p JOIN r ON r.doc_id = p.doc_id AND r.seq = p.seq + 1)
SELECT doc_id, seq, 0 AS part, height::DOUBLE AS height, page, y, error FROM p WHERE seq > 0""")
def page_split(s: SparkSession, d: str) -> DataFrame:
    """Some rows are taller than a page."""
    rows = numbered(s, d).select(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("seq"), F.when(C("l_partkey") % 20 == 0, 120.0).otherwise(C("l_quantity")).alias("height"))
    return layout.page_split(rows, 100.0, 10.0)


@query(f"""WITH r AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, l_quantity * 3 AS h, sum(l_quantity * 3) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS stop FROM {NUMBERED}), s AS (SELECT *, stop - h AS start FROM r), e AS (SELECT *, unnest(range(floor(start / 90)::INT, floor(stop / 90)::INT + 1)) AS page FROM s),
c AS (SELECT doc_id, seq, page, least(stop, (page + 1) * 90) - greatest(start, page * 90) AS height, greatest(start, page * 90) - page * 90 + 10 AS y FROM e) SELECT doc_id, seq, (row_number() OVER (PARTITION BY doc_id, seq ORDER BY page) - 1)::INT AS part, height::DOUBLE AS height, (page + 1)::INT AS page, y::DOUBLE AS y FROM c WHERE height > 0""")
def page_slices(s: SparkSession, d: str) -> DataFrame:
    """Rows cut where pages end: what lies between the headers is one long strip."""
    rows = numbered(s, d).select(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("seq"), (C("l_quantity") * 3).alias("height"))
    return layout.page_split(rows, 100.0, 10.0, slices=True).drop("error")


@query(f"""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, (l_linenumber // 3)::INT AS section, (l_linenumber % 2)::INT AS col, l_linenumber AS seq, l_quantity AS h, row_number() OVER (PARTITION BY l_orderkey, l_linenumber // 3, l_linenumber % 2 ORDER BY l_linenumber) AS k FROM {NUMBERED}),
p AS (SELECT doc_id, section, col, seq, k, 1 AS page, 0.0::DOUBLE AS y, h AS next FROM r WHERE k = 1 UNION ALL SELECT r.doc_id, r.section, r.col, r.seq, r.k, CASE WHEN p.next + r.h >= 60 THEN p.page + 1 ELSE p.page END, CASE WHEN p.next + r.h >= 60 THEN 0 ELSE p.next END, CASE WHEN p.next + r.h >= 60 THEN r.h ELSE p.next + r.h END FROM p JOIN r ON (r.doc_id, r.section, r.col, r.k) = (p.doc_id, p.section, p.col, p.k + 1)),
n AS (SELECT doc_id, section, max(page) AS n FROM p GROUP BY ALL), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
SELECT doc_id, section, col, seq, (before + page)::INT AS page, y::DOUBLE AS y FROM p JOIN b USING (doc_id, section)""")
def column_pages(s: SparkSession, d: str) -> DataFrame:
    rows = numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.expr("int(l_linenumber div 3)").alias("section"), (C("l_linenumber") % 2).alias("col"), C("l_linenumber").alias("seq"), C("l_quantity").alias("height"))
    return layout.column_pages(rows, 60.0)


@query(LINES_SQL + """, p AS (SELECT doc_id, line_no, unnest(range(0, greatest(ceil(length(plain) / 80)::INT, 1))) AS part, plain FROM lines), n AS (SELECT doc_id, line_no, part::INT AS part, plain[part * 80 + 1:part * 80 + 80] AS plain, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS n FROM p)
SELECT doc_id, line_no, part, (n // 40 + 1)::INT AS page, (n % 40 + 1)::INT AS row, plain FROM n""")
def text_pages(s: SparkSession, d: str) -> DataFrame:
    return layout.text_pages(doc_lines(s, d), 80, 40)


@query(f"""WITH o AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, ['headerLeft', 'contentCenter', 'footerRight', 'elsewhere'][l_partkey % 4 + 1] AS container, l_linenumber AS id FROM {NUMBERED}), p AS (SELECT DISTINCT doc_id, page FROM o)
SELECT doc_id, page, container, id, 'content' AS region FROM o WHERE container = 'contentCenter' UNION ALL SELECT p.doc_id, p.page, container, id, CASE container WHEN 'headerLeft' THEN 'header' ELSE 'footer' END FROM o JOIN p USING (doc_id) WHERE container IN ('headerLeft', 'footerRight')""")
def page_objects(s: SparkSession, d: str) -> DataFrame:
    objects = numbered(s, d).select(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("page"), F.element_at(F.array(*(F.lit(x) for x in ("headerLeft", "contentCenter", "footerRight", "elsewhere"))), (C("l_partkey") % 4 + 1).cast("int")).alias("container"), C("l_linenumber").alias("id"))
    return layout.page_objects(objects, objects).select("doc_id", "page", "container", "id", "region")


@query("""WITH h AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, (l_partkey % 9)::INT AS level FROM """ + NUMBERED + """)
SELECT a.doc_id, a.pos, a.level, max(b.pos) AS parent FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL""")
def toc_tree(s: SparkSession, d: str) -> DataFrame:
    return layout.toc_tree(numbered(s, d).select(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("pos"), (C("l_partkey") % 9).cast("int").alias("level")))


@query(f"SELECT l_orderkey AS doc_id, l_linenumber AS page, (count(*) OVER (PARTITION BY l_orderkey))::INT AS total, 'p. ' || l_linenumber || ' of ' || count(*) OVER (PARTITION BY l_orderkey) AS label FROM {NUMBERED} QUALIFY l_linenumber >= 2 AND l_linenumber <> 3")
def page_label_function(s: SparkSession, d: str) -> DataFrame:
    """Labels by a function, from page 2, page 3 hidden."""
    label = lambda page, total: F.format_string("p. %d of %d", page, total)
    return layout.page_labels(numbered(s, d).select(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("page")), first=2, style=label, hidden=(3,))


def line_tokens(s: SparkSession, d: str, per_line: list[Column]) -> DataFrame:
    """Drawing tokens of orders as pages, `per_line` for each line item in order."""
    each = numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), C("l_linenumber").alias("k"), F.posexplode(F.array(*per_line)).alias("j", "t"))
    return each.filter("t.op <> ''").select("doc_id", "page", (C("k") * 16 + C("j")).alias("pos"), "t.*")


def token(op: str | Column, *args: Column | float, name: Column | None = None, text: Column | None = None) -> Column:
    numbers = F.array(*((x if isinstance(x, Column) else F.lit(x)).cast("double") for x in args)) if args else F.lit(None).cast("array<double>")
    none = F.lit(None).cast("string")
    return F.struct((op if isinstance(op, Column) else F.lit(op)).alias("op"), numbers.alias("args"), (none if name is None else name).alias("name"), (none if text is None else text).alias("text"))


@query(f"""WITH l AS (SELECT l_orderkey AS doc_id, n.l_linenumber AS k, l_partkey AS part, l_quantity AS qty FROM {NUMBERED} n),
s AS (SELECT *, k // 2 AS h, coalesce(sum(CASE WHEN k % 2 = 1 THEN k * 2.0 ** ((k - 1) // 2) END) OVER w, 0) AS over_x, coalesce(sum(CASE WHEN k % 2 = 1 THEN qty * 2.0 ** ((k - 1) // 2) END) OVER w, 0) AS over_y FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT doc_id, (k * 16 + 6 + 2 * b)::INT AS pos, (2.0 ** (h + 1) * 5 + over_x + 2.0 ** h * k)::DOUBLE AS x, (2.0 ** (h + 1) * (7 - 3 * b) + over_y + 2.0 ** h * qty)::DOUBLE AS y, 'F' || part % 3 AS font, ['a', 'b'][b + 1] || part AS text FROM s, (VALUES (0), (1)) v(b)""")
def drawn_text(s: SparkSession, d: str) -> DataFrame:
    """Two texts a line item, in scopes of twice the size of the one around; every second scope is closed again."""
    part, even = C("l_partkey").cast("string"), C("l_linenumber") % 2 == 0
    each = [token("q"), token("cm", 2, 0, 0, 2, C("l_linenumber"), C("l_quantity")), token("BT"), token("Td", 5, 7), token("TL", 3), token("Tf", 12, name=F.concat(F.lit("F"), C("l_partkey") % 3)), token("Tj", text=F.concat(F.lit("a"), part)), token("T*"), token("TJ", text=F.concat(F.lit("b"), part)), token("ET"), token(F.when(even, "Q").otherwise(""))]
    return drawing.text_chunks(line_tokens(s, d, each)).drop("page")


@query(f"""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber * 10.0 AS x, l_quantity AS y, l_partkey % 5 AS kind FROM {NUMBERED})
SELECT doc_id, CASE kind WHEN 0 THEN 'bullet' ELSE 'underline' END AS kind, CASE kind WHEN 0 THEN x + 2 WHEN 1 THEN x + 30 ELSE x + 10 END::DOUBLE AS x, CASE kind WHEN 0 THEN y + 2 WHEN 1 THEN y ELSE y - 0.5 END::DOUBLE AS y, CASE kind WHEN 0 THEN 2.0 END::DOUBLE AS radius FROM l WHERE kind IN (0, 1, 4)""")
def drawn_shapes(s: SparkSession, d: str) -> DataFrame:
    """A filled square, a stroked line, a stroked square, a path that is given up, and a thin filled band upside down, one for each line item."""
    kind = C("l_partkey") % 5
    pick = lambda *ops: F.element_at(F.array(*(F.lit(x) for x in ops)), (kind + 1).cast("int"))
    each = [token("q"), token("cm", 1, 0, 0, 1, C("l_linenumber") * 10, C("l_quantity")), token(pick("re", "", "re", "", "re"), 0, 0, F.when(kind == 4, 20).otherwise(4), F.when(kind == 4, -1).otherwise(4)), token(pick("", "m", "", "m", ""), 0, 0), token(pick("", "l", "", "l", ""), 60, 0), token(pick("f", "S", "S", "n", "f*")), token("Q")]
    return glyphs.shapes(drawing.painted_paths(line_tokens(s, d, each))).select("doc_id", "kind", "x", "y", "radius")


ADVANCES = {"i": 250, "j": 250, "l": 250, ".": 250, ",": 250, " ": 300, "m": 800, "w": 700}


@query(LINES_SQL.replace("lines AS (", "given AS (") + """, w AS (SELECT doc_id, line_no, unnest(string_split(plain, ' ')) AS word, generate_subscripts(string_split(plain, ' '), 1) AS k FROM given),
m AS (SELECT *, length(word) * 500 - 250 * length(regexp_replace(word, '[^ijl.,]', '', 'g')) + 300 * length(regexp_replace(word, '[^m]', '', 'g')) + 200 * length(regexp_replace(word, '[^w]', '', 'g')) + 300 AS size FROM w),
p AS (SELECT doc_id, line_no, k, word, 0 AS part, size AS used FROM m WHERE k = 1 UNION ALL SELECT m.doc_id, m.line_no, m.k, m.word, CASE WHEN p.used + m.size > 40300 THEN p.part + 1 ELSE p.part END, CASE WHEN p.used + m.size > 40300 THEN m.size ELSE p.used + m.size END FROM p JOIN m ON m.doc_id = p.doc_id AND m.line_no = p.line_no AND m.k = p.k + 1),
r AS (SELECT doc_id, line_no, part, string_agg(word, ' ' ORDER BY k) AS plain FROM p GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line_no, part) - 1 AS n FROM r)
SELECT doc_id, line_no, part::INT AS part, (n // 40 + 1)::INT AS page, (n % 40 + 1)::INT AS row, plain FROM n""")
def word_lines(s: SparkSession, d: str) -> DataFrame:
    """Whole texts broken between words by the widths of their letters."""
    return layout.word_lines(doc_lines(s, d), 40_000, ADVANCES, 500, 40)


@query(f"""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, l_linenumber AS seq, (l_linenumber // 3)::INT AS g, l_quantity AS h FROM {NUMBERED}), t AS (SELECT doc_id, g, sum(h) AS total FROM r GROUP BY ALL),
u AS (SELECT doc_id, min(seq) AS lead, sum(h) AS h, any_value(g) AS g, true AS fits FROM r JOIN t USING (doc_id, g) WHERE total < 90 GROUP BY doc_id, g UNION ALL SELECT doc_id, seq, h, g, false FROM r JOIN t USING (doc_id, g) WHERE total >= 90), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY lead) AS k FROM u),
p AS (SELECT doc_id, k, g, lead, fits, 1 AS page, 10.0::DOUBLE AS y, 10 + h AS next FROM k WHERE k = 1 UNION ALL SELECT k.doc_id, k.k, k.g, k.lead, k.fits, CASE WHEN p.next + k.h >= 100 THEN p.page + 1 ELSE p.page END, CASE WHEN p.next + k.h >= 100 THEN 10 ELSE p.next END, CASE WHEN p.next + k.h >= 100 THEN 10 + k.h ELSE p.next + k.h END FROM p JOIN k ON k.doc_id = p.doc_id AND k.k = p.k + 1)
SELECT r.doc_id, r.seq, r.g AS "group", p.page, (p.y + CASE WHEN p.fits THEN coalesce(sum(r.h) OVER (PARTITION BY r.doc_id, r.g ORDER BY r.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) ELSE 0 END)::DOUBLE AS y FROM r JOIN p ON p.doc_id = r.doc_id AND p.g = r.g AND (p.fits OR p.lead = r.seq)""")
def grouped_pages(s: SparkSession, d: str) -> DataFrame:
    """Line items that stay together by threes, unless they are higher than a page."""
    rows = numbered(s, d).select(C("l_orderkey").alias("doc_id"), C("l_linenumber").alias("seq"), C("l_quantity").alias("height"), F.expr("int(l_linenumber div 3)").alias("group"))
    return layout.grouped_pages(rows, 100.0, 10.0).drop("error")
