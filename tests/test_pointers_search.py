"""Search by grams and pointer rules against plain loops: short and awkward texts, long chains, large documents."""

import random

from pyspark.sql import functions as F

from threadloom.operators import blocks, layout, pointers, search


def test_holding_equals_contains(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abé\n ") for _ in range(n))
    lines = [(d, i, word(rng.choice([0, 1, 3, 9, 40, 90]))) for d in range(3) for i in range(60)] + [(1, 99, None), (1, 98, "ab" * 300), (1, 97, "ab" * 300)]
    needles = [(d, i, (rng.choice([x[2] for x in lines if x[2]]))[rng.randrange(3) :][: rng.choice([1, 2, 4, 8, 15, 30, 400])]) for d in range(4) for i in range(50)] + [(1, 90, ""), (1, 91, None), (1, 92, "ab" * 200), (1, 93, "ab" * 200)]
    found = search.holding(spark.createDataFrame(needles, "doc_id int, idx int, needle string"), spark.createDataFrame(lines, "doc_id int, line_no int, text string"))
    got = sorted((r.doc_id, r.idx, r.line_no) for r in found.collect())
    assert got == sorted((d, i, k) for d, i, needle in needles if needle for e, k, text in lines if d == e and text is not None and needle in text)
    assert {r[1] for r in got} >= {92, 93}


def test_a_long_document_is_not_paired_with_all_needles(spark):
    n = 100_000
    lines = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") / 40).cast("int").alias("page"), F.col("id").alias("y"), F.concat(F.lit("On Mon, Jan 1, 2024 at 8:12 AM person "), F.col("id") % 50_000, F.lit(" wrote a line")).alias("text"))
    needles = spark.range(2000).select(F.lit(1).alias("doc_id"), F.col("id").alias("idx"), F.concat(F.lit("8:12 AM person "), F.col("id") * 7, F.lit(" wrote")).alias("needle"))
    got = {r.idx: r.y for r in search.first_holding(needles, lines, ["doc_id", "idx"], ["page", "y"]).collect()}
    assert got == {i: i * 7 for i in range(2000)}


def starts_by_hand(sizes, may_start, room):
    found, used = [], 0
    for i, (n, may) in enumerate(zip(sizes, may_start, strict=True)):
        if i == 0 or (may and used + n >= room):
            found.append(i)
            used = 0
        used += n
    return found


def test_greedy_starts(spark):
    rng = random.Random(4)
    rows, want = [], set()
    for doc in range(60):
        n = rng.choice([1, 2, 30, 300])
        sizes = [rng.choice([0, 1, 5, 9, 30]) if doc % 2 else rng.randrange(1, 30) for _ in range(n)]
        may = [doc % 2 == 1 or rng.random() < 0.4 for _ in range(n)]
        rows += [(doc, i, s, m) for i, (s, m) in enumerate(zip(sizes, may, strict=True))]
        want |= {(doc, i) for i in starts_by_hand(sizes, may, 40)}
    found = pointers.greedy_starts(spark.createDataFrame(rows, "doc_id int, at int, size long, may_start boolean"), "doc_id", F.lit(40).cast("long"))
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_a_million_rows_fill_pages(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("doc_id"), F.col("id").alias("seq"), (F.col("id") % 7 + 1).cast("double").alias("height"))
    placed = layout.page_split(rows, 40.0, 4.0).groupBy("page").agg(F.sum("height").alias("h"), F.min("seq").alias("first"), F.min("y").alias("y")).collect()
    page, used, first = 1, 0.0, {1: 0}
    for i in range(n):
        h = i % 7 + 1.0
        if 4 + used + h >= 40:
            page, used = page + 1, 0.0
            first[page] = i
        used += h
    assert {r.page: r["first"] for r in placed} == first
    assert {r.y for r in placed} == {4.0}


def test_slices_of_rows_without_height(spark):
    frame = spark.createDataFrame([(1, 1, 0.0), (1, 2, 36.0), (1, 3, 0.0), (1, 4, 80.5)], "doc_id long, seq int, height double")
    got = [(r.seq, r.part, r.height, r.page, r.y) for r in layout.page_split(frame, 40.0, 4.0, slices=True).orderBy("seq", "part").collect()]
    assert got == [(1, 0, 0.0, 1, 4.0), (2, 0, 36.0, 1, 4.0), (3, 0, 0.0, 2, 4.0), (4, 0, 36.0, 2, 4.0), (4, 1, 36.0, 3, 4.0), (4, 2, 8.5, 4, 4.0)]
    assert layout.page_split(frame.filter("false"), 40.0).count() == 0


def test_contents_of_any_levels(spark):
    rng = random.Random(6)
    heads = [(d, p, rng.choice([-3, 0, 1, 2, 9, 10**6]) if d else 10_000 - p if p < 9_000 else p % 50 + 9_000) for d, n in ((0, 10_000), (1, 500), (2, 64), (3, 65), (4, 1)) for p in range(n)]
    got = {(r.doc_id, r.pos): r.parent for r in layout.toc_tree(spark.createDataFrame(heads, "doc_id int, pos int, level int")).collect()}
    opened, last = [], None
    for d, p, level in heads:
        if d != last:
            opened, last = [], d
        while opened and opened[-1][0] >= level:
            opened.pop()
        assert got[d, p] == (opened[-1][1] if opened else None)
        opened.append((level, p))
    assert len(got) == len(heads)


def test_lists_ten_thousand_deep(spark):
    rows = [("a", i, i - 1 if i else None, 1, "" if i % 10 == 0 else f"c{i}") for i in range(10_000)] + [("b", 1, 2, 1, "x"), ("b", 2, 1, 1, "y"), ("b", 3, 99, 1, "z"), ("c", 1, None, 2, "u"), ("c", 2, None, 1, "v")]
    got = {(r.list_id, r.item_id): (r.level, r.number) for r in layout.list_flatten(spark.createDataFrame(rows, "list_id string, item_id int, parent_id int, ord int, content string")).collect()}
    level, want = 0, {("c", 1): (1, 2), ("c", 2): (1, 1)}
    for i in range(10_000):
        level += i % 10 != 0
        if i % 10:
            want["a", i] = (level, 1)
    assert got == want


def test_chunks_of_a_long_document(spark):
    rng = random.Random(8)
    lines = [(1, i, f"A B <a{i}@x.io>    Mon, Jan 1, 2024 at 8:12 AM" if rng.random() < 0.3 else "x" * rng.randrange(200)) for i in range(5000)] + [(2, 1, "short"), (2, 2, None)]
    got = {(r.doc_id, r.line_no): r.chunk for r in blocks.chunk_pack(spark.createDataFrame(lines, "doc_id int, line_no int, plain string"), 600).collect()}
    chunk, used = 1, 0
    for _, i, plain in lines[:5000]:
        n = len(plain) + 1
        if plain.startswith("A B") and used + n > 1024 and i:
            chunk, used = chunk + 1, 0
        used += n
        assert got[1, i] == chunk
    assert chunk > 100 and got[2, 1] == got[2, 2] == 1
