"""What broke on larger tables: plans and keys that small tables do not show."""

from __future__ import annotations

import time

import duckdb
from pyspark.sql import functions as F

from threadloom import plans
from threadloom.operators import drawing, layout, naming, payload, pointers, runs
from threadloom.operators.keeping import keep
from threadloom.plans.common import dealt
from threadloom.sources import files


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_artefacts_are_told_without_joins(spark, tmp_path):
    """Lines come from exploded rows, whose size Spark's estimates miss, so a join of them is broadcast."""
    orders = "o_orderkey long, o_orderpriority string, o_orderdate timestamp"
    spark.sql("select 1L o_orderkey, '1-URGENT' o_orderpriority, timestamp'1996-01-02 00:00:00' o_orderdate").to(spark.createDataFrame([], orders).schema).write.parquet(f"{tmp_path}/orders.parquet")
    found = plans.queries()["artefact_lines"](spark, str(tmp_path))
    assert "Join" not in plan_of(found) and "Exchange" not in plan_of(found)
    rows = {r.line_no: (r.gmail, r.outlook, r.apple) for r in found.collect()}
    assert len(rows) == 23 and rows[0] == (True, False, False) and rows[12] == (False, False, True) and rows[20] == (False, False, True) and rows[22] == (False, False, False)


def test_names_that_share_a_hash_are_as_the_sql_has_them(spark, tmp_path):
    """Some of 6,000 copies have the hash of an earlier one; the reference and the SQL do not look."""
    spark.range(1, 6001).selectExpr("id c_custkey", "'MACHINERY' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    found = plans.queries()["output_names"](spark, str(tmp_path))
    names = duckdb.sql(plans.oracle_sql()["output_names"].replace("FROM customer", f"FROM '{tmp_path}/customer.parquet/*.parquet'")).fetchall()
    assert len({n for _, n, _ in names}) < len(names) == 6000
    assert sorted(tuple(r) for r in found.select("c_custkey", "name", "copy").collect()) == sorted(names)
    # the operator itself tells them apart
    own = naming.distinct_names(found.select("c_custkey").withColumn("name", F.lit("_ a_b _MACHINERY_.pdf")), "c_custkey")
    assert own.select("output").distinct().count() == 6000


def test_long_bodies_are_replayed_line_by_line(spark):
    """A row a line comes from the task that aligns; it had carried all runs of its document, which is square in long texts."""
    texts = [("ab\ncd", ["ab\n", "c", "d"]), ("\nxaéy\n", ["a", "é"]), ("", []), (None, ["z"]), ("q", None)]
    frame = spark.createDataFrame([(i, b, None if r is None else [(x, k % 2 == 0, None, None, "l" if k else None, 9.0 + k) for k, x in enumerate(r)]) for i, (b, r) in enumerate(texts)], f"id int, body string, runs array<{runs.RUN}>")
    found = runs.replayed(frame, "body", "runs", ["id"])
    assert "Generate" not in plan_of(found)
    got = {(r.id, r.line): [tuple(x) for x in r.runs] for r in found.collect()}
    none = (False, False, False, None, 0.0)
    assert got == {(0, 1): [("ab", True, None, None, None, 9.0)], (0, 2): [("c", False, None, None, "l", 10.0), ("d", True, None, None, "l", 11.0)], (1, 1): [], (1, 2): [("x", *none), ("a", True, None, None, None, 9.0), ("é", False, None, None, "l", 10.0), ("y", *none)], (1, 3): [], (2, 1): [], (3, 1): [], (4, 1): [("q", *none)]}


def test_alignments_near_the_limit_take_milliseconds():
    source = "".join(chr(97 + i * i % 23) for i in range(1800))
    body = "".join(c + "␞" * (k % 10 == 9) for k, c in enumerate(source))
    began = time.process_time()
    found = [payload.align(body, source) for _ in range(20)][-1]
    assert time.process_time() - began < 0.5
    assert [k for k in found if k >= 0] == list(range(1800))


def test_tables_made_by_exploding_are_not_broadcast(spark, tmp_path):
    """Their size is estimated by the small file that they come from."""
    spark.range(1, 40).selectExpr("id c_custkey", "'Customer#' || id c_name", "'MACHINERY' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(40).selectExpr("id div 4 l_orderkey", "id % 4 l_linenumber", "id l_partkey", "id l_suppkey", "double(id) l_quantity", "double(id) l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    for name in ("drawn_shapes", "drawn_text", "glyph_underlines"):
        assert "Broadcast" not in plan_of(plans.queries()[name](spark, str(tmp_path))), name


def test_lines_are_broken_alike_in_their_row_and_by_pointers(spark, monkeypatch):
    words = [(k * k % 7 + 1) * "a" for k in range(700)]
    lines = [(1, 1, " ".join(words)), (1, 2, None), (2, 1, "a" * 40 + "  b " + " ".join(words[:90])), (2, 2, "")]
    frame = spark.createDataFrame(lines, "doc_id int, line_no int, plain string")
    broken = lambda: sorted(tuple(r) for r in layout.word_lines(frame, 20, {" ": 2}, 1, 7).collect())
    kept = []
    monkeypatch.setattr(layout, "keep", lambda df: kept.append(keep(df)) or kept[-1])
    folded = broken()
    # nothing of a line that is folded is written
    assert [df.count() for df in kept] == [0]
    monkeypatch.setattr(layout, "FOLDED", 60)
    assert broken() == folded and kept[-1].count() == 700 + 93
    assert {(d, n): " ".join(r[5] for r in folded if r[:2] == (d, n)) for d, n, _ in lines} == {(d, n): x or "" for d, n, x in lines}


def test_tasks_grow_in_number_with_the_rows(spark, tmp_path):
    assert dealt(spark.range(1000), "id", 10).rdd.getNumPartitions() == 100 and dealt(spark.range(0), "id", 10).rdd.getNumPartitions() == 4
    spark.range(1, 40).selectExpr("id c_custkey", "'Customer#' || id c_name", "'MACHINERY' c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    # rows are dealt before they are exploded, and not again for the second page
    plan = plan_of(plans.queries()["document_lines"](spark, str(tmp_path)))
    assert plan.count("Exchange") == 1 and "Union" not in plan


def test_lines_are_computed_once_for_all_parsers(spark, tmp_path):
    """Each parser reads its input several times; what made the lines had run anew for each reading and each parser."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    lines = spark.range(12).selectExpr("id div 2 doc_id", "id % 2 line_no", "'x' || id plain").mapInArrow(counted, "doc_id long, line_no long, plain string")
    formats = spark.createDataFrame([(0, "a"), (0, "a"), (1, "b"), (2, "a"), (2, "b"), (3, "c"), (4, None)], "doc_id int, format string")
    twice = lambda x: x.join(x.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id")
    found = files.parse_all(lines, formats, {"b": twice, "a": lambda x: twice(x).drop("plain")})
    # of documents with two formats each is read, one named twice once, and others give none
    assert found.dtypes == [("doc_id", "bigint"), ("line_no", "bigint"), ("n", "bigint"), ("format", "string"), ("plain", "string")]
    assert sorted(tuple(r)[:4] for r in found.collect()) == [(d, n, 2, f) for d, n, f in [(0, 0, "a"), (0, 1, "a"), (1, 0, "b"), (1, 1, "b"), (2, 0, "a"), (2, 0, "b"), (2, 1, "a"), (2, 1, "b")]]
    assert sorted(r.plain for r in found.filter("format = 'b'").collect()) == ["x2", "x3", "x4", "x5"]
    assert seen.value == 12


def test_formats_are_parsed_from_kept_lines(spark, tmp_path):
    turns = "conv_id long, turn long, role string, text string"
    rows = [(i, t, "user" if t % 2 else "assistant", f"a line\nand {t}") for i in range(8) for t in range(3)] + [(None, 0, "user", "x"), (-1, 0, "user", "x"), (9, 5, "user", None)]
    spark.createDataFrame(rows, turns).write.parquet(f"{tmp_path}/conversations.parquet")
    found = plans.queries()["parse_formats"](spark, str(tmp_path))
    assert "FileScan" not in plan_of(found) and "Generate" not in plan_of(found)
    named = {(i, t + 1): ("Assistant", "User")[t % 2] for i in range(8) if i % 4 < 3 for t in range(3)} | {(9, 1): "User"}
    assert {(r.doc_id, r.idx): (r.from_name, r.format) for r in found.collect()} == {(i, n): (f"{who} {i}", ("gmail", "outlook", "apple")[i % 4]) for (i, n), who in named.items()}
    assert found.count() == len(named)


def test_drawing_tokens_are_dealt_once_and_nothing_of_them_is_written(spark, tmp_path, monkeypatch):
    """Tables of nodes were written in rounds, and tokens were dealt again for each join: on disk over a hundred times the line items."""
    spark.range(40).selectExpr("id div 4 l_orderkey", "id % 4 l_linenumber", "id l_partkey", "id l_suppkey", "double(id) l_quantity", "double(id) l_extendedprice").write.parquet(f"{tmp_path}/lineitem.parquet")
    kept = []
    for module in (drawing, pointers):
        monkeypatch.setattr(module, "keep", lambda df: kept.append(df) or keep(df), raising=False)
    for name in ("drawn_text", "drawn_shapes"):
        plan = plan_of(plans.queries()[name](spark, str(tmp_path)))
        assert plan.count("Exchange") == 1 and "Join" not in plan and not kept, name
