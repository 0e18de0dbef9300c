"""Rules with the spaces that systems print, artefacts, names that pass over others, groups and words on pages."""

from pyspark.sql import functions as F

from threadloom.operators import chrome, layout, naming, segment


def test_headers_with_no_break_spaces(spark):
    lines = ["Ana Ro <ana@x.io>     Mon, Jan 1, 2024 at 8:12 AM", "hello", "Bo Li <bo@x.io>  Tue, Jan 2, 2024 at 9:05 PM ", "On Wed, Jan 3, 2024 at 7:00 PM Ana <ana@x.io> wrote:", "Ana Ro <ana@x.io>  Mon, Jan 1, 2024 at 8:12"]
    frame = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "doc_id int, line_no int, plain string")
    flags = [r.h for r in frame.orderBy("line_no").select(segment.is_header(F.col("plain")).alias("h")).collect()]
    assert flags == [True, False, True, False, False]
    got = [tuple(r) for r in segment.header_fields(segment.segment(frame)).orderBy("idx").select("from_name", "from_email", "date_raw").collect()]
    assert got == [("Ana Ro", "ana@x.io", "Mon, Jan 1, 2024 at 8:12 AM"), ("Bo Li", "bo@x.io", "Tue, Jan 2, 2024 at 9:05 PM")]
    assert [r.r for r in frame.orderBy("line_no").select(F.col("plain").rlike(segment.REPLY).alias("r")).collect()] == [False, False, False, True, False]


def test_artefacts(spark):
    cases = [
        ("4/30/26,3:48 AM", "g"), ("4/30/26,  3:48AM", "g"), ("4/30/26, 3:48 AM", "g"), ("Gmail -", ""), ("Gmail - x", "g"), ("4/30/26, 3:48 AM Gmail", "g"), ("4/30/26,3:48 AM Gmail", ""), ("… 1/19", "g"), ("https://mail.google.com/mail", "g"), ("1/3", "goa"),
        ("4/30/26 3:48PM Mail - Ana - Outlook", "o"), ("4/30/26, 3:48 PM Mail -Ana- Outlook", "o"), ("Mail -Ana- Outlook", ""), ("http://outlook.live.com/x", "o"), ("Outlook", "o"), ("Outlook is", ""),
        ("Page  1 of 3", "a"), ("1 / 3", "a"), ("– – —", "a"), ("- x", ""), ("", ""), (" ", ""),
    ]
    frame = spark.createDataFrame([(1, i, x) for i, (x, _) in enumerate(cases)], "doc_id int, line_no int, plain string")
    for form in ("gmail", "outlook", "apple"):
        kept = {r.line_no for r in chrome.drop_chrome(frame, form).collect()}
        assert {i for i, (_, dropped) in enumerate(cases) if form[0] in dropped} == set(range(len(cases))) - kept


def test_names_pass_over_others(spark):
    rows = [(1, "a.pdf"), (2, "a.pdf"), (3, "a (2).pdf"), (4, "a.pdf"), (5, "b.pdf"), (6, "a (2).pdf"), (7, "c"), (8, "c")] + [(100 + i, "hot.pdf") for i in range(3000)] + [(9000, "hot (7).pdf")]
    taken = spark.createDataFrame([("b.pdf",), ("a (3).pdf",), ("c (2)",)], "name string")
    got = {r.id: r.output for r in naming.distinct_names(spark.createDataFrame(rows, "id int, name string"), "id", taken=taken).collect()}
    assert [got[i] for i in range(1, 9)] == ["a.pdf", "a (4).pdf", "a (2).pdf", "a (5).pdf", "b (2).pdf", "a (2) (2).pdf", "c", "c (3)"]
    assert len(set(got.values())) == len(rows) and not set(got.values()) & {"b.pdf", "a (3).pdf", "c (2)"}
    assert [got[100 + i] for i in (0, 1, 5, 6)] == ["hot.pdf", "hot (2).pdf", "hot (6).pdf", "hot (8).pdf"]
    # without others' names copies are numbered as they come
    alone = naming.distinct_names(spark.createDataFrame(rows[:2], "id int, name string"), "id").orderBy("id").collect()
    assert [(r.place, r.output) for r in alone] == [(1, "a.pdf"), (2, "a (2).pdf")]


def test_groups_move_whole(spark):
    rows = [(1, 1, 50.0, None), (1, 2, 20.0, 7), (1, 3, 20.0, 7), (1, 4, 5.0, None), (1, 5, 60.0, 8), (1, 6, 60.0, 8), (1, 7, 200.0, None)]
    got = [(r.seq, r.page, r.y, r.error) for r in layout.grouped_pages(spark.createDataFrame(rows, "doc_id int, seq int, height double, group int"), 100.0, 10.0).orderBy("seq").collect()]
    assert got == [(1, 1, 10.0, None), (2, 2, 10.0, None), (3, 2, 30.0, None), (4, 2, 50.0, None), (5, 3, 10.0, None), (6, 4, 10.0, None), (7, None, None, "cell too big")]


def test_no_word_is_cut(spark):
    lines = [(1, 1, "aa bb cc"), (1, 2, None), (1, 3, "a" * 30 + " b  c"), (2, 1, " ".join(["word"] * 500))]
    got = layout.word_lines(spark.createDataFrame(lines, "doc_id int, line_no int, plain string"), 5, {" ": 1}, 1, 2).collect()
    assert [(r.line_no, r.part, r.page, r.row, r.plain) for r in sorted(got) if r.doc_id == 1] == [(1, 0, 1, 1, "aa bb"), (1, 1, 1, 2, "cc"), (2, 0, 2, 1, ""), (3, 0, 2, 2, "a" * 30), (3, 1, 3, 1, "b  c")]
    assert [r.plain for r in got if r.doc_id == 2] == ["word"] * 500
