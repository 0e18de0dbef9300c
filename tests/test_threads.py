import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from threadloom import plans
from threadloom.functions import text as t
from threadloom.operators import blocks, diffing, geometry, layout, payload, runs, segment, stacked

DATA = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


@pytest.fixture(scope="module")
def lines(spark):
    rows = ["My subject", "2 messages", "Ana Ro <a@x.io>     Wed, Apr 29, 2026 at 8:12 AM", "To: Bo <b@x.io>", "<c@x.io>", "", "Hello", "[Quoted text hidden]", "On Wed, Apr 29, 2026 at 7:00 AM Bo <b@x.io> wrote:", "old", "Bo <b@x.io>     Wed, Apr 29, 2026 at 9:00 AM", "Bye"]
    return spark.createDataFrame([(1, i + 1, x) for i, x in enumerate(rows)], "doc_id long, line_no int, plain string")


def test_messages(lines):
    a, b = segment.backfill_to(segment.messages(lines)).orderBy("idx").collect()
    assert (a.from_name, a.from_email, a.date_raw, a.to, a.body) == ("Ana Ro", "a@x.io", "Wed, Apr 29, 2026 at 8:12 AM", "Bo <b@x.io> <c@x.io>", "Hello")
    assert (b.from_name, b.to, b.body) == ("Bo", "Ana Ro <a@x.io>", "Bye")


def test_identity_diff(lines):
    found = segment.messages(lines)
    diff = diffing.similarity(diffing.message_diff(found, found, diffing.pair_messages(found, found)), "l_body", "r_body")
    assert [(r.paired, r.from_matches, r.date_matches, r.similarity) for r in diff.collect()] == [(True, True, True, 1.0)] * 2


def test_integrity(lines):
    row = diffing.integrity(segment.messages(lines), segment.expected_count(lines)).first()
    assert (row.severity, row.message_count, row.expected_count) == ("warning", 2, 2)


def test_no_messages(spark, lines):
    assert segment.messages(lines.filter("line_no < 3")).count() == 0
    assert segment.subjects(segment.segment(lines.filter("line_no = 2"))).first().subject == "(No subject)"


@pytest.mark.parametrize(("a", "b", "want"), [("a", "a", 0.0), ("", "", 1.0), ("a", "", 0.0), ("martha", "marhta", 0.9611), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(diffing.jaro_winkler(a, b), 4) == want


def test_names(spark):
    assert one(spark, t.thread_uid(F.col("s"), F.col("d")), s="Hello", d="Wed, Apr 29, 2026 at 8:12 AM") == "5MQ1PUZJ"
    assert one(spark, t.safe_filename(F.col("s")), s="CON") == "_CON.pdf"
    assert one(spark, t.safe_filename(F.col("s")), s="a/b: c. ") == "a_b_ c.pdf"
    assert len(one(spark, t.safe_filename(F.col("s")), s="é" * 300).encode()) <= 200
    assert [one(spark, t.roman(F.lit(n)), s="") for n in (0, 4, 9, 10, 1994)] == ["", "IV", "IX", "X", "MCMXCIV"]
    name, email = t.repair_sender(F.col("n"), F.col("e"))
    for n in ("Ana Ro <a@x.io>", "Ana Ro<a@x.io>", "Ana Ro a@x.io"):
        assert (one(spark, name, n=n, e=""), one(spark, email, n=n, e="")) == ("Ana Ro", "a@x.io")


def test_payload(spark):
    rows = ["x {\"subject\":\"s\",\"messages\":[]} y", "none", "{\"subject\":\"s\"}"]
    got = payload.decode(spark.createDataFrame([(x,) for x in rows], "raw string")).collect()
    assert [r.error for r in got] == [None, "no JSON object found", "decode: messages"]
    assert payload.align("ac", "abc") == [0, 2]
    assert payload.align("", "abc") == []


def test_blocks_and_layout(spark):
    got = spark.createDataFrame([("- a",), ("1. b",), ("x.pdf",), ("12 KB",), ("",), ("2 attachments",)], "p string").select(blocks.line_class(F.col("p")).alias("c")).collect()
    assert [r.c for r in got] == ["unordered", "ordered", "file", "size", "blank", "attachment_count"]
    cells = spark.createDataFrame([(1, r, c, x) for r, c, x in [(0, 0, "a"), (0, 1, "a"), (1, 0, "a"), (1, 1, "a"), (0, 2, "b"), (1, 2, "c")]], "table_id int, row int, col int, cell_id string")
    assert {(r.cell_id, r.colspan, r.rowspan) for r in layout.merge_spans(cells).collect()} == {("a", 2, 2), ("b", 1, 1), ("c", 1, 1)}
    pages = layout.page_split(spark.createDataFrame([(1, i, h) for i, h in enumerate([40.0, 50.0, 20.0, 200.0])], "doc_id long, seq int, height double"), 100.0, 5.0)
    assert [(r.page, r.y, r.error) for r in pages.orderBy("seq").collect()] == [(1, 5.0, None), (1, 45.0, None), (2, 5.0, None), (None, None, "cell too big")]


@pytest.mark.parametrize("name", list(plans.queries()))
def test_query(spark, name):
    import duckdb

    got = plans.queries()[name](spark, DATA)
    rows = got.collect()
    sql = plans.oracle_sql().get(name)
    if not sql:
        assert rows
        return
    con = duckdb.connect()
    for table in "region nation customer supplier part orders lineitem events documents conversations".split():
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(sql)
    assert sorted(want.columns) == sorted(got.columns)
    order = sorted(got.columns)
    listed = lambda rs, cs: sorted(str([row[cs.index(c)] for c in order]) for row in rs)
    assert listed(map(tuple, rows), got.columns) == listed(want.fetchall(), want.columns)


def test_slices_against_a_strip(spark):
    """Rows cut where pages end, against cutting one long strip; an exact end, an empty row, and a header without room."""
    rng = random.Random(23)
    rows = [(d, i, float(rng.choice([0, 5, 30, 90, 95, 200]))) for d in range(40) for i in range(rng.randint(1, 9))]
    frame = spark.createDataFrame(rows, "doc_id long, seq int, height double")
    got = layout.page_split(frame, 100.0, 10.0, slices=True).collect()
    for d in range(40):
        at, want = 0.0, []
        for _, seq, h in (r for r in rows if r[0] == d):
            part, left = 0, h
            while at % 90 + left >= 90:
                want.append((seq, part, 90 - at % 90, int(at // 90) + 1, at % 90 + 10))
                part, left, at = part + 1, left - (90 - at % 90), (at // 90 + 1) * 90
            if left or not part:
                want.append((seq, part, left, int(at // 90) + 1, at % 90 + 10))
            at += left
        assert sorted((r.seq, r.part, r.height, r.page, r.y) for r in got if r.doc_id == d) == sorted(want)
    assert {r.error for r in layout.page_split(frame, 100.0, 100.0, slices=True).collect()} == {"cell too big"}


def test_contents_of_any_level(spark):
    heads = [(1, i, k) for i, k in enumerate([2, 6, 7, 9, 7, 100, 3, 9, -1, 0])]
    got = {r.pos: r.parent for r in layout.toc_tree(spark.createDataFrame(heads, "doc_id long, pos int, level int")).collect()}
    assert got == {0: None, 1: 0, 2: 1, 3: 2, 4: 1, 5: 4, 6: 0, 7: 6, 8: None, 9: 8}


def test_pairing_against_the_loop(spark):
    """Messages seconds apart, equal texts and dates that do not parse, dealt out one after the other."""
    rng = random.Random(29)

    def side():
        out = []
        for d in range(60):
            for i in range(rng.randint(0, 7)):
                minute = rng.randrange(6)
                out.append((d, i + 1, rng.choice("AB") + "@x.io", rng.choice([f"Wed, Apr 29, 2026 at 8:{10 + minute} AM", f"4/29/2026 8:{10 + minute} AM", "soon", "later"])))
        return out

    left, right = side(), side()
    when = lambda raw: int(re.search(r"8:(\d+)", raw)[1]) if "8:" in raw else None
    want = set()
    for d in range(60):
        used = set()
        for _, i, email, raw in (x for x in left if x[0] == d):
            for _, j, other, again in (y for y in right if y[0] == d):
                near = when(raw) is not None and when(again) is not None and abs(when(raw) - when(again)) <= 1
                if j not in used and email == other and (raw == again or near):
                    used.add(j)
                    want.add((d, i, j))
                    break
    schema = "doc_id long, idx int, from_email string, date_raw string"
    found = diffing.greedy_pairs(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema))
    assert {tuple(r) for r in found.collect()} == want and found.count() == len(want)


def test_bands_against_all_pairs(spark):
    rng = random.Random(31)
    rows = [(i, rng.randrange(4), None if i % 17 == 0 else rng.randrange(-4000, 4000) / 64) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, k int, v double")
    for band in (0.25, 1.0, 7.5):
        want = {i for i, k, v in rows for j, m, w in rows if i != j and k == m and v is not None and w is not None and abs(v - w) <= band}
        assert {r.id for r in geometry.band_semi(frame, frame, "k", "v", band, "id").collect()} == want
        marks = frame.filter("id % 5 = 0")
        want = {i for i, k, v in rows for j, m, w in rows if j % 5 == 0 and i != j and k == m and v is not None and w is not None and abs(v - w) <= band}
        assert {r.id for r in geometry.band_semi(frame, marks, "k", "v", band, "id").collect()} == want


def test_interpolation_against_formula(spark):
    rng = random.Random(37)
    anchors = {k: sorted({float(rng.randrange(0, 60)): rng.uniform(0, 90) for _ in range(n)}.items()) for k, n in ((1, 6), (2, 1), (3, 2), (4, 0))}
    points = [(k, float(x)) for k in anchors for x in range(-5, 66, 3)]
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    found = {(r.k, r.x): r.y for r in geometry.interpolate(frame(points, "k int, x double"), frame([(k, x, y) for k, a in anchors.items() for x, y in a], "k int, x double, y double"), "k").collect()}
    assert len(found) == len(points) - 24
    for (k, x), y in found.items():
        a = anchors[k]
        if len(a) == 1:
            want = a[0][1]
        elif x <= a[0][0]:
            want = max(0.0, a[0][1] + (x - a[0][0]) * (a[1][1] - a[0][1]) / max(1, a[1][0] - a[0][0]))
        elif x >= a[-1][0]:
            want = a[-1][1] + (x - a[-1][0]) * (a[-1][1] - a[-2][1]) / max(1, a[-1][0] - a[-2][0])
        else:
            i = max(i for i in range(len(a)) if a[i][0] <= x)
            want = a[i][1] + (x - a[i][0]) / max(1, a[i + 1][0] - a[i][0]) * (a[i + 1][1] - a[i][1])
        assert abs(y - want) < 1e-9, (k, x)


def test_styles_of_a_changed_body(spark):
    """Characters that the source has take its style, others none; lines stay; edges without text."""
    style = lambda text, bold=False, italic=False, size=0.0: (text, bold, italic, False, None, size)
    rows = [(1, "Hel lo!\n\nworld", [style("Hello ", True), style("world", False, True)]), (2, "", [style("x")]), (3, None, None), (4, "a", [])]
    frame = spark.createDataFrame(rows, f"id int, body string, runs array<{runs.RUN}>")
    got = {}
    for r in runs.replayed(frame, "body", "runs", ["id"]).orderBy("id", "line").collect():
        got.setdefault(r.id, []).append([(x.text, x.bold, x.italic) for x in r.runs])
    assert got == {1: [[("Hel", True, False), (" ", False, False), ("lo", True, False), ("!", False, False)], [], [("world", False, True)]], 2: [[]], 3: [[]], 4: [[("a", False, False)]]}


def test_recursive_scan_and_journal(spark, tmp_path):
    from threadloom.sources import files

    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.PDF").write_bytes(b"one")
    (tmp_path / "in" / "deep" / "b.pdf").write_bytes(b"two")
    (tmp_path / "in" / "deep" / "c.txt").write_bytes(b"three")
    found = files.scan(spark, f"file://{tmp_path}/in").collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.length, r.sha256) for r in found) == sorted((n, 3, hashlib.sha256(x).hexdigest()) for n, x in (("a.PDF", b"one"), ("b.pdf", b"two")))
    rows = spark.createDataFrame([(1, "gmail", "error", "é" * 3000), (2, "gmail", "ok", "")], "doc_id long, format string, severity string, raw string")
    folder = f"file://{tmp_path}/journal"
    for _ in range(2):
        payload.append_journal(payload.journal(rows), folder)
    lines = [json.loads(r.value) for r in spark.read.text(folder).collect()]
    assert len(lines) == 4 and {len(x["raw_text_excerpt_first_1k"]) for x in lines} == {1024, 0} and all(x["ts"].endswith("Z") for x in lines)
    payload.clear_journal(spark, folder)
    assert spark.read.schema("value string").text(folder).count() == 0


def test_kept_tables_are_released(spark):
    from threadloom.operators import keeping

    frame = keeping.keep(spark.range(5))
    assert frame.count() == 5
    keeping.release(spark)
    assert frame.count() == 5 and not keeping._held


STACKED = ["Mail", "", "Plan", "From Ana Ro <a@x.io>", "Date Wed, Apr 29, 2026 at 8:12 AM", "To Bo <b@x.io>", "Cc Cy <c@x.io>", "", "Hello", "On Tue, Apr 28, 2026 at 7:37AM Bo Li <b@x.io> wrote:", "older", "From: Cy <c@x.io>", "Sent: Monday", "To: Bo <b@x.io>", "Subject: Plan", "", "oldest"]
COLON = ["Shown", "From: Ana", "Subject: Row", "Date: April 29, 2026", "To: Bo <b@x.io>", "text", "From: stray <s@x.io>", "On April 28, 2026, at 8:38 AM, Bo <b@x.io> wrote:", "older", "On April 27, 2026 at 8:00 AM Cy <c@x.io> wrote:", "oldest"]


def as_lines(spark, *docs):
    return spark.createDataFrame([(d, i + 1, x) for d, rows in enumerate(docs) for i, x in enumerate(rows)], "doc_id long, line_no int, plain string")


def test_stacked(spark):
    lines = as_lines(spark, STACKED, ["no header", None])
    got = [tuple(r) for r in stacked.messages(lines, stacked.OUTLOOK).orderBy("idx").select("from_name", "from_email", "date_raw", "to", "cc", "body").collect()]
    assert got == [("Ana Ro", "a@x.io", "Wed, Apr 29, 2026 at 8:12 AM", "Bo <b@x.io>", "Cy <c@x.io>", "Hello"), ("Bo Li", "b@x.io", "Tue, Apr 28, 2026 at 7:37AM", "Ana Ro <a@x.io>", None, "older"), ("Cy", "c@x.io", "Monday", "Bo <b@x.io>", None, "\noldest")]
    assert stacked.subjects(lines, stacked.OUTLOOK).collect() == [(0, "Plan")]
    assert stacked.headless(lines, stacked.OUTLOOK).collect() == [(1,)]


def test_stacked_colons(spark):
    lines = as_lines(spark, COLON)
    got = [tuple(r) for r in stacked.messages(lines, stacked.APPLE).orderBy("idx").select("from_name", "from_email", "date_raw", "to", "body").collect()]
    assert got == [("Ana", "", "April 29, 2026", "Bo <b@x.io>", "text\nFrom: stray <s@x.io>"), ("Bo", "b@x.io", "April 28, 2026, at 8:38 AM", "", "older"), ("", "", "April 27, 2026 at 8:00 AM Cy <c@x.io> wrote", "", "oldest")]
    assert stacked.subjects(lines, stacked.APPLE).collect() == [(0, "Row")]


def test_fold_against_loop(spark):
    """Random documents, folded line by line as the rule says."""
    stamp, kinds = "Wed, Apr 29, 2026 at 8:12 AM", ["Ana <a@x.io>", "Bo <b@x.io> x", "<c@x.io>", "To: d", "", "prose", "at a@x.io.", "Wed, Apr 29, 2026 at 8:12 AM", "Di <d@x.io> Wed, Apr 29, 2026 at 8:12 AM"]
    rng = random.Random(5)
    docs = [[rng.choice(kinds[:5] + kinds[:3] + kinds[5:]) for _ in range(rng.randint(1, 14))] for _ in range(300)]

    def goes_on(x):
        return x == "" or x.startswith(("To:", "Cc:", "Bcc:", "<")) or ("@" in x and x[-1] not in ".:")

    def folded(rows):
        out, i = [], 0
        while i < len(rows):
            hit = None
            if rows[i] in kinds[:2]:
                for at in range(i + 1, min(i + 7, len(rows))):
                    if rows[at] == stamp:
                        hit = at
                    if rows[at] == stamp or not goes_on(rows[at]):
                        break
            if hit is None:
                out.append(rows[i])
                i += 1
            else:
                out += [f"{rows[i]} {stamp}", *rows[i + 1 : hit]]
                i = hit + 1
        return out

    got = {}
    for r in stacked.fold_headers(as_lines(spark, *docs)).orderBy("doc_id", "line_no").collect():
        got.setdefault(r.doc_id, []).append(r.plain)
    assert [got[d] for d in range(len(docs))] == [folded(rows) for rows in docs]


def buried(rows):
    """Places of boundaries in rows with their fields and heights, one line after another."""
    preface = re.compile(r"On (.+?\d{1,2}:\d{2}(?: AM)?),? (\w+) <([^>]+)> wrote:")
    found, i = [], 0
    while i < len(rows):
        reply, sender = preface.fullmatch(rows[i].strip()), re.fullmatch(r"From: (\w+) <([^>]+)>", rows[i].strip())
        if reply:
            found.append((i, 1, reply[2], reply[3], reply[1], ""))
        elif sender and any(re.match(r"(Sent|To|Subject): *\S", x.strip()) for x in rows[i + 1 : i + 5]):
            sent, to, height = "", "", 1
            for j, x in enumerate((x.strip() for x in rows[i + 1 : i + 6]), 2):
                label = re.match(r"(Sent|To|Subject): *(\S.*)", x)
                if label:
                    height = j
                    sent, to = (label[2] if label[1] == "Sent" else sent), (label[2] if label[1] == "To" else to)
                if x and not label or label and label[1] == "Subject":
                    break
            found.append((i, height, sender[1], sender[2], sent, to))
            i += height - 1
        i += 1
    return found


@pytest.mark.parametrize(
    ("name", "email", "repaired"),
    [
        ("Ana Ro <a@x.io>", "", ("Ana Ro", "a@x.io")), ("Ana Ro<a@x.io>", "b@x.io", ("Ana Ro", "b@x.io")), ("Ana Ro a@x.io", "a@x.io", ("Ana Ro", "a@x.io")), ("Ana Ro", "<a@x.io>", ("Ana Ro", "a@x.io")),
        ("Ana Ro a@x.io", " ", ("Ana Ro", "a@x.io")), ("A<a@x.io> <b@x.io>", "", ("A<a@x.io>", "b@x.io")), ("a@x.io", "", ("a@x.io", "")), ("Ana <team>", "", ("Ana <team>", "")), ("", "", ("", "")), ("Ana > x <", "c@x.io", ("Ana > x <", "c@x.io")),
    ],
)
def test_repair_sender(spark, name, email, repaired):
    frame = spark.createDataFrame([(name, email)], "n string, e string")
    assert tuple(frame.select(*t.repair_sender(F.col("n"), F.col("e"))).first()) == repaired


def test_jaro_winkler_against_scan():
    """Random strings against the plain search of each letter's window."""
    rng = random.Random(17)

    def scan(a, b):
        if not a or not b:
            return float(a == b)
        reach, used, left = max(len(a), len(b)) // 2 - 1, set(), []
        for i, ch in enumerate(a):
            j = next((j for j, x in enumerate(b) if x == ch and j not in used and abs(i - j) <= reach), None)
            if j is not None:
                used.add(j)
                left.append(ch)
        if not left:
            return 0.0
        m, t = len(left), sum(x != b[j] for x, j in zip(left, sorted(used), strict=True))
        jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
        p = 0
        while p < min(4, len(a), len(b)) and a[p] == b[p]:
            p += 1
        return jaro + p * 0.1 * (1 - jaro)

    for _ in range(3000):
        a, b = ("".join(rng.choice("abcd") for _ in range(rng.randrange(14))) for _ in range(2))
        assert abs(diffing.jaro_winkler(a, b) - scan(a, b)) < 1e-12


def test_embedded_boundaries(spark):
    """Random bodies of all kinds of rows against a walk over their lines."""
    kinds = ["text", " ", "", "From: Ana <a@x.io>", "  From: Bo <b@x.io> ", "Sent: today", "To: Di <d@x.io>", "To:", "Subject: s", "On May 1, 2026 at 8:12 AM Eve <e@x.io> wrote:", "On May 1 at 9:30, Flo <f@x.io> wrote:", "From: prose"]
    rng = random.Random(11)
    given = [(d, i + 1, f"N{i}", rng.choice(["", f"n{i}@x.io"]), "date", rng.choice([None, "", "T <t@x.io>"]), None, "bcc", "\n".join(rng.choice(kinds) for _ in range(rng.randint(0, 14)))) for d in range(150) for i in range(rng.randint(1, 3))]
    given.append((999, 1, None, None, None, None, None, None, None))
    expected = []
    for d in sorted({g[0] for g in given}):
        out = []
        for _, _, name, email, date, to, cc, bcc, body in (g for g in given if g[0] == d):
            rows = (body or "").split("\n")
            at = buried(rows)
            stops = [b[0] for b in at] + [len(rows)]
            out.append([name or "", email or "", date or "", to or "", cc, bcc, "\n".join(rows[: stops[0]])])
            out += [[n, e, t, o, None, None, "\n".join(rows[i + h : stop])] for (i, h, n, e, t, o), stop in zip(at, stops[1:], strict=True)]
        for k in range(1, len(out)):
            if not out[k][3].strip() and out[k - 1][1]:
                out[k][3] = f"{out[k - 1][0]} <{out[k - 1][1]}>" if out[k - 1][0] else out[k - 1][1]
        expected += [(d, k + 1, *x) for k, x in enumerate(out)]
    schema = "doc_id long, idx int, from_name string, from_email string, date_raw string, to string, cc string, bcc string, body string"
    frame = spark.createDataFrame(given, schema)
    assert [tuple(r) for r in payload.split_embedded(frame).orderBy("doc_id", "idx").collect()] == expected
    assert payload.split_embedded(frame.limit(0)).count() == 0


def test_undominated(spark):
    rng = random.Random(13)
    rows = [(p, i, float(rng.randrange(40)), float(rng.randrange(12)), float(rng.choice([4, 6, 6, 12])), 8.0, "clash") for p in range(30) for i in range(rng.randint(1, 20))]
    rows += [(99, 1, None, 1.0, 3.0, 8.0, "clash"), (99, 2, 1.0, 1.0, None, 8.0, None)]
    kept = []
    for page in {r[0] for r in rows}:
        mine = []
        for r in sorted((r for r in rows if r[0] == page), key=lambda r: (-(r[4] or 0), r[1])):
            overlap = [(min(k[2] + k[4], r[2] + r[4]) - max(k[2], r[2]), min(k[3] + k[5], r[3] + r[5]) - max(k[3], r[3])) for k in mine if None not in (*k[2:6], *r[2:6])]
            if not any(a > 0 and b > 0 and a * b / max(1, r[4] * r[5]) > 0.5 for a, b in overlap):
                mine.append(r)
        kept += mine
    frame = spark.createDataFrame(rows, "page int, msg int, x double, y double, w double, h double, kept string")
    found = geometry.undominated(frame, ["page"], ["msg"])
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, kept)) and found.columns == frame.columns
