"""Queries on whole parses: journals and reports, navigation between two documents, sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as t
from threadloom.operators import diffing, navigation, payload, report, runs, segment, stacked
from threadloom.plans.common import MAIL_SQL, NUMBERED, in_order, mail, numbered, read
from threadloom.plans.registry import query
from threadloom.sources import files
from threadloom.sources.mail import mail_lines, stacked_lines

C = F.col


def fixed_time() -> Column:
    return F.lit("2024-01-01 00:00:00").cast("timestamp")


@query(f"""WITH {MAIL_SQL}, x AS (SELECT doc_id, string_agg(plain, chr(10) ORDER BY line_no) AS raw FROM lines GROUP BY doc_id)
SELECT doc_id, '2024-01-01T00:00:00Z' AS ts, sha256(raw) AS source_sha256, 'gmail' AS format, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'warning' END AS severity, (doc_id % 7 - 3)::INT AS delta, left(raw, 1024) AS excerpt FROM x WHERE doc_id % 3 <> 0""")
def journal_rows(s: SparkSession, d: str) -> DataFrame:
    """One JSON line a document that is not ok, read back."""
    rows = mail(s, d).groupBy("doc_id").agg(in_order("line_no", "plain").alias("raw")).withColumns({"format": F.lit("gmail"), "severity": F.when(C("doc_id") % 3 == 0, "ok").when(C("doc_id") % 2 == 0, "error").otherwise("warning"), "diff": F.struct((C("doc_id") % 7 - 3).cast("int").alias("message_count_delta"))})
    lines = payload.journal(rows.filter("severity <> 'ok'"), at=fixed_time())
    schema = "doc_id long, ts string, source_sha256 string, format string, severity string, diff struct<message_count_delta:int>, raw_text_excerpt_first_1k string"
    return lines.select(F.from_json("value", schema).alias("j")).select("j.doc_id", "j.ts", "j.source_sha256", "j.format", "j.severity", C("j.diff.message_count_delta").alias("delta"), C("j.raw_text_excerpt_first_1k").alias("excerpt"))


@query("""SELECT doc_id, length(coalesce(text, ''))::INT AS input_chars, left(coalesce(text, ''), 500) AS input_excerpt, left('{' || coalesce(text, ''), 8000) AS output, length(coalesce(text, ''))::INT + 1 AS output_chars, (doc_id % 2 + 1)::INT AS attempt FROM documents""")
def answer_log(s: SparkSession, d: str) -> DataFrame:
    """A log of answers, read back; attempts carry the document's number."""
    text = F.coalesce("text", F.lit(""))
    rows = read(s, d, "documents").select((C("doc_id") * 2 + C("doc_id") % 2).alias("attempt"), text.alias("raw"), F.concat(F.lit("{"), text).alias("response"))
    schema = "attempt long, input_chars int, input_excerpt string, output string, output_chars int, ts string"
    found = payload.answer_log(rows, fixed_time()).select(F.from_json("value", schema).alias("j")).select("j.*")
    return found.select(F.expr("attempt div 2").alias("doc_id"), "input_chars", "input_excerpt", "output", "output_chars", (C("attempt") % 2 + 1).cast("int").alias("attempt"))


#: Two parses' counts and what comparing them said, by document.
COMPARED = """WITH f AS (SELECT DISTINCT conv_id AS doc_id FROM conversations), r AS (SELECT doc_id, 't' || doc_id || '.pdf' AS file, CASE WHEN doc_id % 2 = 0 THEN 'gmail' ELSE 'outlook' END AS format, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 9)::INT END AS heur_message_count, CASE WHEN doc_id % 7 <> 0 THEN (doc_id % 8)::INT END AS ai_message_count, doc_id % 3 = 0 AS mismatch, round(1 - doc_id % 4 / 100, 2) AS worst, ['ok', 'warning', 'error'][doc_id % 3 + 1] AS sev FROM f),
rows AS (SELECT file, format, heur_message_count, ai_message_count, CASE WHEN doc_id % 35 = 0 OR doc_id % 5 = 0 OR doc_id % 7 = 0 THEN false ELSE NOT mismatch END AS subject_match, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 0.0 ELSE worst END::DOUBLE AS worst_body_sim, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'warning' ELSE sev END AS severity, CASE WHEN doc_id % 35 = 0 THEN 'both engines unavailable (format=' || format || ')' WHEN doc_id % 5 = 0 THEN 'no heuristic for format=' || format WHEN doc_id % 7 = 0 THEN 'ai unavailable' ELSE 'note ' || doc_id END AS note FROM r)"""


def compared(s: SparkSession, d: str) -> DataFrame:
    docs, k = read(s, d, "conversations").select(C("conv_id").alias("doc_id")).distinct(), C("doc_id")
    named = docs.select("doc_id", F.concat(F.lit("t"), k, F.lit(".pdf")).alias("file"), F.when(k % 2 == 0, "gmail").otherwise("outlook").alias("format"))
    said = docs.select("doc_id", (k % 3 == 0).alias("subject_mismatch"), F.round(1 - k % 4 / 100, 2).alias("worst"), F.element_at(F.array(F.lit("ok"), F.lit("warning"), F.lit("error")), (k % 3 + 1).cast("int")).alias("severity"), F.concat(F.lit("note "), k).alias("note"))
    return report.corpus_report(named, docs.filter(k % 5 != 0).withColumn("messages", k % 9), docs.filter(k % 7 != 0).withColumn("messages", k % 8), said)


@query(COMPARED + " SELECT * FROM rows")
def corpus_report(s: SparkSession, d: str) -> DataFrame:
    return compared(s, d)


@query(COMPARED + """, m AS (SELECT 4 AS part, file, '| ' || file || ' | ' || format || ' | ' || coalesce(heur_message_count::VARCHAR, '—') || '/' || coalesce(ai_message_count::VARCHAR, '—') || ' | ' || CASE WHEN subject_match THEN 'match' ELSE '—' END || ' | ' || printf('%.2f', worst_body_sim) || ' | ' || severity || ' | ' || note || ' |' AS value FROM rows)
SELECT * FROM m UNION ALL SELECT 0, '', '# Differential report' UNION ALL SELECT 1, '', '' UNION ALL SELECT 2, '', '| File | Format | Msgs (h/ai) | Subject | Worst body sim | Severity | Note |' UNION ALL SELECT 3, '', '|------|--------|-------------|---------|----------------|----------|------|' UNION ALL SELECT 5, '', ''
UNION ALL SELECT 6, '', 'Errors: ' || count(*) FILTER (severity = 'error') || '  Warnings: ' || count(*) FILTER (severity = 'warning') || '  Total: ' || count(*) FROM rows""")
def markdown_report(s: SparkSession, d: str) -> DataFrame:
    return report.markdown(compared(s, d), "Differential report")


@query(COMPARED + """ SELECT file, 'File:      ' || file || chr(10) || 'Format:    ' || format || chr(10) || 'Messages:  heur=' || coalesce(heur_message_count::VARCHAR, '—') || '  ai=' || coalesce(ai_message_count::VARCHAR, '—') || chr(10) || 'Subject:   ' || CASE WHEN subject_match THEN 'match' ELSE 'MISMATCH' END || chr(10) || 'Body sim:  ' || printf('%.2f', worst_body_sim) || chr(10) || 'Severity:  ' || severity || chr(10) || 'Note:      ' || note AS value FROM rows""")
def single_reports(s: SparkSession, d: str) -> DataFrame:
    return report.single(compared(s, d))


@query(COMPARED + """ SELECT file, '{' || coalesce('"ai_message_count":' || ai_message_count || ',', '') || '"file":"' || file || '","format":"' || format || '",' || coalesce('"heur_message_count":' || heur_message_count || ',', '') || '"note":"' || note || '","severity":"' || severity || '","subject_match":' || subject_match || ',"worst_body_sim":' || worst_body_sim || '}' AS value FROM rows""")
def json_reports(s: SparkSession, d: str) -> DataFrame:
    return report.json_rows(compared(s, d))


@query(COMPARED + " SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) AS total FROM rows")
def severity_counts(s: SparkSession, d: str) -> DataFrame:
    return report.severity_counts(compared(s, d))


@query(f"SELECT l_orderkey AS doc_id, coalesce(min(CASE WHEN l_partkey % 3 > 0 THEN 1 - l_quantity / 100 END), 1) AS worst FROM {NUMBERED} GROUP BY l_orderkey")
def worst_similarity(s: SparkSession, d: str) -> DataFrame:
    return report.worst_similarity(numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.when(C("l_partkey") % 3 > 0, 1 - C("l_quantity") / 100).alias("similarity")))


@query(f"""WITH n AS (SELECT l_orderkey AS doc_id, l_linenumber AS id, l_partkey % 3 AS k, count(*) OVER (PARTITION BY l_orderkey) + 1 - l_linenumber AS back FROM {NUMBERED}), p AS (SELECT doc_id, id, CASE WHEN k <> 0 THEN id END::INT AS l_idx, CASE WHEN k <> 1 THEN back END::INT AS r_idx FROM n)
SELECT a.doc_id, a.id, a.l_idx, a.r_idx, (1 + count(b.id))::INT AS place FROM p a LEFT JOIN p b ON b.doc_id = a.doc_id AND (coalesce(b.l_idx, b.r_idx) < coalesce(a.l_idx, a.r_idx) OR (coalesce(b.l_idx, b.r_idx) = coalesce(a.l_idx, a.r_idx) AND b.l_idx IS NOT NULL AND a.l_idx IS NULL)) GROUP BY ALL""")
def pair_order(s: SparkSession, d: str) -> DataFrame:
    """All items of an order: pairs that run against each other, and unpaired ones of either side."""
    k, back = C("l_partkey") % 3, F.count("*").over(Window.partitionBy("l_orderkey")) + 1 - C("l_linenumber")
    rows = numbered(s, d).select(C("l_orderkey").alias("doc_id"), F.when(k != 0, C("l_linenumber")).alias("l_idx"), F.when(k != 1, back.cast("int")).alias("r_idx"), C("l_linenumber").alias("id"))
    return diffing.in_pair_order(rows)


@query("""WITH t AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx, count(*) OVER (PARTITION BY conv_id) AS n, CASE WHEN conv_id % 4 = 0 THEN 'same' ELSE 'd' || turn END AS date_raw FROM conversations)
SELECT doc_id, CASE WHEN n = 1 THEN a ELSE a || ' – ' || b END AS oldest, CASE WHEN n = 1 OR a = b THEN a ELSE b || ' — ' || a END AS newest FROM (SELECT doc_id, any_value(n) AS n, arg_min(date_raw, idx) AS a, arg_max(date_raw, idx) AS b FROM t GROUP BY doc_id)""")
def date_ranges(s: SparkSession, d: str) -> DataFrame:
    found = read(s, d, "conversations").select(C("conv_id").alias("doc_id"), F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("idx"), F.when(C("conv_id") % 4 == 0, "same").otherwise(F.concat(F.lit("d"), "turn")).alias("date_raw"))
    return diffing.date_range(found).withColumnRenamed("date_range", "oldest").join(diffing.date_range(found, newest_first=True).withColumnRenamed("date_range", "newest"), "doc_id")


@query("SELECT c_custkey, c_custkey % 3 <> 2 AS equal FROM customer")
def address_sets(s: SparkSession, d: str) -> DataFrame:
    """Lists of addresses in another order, case and number, and with one address more."""
    a = F.concat(F.lit("A <a@x.io>, b"), C("c_custkey"), F.lit("@x.io"))
    k = C("c_custkey") % 3
    b = F.when(k == 0, F.concat(F.lit("B"), C("c_custkey"), F.lit("@X.io; <A@x.IO>; a@x.io"))).when(k == 1, a).otherwise(F.concat(a, F.lit(", c@x.io")))
    return read(s, d, "customer").select("c_custkey", (t.address_set(a) == t.address_set(b)).alias("equal"))


@query("SELECT conv_id AS doc_id, 's' || min(turn) AS subject, string_agg(role, ' ' ORDER BY turn, k) AS roles FROM conversations, (VALUES (0), (1)) v(k) WHERE k = 0 OR turn % 2 = 0 GROUP BY conv_id")
def payload_chunks(s: SparkSession, d: str) -> DataFrame:
    """Payloads of a conversation's turns, one or two messages each, put together."""
    one = F.struct(C("role").alias("from_name"))
    parts = read(s, d, "conversations").select(C("conv_id").alias("doc_id"), C("turn").alias("chunk"), F.struct(F.concat(F.lit("s"), "turn").alias("subject"), F.when(C("turn") % 2 == 0, F.array(one, one)).otherwise(F.array(one)).alias("messages")).alias("payload"))
    return payload.reconcile(parts).select("doc_id", "subject", F.array_join(F.transform("messages", lambda m: m["from_name"]), " ").alias("roles"))


@query("""WITH p AS (SELECT conv_id AS doc_id, turn, role FROM conversations WHERE conv_id % 3 <> 0), f AS (SELECT conv_id AS doc_id, turn, 'f' AS role FROM conversations WHERE conv_id % 5 <> 0)
SELECT doc_id, turn, role, 'primary' AS reader FROM p UNION ALL SELECT doc_id, turn, role, 'fallback' FROM f WHERE doc_id NOT IN (SELECT doc_id FROM p)""")
def source_fallback(s: SparkSession, d: str) -> DataFrame:
    rows = read(s, d, "conversations").select(C("conv_id").alias("doc_id"), "turn", "role")
    return files.with_fallback(rows.select("doc_id").distinct(), rows.filter("doc_id % 3 <> 0"), rows.filter("doc_id % 5 <> 0").withColumn("role", F.lit("f")))


@query("""WITH t AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS idx, upper(role[1]) || lower(role[2:]) || ' ' || conv_id AS from_name FROM conversations) SELECT doc_id, idx, from_name, ['gmail', 'outlook', 'apple'][doc_id % 4 + 1] AS format FROM t WHERE doc_id % 4 < 3""")
def parse_formats(s: SparkSession, d: str) -> DataFrame:
    """Three formats by their own parsers, and a fourth without one."""
    talk, k = read(s, d, "conversations"), C("conv_id") % 4
    lines = mail_lines(talk.filter(k.isin(0, 3))).unionByName(stacked_lines(talk.filter(k == 1), colons=False)).unionByName(stacked_lines(talk.filter(k == 2), colons=True))
    formats = talk.select(C("conv_id").alias("doc_id"), F.when(k == 0, "gmail").when(k == 1, "outlook").when(k == 2, "apple").otherwise("unknown").alias("format")).distinct()
    parsers = {"gmail": segment.messages, "outlook": lambda x: stacked.messages(x, stacked.OUTLOOK), "apple": lambda x: stacked.messages(x, stacked.APPLE)}
    return files.parse_all(lines, formats, parsers).select("doc_id", "idx", "from_name", "format")


@query("SELECT n_regionkey AS doc_id, n_nationkey AS page, n_name AS name, 0 AS part FROM nation UNION ALL SELECT r_regionkey, 0, r_name, 1 FROM region")
def stacked_documents(s: SparkSession, d: str) -> DataFrame:
    nations = read(s, d, "nation").select(C("n_regionkey").alias("doc_id"), C("n_nationkey").alias("page"), C("n_name").alias("name"))
    regions = read(s, d, "region").select(C("r_regionkey").alias("doc_id"), F.lit(0).alias("page"), C("r_name").alias("name"))
    return files.stacked_documents([nations, regions])


TURNS = """WITH m AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS idx, count(*) OVER (PARTITION BY conv_id) AS n, turn, role FROM conversations)"""


def turns(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    return read(s, d, "conversations").select(C("conv_id").alias("doc_id"), F.row_number().over(w).alias("idx"), F.concat(F.lit("stamp number "), "turn", F.lit(".")).alias("date_raw"), C("role").alias("from_name"))


@query(TURNS + """, p AS (SELECT doc_id, idx, idx * 10 AS lp, n - n + idx * 7 + 3 AS rp, idx % 4 = 0 AS dated FROM m)
SELECT doc_id, idx, 'heading' AS kind, (lp * 100.0)::DOUBLE AS left, (rp * 50.0 + CASE WHEN dated THEN 1 ELSE 0 END)::DOUBLE AS right FROM p UNION ALL SELECT doc_id, idx, 'line', (lp * 100.0 + 5)::DOUBLE, (rp * 50.0 + 6)::DOUBLE FROM p WHERE idx % 3 <> 0""")
def anchors(s: SparkSession, d: str) -> DataFrame:
    """Messages on pages of their own on both sides; every fourth heading is not found and taken from its date, every third message has no long line."""
    m, k = turns(s, d), C("idx")
    line = F.concat(F.lit("a body line of more than twenty-five characters, of "), k, F.lit(" and what follows beyond the needle"))
    body = m.filter("idx % 3 <> 0").select("doc_id", "idx", F.lit(2).alias("pos"), line.alias("plain")).unionByName(m.select("doc_id", "idx", F.lit(1).alias("pos"), F.lit("Hi,").alias("plain")))
    left, right = k * 10, k * 7 + 3
    at = lambda page, y, text: m.select("doc_id", page.alias("page"), y.cast("double").alias("y"), text.alias("text"))
    original = at(left, left * 100, F.concat(F.lit("On "), "date_raw")).unionByName(at(left, left * 100 + 5, line)).unionByName(at(F.lit(1), F.lit(1), F.lit("a body line of more than twenty-five characters, of 0")))
    heading = F.when(k % 4 == 0, F.concat(k, F.lit(". Someone else"))).otherwise(F.concat(k, F.lit(". "), "from_name"))
    cleaned = at(right, right * 50, heading).unionByName(at(right, right * 50 + 1, C("date_raw"))).unionByName(at(right, right * 50 + 6, line)).unionByName(at(F.lit(0), k, C("date_raw")))
    return navigation.anchors(m, body, original, cleaned)


@query(TURNS + """, p AS (SELECT doc_id, idx, (idx + 2)::INT AS target FROM m)
SELECT doc_id, 0 AS page, '[' || idx || ']' AS needle, target, 98.5::DOUBLE AS x, 98.5::DOUBLE AS y, 23.0::DOUBLE AS w, 13.0::DOUBLE AS h FROM p UNION ALL SELECT doc_id, 9999, idx || '.', target, 98.5, 98.5, 23.0, 13.0 FROM p
UNION ALL SELECT doc_id, b, idx || '', target, 38.0, 98.0, 24.0, 14.0 FROM p, (VALUES (1), (2)) v(b) UNION ALL SELECT DISTINCT doc_id, 5, 'Index', 0, 98.0, 708.0, 24.0, 14.0 FROM p""")
def link_targets(s: SparkSession, d: str) -> DataFrame:
    """Boxes that link and, beside them, some that do not: a message's own heading, numbers out of the first column or the index, too tall ones, headings of the index."""
    m = turns(s, d)
    box = lambda rows, page, needle, x, y, h: rows.select("doc_id", F.lit(page).alias("page") if isinstance(page, int) else page.alias("page"), needle.alias("needle"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), F.lit(20.0).alias("w"), F.lit(float(h)).alias("h"))
    n, docs = C("idx").cast("string"), m.select("doc_id").distinct()
    hits = [box(m, 0, F.concat(F.lit("["), n, F.lit("]")), 100, 100, 10), box(m, 9999, F.concat(n, F.lit(".")), 100, 100, 10), box(m, (C("idx") + 2).cast("int"), F.concat(n, F.lit(".")), 100, 100, 10), box(m, 1, n, 40, 100, 10), box(m, 2, n, 40, 100, 10), box(m, 1, n, 80, 100, 10), box(m, 1, n, 40, 100, 20), box(m, 9000, n, 40, 100, 10)]
    hits += [box(docs, 1, F.lit("Index of Communications"), 40, 700, 20), box(docs, 5, F.lit("Index"), 100, 710, 10), box(docs, 0, F.lit("Index"), 100, 710, 10), box(docs, 5, F.lit("Index"), 100, 600, 10), box(docs, 5, F.lit("Index"), 100, 710, 20)]
    every = hits[0]
    for x in hits[1:]:
        every = every.unionByName(x)
    return navigation.link_boxes(every, m.select("doc_id", "idx", (C("idx") + 2).cast("int").alias("page")))


@query(TURNS + """, l AS (SELECT doc_id, idx, 'one two three ' || idx || '.' AS a, 'four five six seven ' || idx || '.' AS b FROM m)
SELECT doc_id, idx, a || ' ' || b AS text, idx AS page, 1.0::DOUBLE AS y FROM l WHERE idx % 2 = 0 UNION ALL SELECT doc_id, idx, CASE WHEN idx < 10 THEN 'one two' ELSE 'one two three' END, idx, 1.0 FROM l WHERE idx % 2 = 1 UNION ALL SELECT doc_id, idx, 'five six seven ' || idx || '.', idx, 2.0 FROM l WHERE idx % 2 = 1""")
def fragment_lines(s: SparkSession, d: str) -> DataFrame:
    """Underlined texts, in two runs each, that stand on one line or are broken between two; those of other pages do not count. A broken one is cut behind `four`, which no line has with what is before it."""
    m, k = turns(s, d), C("idx")
    a, b = F.concat(F.lit("one two three "), k, F.lit(".")), F.concat(F.lit("four five six seven "), k, F.lit("."))
    styled = F.array(runs.run(F.lit("plain ")), runs.run(F.concat(F.lit(" "), a), underline=F.lit(True)), runs.run(F.concat(F.lit(" "), b, F.lit(" ")), underline=F.lit(True), bold=F.lit(True)), runs.run(F.lit("end")))
    fragments = m.select("doc_id", "idx", F.explode(navigation.underlined_fragments(styled)).alias("text"), k.alias("low"), (k + 1).alias("high"))
    line = lambda cond, page, y, text: m.filter(cond).select("doc_id", page.alias("page"), F.lit(y).alias("y"), text.alias("text"))
    whole = F.concat(F.lit("x "), a, F.lit(" "), b)
    lines = line(k % 2 == 0, k, 1.0, whole).unionByName(line(k % 2 == 1, k, 1.0, F.concat(F.lit("x "), a))).unionByName(line(k % 2 == 1, k, 2.0, b)).unionByName(line(k > 0, k + 1, 9.0, b))
    return navigation.fragment_lines(fragments, lines)
