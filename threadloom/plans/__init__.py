"""Queries by name over the driver's tables, and DuckDB SQL for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadloom.functions import text as t
from threadloom.operators import chrome, diffing, geometry, layout, payload, segment, stacked
from threadloom.operators.keeping import keep
from threadloom.plans.common import NUMBERED, mail, nation_grid, numbered
from threadloom.plans.registry import FOUND, Query, query
from threadloom.sources.mail import MAIL_SQL, read, stacked_lines


HEADER = r"""regexp_matches(plain, '\s\w{3},\s\w{3}\s\d{1,2},\s\d{4}\sat\s\d{1,2}:\d{2}\s(AM|PM)\s*$') AND regexp_matches(plain, '^.+?\s+<[^>]+>')"""
BLOCKS = f"WITH {MAIL_SQL}, marked AS (SELECT *, (sum(({HEADER})::INT) OVER (PARTITION BY doc_id ORDER BY line_no))::INT AS idx FROM lines), blocks AS (SELECT *, (row_number() OVER (PARTITION BY doc_id, idx ORDER BY line_no))::INT AS pos FROM marked)"
FIELDS = r""", fields AS (SELECT doc_id, idx, trim(regexp_extract(plain, '^(.+?)\s+<', 1)) AS from_name, regexp_extract(plain, '<([^>]+)>', 1) AS from_email, regexp_extract(plain, '(\w{3},\s\w{3}\s\d{1,2},\s\d{4}\sat\s\d{1,2}:\d{2}\s(?:AM|PM))\s*$', 1) AS date_raw FROM blocks WHERE idx > 0 AND pos = 1)"""
ROWS = r""", lab AS (SELECT *, nullif(regexp_extract(plain, '^(To|Cc|Bcc):', 1), '') AS label FROM blocks WHERE idx > 0 AND pos > 1), car AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY doc_id, idx ORDER BY pos) AS carried FROM lab),
stops AS (SELECT *, min(CASE WHEN NOT (label IS NOT NULL OR ((contains(plain, '<') OR contains(plain, '@')) AND carried IS NOT NULL)) THEN pos END) OVER (PARTITION BY doc_id, idx) AS stop FROM car),
hrows AS (SELECT doc_id, idx, pos, carried AS label, trim(regexp_replace(plain, '^(To|Cc|Bcc):', '')) AS value FROM stops WHERE stop IS NULL OR pos < stop)"""
BODY = ROWS + r""", b0 AS (SELECT b.* FROM blocks b ANTI JOIN hrows h ON b.doc_id = h.doc_id AND b.idx = h.idx AND b.pos = h.pos WHERE b.idx > 0 AND b.pos > 1),
b1 AS (SELECT *, min(CASE WHEN regexp_matches(plain, '^On\s+\w{3},?\s+.*<[^>]*@[^>]*>\s+wrote:\s*$') THEN pos END) OVER (PARTITION BY doc_id, idx) AS cut FROM b0),
b2 AS (SELECT * FROM b1 WHERE (cut IS NULL OR pos < cut) AND trim(plain) <> '[Quoted text hidden]'),
b3 AS (SELECT *, min(CASE WHEN trim(plain) <> '' THEN pos END) OVER (PARTITION BY doc_id, idx) AS a, max(CASE WHEN trim(plain) <> '' THEN pos END) OVER (PARTITION BY doc_id, idx) AS z FROM b2),
body AS (SELECT doc_id, idx, pos, plain FROM b3 WHERE pos BETWEEN a AND z)"""
SUBJECTS = r""", cand AS (SELECT doc_id, arg_max(trim(plain), (length(trim(plain)), -line_no)) AS subject FROM blocks WHERE idx = 0 AND trim(plain) <> '' AND NOT ends_with(trim(plain), 'messages') AND NOT contains(plain, '@') GROUP BY doc_id),
subjects AS (SELECT d.doc_id, coalesce(subject, '(No subject)') AS subject FROM (SELECT DISTINCT doc_id FROM blocks) d LEFT JOIN cand USING (doc_id))"""


@query(BLOCKS + FIELDS + SUBJECTS + """, per AS (SELECT doc_id, count(*) AS n_messages, arg_min(date_raw, idx) AS first_date, arg_max(date_raw, idx) AS last_date FROM fields GROUP BY doc_id)
SELECT doc_id, subject, n_messages, CASE WHEN n_messages = 1 THEN first_date ELSE first_date || ' – ' || last_date END AS date_range, sha256(subject || '|' || first_date)[1:10] AS uid_head FROM per JOIN subjects USING (doc_id)""")
def thread_summary(s: SparkSession, d: str) -> DataFrame:
    cut = segment.segment(mail(s, d))
    per = segment.header_fields(cut).groupBy("doc_id").agg(F.count("*").alias("n_messages"), F.min_by("date_raw", "idx").alias("first_date"), F.max_by("date_raw", "idx").alias("last_date"))
    span = F.when(F.col("n_messages") == 1, F.col("first_date")).otherwise(F.concat("first_date", F.lit(" – "), "last_date"))
    return per.join(segment.subjects(cut), "doc_id").select("doc_id", "subject", "n_messages", span.alias("date_range"), F.substring(F.sha2(F.concat_ws("|", "subject", "first_date"), 256), 1, 10).alias("uid_head"))


@query(BLOCKS + " SELECT doc_id, line_no, idx, pos FROM blocks")
def segment_messages(s: SparkSession, d: str) -> DataFrame:
    return segment.segment(mail(s, d)).select("doc_id", "line_no", "idx", "pos")


@query(BLOCKS + FIELDS + " SELECT * FROM fields")
def header_fields(s: SparkSession, d: str) -> DataFrame:
    return segment.header_fields(segment.segment(mail(s, d))).drop("inline_to")


@query(BLOCKS + ROWS + " SELECT * FROM hrows")
def header_continuation(s: SparkSession, d: str) -> DataFrame:
    return segment.header_rows(segment.segment(mail(s, d)))


@query(BLOCKS + BODY + " SELECT doc_id, idx, pos, plain FROM body")
def strip_quoted_tail(s: SparkSession, d: str) -> DataFrame:
    return segment.bodies(segment.segment(mail(s, d)))


@query(BLOCKS + FIELDS + ROWS + """, r AS (SELECT doc_id, idx, string_agg(value, ' ' ORDER BY pos) FILTER (label = 'To') AS t FROM hrows GROUP BY doc_id, idx), m AS (SELECT f.*, coalesce(t, '') AS t FROM fields f LEFT JOIN r USING (doc_id, idx))
SELECT doc_id, idx, CASE WHEN t = '' THEN coalesce(lag(from_name || ' <' || from_email || '>') OVER (PARTITION BY doc_id ORDER BY idx), '') ELSE t END AS "to" FROM m""")
def recipient_backfill(s: SparkSession, d: str) -> DataFrame:
    return segment.backfill_to(segment.messages(mail(s, d))).select("doc_id", "idx", "to")


@query(BLOCKS + SUBJECTS + " SELECT * FROM subjects")
def subject_infer(s: SparkSession, d: str) -> DataFrame:
    return segment.subjects(segment.segment(mail(s, d)))


@query(f"WITH {MAIL_SQL} SELECT doc_id, line_no, plain FROM lines WHERE trim(plain) = '' OR NOT (starts_with(plain, 'https://mail.google.com/') OR regexp_matches(trim(plain), '^\\d+/\\d+$'))")
def chrome_lines(s: SparkSession, d: str) -> DataFrame:
    return chrome.drop_chrome(mail(s, d))


#: What printing puts between a text's lines, with spaces as they come.
BAND = " 4/30/26,  3:48 AM  on; line\nGmail -  Re: a (b) 12 next Project Falcon & Co-op 2;  line 4060 end Xy; Zw; line 7 "


@query(r"""SELECT doc_id, replace(regexp_replace(regexp_replace(regexp_replace(t, '\d{1,2}/\d{1,2}/\d{2},[\s\p{Z}]*\d{1,2}:\d{2}[\s\p{Z}]*(AM|PM)[\s\p{Z}]*', '', 'g'), 'Gmail[\s\p{Z}]*-[\s\p{Z}]*[^\n]+?[\s\p{Z}]\d+[\s\p{Z}]', '', 'g'), '[A-Z][\p{L}\p{M}\p{Nd}\p{Pc}&;\s\p{Z}\-]+;[\s\p{Z}]*line[\s\p{Z}]+\d+[\s\p{Z}]', '', 'g'), '  ', ' ') AS text
FROM (SELECT doc_id, coalesce(text, '') || E'""" + BAND.replace("\n", "\\n") + """' AS t FROM documents)""")
def inline_chrome(s: SparkSession, d: str) -> DataFrame:
    return read(s, d, "documents").select("doc_id", chrome.strip_inline(F.concat(F.coalesce("text", F.lit("")), F.lit(BAND))).alias("text"))


@query(f"""WITH {MAIL_SQL}, docs AS (SELECT doc_id, string_agg(plain, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY doc_id),
p AS (SELECT doc_id, CASE WHEN contains(text, 'mail.google.com') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(left(text, 400), '\\bGmail\\s*[-–]') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(text, '\\b\\w{{3}},\\s+\\w{{3}}\\s+\\d{{1,2}},\\s+\\d{{4}}\\s+at\\s+\\d{{1,2}}:\\d{{2}}\\s*(AM|PM)') THEN 1 ELSE 0 END AS g, CASE WHEN regexp_matches(text, '\\b\\w+\\s+\\d{{1,2}},\\s+\\d{{4}}\\s+at\\s+\\d{{1,2}}:\\d{{2}}(:\\d{{2}})?\\s*(AM|PM)') THEN 1 ELSE 0 END AS a FROM docs)
SELECT doc_id, CASE WHEN g > a THEN 'gmail' WHEN a > g THEN 'appleMail' ELSE 'unknown' END AS format, greatest(g, a)::INT AS score FROM p""")
def detect_format(s: SparkSession, d: str) -> DataFrame:
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "plain"))), lambda x: x["plain"]), "\n")
    return chrome.detect_format(mail(s, d).groupBy("doc_id").agg(text.alias("text")))


@query(BLOCKS + FIELDS + """ SELECT doc_id, idx, from_name, from_email, strftime(strptime(regexp_replace(date_raw, '^\\w{3},\\s', ''), '%b %-d, %Y at %-I:%M %p'), '%Y-%m-%d %H:%M:%S') AS at FROM fields""")
def spaced_headers(s: SparkSession, d: str) -> DataFrame:
    """Headers as some systems print them: a narrow no-break space ahead of AM and PM, no-break ones elsewhere."""
    plain = F.when(segment.is_header(F.col("plain")), F.regexp_replace(F.regexp_replace("plain", " (AM|PM)$", "\u202f$1"), " (<|at )", "\u00a0$1")).otherwise(F.col("plain"))
    f = segment.header_fields(segment.segment(mail(s, d).withColumn("plain", plain)))
    return f.select("doc_id", "idx", "from_name", "from_email", F.date_format(t.parse_date(F.col("date_raw")), "yyyy-MM-dd HH:mm:ss").alias("at"))


@query(BLOCKS + FIELDS + r""" SELECT doc_id, idx, lower(trim(from_name)) AS name, lower(from_email) AS email, strftime(strptime(regexp_replace(date_raw, '^\w{3},\s', ''), '%b %-d, %Y at %-I:%M %p'), '%Y-%m-%d %H:%M:%S') AS at, [lower(from_email)] AS addresses FROM fields""")
def normalize_fields(s: SparkSession, d: str) -> DataFrame:
    f, c = segment.header_fields(segment.segment(mail(s, d))), F.col
    return f.select("doc_id", "idx", t.norm_name(c("from_name")).alias("name"), t.norm_email(c("from_email")).alias("email"), F.date_format(t.parse_date(c("date_raw")), "yyyy-MM-dd HH:mm:ss").alias("at"), t.address_set(F.concat(F.lit("x <"), "from_email", F.lit(">"))).alias("addresses"))


@query(r"""SELECT doc_id, lower(trim(regexp_replace(coalesce(text, ''), '[\s•·*-]+', ' ', 'g'))) AS body, regexp_replace(regexp_replace(lower(trim('Re: FWD : ' || coalesce(text, ''), ' ')), '^((re|fw|fwd)\s*:\s*)+', ''), ' +', ' ', 'g') AS subject FROM documents""")
def normalize_text(s: SparkSession, d: str) -> DataFrame:
    body = F.coalesce("text", F.lit(""))
    return read(s, d, "documents").select("doc_id", t.norm_body(body).alias("body"), t.norm_subject(F.concat(F.lit("Re: FWD : "), body)).alias("subject"))


def other_parse(found: DataFrame) -> DataFrame:
    """A second parse to compare with: some messages lost, some dates a minute off, some names changed, bodies lost and recipients swapped."""
    c = F.col
    late = F.date_format(t.parse_date(c("date_raw")) + F.expr("make_interval(0,0,0,0,0,1,0)") * (c("idx") % 2), "EEE, MMM d, yyyy 'at' h:mm a")
    return found.filter("(doc_id * 7 + idx) % 11 <> 0").withColumns({"date_raw": late, "from_name": F.when(c("idx") % 7 == 3, F.lit("Other")).otherwise(c("from_name")), "body": F.when(c("idx") % 5 == 4, F.lit("")).otherwise(c("body")), "to": F.when(c("idx") % 6 == 5, F.lit("Else <else@example.com>")).otherwise(c("to"))})


LEFT_RIGHT = BLOCKS + FIELDS + ", l AS (SELECT doc_id, idx, from_email FROM fields), r AS (SELECT doc_id, idx, from_email FROM fields WHERE (doc_id * 7 + idx) % 11 <> 0)"


@query(LEFT_RIGHT + """, lk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, from_email ORDER BY idx) AS k FROM l), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, from_email ORDER BY idx) AS k FROM r)
SELECT lk.doc_id, lk.idx AS l_idx, rk.idx AS r_idx FROM lk JOIN rk USING (doc_id, from_email, k)""")
def pair_sender_position(s: SparkSession, d: str) -> DataFrame:
    found = segment.header_fields(segment.segment(mail(s, d)))
    return diffing.sender_pairs(found, found.filter("(doc_id * 7 + idx) % 11 <> 0"))


@query(LEFT_RIGHT + """, lk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM l), rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS k FROM r)
SELECT coalesce(lk.doc_id, rk.doc_id) AS doc_id, lk.idx AS l_idx, rk.idx AS r_idx FROM lk FULL JOIN rk ON lk.doc_id = rk.doc_id AND lk.k = rk.k""")
def pair_position_full_outer(s: SparkSession, d: str) -> DataFrame:
    found = segment.header_fields(segment.segment(mail(s, d)))
    return diffing.position_pairs(found, found.filter("(doc_id * 7 + idx) % 11 <> 0"))


#: Both parses' messages and their pairs: at most one message of a sender lies within a minute of another parse's, so the first pass pairs all that both have, and what is left has no partner.
DIFFS = BLOCKS + FIELDS + BODY + r""", r AS (SELECT doc_id, idx, string_agg(value, ' ' ORDER BY pos) FILTER (label = 'To') AS t, string_agg(value, ' ' ORDER BY pos) FILTER (label = 'Cc') AS cc FROM hrows GROUP BY doc_id, idx), bt AS (SELECT doc_id, idx, string_agg(plain, chr(10) ORDER BY pos) AS body FROM body GROUP BY doc_id, idx),
m AS (SELECT f.*, coalesce(t, '') AS t, coalesce(cc, '') AS cc, coalesce(body, '') AS body, strptime(regexp_replace(date_raw, '^\w{3},\s', ''), '%b %-d, %Y at %-I:%M %p') AS stamp FROM fields f LEFT JOIN r USING (doc_id, idx) LEFT JOIN bt USING (doc_id, idx)),
o AS (SELECT doc_id, idx, from_email, CASE WHEN idx % 7 = 3 THEN 'Other' ELSE from_name END AS from_name, stamp + to_minutes((idx % 2)::INT) AS stamp, CASE WHEN idx % 6 = 5 THEN 'Else <else@example.com>' ELSE t END AS t, cc, CASE WHEN idx % 5 = 4 THEN '' ELSE body END AS body FROM m WHERE (doc_id * 7 + idx) % 11 <> 0),
n AS (SELECT m.doc_id, m.idx AS l_idx, o.idx AS r_idx, o.idx IS NOT NULL AS paired, m.from_name AS ln, o.from_name AS rn, m.t AS lt, o.t AS rt, trim(regexp_replace(lower(m.body), '[\s\p{Z}•·*-]+', ' ', 'g')) AS lb, trim(regexp_replace(lower(o.body), '[\s\p{Z}•·*-]+', ' ', 'g')) AS rb
FROM m LEFT JOIN o ON m.doc_id = o.doc_id AND m.from_email = o.from_email AND abs(epoch(m.stamp) - epoch(o.stamp)) <= 60),
d AS (SELECT doc_id, l_idx, r_idx, paired, paired AND ln = rn AS from_matches, paired AS date_matches, paired AND list_sort(list_distinct(regexp_extract_all(lower(lt), '[a-z0-9._%+-]+@[a-z0-9.-]+'))) = list_sort(list_distinct(regexp_extract_all(lower(rt), '[a-z0-9._%+-]+@[a-z0-9.-]+'))) AS to_matches, paired AS cc_matches, paired AND lb = rb AS body_equal,
CASE WHEN coalesce(rb, '') = lb AND length(lb) <> 1 THEN 1.0 ELSE 0.0 END::DOUBLE AS similarity FROM n),
diffs AS (SELECT *, (CASE WHEN NOT paired OR NOT from_matches OR similarity < 0.85 THEN 2 WHEN NOT date_matches OR NOT to_matches OR similarity < 0.95 THEN 1 ELSE 0 END)::INT AS rank FROM d)"""


@query(DIFFS + " SELECT * FROM diffs")
def message_diff(s: SparkSession, d: str) -> DataFrame:
    return diffs_of(keep(segment.messages(mail(s, d))))


def diffs_of(left: DataFrame) -> DataFrame:
    """The parse, kept because three passes of pairing read it, against a second one."""
    right = other_parse(left)
    diff = diffing.similarity(diffing.message_diff(left, right, diffing.pair_messages(left, right)), "l_body", "r_body")
    return diff.withColumn("rank", diffing.message_severity(F.col("similarity"))).drop("l_body", "r_body")


@query(DIFFS + """, g AS (SELECT doc_id, count(*)::INT AS l_count, count(*) FILTER (paired)::INT AS r_count, max(rank) AS rank, count(*) FILTER (rank > 0) AS differing FROM diffs GROUP BY doc_id),
f AS (SELECT doc_id, arg_min(body, idx) AS ls FROM m GROUP BY doc_id), e AS (SELECT doc_id, arg_min(body, idx) AS rs FROM o GROUP BY doc_id),
j AS (SELECT g.*, r_count - l_count AS delta, regexp_replace(trim(lower(ls)), '[ ]+', ' ', 'g') <> regexp_replace(trim(lower(rs)), '[ ]+', ' ', 'g') AS mismatch FROM g JOIN f USING (doc_id) JOIN e USING (doc_id))
SELECT doc_id, delta::INT AS message_count_delta, mismatch AS subject_mismatch, ['ok', 'warning', 'error'][greatest(rank, CASE WHEN delta <> 0 THEN 2 ELSE 0 END, CASE WHEN mismatch THEN 1 ELSE 0 END) + 1] AS severity,
coalesce(nullif(concat_ws('; ', CASE WHEN delta <> 0 THEN 'count delta ' || delta END, CASE WHEN mismatch THEN 'subject differs' END, CASE WHEN differing > 0 THEN differing || ' messages differ' END), ''), 'identical') AS human_summary FROM j""")
def thread_diff(s: SparkSession, d: str) -> DataFrame:
    left = keep(segment.messages(mail(s, d)))
    counts = lambda m, p: m.groupBy("doc_id").agg(F.count("*").alias(f"{p}_count"), F.concat(F.lit("Re: "), F.min_by("body", "idx")).alias(f"{p}_subject"))
    sides = counts(left, "l").join(counts(other_parse(left), "r"), "doc_id")
    return diffing.thread_diff(diffs_of(left), sides)


@query()
def body_similarity(s: SparkSession, d: str) -> DataFrame:
    """Every whole text with that of the id before, or with nothing."""
    docs = read(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("a"))
    before = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("a").alias("b"))
    return diffing.similarity(docs.join(before, "doc_id", "left"), "a", "b").select("doc_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {MAIL_SQL}, k AS (SELECT *, replace(lower(trim(plain)), '  ', ' ') AS key FROM lines WHERE trim(plain) <> ''), e AS (SELECT doc_id, line_no, plain || CASE WHEN line_no % 6 = 0 THEN ' +' ELSE '' END AS plain FROM lines), b AS (SELECT *, replace(lower(trim(plain)), '  ', ' ') AS key FROM e WHERE trim(plain) <> '')
SELECT doc_id, 'missing' AS side, line_no, plain FROM k ANTI JOIN b USING (doc_id, key) UNION ALL SELECT doc_id, 'added', line_no, plain FROM b ANTI JOIN k USING (doc_id, key)""")
def line_set_diff(s: SparkSession, d: str) -> DataFrame:
    """Every line against the same lines, some of which are changed."""
    lines = mail(s, d)
    return diffing.line_diff(lines, lines.withColumn("plain", F.when(F.col("line_no") % 6 == 0, F.concat("plain", F.lit(" +"))).otherwise(F.col("plain"))))


@query(BLOCKS + FIELDS + BODY + r""", r AS (SELECT doc_id, idx, string_agg(value, ' ' ORDER BY pos) FILTER (label = 'To') AS t FROM hrows GROUP BY doc_id, idx), bt AS (SELECT doc_id, idx, string_agg(plain, chr(10) ORDER BY pos) AS body FROM body GROUP BY doc_id, idx),
m AS (SELECT f.*, coalesce(t, '') AS t, coalesce(body, '') AS body FROM fields f LEFT JOIN r USING (doc_id, idx) LEFT JOIN bt USING (doc_id, idx)),
x AS (SELECT doc_id, idx, list_filter([CASE WHEN from_name = '' THEN 'empty name ' || idx END, CASE WHEN NOT contains(from_email, '@') THEN 'bad address ' || idx END, CASE WHEN date_raw = '' THEN 'empty date ' || idx END, CASE WHEN contains(body, '[Quoted text hidden]') THEN 'placeholder ' || idx END, CASE WHEN contains(body, 'https://mail.google.com/') THEN 'footer ' || idx END], lambda e: e IS NOT NULL) AS e, list_filter([CASE WHEN t = '' THEN 'empty to ' || idx END, CASE WHEN body = '' THEN 'empty body ' || idx END], lambda e: e IS NOT NULL) AS w FROM m),
g AS (SELECT doc_id, count(*)::INT AS message_count, flatten(list(e ORDER BY idx)) AS e, flatten(list(w ORDER BY idx)) AS w FROM x GROUP BY doc_id),
n AS (SELECT doc_id, arg_min(regexp_extract(trim(plain), '^(\d{1,9}) messages$', 1)::INT, line_no) AS expected FROM lines WHERE regexp_matches(trim(plain), '^\d{1,9} messages$') GROUP BY doc_id),
f AS (SELECT doc_id, message_count, expected, (CASE WHEN expected <> message_count THEN ['expected ' || expected || ' found ' || message_count] ELSE [] END) || e AS e, w FROM g LEFT JOIN n USING (doc_id))
SELECT doc_id, CASE WHEN len(e) > 0 THEN 'error' WHEN len(w) > 0 THEN 'warning' ELSE 'ok' END AS severity, message_count, expected AS expected_count, array_to_string(e, '; ') AS errors, array_to_string(w, '; ') AS warnings FROM f""")
def integrity_report(s: SparkSession, d: str) -> DataFrame:
    lines = mail(s, d)
    return diffing.integrity(segment.messages(lines), segment.expected_count(lines))


@query(BLOCKS + FIELDS + BODY + r""", bt AS (SELECT doc_id, idx, trim(regexp_replace(string_agg(plain, chr(10) ORDER BY pos), '\s+', ' ', 'g')) AS flat FROM body GROUP BY doc_id, idx), j AS (SELECT f.*, coalesce(flat, '') AS flat, (count(*) OVER (PARTITION BY doc_id))::INT AS total FROM fields f LEFT JOIN bt USING (doc_id, idx))
SELECT doc_id, idx, from_name AS sender, strftime(strptime(regexp_replace(date_raw, '^\w{3},\s', ''), '%b %-d, %Y at %-I:%M %p'), '%b %-d · %-I:%M %p') AS day, CASE WHEN length(flat) > 90 THEN left(flat, 90) || '…' ELSE flat END AS snippet, array_to_string([CASE WHEN i = idx THEN '[' || i || ']' ELSE i::VARCHAR END FOR i IN range(1, total + 1)], ' · ') AS nav FROM j""")
def index_of_communications(s: SparkSession, d: str) -> DataFrame:
    total = F.count("*").over(Window.partitionBy("doc_id")).cast("int")
    found = segment.messages(mail(s, d)).withColumn("total", total)
    return found.select("doc_id", "idx", F.col("from_name").alias("sender"), t.short_date(F.col("date_raw")).alias("day"), t.snippet(F.col("body")).alias("snippet"), t.nav_strip(F.col("idx"), F.col("total")).alias("nav"))


@query("""WITH f AS (SELECT user_id, event_id, event_type, ts, CASE WHEN lag(event_type) OVER w = event_type THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, (sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::INT AS island FROM f) SELECT user_id, island, event_type, count(*) AS n, min(event_id) AS first_id FROM i GROUP BY ALL""")
def coalesce_runs(s: SparkSession, d: str) -> DataFrame:
    runs = geometry.islands(read(s, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "island", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


@query("""WITH f AS (SELECT user_id, event_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value, event_id) <= 3 THEN 0 ELSE 1 END AS fresh FROM events), c AS (SELECT *, (sum(fresh) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING))::INT AS cluster FROM f)
SELECT user_id, cluster, count(*) AS n, min(value) AS low, max(value) AS high FROM c GROUP BY ALL""")
def cluster_by_gap(s: SparkSession, d: str) -> DataFrame:
    found = geometry.cluster(read(s, d, "events"), ["user_id"], "value", 3.0, "event_id")
    return found.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))


@query("SELECT l_orderkey, l_linenumber, greatest(0, l_quantity - min(l_quantity) OVER (PARTITION BY l_orderkey)) AS indent FROM lineitem")
def indent_normalize(s: SparkSession, d: str) -> DataFrame:
    low = F.min("l_quantity").over(Window.partitionBy("l_orderkey"))
    return read(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.greatest(F.lit(0.0), F.col("l_quantity") - low).alias("indent"))


@query("SELECT conv_id AS doc_id, turn, CASE WHEN turn % 4 = 1 THEN 'no JSON object found' WHEN turn % 4 = 2 THEN 'decode: messages' END AS error, CASE WHEN turn % 4 NOT IN (1, 2) THEN role || '@x.io' END AS email FROM conversations")
def payload_json(s: SparkSession, d: str) -> DataFrame:
    one = F.struct(F.col("role").alias("from_name"), F.concat("role", F.lit("@x.io")).alias("from_email"), F.lit("d").alias("date"), F.lit("t").alias("to"), F.coalesce("text", F.lit("")).alias("body"))
    good = F.concat(F.lit("Here: "), F.to_json(F.struct(F.lit("s").alias("subject"), F.array(one).alias("messages"))), F.lit(" done"))
    raw = F.when(F.col("turn") % 4 == 1, "nothing").when(F.col("turn") % 4 == 2, '{"subject": "s"}').otherwise(good)
    decoded = payload.decode(read(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), "turn", raw.alias("raw")))
    return decoded.select("doc_id", "turn", "error", F.element_at("payload.messages", 1)["from_email"].alias("email"))


@query("""WITH c AS (SELECT n_regionkey AS table_id, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS k, left(n_name, 1) AS cell_id FROM nation), g AS (SELECT table_id, k // 2 AS row, k % 2 AS col, cell_id FROM c)
SELECT table_id, count(*) AS n_rows, (min(n) = max(n)) AS regular FROM (SELECT table_id, row, count(*) AS n FROM g GROUP BY ALL) GROUP BY table_id""")
def grid_validate(s: SparkSession, d: str) -> DataFrame:
    grid = nation_grid(s, d)
    return layout.validate_grid(grid).join(grid.select("table_id", "row").distinct().groupBy("table_id").agg(F.count("*").alias("n_rows")), "table_id").select("table_id", "n_rows", (F.col("error") == "ok").alias("regular"))


@query("SELECT l_orderkey AS table_id, l_linenumber AS col, round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 500, 6) AS x, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey) * 500, 6) AS w FROM " + NUMBERED)
def grid_layout(s: SparkSession, d: str) -> DataFrame:
    cols = numbered(s, d).select(F.col("l_orderkey").alias("table_id"), F.col("l_linenumber").alias("col"), F.col("l_quantity").alias("share"))
    return layout.column_offsets(cols, 500.0).select("table_id", "col", F.round("x", 6).alias("x"), F.round("w", 6).alias("w"))


@query("""WITH RECURSIVE i AS (SELECT p_brand AS list_id, p_partkey AS item_id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey))::INT AS k, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END AS content FROM part), t AS (SELECT i.*, (SELECT j.item_id FROM i j WHERE j.list_id = i.list_id AND j.k = i.k // 4) AS parent_id FROM i),
n AS (SELECT *, (row_number() OVER (PARTITION BY list_id, parent_id ORDER BY k))::INT AS number FROM t),
r AS (SELECT list_id, item_id, number, content, CASE WHEN content = '' THEN 0 ELSE 1 END AS level FROM n WHERE parent_id IS NULL UNION ALL SELECT n.list_id, n.item_id, n.number, n.content, r.level + CASE WHEN n.content = '' THEN 0 ELSE 1 END FROM n JOIN r ON n.list_id = r.list_id AND n.parent_id = r.item_id)
SELECT list_id, item_id, level::INT AS level, number, content FROM r WHERE content <> ''""")
def list_flatten(s: SparkSession, d: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey"))
    items = read(s, d, "part").select(F.col("p_brand").alias("list_id"), F.col("p_partkey").alias("item_id"), k.alias("k"), F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.col("p_name")).alias("content"))
    above = items.select("list_id", F.col("k").alias("up"), F.col("item_id").alias("parent_id"))
    tree = items.withColumn("up", F.expr("int(k div 4)")).join(above, ["list_id", "up"], "left").select("list_id", "item_id", "parent_id", F.col("k").alias("ord"), "content")
    return layout.list_flatten(tree)


@query("SELECT l_orderkey AS doc_id, l_linenumber AS page, (count(*) OVER (PARTITION BY l_orderkey))::INT AS total, repeat('X', (l_linenumber // 10)::INT) || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[l_linenumber % 10 + 1] || ' / ' || repeat('X', (count(*) OVER (PARTITION BY l_orderkey) // 10)::INT) || (['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'])[count(*) OVER (PARTITION BY l_orderkey) % 10 + 1] AS label FROM " + NUMBERED)
def page_labels(s: SparkSession, d: str) -> DataFrame:
    return layout.page_labels(numbered(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page")), style="roman")


#: What stacked_lines prints, told from the turns themselves.
STACKED = """WITH turns AS (SELECT conv_id AS doc_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS idx, upper(role[1]) || lower(role[2:]) || ' ' || conv_id AS from_name, role || '.' || conv_id || '@example.com' AS from_email, strftime(TIMESTAMP '2024-01-01' + to_minutes((97 * conv_id + 13 * turn)::INT), '%a, %b %-d, %Y at %-I:%M %p') AS date_raw, coalesce(text, '') AS body FROM conversations)
SELECT doc_id, idx, from_name, from_email, date_raw, len(string_split(body, chr(10))) AS n_body, body, """


@query(STACKED + """CASE WHEN idx % 2 = 1 THEN 'Team <team@example.com>' ELSE lag(from_name || ' <' || from_email || '>') OVER (PARTITION BY doc_id ORDER BY idx) END AS "to" FROM turns""")
def stacked_messages(s: SparkSession, d: str) -> DataFrame:
    return stacked.messages(stacked_lines(read(s, d, "conversations"), colons=False), stacked.OUTLOOK).drop("cc", "bcc")


@query(STACKED + """CASE WHEN idx % 2 = 1 THEN 'Team <team@example.com>' ELSE '' END AS "to" FROM turns""")
def stacked_colon_messages(s: SparkSession, d: str) -> DataFrame:
    return stacked.messages(stacked_lines(read(s, d, "conversations"), colons=True), stacked.APPLE).drop("cc", "bcc")


@query("SELECT DISTINCT conv_id AS doc_id, 'Printed thread' AS plain_subject, 'Thread ' || conv_id AS row_subject FROM conversations")
def stacked_subjects(s: SparkSession, d: str) -> DataFrame:
    found = lambda colons, style, name: stacked.subjects(stacked_lines(read(s, d, "conversations"), colons), style).withColumnRenamed("subject", name)
    return found(False, stacked.OUTLOOK, "plain_subject").join(found(True, stacked.APPLE, "row_subject"), "doc_id")


@query(f"WITH {MAIL_SQL} SELECT doc_id, line_no, plain FROM lines")
def fold_split_headers(s: SparkSession, d: str) -> DataFrame:
    """Every one-line header is split at its stamp first, with a folded address between; folding puts them together."""
    stamp = rf"\s+({t.STAMP})$"
    whole = mail(s, d)
    cut = F.when(segment.is_header(F.col("plain")), F.array(F.regexp_replace("plain", stamp, "    "), F.lit("<extra@example.com>"), F.regexp_extract("plain", stamp, 1))).otherwise(F.array("plain"))
    split = whole.select("doc_id", "line_no", F.posexplode(cut).alias("part", "plain"))
    folded = stacked.fold_headers(split.select("doc_id", (F.col("line_no") * 4 + F.col("part")).alias("line_no"), "plain"))
    return folded.filter("plain <> '<extra@example.com>'").select("doc_id", F.expr("int(line_no div 4)").alias("line_no"), "plain")


@query(BLOCKS + FIELDS + """, pages AS (SELECT doc_id, (line_no - 1) // 20 + 1 AS page, string_agg(plain, chr(10) ORDER BY line_no) AS text FROM lines GROUP BY ALL)
SELECT doc_id, idx, min(page)::INT AS page FROM (SELECT doc_id, idx, date_raw FROM fields) JOIN pages USING (doc_id) WHERE contains(text, date_raw) GROUP BY doc_id, idx""")
def heading_first_page(s: SparkSession, d: str) -> DataFrame:
    lines = mail(s, d)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "plain"))), lambda x: x["plain"]), "\n")
    pages = lines.groupBy("doc_id", F.expr("int((line_no - 1) div 20 + 1)").alias("page")).agg(text.alias("text"))
    return stacked.first_pages(segment.header_fields(segment.segment(lines)).select("doc_id", "idx", F.col("date_raw").alias("heading")), pages)


@query(STACKED + """CASE WHEN idx % 2 = 1 THEN 'Team <team@example.com>' ELSE lag(from_name || ' <' || from_email || '>') OVER (PARTITION BY doc_id ORDER BY idx) END AS "to" FROM turns""")
def posthoc_split(s: SparkSession, d: str) -> DataFrame:
    """One message a conversation, its body with all later turns buried in it."""
    talk, top = read(s, d, "conversations"), stacked_lines(read(s, d, "conversations"), colons=False)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "plain"))), lambda x: x["plain"]), "\n")
    bodies = top.filter("line_no > 6").groupBy("doc_id").agg(body.alias("body"))
    heads = stacked.top_fields(stacked.headed(top, stacked.OUTLOOK), stacked.OUTLOOK).drop("subject")
    return payload.split_embedded(heads.join(bodies, "doc_id")).drop("cc", "bcc").withColumn("n_body", F.size(F.split("body", "\n", -1)))


@query("""WITH RECURSIVE r AS (SELECT l_orderkey AS doc_id, l_linenumber AS msg, l_quantity AS x, (6 * (1 + l_partkey % 3))::DOUBLE AS w, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey % 3 DESC, l_linenumber) AS k FROM """ + NUMBERED + """),
f AS (SELECT doc_id, k, [{'msg': msg, 'x': x, 'w': w}] AS kept FROM r WHERE k = 1 UNION ALL
SELECT r.doc_id, r.k, CASE WHEN len([e FOR e IN kept IF least(e.x + e.w, r.x + r.w) - greatest(e.x, r.x) > 0.5 * r.w]) > 0 THEN kept ELSE list_append(kept, {'msg': r.msg, 'x': r.x, 'w': r.w}) END FROM f JOIN r ON r.doc_id = f.doc_id AND r.k = f.k + 1),
u AS (SELECT doc_id, unnest(arg_max(kept, k)) AS e FROM f GROUP BY doc_id)
SELECT doc_id, e.msg AS msg, e.x AS x, e.w AS w FROM u""")
def link_dominance(s: SparkSession, d: str) -> DataFrame:
    boxes = numbered(s, d).select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("msg"), F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), (6 * (1 + F.col("l_partkey") % 3)).cast("double").alias("w"), F.lit(10.0).alias("h"))
    return geometry.undominated(boxes, ["doc_id"], ["msg"]).drop("y", "h")


from threadloom.plans import bodies, pages, reports  # noqa: E402, F401  (they register queries of their own)


def queries() -> dict[str, Query]:
    return {k: f for k, (f, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in FOUND.items() if sql}
