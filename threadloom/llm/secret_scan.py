"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regular expression gives a Boolean query over trigrams (see trigrams). `postings` is the inverted index over
the trigrams that rules name: one row for each trigram and document that holds it, letters in lower case. `candidates`
intersects postings: per document, the rules whose queries hold. Only candidates are matched against the expression; rules
whose query is empty, such as runs of hexadecimal digits, scan every text. The index is a table: `scan` writes it to the
shared folder, or takes one that was kept (`postings(...)` of the same table and at least the same trigrams, written once).

Base rules keep their leftmost non-overlapping matches per kind and drop those that fail their test; the further rules
add spans of their own kinds, which may lie inside or across base spans; base spans stay as they are. Offsets count code
points, the end is exclusive.

Defined results: null text counts as empty; texts without secrets have counts of zero and empty lists; equal rows give
equal rows, null ids stay; an empty table gives an empty table. Columns other than the two named are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, same_row, text_of
from .native_spans import listed, none, ordered, spans_if
from .trigrams import query, trigrams


@dataclass(frozen=True)
class Rule:
    kind: str
    #: In the syntax that Java, Python and RE2 share.
    pattern: str
    #: SQL over `value`, the matched text, that a match must satisfy; the same in Spark and DuckDB.
    test: str | None = None


ASSIGN_NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
#: The base kinds, in the order of the report. A shorter run than asked for fails whatever stands around it, so the length is in the pattern where that does not change where later matches start.
BASE = (
    Rule("assign", ASSIGN_NAME + "[\"']?\\x20*[:=]\\x20*[\"']?[A-Za-z0-9+/_.=-]+", "length(regexp_replace(value, '^[A-Za-z_]+[\"'']?\\x20*[:=]\\x20*[\"'']?', '')) >= 12"),
    Rule("access", "AKIA[A-Z0-9]{14,}"),
    Rule("hex", "[0-9a-f]{16,}"),
)
#: Formats of well-known services' keys.
MORE = (
    Rule("github", "gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", "[sr]k_(live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", "AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("bearer", "[Bb]earer\\x20+[A-Za-z0-9._~+/-]{20,}"),
    Rule("url", "(postgres|postgresql|mysql|mongodb|redis|amqp)://[^\\x20\\x09-\\x0D:@/]+:[^\\x20\\x09-\\x0D:@/]+@[A-Za-z0-9.-]+"),
)


def postings(df: DataFrame, wanted: set[str], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The inverted index over `wanted`: (trigram, doc_id, row_key), one row for each document that holds the trigram."""
    lowered = df.select(*row_key(id_col, text_col), F.lower(text_of(text_col)).alias("low"))
    present = F.array_compact(F.array(*(F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in sorted(wanted))))
    return lowered.select("doc_id", "row_key", F.explode(present).alias("trigram")).select("trigram", "doc_id", "row_key")


def condition(q: object) -> Column:
    """A query as a condition on the array column `present`."""
    if q is True:
        return F.lit(True)
    if isinstance(q, str):
        return F.array_contains("present", q)
    parts = [condition(x) for x in q[1]]
    out = parts[0]
    for x in parts[1:]:
        out = out & x if q[0] == "and" else out | x
    return out


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, row_key, rules): the documents where queries hold, and of which rules."""
    present = index.groupBy("doc_id", "row_key").agg(F.collect_set("trigram").alias("present"))
    hold = F.array_compact(F.array(*(F.when(condition(query(r.pattern)), F.lit(r.kind)) for r in rules)))
    return present.select("doc_id", "row_key", hold.alias("rules")).filter(F.size("rules") > 0)


def tested(found: Column, rule: Rule) -> Column:
    if rule.test is None:
        return found
    return F.filter(found, lambda x: F.length(F.regexp_replace(x["value"], "^[A-Za-z_]+[\"']?\\x20*[:=]\\x20*[\"']?", "")) >= 12)


def wanted(rules: tuple[Rule, ...] = BASE + MORE) -> set[str]:
    """The trigrams that the rules' queries name."""
    return set().union(*(trigrams(query(r.pattern)) for r in rules))


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + MORE, index: DataFrame | None = None) -> DataFrame:
    """Per document: doc_id, row_key, found: array of (start, end, kind, value) by start, then in the order of the rules. `index` is the table's kept postings."""
    kinds = [r.kind for r in rules]
    indexed = tuple(r for r in rules if query(r.pattern) is not True)
    full = tuple(r for r in rules if query(r.pattern) is True)
    docs = df.select(*row_key(id_col, text_col), text_of(text_col).alias("t"))
    wide = F.concat(*(tested(spans_if(F.lit(True) if r.kind != "hex" else F.col("t").rlike(r.pattern), F.col("t"), r.pattern, r.kind), r) for r in full)) if full else none()
    scanned = docs.select("doc_id", "row_key", wide.alias("wide"))
    index = cut(postings(df, wanted(indexed), id_col, text_col), "trigrams") if index is None else index
    hits = candidates(index, indexed)
    checked = docs.join(hits, same_row(docs, hits)).select(docs["doc_id"], docs["row_key"], F.concat(*(tested(spans_if(F.array_contains("rules", r.kind), F.col("t"), r.pattern, r.kind), r) for r in indexed)).alias("narrow"))
    checked = checked.filter(F.size("narrow") > 0).dropDuplicates(["doc_id", "row_key"])
    both = scanned.join(checked, same_row(scanned, checked), "left").select(scanned["doc_id"], scanned["row_key"], F.concat("wide", F.coalesce("narrow", none())).alias("all"))
    return both.select("doc_id", "row_key", ordered(F.col("all"), kinds, False).alias("found"))


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the lists of spans."""
    base = [r.kind for r in BASE]
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("found", lambda x: x["kind"].isin(*base))
    return found.select("doc_id", *(count(k) for k in base), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


def report_sql() -> str:
    """DuckDB SQL for report(scan(documents)), by matching every rule against every text."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    rules = BASE + MORE
    each = "\nUNION ALL\n".join(
        f"SELECT rid, {k} AS pos, {quoted(r.kind)} AS kind, unnest(regexp_extract_all(text, {quoted(r.pattern)})) AS value, unnest(string_split_regex(text, {quoted(r.pattern)})[:-2]) AS gap, generate_subscripts(regexp_extract_all(text, {quoted(r.pattern)}), 1) AS i FROM docs WHERE regexp_matches(text, {quoted(r.pattern)})"
        for k, r in enumerate(rules)
    )
    test = " AND ".join(f"(kind <> {quoted(r.kind)} OR {r.test})" for r in rules if r.test) or "true"
    base = ", ".join(quoted(r.kind) for r in BASE)
    counts = ", ".join(f"count(*) FILTER (kind = {quoted(r.kind)}) AS n_{r.kind}" for r in BASE)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
raw AS ({each}),
placed AS (SELECT *, sum(length(gap) + length(value)) OVER (PARTITION BY rid, pos ORDER BY i) AS stop FROM raw),
good AS (SELECT rid, pos, kind, (stop - length(value))::BIGINT AS start, kind || ':' || (stop - length(value))::BIGINT || ':' || stop::BIGINT AS item FROM placed WHERE {test}),
per AS (SELECT rid, {counts}, string_agg(item, ',' ORDER BY start, pos) FILTER (kind IN ({base})) AS own, string_agg(item, ',' ORDER BY start, pos) AS every FROM good GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(own, '')) AS base_sha256, coalesce(every, '') AS spans
FROM docs LEFT JOIN per USING (rid)"""
