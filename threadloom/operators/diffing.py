"""Two parses of the same documents, field by field; similarity; integrity."""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import address_set, dates_match, norm_body, norm_email, norm_line, norm_name, norm_subject, parse_date, trim_ws
from threadloom.operators.keeping import keep

SEVERITY = ("ok", "warning", "error")


def jaro_winkler(a: str, b: str) -> float:
    """Window half the longer length less one; transpositions not rounded; prefix bonus always."""
    if not a or not b:
        return float(a == b)
    reach = max(len(a), len(b)) // 2 - 1
    # windows only move right, so the places of a letter that are used or behind are never looked at again
    places, used, left = defaultdict(deque), np.zeros(len(b), bool), []
    for j, ch in enumerate(b):
        places[ch].append(j)
    for i, ch in enumerate(a):
        free = places.get(ch)
        while free and free[0] < i - reach:
            free.popleft()
        if free and free[0] <= i + reach:
            used[free.popleft()] = True
            left.append(ch)
    m = len(left)
    if not m:
        return 0.0
    t = sum(x != b[j] for x, j in zip(left, np.flatnonzero(used), strict=True))
    jaro = (m / len(a) + m / len(b) + (m - t / 2) / m) / 3
    p = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + p * 0.1 * (1 - jaro)


def similarity(df: DataFrame, a: str, b: str, out: str = "similarity") -> DataFrame:
    """df with the similarity of two normalised text columns. Equal texts longer than one character are 1 without a comparison."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    x, y = norm_body(F.coalesce(a, F.lit(""))), norm_body(F.coalesce(b, F.lit("")))
    return df.withColumns({"_a": x, "_b": y}).withColumn(out, F.when((F.col("_a") == F.col("_b")) & (F.length("_a") != 1), 1.0).otherwise(score("_a", "_b"))).drop("_a", "_b")


def greedy_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, l_idx, r_idx): per document and address, in left order the first free right message within a minute or of equal date text.

    Candidates are found by joins on the text and on minutes; only those that share a message with another candidate have to
    be dealt out in order, sender by sender.
    """

    def side(d: DataFrame, n: str) -> DataFrame:
        return d.select("doc_id", norm_email(F.col("from_email")).alias("email"), F.col("idx").alias(f"{n}_idx"), F.lower(trim_ws(F.col("date_raw"))).alias("text"), F.unix_timestamp(parse_date(F.col("date_raw"))).alias(f"{n}_at"))

    a, b = side(left, "l"), side(right, "r")
    minute = lambda d, n, reach: d.drop("text").withColumn("minute", F.explode(F.sequence(F.floor(F.col(f"{n}_at") / 60) - reach, F.floor(F.col(f"{n}_at") / 60) + reach)))
    near = minute(a.filter("l_at is not null"), "l", 1).join(minute(b.filter("r_at is not null"), "r", 0), ["doc_id", "email", "minute"]).filter("abs(l_at - r_at) <= 60")
    ids = ["doc_id", "email", "l_idx", "r_idx"]
    candidates = a.join(b, ["doc_id", "email", "text"]).select(*ids).unionByName(near.select(*ids)).distinct()
    times = lambda c: F.count("*").over(Window.partitionBy("doc_id", c))
    counted = candidates.withColumns({"l_n": times("l_idx"), "r_n": times("r_idx")})
    alone = (F.col("l_n") == 1) & (F.col("r_n") == 1)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        done, taken, out = set(), set(), []
        for doc, x, y in pdf.sort_values(["l_idx", "r_idx"])[["doc_id", "l_idx", "r_idx"]].itertuples(index=False):
            if x not in done and y not in taken:
                done.add(x)
                taken.add(y)
                out.append((doc, x, y))
        return pd.DataFrame(out, columns=["doc_id", "l_idx", "r_idx"])

    kind = left.schema["doc_id"].dataType.simpleString()
    dealt = counted.filter(~alone).select(*ids).groupBy("doc_id", "email").applyInPandas(deal, f"doc_id {kind}, l_idx int, r_idx int")
    return counted.filter(alone).select("doc_id", "l_idx", "r_idx").unionByName(dealt)


def sender_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, l_idx, r_idx): the k-th message of an address with the k-th of the other side."""
    k = lambda d, n: d.select(F.col("doc_id").alias("doc_id"), norm_email(F.col("from_email")).alias("email"), F.col("idx").alias(n)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "email").orderBy(n)))
    return k(left, "l_idx").join(k(right, "r_idx"), ["doc_id", "email", "k"]).select("doc_id", "l_idx", "r_idx")


def position_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, l_idx, r_idx): the k-th with the k-th, either side null beyond the other's end."""
    k = lambda d, n: d.select(F.col("doc_id").alias("doc_id"), F.col("idx").alias(n)).withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(n)))
    return k(left, "l_idx").join(k(right, "r_idx"), ["doc_id", "k"], "full").select("doc_id", "l_idx", "r_idx")


def pair_messages(left: DataFrame, right: DataFrame) -> DataFrame:
    """The three passes one after the other, each on what is left over; what the first two find is kept, as later ones read it again."""
    need = ("doc_id", "idx", "from_email", "date_raw")
    left, right = left.select(*need), right.select(*need)
    rest = lambda d, found, n: d.join(found.select("doc_id", F.col(n).alias("idx")), ["doc_id", "idx"], "left_anti")
    first = keep(greedy_pairs(left, right))
    l1, r1 = rest(left, first, "l_idx"), rest(right, first, "r_idx")
    second = keep(sender_pairs(l1, r1))
    return first.unionByName(second).unionByName(position_pairs(rest(l1, second, "l_idx"), rest(r1, second, "r_idx")))


def message_diff(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: which fields match. An unpaired message matches nowhere."""
    own = lambda d, p: d.select("doc_id", *(F.col(c).alias(f"{p}_{c}") for c in ("idx", "from_name", "from_email", "date_raw", "to", "cc", "body")))
    full = pairs.join(own(left, "l"), ["doc_id", "l_idx"], "left").join(own(right, "r"), ["doc_id", "r_idx"], "left")
    both = F.col("l_idx").isNotNull() & F.col("r_idx").isNotNull()
    same = lambda f, c: f(F.col(f"l_{c}")) == f(F.col(f"r_{c}"))
    sets = lambda c: address_set(F.coalesce(f"l_{c}", F.lit(""))) == address_set(F.coalesce(f"r_{c}", F.lit("")))
    yes = lambda c: F.coalesce(both & c, F.lit(False))
    return full.select(
        "doc_id", "l_idx", "r_idx", both.alias("paired"), yes(same(norm_email, "from_email") & same(norm_name, "from_name")).alias("from_matches"), yes(dates_match(F.col("l_date_raw"), F.col("r_date_raw"))).alias("date_matches"),
        yes(sets("to")).alias("to_matches"), yes(sets("cc")).alias("cc_matches"), yes(same(norm_body, "body")).alias("body_equal"), "l_body", "r_body",
    )


def in_pair_order(diffs: DataFrame) -> DataFrame:
    """diffs with place: by the left message, of unpaired right ones by their own; equal numbers left first."""
    order = Window.partitionBy("doc_id").orderBy(F.coalesce("l_idx", "r_idx"), F.col("l_idx").isNull(), "r_idx")
    return diffs.withColumn("place", F.row_number().over(order))


def date_range(messages: DataFrame, newest_first: bool = False) -> DataFrame:
    """(doc_id, date_range): first and last date in the document's order with a dash between; a single message's date alone. Formats that print the newest first say the last first, behind an em dash, and an equal pair once."""
    per = messages.groupBy("doc_id").agg(F.count("*").alias("n"), F.min_by("date_raw", "idx").alias("a"), F.max_by("date_raw", "idx").alias("b"))
    both = F.concat("b", F.lit(" — "), "a") if newest_first else F.concat("a", F.lit(" – "), "b")
    alone = (F.col("n") == 1) | (F.col("a") == F.col("b")) if newest_first else F.col("n") == 1
    return per.select("doc_id", F.when(alone, F.col("a")).otherwise(both).alias("date_range"))


def message_severity(similarity_col: Column) -> Column:
    """0 ok, 1 warning, 2 error."""
    c = F.col
    error = ~c("paired") | ~c("from_matches") | (similarity_col < 0.85)
    return F.when(error, 2).when(~c("date_matches") | ~c("to_matches") | (similarity_col < 0.95), 1).otherwise(0)


def thread_diff(diffs: DataFrame, counts: DataFrame) -> DataFrame:
    """diffs with `rank`, and (doc_id, l_count, r_count, l_subject, r_subject): delta, subject, severity, summary."""
    per = diffs.groupBy("doc_id").agg(F.max("rank").alias("rank"), F.count_if(F.col("rank") > 0).alias("differing"))
    j = counts.join(per, "doc_id", "left")
    delta = (F.col("r_count") - F.col("l_count")).cast("int")
    mismatch = norm_subject(F.col("l_subject")) != norm_subject(F.col("r_subject"))
    rank = F.greatest(F.coalesce("rank", F.lit(0)), F.when(delta != 0, 2).otherwise(0), F.when(mismatch, 1).otherwise(0))
    notes = F.concat_ws("; ", F.when(delta != 0, F.format_string("count delta %d", delta)), F.when(mismatch, F.lit("subject differs")), F.when(F.col("differing") > 0, F.format_string("%d messages differ", "differing")))
    return j.select("doc_id", delta.alias("message_count_delta"), mismatch.alias("subject_mismatch"), F.element_at(F.array(*(F.lit(s) for s in SEVERITY)), rank + 1).alias("severity"), F.when(notes == "", "identical").otherwise(notes).alias("human_summary"))


def line_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """(doc_id, side, line_no, plain): non-blank lines of one side whose normal form the other side's document lacks."""
    key = lambda d: d.withColumn("key", norm_line(F.col("plain"))).filter("key <> ''")
    a, b = key(left), key(right)
    missing = a.join(b.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti").withColumn("side", F.lit("missing"))
    return missing.unionByName(b.join(a.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_anti").withColumn("side", F.lit("added"))).select("doc_id", "side", "line_no", "plain")


def integrity(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Per document: severity, message_count, expected_count, errors and warnings by message."""
    c = F.col
    errors = F.array_compact(F.array(*(F.when(cond, F.concat(F.lit(f"{name} "), c("idx"))) for name, cond in (("empty name", c("from_name") == ""), ("bad address", ~c("from_email").contains("@")), ("empty date", c("date_raw") == ""), ("placeholder", c("body").contains("[Quoted text hidden]")), ("footer", c("body").contains("https://mail.google.com/"))))))
    warnings = F.array_compact(F.array(F.when(F.coalesce("to", F.lit("")) == "", F.concat(F.lit("empty to "), c("idx"))), F.when(c("body") == "", F.concat(F.lit("empty body "), c("idx")))))
    ordered = lambda n: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", n))), lambda x: x[n]))
    per = found.withColumns({"e": errors, "w": warnings}).groupBy("doc_id").agg(F.count("*").cast("int").alias("message_count"), ordered("e").alias("e"), ordered("w").alias("warnings"))
    j = per.join(expected, "doc_id", "left")
    count = F.when(c("expected") != c("message_count"), F.array(F.format_string("expected %d found %d", "expected", "message_count"))).otherwise(F.array().cast("array<string>"))
    full = j.withColumn("errors", F.concat(count, "e"))
    severity = F.when(F.size("errors") > 0, "error").when(F.size("warnings") > 0, "warning").otherwise("ok")
    return full.select("doc_id", severity.alias("severity"), "message_count", F.col("expected").alias("expected_count"), F.array_join("errors", "; ").alias("errors"), F.array_join("warnings", "; ").alias("warnings"))
