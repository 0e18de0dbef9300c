"""Quality classifier: Bradley-Terry pairwise ranking.

Each text gets a vector of ratios. Pairs of a preferred and a rejected labelled text are drawn, and weights are learnt by
logistic loss on the difference of their vectors (Newton's method with a quadratic penalty), as in the Bradley-Terry
model whose strengths are linear in the vector. The threshold is the quantile of the learnt scores of the labelled rows
at the share of rejected ones; scores are mapped to 0..1 so that it lies at 0.3.

The fit uses about `max_rows` different labelled rows at most and `pairs` drawn pairs; both are parameters. Labelled rows
are counted by their vector and label and written; the share that `max_rows` is of them is taken by a hash, so what goes to
the driver does not grow with the table, and a row that is there many times weighs as often. Every row of the table is
scored. Defined results: null and empty texts have the vector of a text without words; a label row with null in its id or
quality, of another quality than 0 and 1, or without a document teaches nothing; a document with several label rows teaches
with each; with labels of one kind only every score is the share of label 1, or 0.5 without labels; equal vectors have equal
scores; an empty table gives an empty one.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .quality_mcd import base_counts

FEATURES = ("symbols", "upper", "bars", "marks", "dup_lines", "repeats", "distinct", "ends", "digits", "word_length", "length")
THRESHOLD = 0.3


def features() -> list[Column]:
    c, n = F.col, F.col("n_words") + 10
    return [
        F.sqrt(c("n_symbols") / n).alias("symbols"), F.sqrt(c("n_upper") / (c("n_upper") + c("n_lower") + 40)).alias("upper"), F.sqrt(c("n_bars") / n).alias("bars"), F.sqrt(c("n_marks") / n).alias("marks"),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 4)).alias("dup_lines"), F.sqrt(c("n_repeat_words") / n).alias("repeats"), F.log((c("n_distinct") + 10) / n).alias("distinct"), F.sqrt(c("n_ends") / n).alias("ends"),
        F.sqrt(c("n_digits") / n).alias("digits"), F.abs(F.log((c("word_chars") + 50) / n) - math.log(5)).alias("word_length"), F.log(n).alias("length"),
    ]


def learn(x: np.ndarray, y: np.ndarray, times: np.ndarray | None = None, pairs: int = 200_000, penalty: float = 1e-3, seed: int = 7) -> tuple[np.ndarray, float, float]:
    """Weights, and offset and slope that map a score to the logit of its 0..1 form; `times` says how often a row counts."""
    times = np.ones(len(y)) if times is None else times
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        share = float(np.average(y, weights=times)) if len(y) else 0.5
        share = min(max(share, 0.01), 0.99)
        return np.zeros(x.shape[1]), math.log(share / (1 - share)), 0.0
    middle = np.average(x, axis=0, weights=times)
    spread = np.sqrt(np.average((x - middle) ** 2, axis=0, weights=times)) + 1e-9
    z = x / spread
    rng = np.random.default_rng(seed)
    drawn = lambda which: rng.choice(which, pairs, p=times[which] / times[which].sum())
    d = z[drawn(good)] - z[drawn(bad)]
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # chance that the model prefers the rejected one
        grad = -(d * p[:, None]).mean(0) + penalty * w
        hess = (d * (p * (1 - p))[:, None]).T @ d / pairs + penalty * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    w = w / spread
    s = x @ w
    at = weighted_quantile(s, times, times[bad].sum() / times.sum())
    slope = 4 / max(weighted_quantile(s[good], times[good], 0.5) - at, 1e-6)
    return w, math.log(THRESHOLD / (1 - THRESHOLD)) - slope * at, slope


def weighted_quantile(values: np.ndarray, times: np.ndarray, share: float) -> float:
    """The value below which `share` of the weight lies, between neighbours in proportion."""
    order = np.argsort(values, kind="stable")
    upto = np.cumsum(times[order])
    return float(np.interp(share * upto[-1], upto - times[order] / 2, values[order]))


def taught_rows(table: DataFrame, labels: DataFrame, max_rows: int) -> np.ndarray:
    """(label, times, features...) of about `max_rows` labelled rows at most, in a fixed order."""
    rows = cut(table.join(labels, "doc_id").groupBy("quality", *FEATURES).agg(F.count("*").alias("times")), "bradley-terry-labels")
    share = max_rows / max(1, rows.count())
    if share < 1:
        rows = rows.filter(F.pmod(F.xxhash64("quality", *FEATURES), F.lit(1 << 30)) < int(share * (1 << 30)))
    found = rows.select("quality", "times", *FEATURES).toArrow()
    made = np.column_stack([c.to_numpy().astype(float) for c in found.columns]) if len(found) else np.zeros((0, len(FEATURES) + 2))
    return made[np.lexsort(made.T[::-1])]


def score_quality(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_rows: int = 10_000, pairs: int = 200_000) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels of held-out ids (crc32 of the id as text, modulo 5, is 0) are never read."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0
    named = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    table = cut(base_counts(named, carry=()).select("doc_id", *features()), "bradley-terry")
    taught = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held)
    known = taught_rows(table, taught, max_rows)
    w, offset, slope = learn(known[:, 2:], known[:, 0], known[:, 1], pairs)
    total = sum((F.col(f) * float(v) for f, v in zip(FEATURES, w, strict=True)), F.lit(0.0))
    logit = F.least(F.greatest(total * slope + offset, F.lit(-30.0)), F.lit(30.0))
    return table.withColumn("score", 1 / (1 + F.exp(-logit))).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
