"""Quality rules: fixed rules first, then robust multivariate outliers per language and source.

Each text gets counts and a vector of transformed ratios (VECTOR). For every language and source a minimum-covariance-
determinant estimate is reached by concentration steps over all rows: take the rows of smallest Mahalanobis distance up to
the share CORE, estimate centre and covariance from them, and repeat. There are three starts, all around the medians: quartile
ranges alone, these with the correlations of the entries' hyperbolic tangents, and with those of the rows' directions. After
TRIAL steps each group keeps the start of smallest core determinant and takes STEPS more. A step is one aggregation by
group, start and distance bin (a sixteenth of a power of e) whose sums are then cut at the bin that reaches the share, so
no group is gathered in one place and no row is left out; a core is at most one bin larger than the share. RIDGE is added to
the covariance, so ratios that are zero throughout the core do not make it singular. A row is rejected if its squared
distance exceeds the CUT quantile of chi square.

Defined results: null and empty texts have zero counts and fail the base rules; groups of under MIN_ROWS rows use the
estimate of their language, else that of all small groups together; null languages and sources are groups of their own;
repeated rows give repeated rows; an empty table gives an empty table. Columns other than the four named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, keep_rows, row_key, text_of
from .text_stats import COUNTS, counts

VECTOR = ("symbols", "upper", "dup_lines", "repeats", "word_length")
#: Standard deviations added to each entry of VECTOR: what differs by less than a few of these is no outlier.
RIDGE = (0.05, 0.05, 0.15, 0.15, 0.1)
CORE, CUT, TRIAL, STEPS, MIN_ROWS = 0.75, 0.99999, 2, 3, 50


def chi2_quantile(p: float, k: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    return k * (1 - 2 / (9 * k) + NormalDist().inv_cdf(p) * math.sqrt(2 / (9 * k))) ** 3


def base_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ("lang", "source")) -> DataFrame:
    """doc_id, the carried columns as strings, and COUNTS of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                rows = np.array([counts(x.as_py()) for x in part.column(part.num_columns - 1)], np.int64).reshape(-1, len(COUNTS))
                yield pa.record_batch([*part.columns[:-1], *(pa.array(rows[:, k]) for k in range(len(COUNTS)))], names=["doc_id", *carry, *COUNTS])

    schema = ", ".join(["doc_id long", *(f"`{c}` string" for c in carry), *(f"{c} long" for c in COUNTS)])
    return df.select(F.col(id_col).cast("long").alias("doc_id"), *(F.col(c).cast("string") for c in carry), text_of(text_col).cast("binary").alias("t")).mapInArrow(run, schema)


def vector() -> list[Column]:
    n, c = F.col("n_words"), F.col
    return [
        F.sqrt(c("n_symbols") / (n + 20)).alias("symbols"),
        F.sqrt(c("n_upper") / (c("n_upper") + c("n_lower") + 40)).alias("upper"),
        F.sqrt(c("n_dup_lines") / (c("n_lines") + 4)).alias("dup_lines"),
        F.sqrt(c("n_repeat_words") / (n + 20)).alias("repeats"),
        F.log((c("word_chars") + 50) / (n + 10)).alias("word_length"),
    ]


def distance(names: tuple[str, ...]) -> Column:
    """Squared Mahalanobis distance from the columns centre and precision."""
    p = len(names)
    d = [F.col(x) - F.element_at("centre", i + 1) for i, x in enumerate(names)]
    terms = [d[i] * d[j] * F.element_at("precision", i * p + j + 1) * (1 if i == j else 2) for i in range(p) for j in range(i, p)]
    return F.greatest(sum(terms[1:], terms[0]), F.lit(0.0))


PARAMETERS = "pool string, start int, centre array<double>, precision array<double>, logdet double"
Estimate = tuple[np.ndarray, np.ndarray]


def estimates(pool: str, found: list[tuple[int, Estimate, float]], floor: np.ndarray) -> pd.DataFrame:
    """Rows of PARAMETERS from (start, (centre, covariance), log determinant)."""
    made = [(pool, start, centre, np.linalg.inv(cov + floor).ravel(), logdet) for start, (centre, cov), logdet in found]
    return pd.DataFrame(made, columns=["pool", "start", "centre", "precision", "logdet"])


def mcd(rows: DataFrame, names: tuple[str, ...] = VECTOR, ridge: tuple[float, ...] = RIDGE, core: float = CORE, trial: int = TRIAL, steps: int = STEPS) -> DataFrame:
    """Estimates per `pool` of rows: start, centre, precision (inverse covariance, row by row) and logdet, the core's log determinant."""
    p, floor = len(names), np.diag(np.square(ridge))
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    median = chi2_quantile(0.5, p)

    def symmetric(found: dict, prefix: str) -> np.ndarray:
        out = np.zeros((p, p))
        for i, j in upper:
            out[i, j] = out[j, i] = found[f"{prefix}{i}_{j}"]
        return out

    def correlation(m: np.ndarray) -> np.ndarray:
        d = np.sqrt(np.maximum(np.diag(m), 1e-12))
        return m / np.outer(d, d) * (1 - 1e-9) + np.eye(p) * 1e-9

    def begin(found: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in found:
            for r in pdf.to_dict("records"):
                middle, spread = np.array([r[f"m_{x}"] for x in names]), np.array([r[f"d_{x}"] for x in names])
                shapes = [np.eye(p), correlation(symmetric(r, "t") / r["n"]), correlation(symmetric(r, "u") / r["n"])]
                yield estimates(r["pool"], [(k, (middle, np.outer(spread, spread) * shape), 0.0) for k, shape in enumerate(shapes)], floor)

    def concentrate(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bin")
        cum = pdf.n.cumsum().to_numpy()
        last = int(np.searchsorted(cum, core * cum[-1]))
        inside = pdf.iloc[: last + 1]
        n = inside.n.sum()
        centre = inside[[f"s{i}" for i in range(p)]].sum().to_numpy() / n
        cov = symmetric((inside[[f"q{i}_{j}" for i, j in upper]].sum() / n).to_dict(), "q") - np.outer(centre, centre)
        # the core's spread understates that of the whole; the median distance shows by how much
        middle = math.exp((pdf.bin.to_numpy()[np.searchsorted(cum, 0.5 * cum[-1])] + 1) / 16)
        logdet = float(np.linalg.slogdet(cov + floor)[1])
        return estimates(pdf.pool.iloc[0], [(int(pdf.start.iloc[0]), (centre, cov * max(1.0, middle / median)), logdet)], floor)

    def stepped(params: DataFrame) -> DataFrame:
        sums = [F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(names)), *(F.sum(F.col(names[i]) * F.col(names[j])).alias(f"q{i}_{j}") for i, j in upper)]
        binned = rows.join(params, "pool").withColumn("bin", F.floor(F.log(distance(names) + 1e-6) * 16).cast("int"))
        return cut(binned.groupBy("pool", "start", "bin").agg(*sums).groupBy("pool", "start").applyInPandas(concentrate, PARAMETERS), "mcd")

    quartiles = rows.groupBy("pool").agg(*(F.percentile_approx(x, [0.25, 0.5, 0.75], 10000).alias(x) for x in names))
    placed = cut(quartiles.select("pool", *(F.element_at(x, 2).alias(f"m_{x}") for x in names), *(((F.element_at(x, 3) - F.element_at(x, 1)) / 1.349).alias(f"d_{x}") for x in names)), "mcd-quartiles")
    # where the quartiles agree the ridge says what a step is
    scaled = rows.join(placed, "pool").select("pool", *(((F.col(x) - F.col(f"m_{x}")) / F.greatest(F.col(f"d_{x}"), F.lit(r))).alias(f"z{i}") for i, (x, r) in enumerate(zip(names, ridge, strict=True))))
    norm = F.greatest(sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(1, p)), F.col("z0") * F.col("z0")), F.lit(1e-12))
    moments = scaled.groupBy("pool").agg(F.count("*").alias("n"), *(F.sum(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in upper), *(F.sum(F.col(f"z{i}") * F.col(f"z{j}") / norm).alias(f"u{i}_{j}") for i, j in upper))
    params = cut(placed.join(moments, "pool").mapInPandas(begin, PARAMETERS), "mcd")
    for _ in range(trial):
        params = stepped(params)
    best = params.groupBy("pool").agg(F.min_by(F.struct("start", "centre", "precision", "logdet"), F.struct("logdet", "start")).alias("best"))
    params = best.select("pool", "best.*")
    for _ in range(steps):
        params = stepped(params)
    return params


def pooled(stats: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """stats with `pool`: its language and source, or a wider one where these have few rows."""
    nothing = F.lit("\0")
    lang, source = F.coalesce("lang", nothing), F.coalesce("source", nothing)
    keyed = stats.withColumns({"_l": lang, "_s": source})
    fine = keyed.groupBy("_l", "_s").agg(F.count("*").alias("_n"))
    wide = fine.filter(F.col("_n") < min_rows).groupBy("_l").agg(F.sum("_n").alias("_m"))
    pool = F.when(F.col("_n") >= min_rows, F.concat_ws("\1", F.lit("s"), "_l", "_s")).when(F.col("_m") >= min_rows, F.concat_ws("\1", F.lit("l"), "_l")).otherwise("all")
    names = fine.join(wide, "_l", "left").select("_l", "_s", pool.alias("pool"))
    return keyed.join(names, ["_l", "_s"]).drop("_l", "_s")


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Per document: doc_id, row_key, COUNTS, distance2, base_failed, outlier, kept."""
    named = df.select(*row_key(id_col, text_col), F.col(lang_col).alias("lang"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    stats = cut(base_counts(named, carry=("row_key", "lang", "source")).select("*", *vector()), "quality").withColumn("row_key", F.col("row_key").cast("long"))
    rows = pooled(stats)
    params = mcd(rows.filter("n_words > 0"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    outlier = F.coalesce(F.col("distance2") > chi2_quantile(CUT, len(VECTOR)), F.lit(False))
    judged = rows.join(params, "pool", "left").withColumn("distance2", distance(VECTOR))
    return judged.select("doc_id", "row_key", *COUNTS, "distance2", failed.alias("base_failed"), outlier.alias("outlier"), (~failed & ~outlier).alias("kept"))


def keep_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The rows of df, all columns, that `quality` keeps."""
    return keep_rows(df, quality(df, id_col, text_col, lang_col, source_col).filter("kept"), id_col, text_col)
