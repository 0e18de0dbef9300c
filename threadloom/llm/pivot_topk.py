"""Exact top-k by integer inner product over a pivot-distance index.

Index: a vector's key is its nearest pivot and its distance from it. Vectors are dealt by ranges of (pivot, distance, row) and
cut into annuli of at most RING vectors of one pivot with neighbouring distances, so equal vectors and a hot pivot spread over
annuli. Pivots are PIVOTS vectors far apart, from the SAMPLE vectors of smallest hash; every vector is indexed.

Search: a vector v at distance d from pivot p has |q - v| >= |d(q, p) - d|, so with N the greatest squared length
q.v <= (|q|^2 + N - (d(q, p) - d)^2) / 2; with a k-th best score t only distances within sqrt(|q|^2 + N - 2 t) of d(q, p)
count. The queries of an annulus first search that annulus, then the next ones by the gap between distances, WIDTH at first and
GROW times as many in each round, until no annulus that the bounds admit is left; inside a task the bound of the annulus
itself leaves queries out once more. Bounds have a margin for rounding and scores are integers, so results are exact.

A round sends query blocks (one row in fifty) to annuli, never annuli to queries; a task streams query blocks past one
annulus, and keeps k rows a query. What an annulus or a block holds is bounded by RING. Only pivots, sizes and norms are
collected or sent to all tasks.

Defined results: null vectors and those with a null, NaN or infinite component take no part; equal rows are rows of their
own, each a query if its id is; a null id is never a query and loses ties; vectors of different lengths are compared as if
filled up with zeros; scores beyond 64 bits raise an error; an empty table gives an empty table. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, SCALE, EVERY = 5, 256, 50
PIVOTS, SAMPLE, RING, WIDTH, GROW = 32, 2048, 4096, 4, 8
MARGIN = 1e-7
FOUND = "block long, row long, query_id long, vec_id long, score long, other long"


def whole_vectors(df: DataFrame, id_col: str, vec_col: str, scale: int, query: Column) -> DataFrame:
    """(row, vec_id, is_query, v): vectors of finite components as integers, floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    kept = df.filter(F.col(vec_col).isNotNull()).filter(finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), F.coalesce(query, F.lit(False)).alias("is_query"), F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(vectors, width: int) -> np.ndarray:
    """A list column as rows of a matrix, short ones filled up with zeros."""
    sizes = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The integer inner products of rows of a and rows of b."""
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    if most < 2**63:
        return a @ b.T
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    v, pivots = v.astype(float), pivots.astype(float)
    return np.sqrt(np.maximum((v * v).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * (v @ pivots.T), 0))


def choose_pivots(vectors: DataFrame, width: int) -> np.ndarray:
    """Vectors of a bounded sample, each the farthest from those before it."""
    found = vectors.select("v").orderBy(F.xxhash64("vec_id", "v"), "row").limit(SAMPLE).collect()
    v = np.unique(np.array([list(x.v) + [0] * (width - len(x.v)) for x in found], np.int64).reshape(len(found), width), axis=0)
    chosen, nearest = [0], distances(v, v[:1])[:, 0]
    while len(chosen) < min(PIVOTS, len(v)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, distances(v, v[chosen[-1:]])[:, 0])
    return v[chosen]


ANNULUS = pa.schema([("ring", pa.int64()), ("pivot", pa.int32()), ("low", pa.float64()), ("high", pa.float64()), ("norm", pa.float64()), ("n_queries", pa.int32()), ("vec_ids", pa.list_(pa.int64())), ("rows", pa.binary()), ("queries", pa.binary()), ("m", pa.binary())])
ANNULUS_DDL = "ring long, pivot int, low double, high double, norm double, n_queries int, vec_ids array<long>, rows binary, queries binary, m binary"


def index(vectors: DataFrame, pivots: np.ndarray, width: int, ring: int = RING) -> DataFrame:
    """Annuli of at most `ring` vectors of a pivot, of neighbouring distances."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                d = distances(matrix(batch.column(3), width), pivots)
                near = d.argmin(1)
                yield pa.record_batch([*batch.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], names=["row", "vec_id", "is_query", "v", "pivot", "d"])

    def made(part: pa.Table, number: int) -> pa.RecordBatch:
        part = part.combine_chunks()
        m, d = matrix(part["v"].chunk(0), width), part["d"].to_numpy()
        flags = part["is_query"].to_numpy(zero_copy_only=False)
        norm = (m.astype(float) ** 2).sum(1).max()
        row = (number, part["pivot"][0].as_py(), d[0], d[-1], norm, int(flags.sum()), part["vec_id"].to_pylist(), part["row"].to_numpy().tobytes(), flags.tobytes(), m.tobytes())
        return pa.record_batch([pa.array([x], f.type) for x, f in zip(row, ANNULUS, strict=True)], schema=ANNULUS)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, rest = TaskContext.get().partitionId() << 32, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest else table
            while len(rest):
                pivot = rest["pivot"].to_numpy()
                n = min(ring, int(np.searchsorted(pivot, pivot[0], side="right")))
                if n == len(rest) and n < ring:
                    break
                yield made(rest.slice(0, n), number)
                rest, number = rest.slice(n), number + 1
        if rest:
            yield made(rest, number)

    keyed = vectors.mapInArrow(key, "row long, vec_id long, is_query boolean, v array<long>, pivot int, d double")
    return keyed.repartitionByRange("pivot", "d", "row").sortWithinPartitions("pivot", "d", "row").mapInArrow(pack, ANNULUS_DDL)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def best_of(scores: np.ndarray, ids: list, rows: np.ndarray, block: int, query_rows: np.ndarray, query_ids: list, least: np.ndarray, k: int) -> pa.RecordBatch:
    """The k best of scores (queries by vectors) that reach each query's least score; a query's own row is none."""
    order_id = np.array([np.iinfo(np.int64).max if x is None else x for x in ids], np.int64)
    unknown = np.array([x is None for x in ids], bool)
    out: list[tuple] = []
    for i in range(len(scores)):
        s = scores[i]
        at = np.flatnonzero((s >= least[i]) & (rows != query_rows[i]))
        if len(at) > k:
            kth = np.partition(s[at], len(at) - k)[len(at) - k]
            at = at[s[at] >= kth]
        at = at[np.lexsort((rows[at], order_id[at], unknown[at], -s[at]))[:k]]
        out += [(block, int(query_rows[i]), query_ids[i], ids[j], int(s[j]), int(rows[j])) for j in at.tolist()]
    names = ["block", "row", "query_id", "vec_id", "score", "other"]
    return pa.record_batch([pa.array([x[c] for x in out], pa.int64()) for c in range(6)], names=names)


def at_home(batches: Iterator[pa.RecordBatch], width: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each annulus' queries against that annulus."""
    lowest = np.iinfo(np.int64).min
    for x in each(batches):
        m, rows, flags = np.frombuffer(x["m"], np.int64).reshape(-1, width), np.frombuffer(x["rows"], np.int64), np.frombuffer(x["queries"], bool)
        own = np.flatnonzero(flags)
        for at in range(0, len(own), 512):
            q = own[at : at + 512]
            yield best_of(products(m[q], m), x["vec_ids"], rows, x["ring"], rows[q], [x["vec_ids"][i] for i in q.tolist()], np.full(len(q), lowest), k)


def query_blocks(rings: DataFrame) -> DataFrame:
    """(block, ids, rows, m): an annulus' queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each(batches):
            flags, rows = np.frombuffer(x["queries"], bool), np.frombuffer(x["rows"], np.int64)
            m = np.frombuffer(x["m"], np.int64).reshape(len(rows), -1)
            ids = [i for i, q in zip(x["vec_ids"], flags, strict=True) if q]
            yield pa.record_batch([pa.array([x["ring"]]), pa.array([ids], pa.list_(pa.int64())), pa.array([rows[flags].tobytes()]), pa.array([m[flags].tobytes()])], names=["block", "ids", "rows", "m"])

    return rings.filter("n_queries > 0").mapInArrow(run, "block long, ids array<long>, rows binary, m binary")


def least_scores(x: dict, k: int) -> np.ndarray:
    """A block's k-th best scores so far, by the order of its queries; the lowest number where there are fewer."""
    found: dict[int, list[int]] = {}
    for y in x["best"] or []:
        found.setdefault(y["row"], []).append(y["score"])
    rows = np.frombuffer(x["rows"], np.int64)
    return np.array([min(s) if len(s := found.get(int(r), [])) >= k else np.iinfo(np.int64).min for r in rows], np.int64)


def reach(blocks: DataFrame, pivots: np.ndarray, norm: float, width: int, k: int) -> DataFrame:
    """(block, pivot, near, far, low, high): a block's distances from each pivot, and those of vectors that may be among the best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each(batches):
            m, t = np.frombuffer(x["m"], np.int64).reshape(-1, width), least_scores(x, k).astype(float)
            d, length = distances(m, pivots), (m.astype(float) ** 2).sum(1)
            w = np.sqrt(np.maximum(length + norm - 2 * t + MARGIN * (length + norm + np.abs(t) + 1), 0))[:, None] + MARGIN * (1 + np.sqrt(length + norm))[:, None]
            n = len(pivots)
            yield pa.record_batch([pa.array([x["block"]] * n, pa.int64()), pa.array(np.arange(n, dtype=np.int32)), *(pa.array(c) for c in (d.min(0), d.max(0), (d - w).min(0), (d + w).max(0)))], names=["block", "pivot", "near", "far", "low", "high"])

    return blocks.mapInArrow(run, "block long, pivot int, near double, far double, low double, high double")


def search(visits: DataFrame, rings: DataFrame, blocks: DataFrame, pivots: np.ndarray, width: int, k: int) -> DataFrame:
    """What the annuli of visits (block, ring) have for the blocks' queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groupby(each(batches), lambda x: x["ring"]):
            here = next(found)
            m, rows = np.frombuffer(here["m"], np.int64).reshape(-1, width), np.frombuffer(here["rows"], np.int64)
            for x in found:
                q, t = np.frombuffer(x["m"], np.int64).reshape(-1, width), least_scores(x, k)
                d, length = distances(q, pivots[here["pivot"] : here["pivot"] + 1])[:, 0], (q.astype(float) ** 2).sum(1)
                gap = np.maximum(np.maximum(here["low"] - d, d - here["high"]) - MARGIN * (1 + np.sqrt(length + here["norm"])), 0)
                bound = (length + here["norm"] - gap**2) / 2 + MARGIN * (length + here["norm"] + 1)
                own = np.flatnonzero(bound >= t)
                query_rows, ids = np.frombuffer(x["rows"], np.int64)[own], [x["vec_ids"][i] for i in own.tolist()]
                for at in range(0, len(own), 512):
                    some = slice(at, at + 512)
                    yield best_of(products(q[own[some]], m), here["vec_ids"], rows, x["block"], query_rows[some], ids[some], t[own[some]], k)

    none = F.lit(None)
    here = rings.join(visits.select("ring").distinct(), "ring", "left_semi").select("ring", F.lit(0).alias("kind"), none.cast("long").alias("block"), "pivot", "low", "high", "norm", "vec_ids", "rows", "m", none.cast("array<struct<row: long, score: long>>").alias("best"))
    sent = visits.join(blocks, "block").select("ring", F.lit(1).alias("kind"), "block", none.cast("int").alias("pivot"), none.cast("double").alias("low"), none.cast("double").alias("high"), none.cast("double").alias("norm"), F.col("ids").alias("vec_ids"), "rows", "m", "best")
    return here.unionByName(sent).repartition("ring").sortWithinPartitions("ring", "kind", "block").mapInArrow(run, FOUND)


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "other"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k)


def top_products(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, scale: int = SCALE, query: Column | None = None, ring: int = RING, width: int = WIDTH) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `query` marks (an id divisible by EVERY) its k best others by the inner product of floor(scale * x)."""
    marked = F.col(id_col) % EVERY == 0 if query is None else query
    vectors = cut(whole_vectors(df, id_col, vec_col, scale, marked), "vectors")
    size, norm = vectors.agg(F.max(F.size("v")), F.max(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda s, c: s + c * c))).first()
    if size is None:  # no vectors
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.col("row").alias("score"))
    size = max(size, 1)
    pivots = choose_pivots(vectors, size)
    rings = cut(index(vectors, pivots, size, ring), "annuli")
    best = cut(rings.filter("n_queries > 0").mapInArrow(lambda batches: at_home(batches, size, k), FOUND), "at-home")
    asked = cut(query_blocks(rings), "queries")
    directory = rings.select("ring", "pivot", F.col("low").alias("from"), F.col("high").alias("to"))
    done = asked.select("block", F.col("block").alias("ring"))
    while True:
        blocks = asked.join(best.groupBy("block").agg(F.collect_list(F.struct("row", "score")).alias("best")), "block", "left")
        near = reach(blocks, pivots, norm, size, k).join(directory, "pivot").filter((F.col("from") <= F.col("high")) & (F.col("to") >= F.col("low")))
        gap = F.greatest(F.lit(0.0), F.col("from") - F.col("far"), F.col("near") - F.col("to"))
        left = near.select("block", "ring", gap.alias("gap")).join(done, ["block", "ring"], "left_anti")
        next_ones = F.row_number().over(Window.partitionBy("block").orderBy("gap", "ring"))
        visits = cut(left.withColumn("place", next_ones).filter(F.col("place") <= width).select("block", "ring"), "visits")
        if visits.isEmpty():
            return ranked(best, k).select("query_id", "rank", "vec_id", "score")
        best = cut(ranked(best.unionByName(search(visits, rings, blocks, pivots, size, k)), k).drop("rank"), "best")
        done, width = done.unionByName(visits), width * GROW


#: The same in DuckDB.
SQL = f"""
WITH n AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL),
v AS (SELECT r, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM n WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, o.vec_id, list_dot_product(q.v, o.v)::BIGINT AS score, o.r AS other FROM v q JOIN v o ON q.r <> o.r WHERE q.vec_id % {EVERY} = 0),
ranked AS (SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST, other)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}"""
