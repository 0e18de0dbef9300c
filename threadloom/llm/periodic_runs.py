"""Periodic runs of words by Karp-Miller-Rosenberg naming.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of 2 * q and of
`least` or more that no neighbouring word extends. Texts are taken some at a time and put in a row, longest first:

1. `names[k][i]` names the 2 ** k words from i: equal numbers for equal words of the same text, from pairs of names of the
   level below. A block that occurs once in its text equals nothing, nor does any block around it; only the others are named.
2. A run of period q has a stretch of e = max(least - q, q) places or more whose words equal those q further on. It covers
   a whole block of a grid of 2 ** k <= (e + 1) / 2 words, so for each q the names of the grid's blocks are compared with
   those q further on.
3. Where they are equal, the common extension to both sides is found by descending levels of names. Of equal stretches the
   one of smallest period is the run: a smaller period of a maximal stretch has the same stretch.

No hash, no sorting of suffixes: a text of n words takes O(n log n) names and grid places. A text is handled by one task
and whole; texts are independent, so no key is hot.

Defined results: null and empty texts have no words and no runs; equal rows and null ids give a row each; an empty table
gives an empty table; bytes that are no UTF-8 are compared as bytes. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_of

LEAST = 12
#: Words of texts that are named together, and grid places whose extensions are found at once.
TOGETHER, AT_ONCE = 1 << 18, 1 << 18
Runs = tuple[np.ndarray, np.ndarray, np.ndarray]


def grid_level(q: int, least: int) -> int:
    return ((max(least - q, q) + 1) // 2).bit_length() - 1


def name_levels(ids: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Names of the blocks of 1, 2, 4 ... words of texts in a row, longest first; negative where a block equals no other of its text."""
    n = len(ids)
    alone = -1 - np.arange(n)
    text = np.repeat(np.arange(len(sizes)), sizes)
    pairs = text * (int(ids.max()) + 1) + ids
    at, levels = np.arange(n), []
    while True:
        names = alone.copy()
        if len(at):
            _, inverse, counts = np.unique(pairs, return_inverse=True, return_counts=True)
            twice = counts[inverse] > 1
            names[at[twice]] = inverse[twice]
        levels.append(names)
        width = 1 << (len(levels) - 1)
        # blocks whose halves both have names; those of two texts are none
        end = n - width
        at = np.flatnonzero((names[:end] >= 0) & (names[width:] >= 0) & (text[:end] == text[width:])) if end > 0 else at[:0]
        if not len(at):
            return levels
        pairs = names[at] * n + names[at + width]


def extend(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words from a equal those from b, and how many before a those before b."""
    after, before = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    n = len(levels[0])
    for k in reversed(range(len(levels))):
        width, names = 1 << k, levels[k]
        x, y = a + after, b + after
        inside = np.flatnonzero(y + width <= n)
        same = names[x[inside]] == names[y[inside]]
        after[inside[same]] += width
        x, y = a - before - width, b - before - width
        inside = np.flatnonzero(x >= 0)
        same = names[x[inside]] == names[y[inside]]
        before[inside[same]] += width
    return after, before


def smallest(runs: list[Runs]) -> list[Runs]:
    """Each stretch once, with its smallest period."""
    start, end, period = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    first = np.flatnonzero(np.r_[True, (start[1:] != start[:-1]) | (end[1:] != end[:-1])][: len(start)])
    return [(start[first], end[first], period[first])]


def runs_in(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> Runs:
    """(start, end, period) of all runs of texts in a row, longest first, by start; end exclusive."""
    starts = np.cumsum(sizes) - sizes
    levels = name_levels(ids, sizes)
    found: list[Runs] = []
    waiting: list[tuple[np.ndarray, int]] = []
    held = size = 0

    def settle() -> None:
        nonlocal found, size
        a = np.concatenate([x for x, _ in waiting])
        q = np.repeat(np.array([q for _, q in waiting]), [len(x) for x, _ in waiting])
        for at in range(0, len(a), AT_ONCE):
            x, period = a[at : at + AT_ONCE], q[at : at + AT_ONCE]
            after, before = extend(levels, x, x + period)
            start, end = x - before, x + period + after
            kept = end - start >= np.maximum(least, 2 * period)
            found.append((start[kept], end[kept], period[kept]))
            size += int(kept.sum())
        waiting.clear()
        if size > AT_ONCE:
            found = smallest(found)
            size = 0

    for q in range(1, int(sizes[0]) // 2 + 1):
        k = grid_level(q, least)
        if k >= len(levels):
            if q >= least:
                break  # no block of this size equals another one, nor does any larger one
            continue
        reach = int(np.searchsorted(-sizes, -2 * q, side="right"))  # texts of 2 * q words or more
        end = int(starts[reach - 1] + sizes[reach - 1]) - q
        names, step = levels[k], 1 << k
        left = names[0:end:step]
        at = np.flatnonzero((left == names[q : q + end : step]) & (left >= 0)) * step
        if len(at):
            waiting.append((at, q))
            held += len(at)
            if held >= AT_ONCE:
                settle()
                held = 0
    if waiting:
        settle()
    return smallest(found)[0] if found else (np.zeros(0, np.int64),) * 3


class Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def texts_in(raws: list[bytes], least: int) -> list[tuple[list[tuple[int, int, int]], bytes]]:
    """For each text its runs (start, length, period) and the words that no run repeats, joined by a space."""
    words = [x.split() for x in raws]
    order = sorted(range(len(raws)), key=lambda i: -len(words[i]))
    sizes = np.array([len(words[i]) for i in order], np.int64)
    known = Known()
    ids = np.fromiter((known[w] for i in order for w in words[i]), np.int64, int(sizes.sum()))
    out: list = [([], b" ".join(x)) for x in words]
    if not len(ids):
        return out
    start, end, period = runs_in(ids, sizes, least)
    begins = np.cumsum(sizes) - sizes
    owner = np.searchsorted(begins, start, side="right") - 1
    while (short := sizes[owner] == 0).any():  # texts without words begin where the next one does
        owner[short] -= 1
    first = np.searchsorted(owner, np.arange(len(order) + 1))
    for t in np.unique(owner).tolist():
        of, base, i = slice(first[t], first[t + 1]), begins[t], order[t]
        found = sorted(zip((start[of] - base).tolist(), (end[of] - start[of]).tolist(), period[of].tolist(), strict=True), key=lambda x: (x[0], x[2]))
        repeated = np.zeros(len(words[i]) + 1, np.int64)
        np.add.at(repeated, start[of] - base + period[of], 1)
        np.add.at(repeated, end[of] - base, -1)
        kept = np.flatnonzero(np.cumsum(repeated[:-1]) == 0).tolist()
        out[i] = found, b" ".join([words[i][k] for k in kept])
    return out


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_id, runs, collapsed): a text's runs by start and period, and as bytes its words but for those that stand in a run after its first period."""
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, held, size = 0, [], 0
            for k in range(batch.num_rows):
                held.append(batch.column(1)[k].as_py())
                size += len(held[-1])
                if size >= 6 * TOGETHER or k + 1 == batch.num_rows:
                    found = texts_in(held, least)
                    runs = pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in x] for x, _ in found], kind)
                    yield pa.record_batch([batch.column(0).slice(at, k + 1 - at), runs, pa.array([x for _, x in found], pa.binary())], names=["doc_id", "runs", "collapsed"])
                    at, held, size = k + 1, [], 0

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed binary")


def run_digest(found: DataFrame) -> DataFrame:
    """Per text the number of its runs, the longest one (ties: smallest start, then period), and digests of the runs and of the collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("back"), (-r["period"]).alias("short"))))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))))
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    exponent = F.expr("1000 * best.length div -best.short")
    return each.select("doc_id", "n_runs", (-F.col("best.back")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.short")).alias("period"), exponent.alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


def with_planted_periods(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df (doc_id, text) where one document in ten, by its id's checksum, repeats itself from some word on; texts of null ids stay as they are.

    Words are those between ASCII white space, so a changed text has single spaces between them.
    """
    h = F.crc32(F.col(id_col).cast("long").cast("string").cast("binary"))
    words: Column = F.filter(F.split(text_of(text_col), "[ \\x09-\\x0D]+"), lambda w: w != "")
    each = df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"), h.alias("h"))
    planted = each.filter("h % 10 = 0").withColumn("words", words).withColumn("n", F.size("words").cast("long"))
    planted = planted.withColumn("a", F.expr("if(n > 0, h div 10 % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + h div 10 % 8)"))
    turned = F.transform("words", lambda _, i: F.get("words", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")))
    return each.filter("h % 10 <> 0 or h is null").select("doc_id", "text").unionByName(planted.select("doc_id", F.array_join(turned, " ").alias("text")))
