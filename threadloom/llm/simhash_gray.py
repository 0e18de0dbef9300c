"""SimHash near-duplicates by a Gray-order hierarchical index.

Fingerprints (64 bits, majority of the XXH64 hashes of word shingles) are grouped by value first. The upper nodes of the
index are bit patterns under masks of whole blocks: of b blocks fingerprints that differ in at most r bits agree on b - r,
so every link lies inside an upper node. With three-word shingles and a radius of 2, the operator's own settings, these are
six masks of two of four 16-bit blocks. For other radii b is the least number whose masks have as many bits as it takes to
count the fingerprints, so that nodes stay small while the table grows; it decides how links are found, never which. Inside a node the fingerprints are sorted by
Gray rank, and runs of FAN of them form the next nodes up to one root; a node keeps the pattern of the bits that all its
fingerprints share. Two nodes are compared by the shared bits in which they differ: this count only grows on the way down,
and once it exceeds the radius both groups are pruned as a whole. Each task passes on a spanning forest of the links it
finds, never all pairs, and components are joined by star contraction on the edge table.

At most 2,080 fingerprints lie within two bits of another, so links grow in proportion to distinct fingerprints however
large a group of near copies is; exact copies of a fingerprint count once. An upper node of more than SPLIT fingerprints is
dealt out again under its wider masks: of the bits left to it, in r + 2 parts, fingerprints within the radius agree on two,
so these masks find the same links; at a radius of 2 no such node has more than the 65,536 values of its other 16 bits.
A task handles whole upper nodes in blocks of BLOCK rows.

Defined results: null text counts as empty; texts without words have fingerprint zero and are linked like any other; equal
rows give equal rows; a null id never becomes a component's id unless all ids of the component are null; an empty table
gives an empty table. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, keep_marked, row_key, text_of
from .components import star_components

RADIUS, FAN, BLOCK, SPLIT = 2, 8, 400_000, 65_536
WORDS = 3


def parts(bits: list[int], n: int) -> list[int]:
    """The bits in n parts of nearly equal size, as masks."""
    ends = [len(bits) * k // n for k in range(n + 1)]
    return [sum(1 << b for b in bits[i:j]) for i, j in zip(ends, ends[1:], strict=False)]


def masks(radius: int = RADIUS, blocks: int | None = None) -> list[int]:
    """Masks of all but `radius` of the blocks, of which there are twice as many as the radius unless it is said otherwise."""
    blocks = 2 * radius if blocks is None else blocks
    return [sum(x) for x in combinations(parts(list(range(64)), blocks), blocks - radius)]


def wider(mask: int, radius: int = RADIUS) -> list[int]:
    """The mask with two of the radius + 2 parts of its other bits."""
    return [mask | a | b for a, b in combinations(parts([b for b in range(64) if not mask >> b & 1], radius + 2), 2)]


def blocks_for(count: int, radius: int) -> int:
    """The least number of blocks whose masks have enough bits to count so many fingerprints; twice the radius at least where that is 2."""
    least = 2 * radius if radius <= 2 else radius + 2
    return next((b for b in range(least, 2 * radius + 3) if 64 * (b - radius) // b >= max(1, count).bit_length()), 2 * radius + 2)


def shingle_hashes(raw: bytes, n: int = WORDS) -> np.ndarray:
    """The XXH64 hashes of the text's shingles in order, repeats included; fewer words are one shingle, none give none."""
    words = raw.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)) if len(words) >= n else [b" ".join(words)]
    return np.fromiter(map(xxh64_intdigest, shingles, repeat(42)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(raw: bytes, n: int = WORDS) -> int:
    return majority(shingle_hashes(raw, n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(doc_id, row_key, fp): fp has the fingerprint's 64 bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                fps = np.array([fingerprint(x.as_py(), words) for x in part.column(2)], np.uint64).view(np.int64)
                yield pa.record_batch([*part.columns[:2], pa.array(fps)], names=["doc_id", "row_key", "fp"])

    return df.select(*row_key(id_col, text_col), text_of(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, row_key long, fp long")


def gray_rank(fp: Column) -> Column:
    """The place of fp in the order of the reflected binary code; as a long, so only ties and runs matter."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp


def popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class Tree:
    """The index of one block of upper nodes: `node` numbers them, fps are sorted by node and Gray rank."""

    def __init__(self, node: np.ndarray, fps: np.ndarray):
        self.levels = [(fps, ~(fps ^ fps), node, np.arange(len(fps)), np.arange(len(fps)) + 1)]
        while True:
            pattern, mask, owner, _, _ = self.levels[-1]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[first, len(owner)])
            if sizes.max() == 1:
                break
            place = np.arange(len(owner)) - np.repeat(first, sizes)
            begin = np.flatnonzero(place % FAN == 0)
            both, either = np.bitwise_and.reduceat(pattern, begin), np.bitwise_or.reduceat(pattern, begin)
            shared = np.bitwise_and.reduceat(mask, begin) & ~(both ^ either)
            self.levels.append((both & shared, shared, owner[begin], begin, np.r_[begin[1:], len(owner)]))

    def links(self, radius: int = RADIUS, chunk: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places whose fingerprints differ in at most radius bits, by descent from (root, root); at most chunk * FAN * FAN pairs are held at once."""
        top = len(self.levels) - 1
        roots = np.arange(len(self.levels[top][0]))
        work = [(top, roots[at : at + chunk], roots[at : at + chunk]) for at in range(0, len(roots), chunk)]
        while work:
            level, a, b = work.pop()
            if level == 0:
                keep = a != b
                if keep.any():
                    yield a[keep], b[keep]
                continue
            _, _, _, begin, end = self.levels[level]
            pattern, mask, *_ = self.levels[level - 1]
            na, nb = end[a] - begin[a], end[b] - begin[b]
            n = na * nb
            which = np.repeat(np.arange(len(a)), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            x, y = begin[a][which] + k // nb[which], begin[b][which] + k % nb[which]
            keep = (x <= y) & (popcount((pattern[x] ^ pattern[y]) & mask[x] & mask[y]) <= radius)
            x, y = x[keep], y[keep]
            work += [(level - 1, x[at : at + chunk], y[at : at + chunk]) for at in range(0, len(x), chunk)]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """For each of n places the smallest place linked to it, directly or not."""
    root = np.arange(n)
    for a, b in links:
        while True:
            x, y = root[a], root[b]
            low, high = np.minimum(x, y), np.maximum(x, y)
            if (low == high).all():
                break
            np.minimum.at(root, high, low)
            while (root != root[root]).any():
                root = root[root]
    return root


def edges_of(part: pa.Table, radius: int = RADIUS) -> pa.RecordBatch:
    m, pattern = part["m"].to_numpy(), part["pattern"].to_numpy()
    fps = part["fp"].to_numpy()
    node = np.cumsum(np.r_[0, (m[1:] != m[:-1]) | (pattern[1:] != pattern[:-1])])
    several = np.bincount(node)[node] > 1
    again = np.r_[False, (fps[1:] == fps[:-1]) & (node[1:] == node[:-1])]  # a wider node that two split ones share
    fps, node = fps[several & ~again], node[several & ~again]
    if not len(fps):
        return pa.record_batch([pa.array([], pa.int64())] * 2, names=["u", "v"])
    root = forest(len(fps), Tree(node, fps.view(np.uint64)).links(radius))
    other = root != np.arange(len(fps))
    return pa.record_batch([pa.array(fps[other]), pa.array(fps[root[other]])], names=["u", "v"])


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def upper_nodes(distinct: DataFrame, split: int = SPLIT, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(m, pattern, fp): every fingerprint under each mask, those of nodes above `split` under the wider masks instead."""
    first = masks(radius, blocks)

    def under(wanted: list[int]) -> Column:
        return F.array(*(F.struct(F.lit(signed(m)).alias("m"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("pattern")) for m in wanted))

    nodes = distinct.select("fp", F.inline(under(first)))
    large = cut(nodes.groupBy("m", "pattern").agg(F.count("*").alias("n")).filter(F.col("n") > split).select("m", "pattern", F.lit(True).alias("large")), "simhash-large")
    if large.isEmpty():
        return nodes.select("m", "pattern", "fp")
    marked = nodes.join(large, ["m", "pattern"], "left")
    small = marked.filter("large is null").select("m", "pattern", "fp")
    # a few rows a mask, whatever the table's size
    finer = distinct.sparkSession.createDataFrame([(signed(m), signed(w)) for m in first for w in wider(m, radius)], "m long, w long")
    again = marked.filter("large").select("m", "fp").join(F.broadcast(finer), "m")
    return small.unionByName(again.select(F.col("w").alias("m"), F.col("fp").bitwiseAND(F.col("w")).alias("pattern"), "fp"))


def link_edges(distinct: DataFrame, split: int = SPLIT, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """(u, v): a spanning forest, per upper node, of the links between the distinct fingerprints in column fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest else table
            if len(rest) >= BLOCK:  # up to the last change of node
                m, pattern = rest["m"].to_numpy(), rest["pattern"].to_numpy()
                changes = np.flatnonzero((m[1:] != m[:-1]) | (pattern[1:] != pattern[:-1]))
                if len(changes):
                    yield edges_of(rest.slice(0, changes[-1] + 1), radius)
                    rest = rest.slice(changes[-1] + 1).combine_chunks()
        if rest:
            yield edges_of(rest, radius)

    nodes = upper_nodes(distinct, split, radius, blocks).withColumn("rank", gray_rank(F.col("fp")))
    return nodes.repartition("m", "pattern").sortWithinPartitions("m", "pattern", "rank").drop("rank").mapInArrow(run, "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", split: int = SPLIT, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """Per document: doc_id, row_key, fingerprint, component_id, keep (true for the row, or equal rows, that stand for the component)."""
    rows = cut(fingerprints(df, id_col, text_col, words), "simhash")
    one = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")
    distinct = cut(rows.groupBy("fp").agg(F.min(one).alias("first")), "simhash-distinct")
    roots = star_components(link_edges(distinct.select("fp"), split, radius, blocks_for(distinct.count(), radius)))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    firsts = placed.groupBy("root").agg(F.min("first").alias("best"))
    classes = placed.join(firsts, "root").select("fp", "best")
    keep = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    return rows.join(classes, "fp").select("doc_id", "row_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"), keep.alias("keep"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows of df, all columns, that stand for their components: one of each, the one of smallest id."""
    return keep_marked(df, near_duplicates(df, id_col, text_col, words=words, radius=radius), id_col, text_col)
