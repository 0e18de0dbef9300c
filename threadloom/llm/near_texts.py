"""Near copies by SimHash and MinHash candidates and an exact check: sets of word shingles whose Jaccard coefficient is `percent` or more.

SimHash of 64 bits alone can't reach a similarity of 0.8, where fingerprints differ in about ten bits: a radius that wide has
no useful masks. So candidates come from two sides. The Gray-order index of simhash_gray links fingerprints within `radius`
bits; and texts are put in BANDS buckets, each by the hash of ROWS least shingles under as many permutations, so that two
texts of similarity s share a bucket with chance 1 - (1 - s ** ROWS) ** BANDS: 0.986 at 0.8, and more above. Pairs of a bucket
whose fingerprints differ in more than APART bits, or whose sizes rule the similarity out, are left (at 0.8 the distance is
9.7 on average, with a deviation of 2.9), but for the last round. Every candidate is compared by the two texts' whole sets.

Equal sets count once. A bucket's sets are first compared with its smallest only, so a group of copies costs as many
comparisons as it has members. Where a bucket then still lies in several components, about LEADERS of its sets are compared
with those of other components. In a last round all sets of a bucket that are still apart meet, block by block of bounded
size, and only links are written: so no link of a bucket is lost between components, large groups are settled before, and
pairs of unlike sets of a bucket cost a count in a task, neither a row nor a shuffle.

Sets are told apart by 64-bit hashes of their shingles' XXH64 hashes (chance). Defined results: null text counts as empty;
texts without words are copies of each other; texts of fewer words than a shingle has are one shingle; equal rows give equal
rows; a null id never becomes a component's id unless all ids of the component are null; an empty table gives an empty table.
Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import cut, keep_marked, row_key, text_of
from .components import star_components
from .simhash_gray import blocks_for, link_edges, majority, shingle_hashes

WORDS, PERCENT, RADIUS = 5, 80, 4
BANDS, ROWS, APART, LEADERS = 14, 6, 24, 16
SETS, HASHES = 1024, 1 << 20

#: Multiplication by an odd number permutes the 64-bit hashes.
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)


def buckets(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, from the least hashes under its permutations; none for a text without words."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (FACTORS[:, None] * hashes[None, at : at + 1024]).min(1), out=least)
    rows = least.astype("<u8").reshape(BANDS, ROWS)
    return np.array([xxh64_intdigest(rows[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def sketches(df: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, row_key, fp, key, n, buckets): fingerprint, the set's key, its size and its buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                fps, keys, sizes, found = [], [], [], []
                for x in part.column(2):
                    hashes = shingle_hashes(x.as_py(), words)
                    alone = np.unique(hashes)
                    fps.append(majority(hashes))
                    keys.append(xxh64_intdigest(alone.astype("<u8").tobytes(), 7))
                    sizes.append(len(alone))
                    found.append(buckets(alone))
                longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (fps, keys)]
                yield pa.record_batch([*part.columns[:2], *longs, pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "row_key", "fp", "key", "n", "buckets"])

    texts = df.select(*row_key(id_col, text_col), text_of(text_col).cast("binary").alias("t"))
    return texts.mapInArrow(run, "doc_id long, row_key long, fp long, key long, n long, buckets array<long>")


def may_be_near(a: str, b: str, percent: int) -> Column:
    """Whether sizes and fingerprints of a and b allow for the similarity."""
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= APART)


def pair(a: str, b: str) -> list[Column]:
    """The pair as (u, v), the smaller key as v: what a bucket's sets are first compared with."""
    return [F.greatest(f"{a}.key", f"{b}.key").alias("u"), F.least(f"{a}.key", f"{b}.key").alias("v")]


def gray_pairs(sets: DataFrame, radius: int) -> DataFrame:
    """(u, v): sets of one fingerprint with the first of them, and the first ones of fingerprints that the Gray-order index links."""
    sets = sets.select("key", "fp")
    firsts = cut(sets.groupBy("fp").agg(F.min("key").alias("first")), "near-fingerprints")
    links = link_edges(firsts.select("fp"), radius=radius, blocks=blocks_for(firsts.count(), radius))
    ends = [firsts.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "uv"]
    linked = links.join(ends[0], "u").join(ends[1], "v").select(F.greatest("first_u", "first_v").alias("u"), F.least("first_u", "first_v").alias("v"))
    return sets.join(firsts, "fp").select(F.col("key").alias("u"), F.col("first").alias("v")).filter("u <> v").unionByName(linked)


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(key, hashes): the set of a text's shingles as its sorted hashes, eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                found = [np.unique(shingle_hashes(x.as_py(), words)).astype("<u8").tobytes() for x in part.column(1)]
                yield pa.record_batch([part.column(0), pa.array(found, pa.binary())], names=["key", "hashes"])

    return texts.mapInArrow(run, "key long, hashes binary")


def similar(pairs: DataFrame, hashes: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose sets are similar enough, by all their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(z.as_py(), "<u8") for z in (x, y))
                both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a) if len(b) else 0
                keep.append((100 + percent) * both >= percent * (len(a) + len(b)))
            yield pa.record_batch(batch.select(["u", "v"]).columns, names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    u, v = (hashes.select(F.col("key").alias(k), F.col("hashes").alias(f"h{k}")) for k in "uv")
    return pairs.join(u, "u").join(v, "v").select("u", "v", "hu", "hv").mapInArrow(run, "u long, v long")


def links_of(group: pa.Table, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between the sets of different roots in block `lo` and block `hi`, which may be the same."""
    keys, block = group["key"].to_numpy(), group["block"].to_numpy()
    found = [np.frombuffer(x.as_py(), "<u8") for x in group["hashes"]]
    sizes = np.array([len(x) for x in found])
    starts = np.cumsum(sizes) - sizes
    _, places = np.unique(np.concatenate(found), return_inverse=True)
    _, label = np.unique(group["root"].to_numpy(), return_inverse=True)
    inside, links = np.zeros(places.max() + 1, np.int64), []
    # rows are sorted by block: those of hi come last, and each is compared with all before it that are of lo
    lo = group["lo"][0].as_py()
    for i in np.flatnonzero(block == group["hi"][0].as_py()):
        n = i if block[i] == lo else np.searchsorted(block, lo, "right")
        if not n or (label[:n] == label[i]).all():
            continue
        mine = places[starts[i] : starts[i] + sizes[i]]
        inside[mine] = 1
        both = np.add.reduceat(inside[places[: starts[n - 1] + sizes[n - 1]]], starts[:n])
        inside[mine] = 0
        hits = np.flatnonzero(((100 + percent) * both >= percent * (sizes[:n] + sizes[i])) & (label[:n] != label[i]))
        if len(hits):
            joined, first = np.unique(label[hits], return_index=True)
            links += [(int(max(keys[i], keys[j])), int(min(keys[i], keys[j]))) for j in hits[first]]
            label[np.isin(label, joined)] = label[i]
    return links


def apart_links(members: DataFrame, hashes: DataFrame, percent: int, most_sets: int = SETS, most_hashes: int = HASHES) -> DataFrame:
    """(u, v): links between sets of members (bucket, s, root) that share a bucket and have different roots; no pair is written before it is found to be a link.

    A bucket's most frequent root is its main one. Sets of the main root and the others are dealt to blocks of about
    `most_sets` sets and `most_hashes` hashes by their keys; each block of others meets every block, and blocks of the main
    root don't meet each other. A task holds two blocks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(part: pa.Table) -> pa.RecordBatch:
            ids = [part[c].to_numpy() for c in ("bucket", "lo", "hi")]
            ends = [0, *(np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0)) + 1), len(part)]
            links = [x for a, b in zip(ends, ends[1:], strict=False) for x in links_of(part.slice(a, b - a), percent)]
            return pa.record_batch([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["u", "v"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            rest = pa.concat_tables([rest, table]) if rest else table
            if len(rest):  # up to the last change of group
                ids = [rest[c].to_numpy() for c in ("bucket", "lo", "hi")]
                changes = np.flatnonzero(np.any([x[1:] != x[:-1] for x in ids], axis=0))
                if len(changes):
                    yield flush(rest.slice(0, changes[-1] + 1))
                    rest = rest.slice(changes[-1] + 1).combine_chunks()
        if rest:
            yield flush(rest)

    roots = members.groupBy("bucket", "root").agg(F.count("*").alias("c"), F.sum("s.n").alias("w"))
    per = roots.groupBy("bucket").agg(F.max(F.struct("c", "root", "w")).alias("main"), F.sum("c").alias("c"), F.sum("w").alias("w"))

    def blocks(c: Column, w: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil(c / most_sets), F.ceil(w / most_hashes)).cast("long")

    per = per.select("bucket", F.col("main.root").alias("main"), blocks(F.col("main.c"), F.col("main.w")).alias("p"), blocks(F.col("c") - F.col("main.c"), F.col("w") - F.col("main.w")).alias("q"))
    hashed, is_main = F.xxhash64("s.key"), F.col("root") == F.col("main")
    placed = members.join(per, "bucket").withColumn("block", F.when(is_main, F.pmod(hashed, "p")).otherwise(F.col("p") + F.pmod(hashed, "q")))
    met = F.explode(F.sequence(F.when(is_main, F.col("p")).otherwise(F.lit(0)), F.col("p") + F.col("q") - 1)).alias("met")
    dealt = placed.select("bucket", "block", "root", F.col("s.key").alias("key"), met).withColumns({"lo": F.least("block", "met"), "hi": F.greatest("block", "met")}).drop("met")
    rows = dealt.join(hashes, "key").repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "block", "key")
    return rows.select("bucket", "lo", "hi", "block", "key", "root", "hashes").mapInArrow(run, "u long, v long").distinct()


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS, leaders: int = LEADERS) -> DataFrame:
    """Per document: doc_id, row_key, component_id, keep (true for the row, or equal rows, that stand for the component)."""
    rows = cut(sketches(df, id_col, text_col, words), "near")
    one = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_key")
    # equal sets have equal sizes and buckets, and fingerprints that may differ
    sets = cut(rows.groupBy("key").agg(F.min(one).alias("first"), F.min("fp").alias("fp"), F.first("n").alias("n"), F.first("buckets").alias("buckets")), "near-sets")
    members = sets.select(F.explode("buckets").alias("bucket"), F.struct("key", "n", "fp").alias("s"))
    heads = members.groupBy("bucket").agg(F.min("s").alias("head"), F.count("*").alias("m")).filter("m > 1")
    shared = cut(members.join(heads, "bucket"), "near-shared")

    stars = shared.filter("s.key <> head.key").filter(may_be_near("s", "head", percent)).select(*pair("s", "head"))
    tried = cut(stars.unionByName(gray_pairs(sets, radius)).distinct(), "near-stars")

    # the sets that any round may compare
    ends = tried.select(F.explode(F.array("u", "v")).alias("key")).unionByName(shared.select("s.key")).distinct()
    wanted = cut(sets.join(ends, "key", "left_semi").select("key", F.col("first.doc_id").alias("__doc"), F.col("first.row_key").alias("__row")), "near-wanted")
    doc, row = row_key(id_col, text_col)
    given = df.select(doc, row, text_of(text_col).cast("binary").alias("t"))
    texts = given.join(wanted, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("row_key") == F.col("__row"))).select("key", "t")
    repeated = not rows.groupBy("doc_id", "row_key").count().filter("count > 1").isEmpty()
    hashes = cut(shingle_sets(texts.dropDuplicates(["key"]) if repeated else texts, words), "near-hashes")

    def mixed(roots: DataFrame) -> DataFrame:
        """What shares a bucket with sets of other components."""
        marked = shared.join(roots, shared["s.key"] == roots["node"], "left").select("bucket", "s", "m", F.coalesce("root", "s.key").alias("root"))
        several = marked.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high").select("bucket")
        return cut(marked.join(several, "bucket"), "near-mixed")

    edges = cut(similar(tried, hashes, percent), "near-edges")
    roots = star_components(edges)
    still = mixed(roots)
    chosen = F.pmod(F.xxhash64("bucket", "s.key"), F.lit(1 << 30)) / (1 << 30) < leaders / F.col("m")
    heads = still.filter(chosen).select("bucket", F.col("s").alias("head"), F.col("root").alias("head_root"))
    apart = still.join(heads, "bucket").filter("root <> head_root").filter(may_be_near("s", "head", percent))
    led = cut(similar(apart.select(*pair("s", "head")).distinct().join(tried, ["u", "v"], "left_anti"), hashes, percent), "near-edges")
    if not led.isEmpty():
        edges = edges.unionByName(led)
        roots = star_components(edges)
        still = mixed(roots)
    last = cut(apart_links(still, hashes, percent), "near-edges")
    if not last.isEmpty():
        roots = star_components(edges.unionByName(last))

    placed = sets.join(roots, sets["key"] == roots["node"], "left").select("key", "first", F.coalesce("root", "key").alias("root"))
    classes = placed.join(placed.groupBy("root").agg(F.min("first").alias("best")), "root").select("key", "best")
    keep = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))
    return rows.join(classes, "key").select("doc_id", "row_key", F.col("best.doc_id").alias("component_id"), keep.alias("keep"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, radius: int = RADIUS) -> DataFrame:
    """The rows of df, all columns, that stand for their components: one of each, the one of smallest id."""
    return keep_marked(df, near_duplicates(df, id_col, text_col, words, percent, radius), id_col, text_col)
