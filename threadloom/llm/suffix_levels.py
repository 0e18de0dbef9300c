"""Exact repeated passages: a logarithmic family of sparse suffix arrays.

A byte goes if some string of LENGTH bytes that covers it starts at two or more places of the corpus. Suffixes are indexed
at anchors only: the anchor of a window of LENGTH bytes is the place of its smallest GRAM-byte hash (the first of equal
ones), so equal windows have equal anchors. The stretch of windows that share an anchor is a segment, about 170 bytes of
window starts; the index has one entry for each distinct segment, with its anchor's gram, in the suffix order's runs.

`SuffixLevels.ingest` takes a batch of documents: the batch's entries are merge-scanned against the existing levels (a join
on the gram, which sorts both sides), runs that may match are noted, and the batch becomes a level of its own; levels of
equal size class are merged before the next batch, so there are about log2(batches) of them and an entry is rewritten as
often. `measured` reads the noted entries' bytes once and measures their matches.

Two entries of one gram match over the bytes that their contexts share to the left and to the right of the anchor, if
these are LENGTH or more. A task sorts the right contexts (a suffix array cut at LENGTH bytes) and the reversed left ones,
and takes the lengths of common prefixes of neighbours; for an offset o, entries in one run of the right array at
LENGTH - o and in one run of the left array at o have the window at this offset in common. Runs of a gram with more than
HOT distinct contexts, which would not fit a task, are matched by an aggregation over their windows' hashes instead.

Segments count as equal if their two 64-bit hashes are: for texts not made against the hashes' fixed bases the chance that
any two different ones of n agree is n * n / 2**129, 5e-16 for the 6e11 segments of 100 TB. Matches of unequal segments are
measured on the bytes themselves.

With `words`, passages are counted a second time by words, whatever their bytes: a word counts if a string of PASSAGE words
that covers it is found in another document too; white space between words does not tell strings apart, repeats inside one
document do not count. Its segments are anchored in the same way, at the smallest hash of PHRASE words, and measured by the
same suffix arrays over 64-bit codes of words; two words of equal codes count as equal (chance). They are not kept in levels:
anchors of one document alone are dropped at once. What is removed does not depend on it.

Defined results: null text counts as empty; texts under LENGTH bytes keep everything; matches never cross texts; equal
rows each count as a document, so both go; null ids stay; an empty table gives an empty table. Columns other than the two
named are not read. Texts are scanned in stretches of STRETCH bytes, so memory does not grow with their length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, same_row, text_of

LENGTH, GRAM, STRETCH, HOT, BLOCK = 400, 64, 1 << 19, 20_000, 8_000
PASSAGE, PHRASE, LONG = 51, 8, 1 << 12
SPACE = np.isin(np.arange(256), [32, *range(9, 14)])

_random = np.random.default_rng(400)
#: A random value for each byte and for each of two hashes, and the hashes' odd bases.
TABLE = _random.integers(0, 1 << 64, (2, 256), np.uint64)
BASES = _random.integers(0, 1 << 63, 2, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of a base and of its inverse modulo 2**64."""
    if which not in _powers or len(_powers[which][0]) < n:
        size = max(n, 1 << 14)
        base = int(BASES[which])
        with np.errstate(over="ignore"):
            _powers[which] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, b, np.uint64))]) for b in (base, pow(base, -1, 1 << 64)))
    p, q = _powers[which]
    return p[:n], q[:n]


def prefix(values: np.ndarray, which: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(which, len(values))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """For each window of w values the place of the least, the first of equal ones; values count by their upper 44 bits."""
    key = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)
    n = len(key) - w + 1
    blocks = -(-len(key) // w)
    padded = np.full(blocks * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[: len(key)] = key
    ahead = np.minimum.accumulate(padded.reshape(blocks, w), axis=1).ravel()
    behind = np.minimum.accumulate(padded.reshape(blocks, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    return (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & np.uint64(0xFFFFF)).astype(np.int64)


def word_codes(raw: bytes) -> np.ndarray:
    """A code of each word, never 0; words of over LONG bytes get theirs from another hash, so that texts are read in stretches."""
    data = np.frombuffer(raw, np.uint8)
    edges = np.flatnonzero(np.diff(np.r_[True, SPACE[data], True]))
    first, last = edges[::2], edges[1::2]
    codes = np.empty(len(first), np.uint64)
    for at in range(0, len(raw), STRETCH):
        some = slice(*np.searchsorted(first, [at, at + STRETCH]))
        sums = prefix(TABLE[0][data[at : at + STRETCH + LONG]], 0)
        b, e = first[some] - at, np.minimum(last[some] - at, len(sums) - 1)
        codes[some] = mixed((sums[e] - sums[b]) * powers(0, len(sums))[1][b])
    for i in np.flatnonzero(last - first > LONG):
        codes[i] = int.from_bytes(hashlib.blake2b(raw[first[i] : last[i]], digest_size=8).digest(), "little")
    return codes | np.uint64(1)


def segments(units: np.ndarray) -> np.ndarray:
    """Rows (first window, last window, anchor, gram hash, segment hash) of one text, its bytes or the codes of its words, as int64."""
    is_bytes, out = units.dtype == np.uint8, []
    length, gram = (LENGTH, GRAM) if is_bytes else (PASSAGE, PHRASE)
    for at in range(0, len(units) - length + 1, STRETCH):
        data = units[at : at + STRETCH + length - 1]
        values = [TABLE[k][data] if is_bytes else mixed(data ^ TABLE[k][0]) for k in (0, 1)]
        sums = prefix(values[0], 0)
        n = len(data) - gram + 1
        grams = mixed((sums[gram:] - sums[:n]) * powers(0, n)[1])
        anchor = sliding_argmin(grams, length - gram + 1)
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        last = np.r_[first[1:] - 1, len(anchor) - 1]
        a = anchor[first]
        sums = prefix(values[1], 1)
        whole = mixed((sums[last + length] - sums[first]) * powers(1, len(data))[1][first]) + mixed((a - first).astype(np.uint64) << np.uint64(12) | (a - last).astype(np.uint64))
        out.append(np.stack([first + at, last + at, a + at, grams[a].view(np.int64), whole.view(np.int64)], 1))
    return np.concatenate(out) if out else np.zeros((0, 5), np.int64)


SEGMENT = ("w0", "w1", "a", "g", "s")


def segment_table(df: DataFrame, id_col: str, text_col: str, words: bool = False) -> DataFrame:
    """(doc_id, row_key, SEGMENT) of the texts' bytes or words, and the document's number o; equal rows have numbers of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                found = [segments(word_codes(x.as_py()) if words else np.frombuffer(x.as_py(), np.uint8)) for x in part.column(2)]
                which = np.repeat(np.arange(len(found)), [len(x) for x in found])
                rows = np.concatenate(found)
                kept = [c.take(pa.array(which)) for k, c in enumerate(part.columns) if k != 2]
                yield pa.record_batch([*kept, *(pa.array(rows[:, k]) for k in range(5))], names=[*names, *SEGMENT])

    names = ["doc_id", "row_key", *(["o"] if words else [])]
    docs = df.select(*row_key(id_col, text_col), text_of(text_col).cast("binary").alias("t"), *([F.monotonically_increasing_id().alias("o")] if words else []))
    return docs.mapInArrow(run, ", ".join(f"{c} long" for c in (*names, *SEGMENT)))


def shared_words(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The segments of words, without those whose anchor's gram is one document's alone."""
    table = cut(segment_table(df, id_col, text_col, True), "words")
    grams = table.groupBy("g").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo < hi").select("g")
    return cut(table.join(cut(grams, "grams"), "g"), "shared")  # as a table, so that a very common gram is split between tasks


def contexts(df: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(g, s, low, high, words, owner, context): each wanted segment's bytes or codes of words; offsets of its windows run from low to high."""
    docs = df.select(*row_key(id_col, text_col), text_of(text_col).cast("binary").alias("t"))
    places = wanted.groupBy("doc_id", "row_key").agg(F.collect_list(F.struct(*SEGMENT, "words", "owner")).alias("places"))
    joined = docs.join(places, same_row(docs, places)).select(docs["t"], places["places"], docs["doc_id"], docs["row_key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 32):
                part = whole.slice(at, 32)
                rows = []
                for t, found in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    codes = word_codes(t) if any(p["words"] for p in found) else None
                    for p in found:
                        context = codes[p["w0"] : p["w1"] + PASSAGE].tobytes() if p["words"] else t[p["w0"] : p["w1"] + LENGTH]
                        rows.append((p["g"], p["s"], p["a"] - p["w1"], p["a"] - p["w0"], p["words"], p["owner"], context))
                kinds = [pa.int64()] * 4 + [pa.bool_(), pa.int64(), pa.binary()]
                yield pa.record_batch([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["g", "s", "low", "high", "words", "owner", "context"])

    made = joined.select("t", "places").mapInArrow(run, "g long, s long, low long, high long, words boolean, owner long, context binary")
    return made


def suffix_order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in sorted order, and each place's length in common with the one before; rows are padded with 0, which no byte (they count from 1) and no code is."""
    order = np.argsort(rows.view(f"S{rows.shape[1] * rows.itemsize}").ravel(), kind="stable")
    sorted_rows = rows[order]
    differ = sorted_rows[1:] != sorted_rows[:-1]
    lengths = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    real = (sorted_rows != 0).sum(1)
    return order, np.r_[0, np.minimum(lengths, np.minimum(real[1:], real[:-1]))]


def matched(low: np.ndarray, high: np.ndarray, texts: list[bytes], owners: np.ndarray, words: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of each entry the least and the greatest offset of a window that an entry of another owner has as well; -1 where there is none."""
    n, by_owner = len(texts), np.argsort(owners, kind="stable")
    length, gram, kind = (PASSAGE, PHRASE, np.uint64) if words else (LENGTH, GRAM, np.uint8)
    right, left = np.zeros((n, length), kind), np.zeros((n, length - gram), kind)
    for i, (h, t) in enumerate(zip(high.tolist(), texts, strict=True)):
        b = np.frombuffer(t, kind) if words else np.frombuffer(t, kind) + np.uint8(1)
        right[i, : min(len(b) - h, length)] = b[h : h + length]
        left[i, :h] = b[:h][::-1]
    r_order, r_common = suffix_order(right)
    l_order, l_common = suffix_order(left)
    least, most = np.full(n, -1), np.full(n, -1)
    r_run, l_run = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1):
        r_run[r_order] = np.cumsum(r_common < length - o)
        l_run[l_order] = np.cumsum(l_common < o) if o else 0
        valid = by_owner[((low <= o) & (o <= high))[by_owner]]
        if len(valid) < 2:
            continue
        key = r_run[valid] * (n + 1) + l_run[valid]
        order = np.argsort(key, kind="stable")
        first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
        sizes, who = np.diff(np.r_[first, len(order)]), owners[valid[order]]
        twice = valid[order[np.repeat(who[first] != who[first + sizes - 1], sizes)]]
        least[twice] = np.where(least[twice] < 0, o, least[twice])
        most[twice] = o
    return least, most


COVERED = "g long, s long, least long, most long"


def matches(found: DataFrame) -> DataFrame:
    """(g, s, least, most) for the entries of `contexts` that share a window with one of another owner and of their gram."""

    def solve(block: pa.Table) -> Iterator[pa.RecordBatch]:
        for words in (False, True):
            part = block.filter(pa.compute.equal(block["words"], words))
            if len(part):
                yield solved(part, words)

    def solved(part: pa.Table, words: bool) -> pa.RecordBatch:
        least, most = matched(part["low"].to_numpy(), part["high"].to_numpy(), part["context"].to_pylist(), part["owner"].to_numpy(), words)
        keep = pa.array(least >= 0)
        return pa.record_batch([part["g"].combine_chunks().filter(keep), part["s"].combine_chunks().filter(keep), pa.array(least).filter(keep), pa.array(most).filter(keep)], names=["g", "s", "least", "most"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                table = pa.Table.from_batches([whole.slice(at, BLOCK)])
                rest = pa.concat_tables([rest, table]) if rest else table
                if len(rest) >= BLOCK:
                    g = rest["g"].to_numpy()
                    changes = np.flatnonzero(g[1:] != g[:-1])
                    if len(changes):
                        yield from solve(rest.slice(0, changes[-1] + 1))
                        rest = rest.slice(changes[-1] + 1)
        if rest:
            yield from solve(rest)

    return found.repartition("g").sortWithinPartitions("g").mapInArrow(run, COVERED)


def matches_by_window(found: DataFrame) -> DataFrame:
    """As `matches`, by counting every window's hash: for runs too large for a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                for g, s, low, high, words, owner, t in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True):
                    offsets = np.arange(low, high + 1)
                    width, unit = (PASSAGE, 8) if words else (LENGTH, 1)
                    hashes = [hashlib.blake2b(t[(high - o) * unit : (high - o + width) * unit], digest_size=16).digest() for o in offsets.tolist()]
                    yield pa.record_batch([*(pa.array(np.full(len(offsets), x)) for x in (g, s, owner)), pa.array(offsets), pa.array(hashes, pa.binary())], names=["g", "s", "owner", "o", "h"])

    windows = found.mapInArrow(run, "g long, s long, owner long, o long, h binary")
    twice = windows.groupBy("g", "o", "h").agg(F.min("owner").alias("lo"), F.max("owner").alias("hi")).filter("lo < hi").drop("lo", "hi")
    return windows.join(twice, ["g", "o", "h"]).groupBy("g", "s").agg(F.min("o").alias("least"), F.max("o").alias("most"))


PLACE = ("doc_id", "row_key", "w0", "w1", "a")


class SuffixLevels:
    """The index. A level is a table of entries (g, s, n, PLACE): a distinct segment, how often it occurs, and one place."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []
        self.pending: list[DataFrame] = []

    @staticmethod
    def entries(rows: DataFrame, n) -> DataFrame:
        # any place serves, since equal segments are equal bytes
        return rows.groupBy("g", "s").agg(n.alias("n"), *(F.first(c).alias(c) for c in PLACE))

    def merge(self) -> None:
        """Merge the last two levels while they are of one size class."""
        while len(self.levels) > 1 and self.levels[-1][0].bit_length() >= self.levels[-2][0].bit_length():
            (a, x), (b, y) = self.levels.pop(), self.levels.pop()
            self.levels.append((a + b, cut(self.entries(x.unionByName(y), F.sum("n")), "suffixes")))

    def ingest(self, batch: DataFrame) -> None:
        """Merge-scan a batch's segments (see segment_table) against each other and the levels, note what may match, then add them."""
        self.merge()
        new = cut(self.entries(batch, F.count("*")), "suffixes")
        scanned = new.withColumn("old", F.lit(0))
        for _, level in self.levels:
            scanned = scanned.unionByName(level.withColumn("old", F.lit(1)))
        # what a batch does not touch has been noted before
        grams = scanned.groupBy("g").agg(F.count("*").alias("runs"), F.sum("n").alias("times"), F.min("old").alias("old")).filter("times > 1 and old = 0").select("g", "runs")
        noted = scanned.join(grams, "g").select("g", "s", "n", *PLACE, "old", F.lit(len(self.pending)).alias("batch"))
        self.pending.append(cut(noted, "scanned"))
        self.levels.append((new.count(), new))

    def noted(self) -> DataFrame:
        """(g, s, n, PLACE) of the entries that may match."""
        noted = self.pending[0]
        for x in self.pending[1:]:
            noted = noted.unionByName(x)
        if len(self.pending) > 1:  # an entry may be noted with several batches; one that was in a level when it first was occurred once till then
            own, before = F.col("old") == 0, F.col("old") == 1
            first_new, first_old = F.coalesce(F.min(F.when(own, F.col("batch"))), F.lit(len(self.pending))), F.min(F.when(before, F.col("batch")))
            times = F.coalesce(F.sum(F.when(own, F.col("n"))), F.lit(0)) + F.when(first_old <= first_new, 1).otherwise(0)
            noted = noted.groupBy("g", "s").agg(times.alias("n"), *(F.first(c).alias(c) for c in PLACE))
        return noted.select("g", "s", "n", *PLACE)


def word_entries(shared: DataFrame) -> DataFrame:
    """(g, s, n, PLACE, owner) of `shared_words`; n is 2 where several documents have the segment, and its owner is a document if it is the only one."""
    found = shared.groupBy("g", "s").agg(F.min("o").alias("lo"), F.max("o").alias("hi"), *(F.first(c).alias(c) for c in PLACE))
    alone = F.col("lo") == F.col("hi")
    return found.select("g", "s", F.when(alone, 1).otherwise(2).alias("n"), *PLACE, F.when(alone, F.col("lo")).otherwise(F.col("s")).alias("owner"))


def measured(noted: DataFrame, corpus: DataFrame, id_col: str, text_col: str, hot: int = HOT) -> DataFrame:
    """(g, s, least, most): the windows of a segment that occur elsewhere lie between these offsets and reach both."""
    runs = noted.groupBy("g").agg(F.count("*").alias("runs")).filter("runs > 1")
    noted = cut(noted.join(runs, "g", "left"), "noted")
    whole = noted.filter("n > 1").select("g", "s", (F.col("a") - F.col("w1")).alias("least"), (F.col("a") - F.col("w0")).alias("most"))
    every = whole.unionByName(matches(contexts(corpus, noted.filter(F.col("runs") <= hot), id_col, text_col)))
    large = noted.filter(F.col("runs") > hot)
    if not large.isEmpty():
        every = every.unionByName(matches_by_window(contexts(corpus, large, id_col, text_col)))
    return every.groupBy("g", "s").agg(F.min("least").alias("least"), F.max("most").alias("most"))


def runs_of(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of the union of the spans."""
    merged: list[tuple[int, int]] = []
    for b, e in sorted((x["b"], x["e"]) for x in spans):
        if merged and b <= merged[-1][1]:
            merged[-1] = merged[-1][0], max(e, merged[-1][1])
        else:
            merged.append((b, e))
    return merged


def kept_bytes(raw: bytes, spans: list[dict]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal runs of the union of the spans, and the rest."""
    merged = runs_of(spans)
    at, rest = 0, []
    for b, e in merged:
        rest.append(raw[at:b])
        at = e
    return merged, b"".join([*rest, raw[at:]])


def removed_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = 1, digests: bool = True, hot: int = HOT, words: bool = False) -> DataFrame:
    """Per document: doc_id, row_key, n_bytes, n_removed, n_spans, and kept_sha256, or with digests off the spans and the kept bytes.

    The table is dealt into `batches` by row, ingested one after the other; the result does not depend on their number.
    With `words` a column n_passage_words follows: words in strings of PASSAGE words that another document has as well.
    """
    table = cut(segment_table(df, id_col, text_col), "segments")
    index = SuffixLevels()
    for k in range(batches):
        index.ingest(table.filter(F.pmod(F.col("row_key"), F.lit(batches)) == k) if batches > 1 else table)
    noted = index.noted().withColumns({"words": F.lit(False), "owner": F.col("s")})
    shared = shared_words(df, id_col, text_col) if words else None
    if words:
        noted = noted.unionByName(word_entries(shared).withColumn("words", F.lit(True)))
    found = cut(measured(noted, df, id_col, text_col, hot), "found")  # as a table, so that a passage in very many documents is split between tasks

    def spans(places: DataFrame, length: int, name: str) -> DataFrame:
        return places.join(found, ["g", "s"]).select("doc_id", "row_key", F.lit(name).alias("of"), F.struct((F.col("a") - F.col("most")).alias("b"), (F.col("a") - F.col("least") + length).alias("e")).alias("span"))

    hits = spans(table, LENGTH, "bytes")
    if words:
        hits = hits.unionByName(spans(shared, PASSAGE, "words"))
    hits = hits.groupBy("doc_id", "row_key").agg(*(F.collect_set(F.when(F.col("of") == c, F.col("span"))).alias(c) for c in ("bytes", "words")))
    docs = df.select(*row_key(id_col, text_col), text_of(text_col).cast("binary").alias("t"))
    joined = docs.join(hits, same_row(docs, hits), "left").select(docs["doc_id"], docs["row_key"], "t", "bytes", "words")
    names = ["n_bytes long", "n_removed long", "n_spans long", *(["kept_sha256 string"] if digests else ["spans array<struct<b: long, e: long>>", "kept binary"]), *(["n_passage_words long"] if words else [])]
    kinds = [pa.int64()] * 3 + ([pa.string()] if digests else [pa.list_(pa.struct({"b": pa.int64(), "e": pa.int64()})), pa.binary()]) + [pa.int64()] * words

    def run(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in found:
            for at in range(0, whole.num_rows, 128):
                part = whole.slice(at, 128)
                rows = []
                for t, of_bytes, of_words in zip(*(part.column(k).to_pylist() for k in (2, 3, 4)), strict=True):
                    merged, kept = kept_bytes(t, of_bytes or [])
                    last = (hashlib.sha256(kept).hexdigest(),) if digests else ([{"b": b, "e": e} for b, e in merged], kept)
                    rows.append((len(t), len(t) - len(kept), len(merged), *last, *([sum(e - b for b, e in runs_of(of_words or []))] if words else [])))
                yield pa.record_batch([*part.columns[:2], *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=["doc_id", "row_key", *(x.split()[0] for x in names)])

    return joined.mapInArrow(run, "doc_id long, row_key long, " + ", ".join(names))
