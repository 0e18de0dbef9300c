"""Collocations by Apriori-safe candidates counted in the slots of minimal perfect hashes.

Texts are lower-cased (A-Z) and split into pieces and words; phrases of one to three words are counted per language. Three
passes over the texts:

1. `bucket_counts`, `full_buckets`: how many words, pairs and triples fall into each bucket of hashes, in bytes that stop at
   255. A phrase whose bucket stays below `least` is rarer than that, and so is every longer phrase around it (Apriori). The
   full buckets are marked in a bitmap of at most 64 MB, which is all that is broadcast; where there are so many that its
   bits run out, more phrases become candidates, and results stay the same.
2. `candidates`: the distinct phrases whose own bucket and whose parts' buckets are full, dealt by hash to shards. A task
   builds one shard's minimal perfect hash (levels of bit arrays, ranks by counted bits) and stores keys by slot.
3. `slot_counts`: mappers look up what a block of text holds, each distinct phrase once with its count; tasks of one shard
   and one salt find the slots, compare the stored keys, bincount, and the arrays are summed in a tree.

`cuts` sends each phrase's parts to the shards that own them and reads their counts by slot. No table of phrases is gathered
anywhere: a shard has about SHARD keys, however many there are, and a common phrase counts once for a block.

A stored key is the 128 bits of hash lanes over language and words; different phrases with equal ones would count as one
(chance below 1e-14 for 1e12 phrases), and candidates that collide raise an error.

Defined results: null text has no words, null language is `und`; ids are not read; equal rows count each; an empty table
gives an empty table; a text of any length is read whole by one task. Columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from .common import cut, text_of

LEAST, TOP, LONGEST = 10, 2000, 3
#: Bits of the bitmap for each full bucket, and the exponent of its greatest size (64 MB); counts and phrases that a task holds before it adds them up or sends them.
FILTER, LARGEST, PENDING, PHRASES = 64, 29, 4 << 20, 1 << 19
#: Keys of a shard, and the least number of shards; bytes of a block of text; salts of the first sum.
SHARD, LEAST_SHARDS, BLOCK, SALTS = 1 << 20, 64, 4 << 20, 8
SPLIT = bytes(10 if c in b".,;:!?\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
U = np.uint64
NEEDED = "shard int, salt int, kind int, h1 binary, h2 binary, data binary, sizes binary, counts binary"


def final(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def joined(left: np.ndarray, right: np.ndarray, n: int, lane: int) -> np.ndarray:
    """The hash lane of a phrase of n words from those of its first n - 1 words and its last word."""
    return final(left + final(right + U(0x9E3779B97F4A7C15 * (2 * n + lane) % 2**64)))


class Known(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


class Block:
    """Words of texts of one language, and the hash lanes of all phrases: valid[n - 1][i] tells whether n words start at i."""

    def __init__(self, lang: str, raw: bytes):
        self.lang = lang
        self.words = [w for w in raw.lower().translate(SPLIT).replace(b"\n", b" \n ").split(b" ") if w]
        known = Known({b"\n": 0})
        ids = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words))
        own = word_lanes(lang, known)
        self.lanes, self.valid = [(own[0][ids], own[1][ids])], [ids > 0]
        for n in range(2, LONGEST + 1):
            self.lanes.append(tuple(joined(self.lanes[-1][k][:-1], self.lanes[0][k][n - 1 :], n, k) for k in (0, 1)))
            self.valid.append(self.valid[-1][:-1] & self.valid[0][n - 1 :])

    def full(self, bitmap: np.ndarray) -> list[np.ndarray]:
        """Per length, where phrases start that may be frequent: their own bucket and those of all their parts are full."""
        found, drop = [], U(64 - (8 * len(bitmap) - 1).bit_length())
        for n, ((h, _), ok) in enumerate(zip(self.lanes, self.valid, strict=True)):
            if n:
                ok = ok & found[-1][:-1] & found[-1][1:]
            at = np.flatnonzero(ok)
            where = (h[at] >> drop).astype(np.int64)
            kept = np.zeros(len(ok), bool)
            kept[at[(bitmap[where >> 3] >> (where & 7).astype(np.uint8) & 1).astype(bool)]] = True
            found.append(kept)
        return found


def word_lanes(lang: str, words) -> tuple[np.ndarray, np.ndarray]:
    head = lang.encode()
    head = b"%d:%s" % (len(head), head)
    both = np.frombuffer(b"".join([xxh3_128_digest(head + w) for w in words]), "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """Texts (lang, t) put together by language, about BLOCK bytes at a time."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_py()
            held.setdefault(lang, []).append(raw)
            size += len(raw) + 1
            if size >= BLOCK:
                yield from (Block(k, b"\n".join(v)) for k, v in held.items())
                held, size = {}, 0
    yield from (Block(k, b"\n".join(v)) for k, v in held.items())


def distinct(h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each distinct pair, by h1, and how often it is there."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    first = np.flatnonzero(np.r_[True, ~same][: len(order)])
    return order[first], np.diff(np.r_[first, len(order)])


def bucket_counts(texts: DataFrame, bits: int) -> DataFrame:
    """Phrases by bucket (shard, keys, counts), packed by block of text, and words per language (shard below 0, lang, n).

    A bucket is the leading bits of a hash: `bits` for the shard, which grow with the texts' partitions, and 32 more.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for block in blocks(batches):
            totals[block.lang] = totals.get(block.lang, 0) + int(block.valid[0].sum())
            keys = np.concatenate([h[ok] >> U(32 - bits) for (h, _), ok in zip(block.lanes, block.valid, strict=True)])
            keys.sort()
            first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            counts = np.minimum(np.diff(np.r_[first, len(keys)]), 255).astype(np.uint8)
            keys = keys[first]
            low = keys.astype(np.uint32)
            yield from packed([(shard, None, 0, low[a:b].tobytes(), counts[a:b].tobytes()) for shard, a, b in pieces(keys >> U(32))], COUNTED)
        yield from packed([(-1, lang, n, None, None) for lang, n in totals.items()], COUNTED)

    return texts.mapInArrow(count, "shard int, lang string, n long, keys binary, counts binary")


COUNTED = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def pieces(shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Equal neighbours: (value, begin, end)."""
    begin = np.flatnonzero(np.r_[True, shards[1:] != shards[:-1]][: len(shards)])
    yield from zip(shards[begin].tolist(), begin.tolist(), np.r_[begin[1:], len(shards)].tolist(), strict=False)


def full_buckets(buckets: DataFrame, least: int) -> DataFrame:
    """(shard, n, keys): the buckets that `least` phrases or more fall into; and with shard -1 words per language (lang, n)."""

    def compact(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        k, n = np.concatenate(keys), np.concatenate(counts)
        order = np.argsort(k)
        k, n = k[order], n[order].astype(np.int64)
        first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]][: len(k)])
        return k[first], np.minimum(np.add.reduceat(n, first), 255).astype(np.uint8)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groupby(each(batches), lambda x: x["shard"]):
            if shard < 0:
                totals: dict[str, int] = {}
                for x in rows:
                    totals[x["lang"]] = totals.get(x["lang"], 0) + x["n"]
                yield from packed([(-1, lang, n, None, None) for lang, n in totals.items()], COUNTED)
                continue
            keys, counts, waiting = [], [], 0
            for x in rows:
                keys.append(numbers(x["keys"], np.uint32))
                counts.append(numbers(x["counts"], np.uint8))
                waiting += len(counts[-1])
                if waiting > PENDING:
                    keys, counts = ([y] for y in compact(keys, counts))
                    waiting = 0
            k, n = compact(keys, counts)
            k = k[n >= min(least, 255)]
            yield from packed([(shard, None, len(k), k.tobytes(), None)], COUNTED)

    return cut(buckets.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "shard int, lang string, n long, keys binary, counts binary"), "full")


def marked(full: DataFrame, bits: int, count: int) -> np.ndarray:
    """A bitmap of the leading bits of full buckets: FILTER bits for each of `count`, 1 << LARGEST at most."""
    wide = max(bits + 3, min(LARGEST, (FILTER * max(count, 1) - 1).bit_length()))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each(batches):
            piece = np.zeros(1 << (wide - bits), np.uint8)
            piece[numbers(x["keys"], np.uint32) >> np.uint32(32 - (wide - bits))] = 1
            yield pa.record_batch([pa.array([x["shard"]], pa.int32()), pa.array([np.packbits(piece, bitorder="little").tobytes()])], names=["shard", "piece"])

    bitmap = np.zeros(1 << (wide - 3), np.uint8)
    for x in full.select("shard", "keys").mapInArrow(mark, "shard int, piece binary").toLocalIterator():
        size = len(x.piece)
        bitmap[x.shard * size : (x.shard + 1) * size] = np.frombuffer(x.piece, np.uint8)
    return bitmap


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(batch.num_rows):
            yield batch.slice(at, 1).to_pylist()[0]


def packed(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 4096):
        yield pa.record_batch([pa.array(list(c), f.type) for c, f in zip(zip(*rows[at : at + 4096], strict=True), schema, strict=True)], schema=schema)


def candidates(texts: DataFrame, maps, bits: int) -> DataFrame:
    """(shard, lang, data): every phrase that may be frequent, by shard, a task's phrases packed; a phrase may be there once a task and more. maps: the broadcast bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [np.zeros(1 << 20, U), np.zeros(1 << 20, U)]  # keys emitted before, as far as they are not overwritten
        held: dict[str, list] = {}
        size = 0
        for block in blocks(batches):
            for n, ((h1, h2), kept) in enumerate(zip(block.lanes, block.full(maps.value), strict=True), 1):
                at = np.flatnonzero(kept)
                at = at[distinct(h1[at], h2[at])[0]]
                a, b = h1[at], h2[at]
                where = (a & U((1 << 20) - 1)).astype(np.int64)
                new = (seen[0][where] != a) | (seen[1][where] != b)
                at, a, b, where = at[new], a[new], b[new], where[new]
                seen[0][where], seen[1][where] = a, b
                held.setdefault(block.lang, []).append((a >> U(64 - bits), [b" ".join(block.words[i : i + n]) for i in at.tolist()]))
                size += len(at)
            if size > PHRASES:
                yield from flush(held)
                held, size = {}, 0
        yield from flush(held)

    def flush(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(3).compress
        for lang, found in held.items():
            shards, phrases = np.concatenate([s for s, _ in found]), [p for _, some in found for p in some]
            order = np.argsort(shards, kind="stable")
            rows = [(shard, lang, pack(b"\n".join(sorted(phrases[i] for i in order[a:b].tolist())))) for shard, a, b in pieces(shards[order])]
            yield from packed(rows, pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("data", pa.binary())]))

    return texts.mapInArrow(run, "shard int, lang string, data binary")


class Slots:
    """A minimal perfect hash of keys (h1, h2): each level's bit array marks the places that one key alone fell on."""

    def __init__(self, h1: np.ndarray, h2: np.ndarray, bits: np.ndarray, sizes: np.ndarray):
        self.h1, self.h2, self.bits, self.sizes = h1, h2, bits, sizes
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @staticmethod
    def places(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
        x = final(h1 ^ final(h2 + U(0x9E3779B97F4A7C15 * (level + 1) % 2**64)))
        return ((x >> U(32)) * U(size) >> U(32)).astype(np.int64)

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> tuple[Slots, np.ndarray]:
        """The hash, its keys in the order of slots, and for each slot the place of its key in h1."""
        left, levels = np.arange(len(h1)), []
        while len(left):
            if len(levels) == 60:
                raise ValueError("two phrases have the same 128 bits of hash")
            size = -(-2 * len(left) // 64) * 64
            at = cls.places(h1[left], h2[left], len(levels), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            left = left[~alone[at]]
        bits = np.concatenate(levels) if levels else np.zeros(0, U)
        made = cls(h1, h2, bits, np.array([64 * len(x) for x in levels], np.int64))
        slots = made.find(h1, h2, check=False)
        order = np.empty(len(h1), np.int64)
        order[slots] = np.arange(len(h1))
        made.h1, made.h2 = h1[order], h2[order]
        return made, order

    def find(self, h1: np.ndarray, h2: np.ndarray, check: bool = True) -> np.ndarray:
        """The slot of each key, -1 where it is none of the stored ones."""
        slots, left, base = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = self.places(h1[left], h2[left], level, size) + base
            word, bit = self.bits[at >> 6], (at & 63).astype(U)
            hit = (word >> bit & U(1)).astype(bool)
            slots[left[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(word[hit] & ((U(1) << bit[hit]) - U(1)))
            left, base = left[~hit], base + size
        if check:
            slots[(self.h1[slots] != h1) | (self.h2[slots] != h2)] = -1
        return slots


def numbers(x: bytes, kind=U) -> np.ndarray:
    return np.frombuffer(x, kind)


def phrase_lanes(lang: str, phrases: list[list[bytes]]) -> list[np.ndarray]:
    """The hash lanes of phrases of the same number of words."""
    lanes = [word_lanes(lang, [p[i] for p in phrases]) for i in range(len(phrases[0]))]
    found = list(lanes[0])
    for i in range(1, len(lanes)):
        found = [joined(found[k], lanes[i][k], i + 1, k) for k in (0, 1)]
    return found


def hashed_keys(packed_phrases: DataFrame) -> DataFrame:
    """Per shard: a row of slot -1 with the hash, and (shard, slot, lang, words, phrase) for each phrase."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groupby(each(batches), lambda x: x["shard"]):
            known: dict[str, set[bytes]] = {}
            for x in rows:
                known.setdefault(x["lang"], set()).update(zstandard.ZstdDecompressor().decompress(x["data"]).split(b"\n"))
            langs, sizes, phrases, lanes = [], [], [], []
            for lang, found in known.items():
                split = [p.split(b" ") for p in found]
                for n in range(1, LONGEST + 1):
                    if own := [p for p in split if len(p) == n]:
                        lanes.append(phrase_lanes(lang, own))
                        phrases += [b" ".join(p) for p in own]
                        langs += [lang] * len(own)
                        sizes += [n] * len(own)
            made, order = Slots.build(*(np.concatenate([x[k] for x in lanes]) for k in (0, 1)))
            yield from packed([(shard, -1, None, None, None, made.h1.tobytes(), made.h2.tobytes(), made.bits.tobytes(), made.sizes.tobytes())], schema)
            yield from packed([(shard, slot, langs[i], sizes[i], phrases[i], None, None, None, None) for slot, i in enumerate(order.tolist())], schema)

    schema = pa.schema([("shard", pa.int32()), ("slot", pa.int32()), ("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.binary()), ("h1", pa.binary()), ("h2", pa.binary()), ("data", pa.binary()), ("sizes", pa.binary())])
    return packed_phrases.repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard int, slot int, lang string, words int, phrase binary, h1 binary, h2 binary, data binary, sizes binary")


def by_shard(h1: np.ndarray, h2: np.ndarray, values: np.ndarray, bits: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Keys in the order of h1, with values, as a row for each shard."""
    rows = [(shard, salt, 1, h1[a:b].tobytes(), h2[a:b].tobytes(), values[a:b].tobytes(), None, None) for shard, a, b in pieces(h1 >> U(64 - bits))]
    yield from packed(rows, PACKED)


PACKED = pa.schema([("shard", pa.int32()), ("salt", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in ("h1", "h2", "data", "sizes", "counts"))])


def at_slots(rows: DataFrame, hashes: DataFrame, salts: int, use, ddl: str) -> DataFrame:
    """rows (NEEDED's columns, of kind 1) with the hash of their shard: use(slots, hash row, rows) makes record batches of all rows of a shard and salt, which are streamed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, found in groupby(each(batches), lambda x: (x["shard"], x["salt"])):
            head = next(found)
            made = Slots(*(numbers(head[c]) for c in ("h1", "h2", "data")), numbers(head["sizes"], np.int64))
            yield from use(made, head, found)

    heads = hashes.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("kind"), "h1", "h2", "data", "sizes", "counts")
    return heads.unionByName(rows).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInArrow(run, ddl)


def slot_counts(texts: DataFrame, hashes: DataFrame, maps, bits: int) -> DataFrame:
    """(shard, counts): how often each slot's phrase is in the texts."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        salt = TaskContext.get().partitionId() % SALTS
        held, size = [], 0
        for block in blocks(batches):
            kept = block.full(maps.value)
            h1, h2 = (np.concatenate([x[k][ok] for x, ok in zip(block.lanes, kept, strict=True)]) for k in (0, 1))
            at, n = distinct(h1, h2)
            held.append((h1[at], h2[at], n))
            size += len(n)
            if size > PENDING:
                held = [together(held)]
                size = len(held[0][2])
                if size > PENDING // 2:
                    yield from by_shard(*held[0], bits, salt)
                    held, size = [], 0
        if held:
            yield from by_shard(*together(held), bits, salt)

    def together(held: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h1, h2, n = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((h2, h1))
        h1, h2, n = h1[order], h2[order], n[order]
        first = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])][: len(h1)])
        return h1[first], h2[first], np.add.reduceat(n, first).astype(np.uint32) if len(first) else n.astype(np.uint32)

    def count(made: Slots, head: dict, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(made.h1), np.int64)
        for x in rows:
            slots, n = made.find(numbers(x["h1"]), numbers(x["h2"])), numbers(x["data"], np.uint32)
            np.add.at(total, slots[slots >= 0], n[slots >= 0])
        yield pa.record_batch([pa.array([head["shard"]], pa.int32()), pa.array([total.tobytes()])], names=["shard", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in groupby(each(batches), lambda x: x["shard"]):
            total = sum(numbers(x["counts"], np.int64) for x in rows)
            yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([total.tobytes()])], names=["shard", "counts"])

    part = at_slots(texts.mapInArrow(look, NEEDED), hashes.withColumn("counts", F.lit(None).cast("binary")), SALTS, count, "shard int, counts binary")
    return part.repartition("shard").sortWithinPartitions("shard").mapInArrow(add, "shard int, counts binary")


def frequent_phrases(keys: DataFrame, counts: DataFrame, least: int) -> DataFrame:
    """(shard, slot, lang, words, phrase, a) of keys counted `least` times or more."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in each(batches):
            n = numbers(x["counts"], np.int64)
            at = np.flatnonzero(n >= least)
            yield pa.record_batch([pa.array(np.full(len(at), x["shard"], np.int32)), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["shard", "slot", "a"])

    return keys.filter("slot >= 0").select("shard", "slot", "lang", "words", "phrase").join(counts.mapInArrow(spread, "shard int, slot int, a long"), ["shard", "slot"])


def cuts(phrases: DataFrame, hashes: DataFrame, bits: int) -> DataFrame:
    """(owner, side, f, part, a) for the parts of each phrase of two words or more: side 2 * k is the first k words, 2 * k + 1 the rest; owner and part are shard << 32 | slot."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, rows in groupby(sorted(batch.to_pylist(), key=lambda x: x["lang"]), lambda x: x["lang"]):
                found: list[tuple[list[bytes], int, int, int]] = []
                for x in rows:
                    words = x["phrase"].split(b" ")
                    for k in range(1, len(words)):
                        found += [(words[:k], x["owner"], 2 * k, x["a"]), (words[k:], x["owner"], 2 * k + 1, x["a"])]
                for n in range(1, LONGEST):
                    own = [x for x in found if len(x[0]) == n]
                    if own:
                        h = phrase_lanes(lang, [x[0] for x in own])
                        order = np.argsort(h[0])
                        yield from by_shard(h[0][order], h[1][order], np.array([x[1:] for x in own], np.int64)[order], bits, 0)

    def read(made: Slots, head: dict, rows: Iterator[dict]) -> Iterator[pa.RecordBatch]:
        counts, shard = numbers(head["counts"], np.int64), head["shard"]
        for x in rows:
            slots, v = made.find(numbers(x["h1"]), numbers(x["h2"])), numbers(x["data"], np.int64).reshape(-1, 3)
            assert (slots >= 0).all()  # a part is as frequent as its phrase
            yield pa.record_batch([pa.array(v[:, 0]), pa.array(v[:, 1]), pa.array(counts[slots]), pa.array(slots + (shard << 32)), pa.array(v[:, 2])], names=["owner", "side", "f", "part", "a"])

    return at_slots(phrases.mapInArrow(split, NEEDED), hashes, 1, read, "owner long, side long, f long, part long, a long")


def collocations(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, near: int = 50) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases by their lowest-scoring cut.

    Dropped are phrases inside a longer frequent one that has `near` percent of their occurrences or more.
    """
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_of(text_col).cast("binary").alias("t"))
    bucket_bits = (max(LEAST_SHARDS, 4 * texts.rdd.getNumPartitions()) - 1).bit_length()
    known = full_buckets(bucket_counts(texts, bucket_bits), least)
    totals, full = known.filter("shard < 0").select("lang", "n"), known.filter("shard >= 0")
    many = full.agg(F.sum("n")).first()[0] or 0
    maps = df.sparkSession.sparkContext.broadcast(marked(full, bucket_bits, many))
    bits = (max(LEAST_SHARDS, -(-many // SHARD)) - 1).bit_length()
    hashed = cut(hashed_keys(candidates(texts, maps, bits)), "slots")
    hashes = hashed.filter("slot = -1").select("shard", "h1", "h2", "data", "sizes")
    counts = cut(slot_counts(texts, hashes, maps, bits), "counts")
    owner = F.shiftleft(F.col("shard").cast("long"), 32) + F.col("slot")
    phrases = cut(frequent_phrases(hashed, counts, least).filter("words > 1").select(owner.alias("owner"), "lang", "words", "phrase", "a"), "phrases")
    parts = cut(cuts(phrases, hashes.join(counts, "shard"), bits), "cuts")
    read = [F.max(F.when(F.col("side") == s, F.col("f"))).alias(f"s{s}") for s in range(2, 2 * LONGEST)]
    sides = parts.groupBy("owner").agg(*read)
    longer = parts.groupBy("part").agg(F.max("a").alias("longest"))
    whole = phrases.join(sides, "owner").join(longer, F.col("owner") == F.col("part"), "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < near * F.col("a")))
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    whole = whole.withColumn("a19", wide("a"))
    for k in range(1, LONGEST):
        whole = whole.withColumns({f"l{k}": wide(f"s{2 * k}"), f"r{k}": wide(f"s{2 * k + 1}")})
    score = lambda k: F.expr(f"cast(1000000 as decimal(7,0)) * (a19 * a19) div (l{k} * r{k})")
    cut_at = F.array(*(F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"s{2 * k}").alias("l"), F.col(f"s{2 * k + 1}").alias("r")) for k in range(1, LONGEST)))
    scored = whole.select("lang", F.col("phrase").cast("string").alias("phrase"), "a", F.array_min(F.filter(cut_at, lambda x: x["l"].isNotNull())).alias("cut"), (F.xxhash64("phrase") % 32).alias("salt"))
    order = [F.desc("cut.score"), F.desc("a"), F.asc("phrase")]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


#: The same in DuckDB.
SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT row_number() OVER () AS d, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
u AS (SELECT d, lang, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
t AS (SELECT lang, x, lead(x) OVER (PARTITION BY d ORDER BY i) AS y, lead(x, 2) OVER (PARTITION BY d ORDER BY i) AS z FROM u),
totals AS (SELECT lang, count(*) AS n FROM u GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS a FROM t GROUP BY ALL HAVING count(*) >= {LEAST}),
f2 AS (SELECT lang, x, y, count(*) AS a FROM t WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
f3 AS (SELECT lang, x, y, z, count(*) AS a FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST}),
longest AS (SELECT lang, x, y, max(a) AS longest FROM (SELECT lang, x, y, a FROM f3 UNION ALL SELECT lang, y, z, a FROM f3) GROUP BY ALL),
cuts AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.a, 1 AS k, l.a AS l, r.a AS r FROM f2 JOIN f1 l ON l.lang = f2.lang AND l.x = f2.x JOIN f1 r ON r.lang = f2.lang AND r.x = f2.y LEFT JOIN longest g ON g.lang = f2.lang AND g.x = f2.x AND g.y = f2.y WHERE g.longest IS NULL OR 100 * g.longest < 50 * f2.a
UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, 1, l.a, r.a FROM f3 JOIN f1 l ON l.lang = f3.lang AND l.x = f3.x JOIN f2 r ON r.lang = f3.lang AND r.x = f3.y AND r.y = f3.z
UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.a, 2, l.a, r.a FROM f3 JOIN f2 l ON l.lang = f3.lang AND l.x = f3.x AND l.y = f3.y JOIN f1 r ON r.lang = f3.lang AND r.x = f3.z),
scored AS (SELECT *, 1000000::HUGEINT * a * a // (l::HUGEINT * r) AS score FROM cuts),
low AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM low WHERE place = 1)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}"""
