"""SentencePiece encoding and decoding with original byte spans.

The normaliser is written here: a longest prefix of the rest of the text is looked up in the model's compiled character
map (a double-array trie and the strings it points to), whitespace rules are applied, and for each normalised byte the
source byte is recorded, so every piece is projected to a byte span of the text as given. Symbols that the model's user
defined are taken as they stand. The normalised text is then
segmented by the sentencepiece library under a copy of the model without normalisation; a piece's length in bytes is
known from its id. Ids equal those of the library on the text as given.

Defined results: null or empty text has no ids and decodes to an empty text; copies give equal rows; null ids stay.
A piece of a single byte spans this byte; the space mark put before a text has an empty span.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"


class CharMap:
    """The compiled character map: trie units and replacement strings."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if blob else []
        self.strings = blob[4 + size :] if blob else b""

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """Replacement and length of the longest key that data has at `at`."""
        units = self.units
        if not units:
            return None
        unit, found = units[0], None
        node = (unit >> 10) << ((unit & 1 << 9) >> 6)
        for p in range(at, len(data)):
            node ^= data[p]
            unit = units[node]
            if unit & 0x800000FF != data[p]:
                break
            node ^= (unit >> 10) << ((unit & 1 << 9) >> 6)
            if unit >> 8 & 1:
                found = units[node] & 0x7FFFFFFF, p + 1 - at
        if found is None:
            return None
        end = self.strings.index(b"\0", found[0])
        return self.strings[found[0] : end], found[1]


class Normalizer:
    """Normalised text and, for each of its bytes and its end, the source byte."""

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, escape: bool, symbols: tuple[bytes, ...] = ()):
        self.map, self.dummy, self.squeeze, self.space = CharMap(blob), dummy_prefix, squeeze, MARK.encode() if escape else b" "
        self.symbols = sorted(symbols, key=len, reverse=True)

    @property
    def identity(self) -> bool:
        return not self.map.units and not self.squeeze

    def steps(self, data: bytes) -> Iterator[tuple[bytes, int, int]]:
        at = 0
        while at < len(data):
            own = next((x for x in self.symbols if data.startswith(x, at)), None)
            hit = (own, len(own)) if own else self.map.longest(data, at)
            if hit is None:
                b = data[at]
                n = 1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
                hit = data[at : at + n], n
            yield hit[0], at, hit[1]
            at += hit[1]

    def __call__(self, data: bytes) -> tuple[bytes, list[int]]:
        parts = list(self.steps(data))
        first = 0
        if self.squeeze:
            while first < len(parts) and parts[first][0] == b" ":
                first += 1
            parts = parts[first:]
        if not parts:
            return b"", [len(data) if data else 0]
        out, source = bytearray(), []
        if self.dummy:
            out += self.space
            source += [parts[0][1]] * len(self.space)
        after_space = self.squeeze
        for new, at, _ in parts:
            new = new.lstrip(b" ") if after_space and self.squeeze else new
            for k in range(len(new)):
                piece = self.space if new[k : k + 1] == b" " else new[k : k + 1]
                out += piece
                source += [at] * len(piece)
            if new:
                after_space = new.endswith(b" ")
        end = parts[-1][1] + parts[-1][2]
        if self.squeeze:
            while bytes(out).endswith(self.space):
                end = source[-len(self.space)]
                del out[-len(self.space) :], source[-len(self.space) :]
        return bytes(out), [*source, end]


class Encoder:
    """Ids, pieces' spans and decoded text, equal to the library's."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto.FromString(model)
        spec = proto.normalizer_spec
        symbols = tuple(p.piece.encode() for p in proto.pieces if p.type == proto.SentencePiece.USER_DEFINED)
        self.normalizer = Normalizer(spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, symbols)
        self.whole = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec.precompiled_charsmap, spec.name = b"", "identity"
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.inner = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        kinds = proto.SentencePiece
        #: Bytes of normalised text that a piece stands for; -1: not fixed.
        self.lengths = np.array([1 if p.type == kinds.BYTE else -1 if p.type == kinds.UNKNOWN else len(p.piece.encode()) for p in proto.pieces], np.int64)

    def normalized(self, text: str) -> tuple[str, list[int] | None]:
        if not self.normalizer.identity:
            raw, source = self.normalizer(text.encode())
            return raw.decode(), source
        norm = (MARK if self.normalizer.dummy and text else "") + text
        return norm.replace(" ", MARK) if self.normalizer.space != b" " else norm, None

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its ids, and its pieces' spans as an array of [begin, end) in bytes of the text's UTF-8."""
        norms = [self.normalized(x) for x in texts]
        out = []
        for text, (norm, source), found in zip(texts, norms, self.inner.encode([n for n, _ in norms], num_threads=1), strict=True):
            ids = np.array(found, np.int64)
            sizes = self.lengths[ids]
            if (sizes < 0).any():  # the unknown piece stands for as much text as it took
                sizes = np.array([len(p.surface.encode()) for p in self.inner.encode(norm, return_type="proto").pieces], np.int64)
            ends = np.cumsum(sizes)
            source = np.asarray(self.identity_source(text) if source is None else source, np.int64)
            out.append((ids, np.stack([source[ends - sizes], source[ends]], 1) if len(ids) else np.zeros((0, 2), np.int64)))
        return out

    def identity_source(self, text: str) -> np.ndarray:
        """For each byte of the normalised text and its end, the source byte: a mark stands for one space, or for none at the start."""
        raw = np.frombuffer(text.encode(), np.uint8)
        wide = 3 if self.normalizer.space != b" " else 1
        source = np.repeat(np.arange(len(raw), dtype=np.int64), np.where(raw == 32, wide, 1))
        if self.normalizer.dummy and text:
            source = np.concatenate([np.zeros(wide, np.int64), source])
        return np.append(source, len(raw))

    def decode(self, ids: list[int]) -> str:
        return self.whole.decode(ids) if ids else ""


@lru_cache(2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def encode_texts(df: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids, begins and ends (byte spans of the pieces), decoded; with `digests`, hashes instead of these lists.

    The model file has to be at model_path on every executor, as an installed library is. Every row gets one row.
    """
    schema = "doc_id long, n_tokens long, " + ("ids_sha256 string, decoded_sha256 string, spans_sha256 string" if digests else "ids array<int>, begins array<long>, ends array<long>, decoded string")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(model_path)
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                part = whole.slice(at, 64)
                texts = [x or "" for x in part.column(1).to_pylist()]
                rows = []
                for (ids, spans), listed in ((x, x[0].tolist()) for x in own.encode(texts)):
                    text = own.decode(listed)
                    if digests:
                        hashed = [hashlib.sha256(b).hexdigest() for b in (",".join(map(str, listed)).encode(), text.encode(), np.ascontiguousarray(spans, "<i8").tobytes())]
                        rows.append((len(ids), *hashed))
                    else:
                        rows.append((len(ids), ids, spans[:, 0], spans[:, 1], text))
                kinds = [pa.int64(), *([pa.string()] * 3 if digests else [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()])]
                yield pa.record_batch([part.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("t")).mapInArrow(run, schema)
