"""Media columns: MPEG audio.

`encode_mpeg` stores any bytes losslessly in a valid silent MPEG-1 Layer III stream (48 kHz, mono, CRC-protected):
an ID3v2.3 tag, a Xing frame with frame count, byte count and seek table, then frames whose granules are empty and
whose main-data area carries the bytes as ancillary data. `parse_mpeg` reads any MPEG-1/2/2.5 audio stream: it skips
ID3v1, ID3v2 and APE tags, resynchronises on frame headers (a header counts only if the next one follows it or the
stream ends), reads Xing, Info and VBRI tables, verifies the CRC-16 of protected headers of all three layers, and gives
the exact duration as samples over rate and the byte offset of every frame.

Defined results: null media gives zero frames and empty tables; bytes that hold no frame give zero frames; damaged
stretches are skipped and counted in `skipped_bytes`; frames cut short at the end are not counted, nor are frames of free
format, whose length no header states; tables that reach beyond their frame end with it. Rows repeat, ids may be null, and
columns other than the two named ones are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

# Fixed values of the MPEG audio standard.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
SIDE_INFO = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}
#: Layer II: how many subbands have allocations of 4, 3 and 2 bits, by table.
ALLOCATION = {"a": (11, 12, 4), "b": (11, 12, 7), "c": (2, 6, 0), "d": (2, 10, 0), "low": (4, 7, 19)}

#: Here: version 1, Layer III, protected, 48 kHz, mono; a frame of bitrate b kbit/s has 3 b bytes.
HEAD, SIDE, OVERHEAD = 6, 17, 23
UNIT = 64


def crc16(data: bytes, bits: int | None = None) -> int:
    """The standard's CRC-16, polynomial 0x8005, most significant bit first, of all or the first bits of data."""
    crc = 0xFFFF
    for k in range(8 * len(data) if bits is None else bits):
        top = crc >> 15 ^ data[k >> 3] >> (7 - (k & 7)) & 1
        crc = (crc << 1 ^ 0x8005) & 0xFFFF if top else crc << 1 & 0xFFFF
    return crc


cached_crc = lru_cache(4096)(crc16)


@lru_cache(65536)
def header(raw: bytes) -> tuple[int, int, int, int, bool, bool, int] | None:
    """(version, layer, rate, frame bytes, protected, mono, samples), or None if the four bytes are no header."""
    b1, b2, b3 = raw[1], raw[2], raw[3]
    if raw[0] != 0xFF or b1 & 0xE0 != 0xE0:
        return None
    version, layer, index, rate = b1 >> 3 & 3, 4 - (b1 >> 1 & 3), b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3 or b3 & 3 == 2:
        return None
    v = 1 if version == 3 else 2
    kbit, hz, pad = BITRATES[v, layer][index], RATES[version][rate], b2 >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and v == 2 else 1152
    length = (12 * kbit * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // hz + pad
    return version, layer, hz, length, not b1 & 1, b3 >> 6 == 3, samples


def checked_bits(raw: bytes, body: bytes) -> int:
    """How many bits of a protected frame's body its CRC covers: side information, or bit allocation and, in Layer II, scale-factor selection."""
    version, layer, hz, _, _, mono, _ = header(raw)
    v = 1 if version == 3 else 2
    if layer == 3:
        return 8 * SIDE_INFO[v, mono]
    bound = 4 * (raw[3] >> 4 & 3) + 4 if raw[3] >> 6 == 1 else 32  # joint stereo shares what lies above
    channels = 1 if mono else 2
    if layer == 1:
        return 4 * (channels * bound + 32 - bound if channels == 2 else 32)
    kbit = BITRATES[v, 2][raw[2] >> 4] // channels
    table = "low" if v == 2 else ("d" if hz == 32000 else "c") if kbit < 56 else "a" if hz == 48000 or kbit < 96 else "b"
    widths = [w for w, n in zip((4, 3, 2), ALLOCATION[table], strict=True) for _ in range(n)]
    at, selected = 0, 0
    for band, w in enumerate(widths):
        own = channels if band < bound else 1
        for _ in range(own):
            chunk = int.from_bytes(body[at >> 3 : (at + w + 7) >> 3].ljust(2, b"\0")[:2])
            selected += (chunk >> (16 - (at & 7) - w) & (1 << w) - 1 != 0) * (channels // own)
            at += w
    return at + 2 * selected


@lru_cache(16)
def frame_head(index: int) -> bytes:
    head = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    return head + struct.pack(">H", crc16(head[2:] + bytes(SIDE))) + bytes(SIDE)


def capacity(index: int) -> int:
    return 3 * BITRATES[1, 3][index] - OVERHEAD


def pad(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def encode_bytes(payload: bytes) -> bytes:
    full, rest = divmod(len(payload), most := capacity(14))
    top = frame_head(14)
    body = [part for at in range(0, full * most, most) for part in (top, payload[at : at + most])]
    lengths = [960] * full
    if rest:
        index = next(i for i in range(1, 15) if capacity(i) >= rest)
        body += [frame_head(index), payload[full * most :], bytes(capacity(index) - rest)]
        lengths.append(3 * BITRATES[1, 3][index])
    audio = b"".join(body)
    total = 480 + len(audio)
    starts = [480 + 960 * i for i in range(len(lengths))] or [480]
    toc = bytes(min(255, 256 * starts[min(len(starts) - 1, p * len(starts) // 100)] // total) for p in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(lengths), total) + toc
    first = frame_head(10)  # 160 kbit/s: 480 bytes
    first += xing + bytes(480 - len(first) - len(xing))
    note = b"\0payload_bytes\0%d" % len(payload)
    check = b"payload-crc32\0" + struct.pack(">I", zlib.crc32(payload))
    frames = b"".join(name + struct.pack(">IH", len(x), 0) + x for name, x in ((b"TXXX", note), (b"PRIV", check)))
    n = len(frames)
    return b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127)) + frames + first + audio


def id3v2(data: bytes, at: int) -> tuple[int, dict[str, bytes]]:
    """End of the tag at `at`, and its frames: TXXX by description, others by id. Version 2 has ids of three letters and no flags."""
    size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
    end, tags, p, major = at + 10 + size + 10 * (data[at + 5] >> 4 & 1), {}, at + 10, data[at + 3]
    stop, letters = min(at + 10 + size, len(data)), 3 if major == 2 else 4
    head = 6 if major == 2 else 10
    while p + head <= stop and data[p]:
        name, raw = data[p : p + letters].decode("latin-1"), data[p + letters : p + 2 * letters]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if major == 4 else int.from_bytes(raw)
        value = data[p + head : min(p + head + n, stop)]
        if name in ("TXXX", "TXX") and value[:1] == b"\0" and b"\0" in value[1:]:
            key, _, value = value[1:].partition(b"\0")
            name = f"TXXX:{key.decode('latin-1')}"
        elif name == "PRIV" and b"\0" in value:
            key, _, value = value.partition(b"\0")
            name = f"PRIV:{key.decode('latin-1')}"
        tags.setdefault(name, value)
        p += head + n
    return min(end, len(data)), tags


def rate_table(frame: bytes, at: int) -> dict | None:
    """The Xing, Info or VBRI table of a frame whose main data starts at `at`: kind, frames, bytes, toc, and the byte offsets that toc states, as far as the frame has them."""
    number = lambda p, n: int.from_bytes(frame[p : p + n])
    if frame[at : at + 4] in (b"Xing", b"Info") and len(frame) >= at + 8:
        flags, p, table = number(at + 4, 4), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit and len(frame) >= p + 4:
                table[name], p = number(p, 4), p + 4
        if flags & 4:
            table["toc"] = frame[p : p + 100]
            table["stated"] = [x * table.get("bytes", 0) // 256 for x in table["toc"]]
        return table
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        entries, scale, width = number(54, 2), number(56, 2), number(58, 2)
        toc = frame[62 : 62 + entries * width]
        table = {"kind": "VBRI", "bytes": number(46, 4), "frames": number(50, 4), "toc": toc, "stated": []}
        total = 0
        for k in range(len(toc) // width if width else 0):
            total += number(62 + k * width, width) * scale
            table["stated"].append(total)
        return table
    return None


def parse_bytes(data: bytes) -> dict:
    """Everything that parse_mpeg returns for one stream."""
    at, end, tags, table, kinds = 0, len(data), {}, None, []
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at, found = id3v2(data, at)
        tags |= found
        kinds.append("id3v2")
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        kinds.append("id3v1")
    if end - at >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack_from("<I4xI", data, end - 20)
        end = max(at, end - size - 32 * (flags >> 31))
        kinds.append("ape")
    offsets, pieces, skipped, good, bad, samples, rate, locked = [], [], 0, 0, 0, 0, 0, False
    while at + 4 <= end:
        h = header(data[at : at + 4]) if data[at] == 0xFF else None
        if h and at + h[3] <= end and (locked or at + h[3] + 4 > end or header(data[at + h[3] : at + h[3] + 4])):
            _, layer, hz, length, protected, mono, count = h
            v = 1 if h[0] == 3 else 2
            side = SIDE_INFO[v, mono] if layer == 3 else 0
            body = at + 4 + 2 * protected
            if protected:
                frame_body = data[body : min(body + 64, at + length)]
                bits = 16 + checked_bits(data[at : at + 4], frame_body)
                right = bits <= 16 + 8 * len(frame_body) and cached_crc(data[at + 2 : at + 4] + frame_body[: (bits - 9) // 8], bits) == int.from_bytes(data[at + 4 : at + 6])
                good, bad = good + right, bad + (not right)
            first = None if offsets or table else rate_table(data[at : at + length], body + side - at)
            if first:
                table = first
            else:
                offsets.append(at)
                pieces.append(data[body + side : at + length])
                samples, rate = samples + count, rate or hz
            at, locked = at + length, True
        else:
            following = data.find(b"\xff", at + 1, end)
            following = end if following < 0 else following
            skipped, at, locked = skipped + following - at, following, False
    skipped += max(0, end - at)
    note = tags.get("TXXX:payload_bytes", b"")
    payload = b"".join(pieces)
    payload = payload[: int(note)] if note.isdigit() else payload
    check, table = tags.get("PRIV:payload-crc32"), table or {}
    return {
        "payload": payload, "offsets": offsets, "samples": samples, "rate": rate, "crc_good": good, "crc_bad": bad, "skipped_bytes": skipped,
        "vbr": table.get("kind"), "vbr_frames": table.get("frames"), "vbr_bytes": table.get("bytes"), "seek_table": table.get("toc"), "table_offsets": table.get("stated"),
        "tags": ",".join(kinds), "payload_ok": None if check is None else check == struct.pack(">I", zlib.crc32(payload)),
    }


PARSED = {
    "frames": pa.int64(), "samples": pa.int64(), "rate": pa.int64(), "duration_us": pa.int64(), "seek_offsets": pa.list_(pa.int64()), "crc_good": pa.int64(), "crc_bad": pa.int64(),
    "skipped_bytes": pa.int64(), "vbr": pa.string(), "vbr_frames": pa.int64(), "vbr_bytes": pa.int64(), "seek_table": pa.binary(), "table_offsets": pa.list_(pa.int64()), "tags": pa.string(), "payload_ok": pa.bool_(), "payload": pa.binary(),
}
SQL_TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
#: Rows of a Python batch at most, so that long rows don't gather.
STEP = 256


def parsed_row(media: bytes | None) -> dict:
    x = parse_bytes(media or b"")
    offsets = x.pop("offsets")
    return x | {"frames": len(offsets), "seek_offsets": offsets, "duration_us": x["samples"] * 1_000_000 // x["rate"] if x["rate"] else 0}


def encode_mpeg(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded, as an MPEG audio stream; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                ids, texts = whole.slice(at, STEP).columns
                raw = [x or b"" for x in texts.to_pylist()]
                yield pa.record_batch([ids, pa.array([len(x) for x in raw], pa.int64()), pa.array([encode_bytes(pad(x)) for x in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def parse_mpeg(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of `keep`, then what PARSED lists: frames, exact samples and rate, duration in microseconds, seek offsets, checks, tables, payload."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                rows = [parsed_row(x) for x in part.column(part.num_columns - 1).to_pylist()]
                made = [pa.array([r[k] for r in rows], t) for k, t in PARSED.items()]
                yield pa.record_batch([*part.columns[:-1], *made], names=[*keep, *PARSED])

    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keep), *(f"{k} {SQL_TYPES[t]}" for k, t in PARSED.items())])
    return df.select(*keep, F.col(media_col).cast("binary")).mapInArrow(run, schema)


def stored_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The media column of `encode_mpeg`, written to the shared folder and read from there."""
    return cut(encode_mpeg(df, id_col, text_col), "mpeg")


def media_digest(stored: DataFrame) -> DataFrame:
    """Of a table (doc_id, n_bytes, media): what the parsed streams hold, as digests, durations and frame seek offsets.

    Columns: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, then numbers
    and seek_offsets. The feature names frames, samples, rate, checks, table, tag kinds and the duration.
    """
    numbers = ("frames", "samples", "rate", "duration_us", "crc_good", "crc_bad", "skipped_bytes", "vbr_frames", "vbr_bytes")

    def one(media: bytes | None) -> dict:
        media = media or b""
        x = parsed_row(media)
        back = x["payload"]
        feature = f"mp3 frames={x['frames']} samples={x['samples']} rate={x['rate']} crc={x['crc_good']}/{x['crc_good'] + x['crc_bad']} skipped={x['skipped_bytes']} vbr={x['vbr']}:{x['vbr_frames']}:{x['vbr_bytes']} tags={x['tags']} payload_ok={str(x['payload_ok']).lower()} duration_us={x['duration_us']}"
        return {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature, "seek_offsets": x["seek_offsets"]} | {k: x[k] for k in numbers}

    text = ("payload_sha256", "media_sha256", "feature")
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *numbers, "seek_offsets"]
    kind = lambda k: pa.string() if k in text else pa.list_(pa.int64()) if k == "seek_offsets" else pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, STEP):
                part = whole.slice(at, STEP)
                rows = [one(x.as_py()) for x in part.column(2)]
                yield pa.record_batch([*part.columns[:2], *(pa.array([r[k] for r in rows], kind(k)) for k in names)], names=["doc_id", "n_bytes", *names])

    schema = "doc_id long, n_bytes long, " + ", ".join(f"{k} {SQL_TYPES[kind(k)]}" for k in names)
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(run, schema)
