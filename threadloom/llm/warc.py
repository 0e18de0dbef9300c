"""WARC: archives of gzip members, written by tasks and read back in byte ranges.

`write_archives` writes one member per row. Rows with equal payloads of at least `least` bytes share one response record,
that of the smallest page_id; the others are revisit records that name it, carry the digest and no payload. Each task
writes files of its own under a name with its attempt; only files of attempts that Spark accepted are in the returned
list, so a repeated or lost task leaves at most files that nothing reads.

`read_archives` splits each file into ranges. A task scans its range for gzip's magic, accepts a place as a member if it
decodes to a WARC header and, for the first one of a range, if another member or the file's end follows it; it owns the
records that start inside the range and reads past its end to complete the last.

Defined results: null html counts as an empty payload, null url as an empty one; a null page_id is written as an empty
header and read as null, and never becomes the response while a page with the same payload has an id; of rows equal in
page_id and payload one, that of smallest url, is the response and the others revisit it; an empty table gives no files
and no rows. Only the three named columns are read. A task holds one record's content at a time, and that twice while its
gzip member is unpacked.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, scratch, text_of

MAGIC = b"\x1f\x8b\x08"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
SPLIT = 8 << 20
#: Tasks at most that read; beyond it a task reads several ranges.
TASKS = 20_000


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}').urn}>"


def member(page_id: int | None, url: str, payload: bytes | None, size: int, sha1: str, first: int | None, level: int = 6) -> bytes:
    """One record as a gzip member: a response if it has a payload, else a revisit of `first`'s; `size` and `sha1` (hexadecimal) are the payload's."""
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    shown = lambda x: "" if x is None else str(x)
    fields = [
        ("WARC-Type", "revisit" if payload is None else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE), ("WARC-Target-URI", "".join(url.split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-Id", shown(page_id)), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + len(payload or b""))),
    ]
    if payload is None:
        fields[4:4] = [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest)), ("X-Refers-To-Page-Id", shown(first))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return b"".join((packer.compress(head.encode()), packer.compress(http), packer.compress(payload or b""), packer.compress(b"\r\n\r\n"), packer.flush()))


def rows_to_write(df: DataFrame, id_col: str, url_col: str, html_col: str, least: int) -> DataFrame:
    """(page_id, url, html, size, digest, first): the records to write, html null for revisits, which then name `first`."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), text_of(url_col).alias("url"), text_of(html_col).cast("binary").alias("html"))
    pages = pages.select("*", F.octet_length("html").cast("long").alias("size"), F.sha1("html").alias("digest"))
    times = pages.filter(F.col("size") >= least).groupBy("digest", "page_id").agg(F.count("*").alias("n"))
    order = F.struct(F.col("page_id").isNull(), "page_id")
    payloads = times.groupBy("digest").agg(F.min("page_id").alias("first"), F.min_by("n", order).alias("ties"), F.sum("n").alias("n"))
    shared = cut(payloads.filter("n > 1").select("digest", "first", "ties"), "warc-payloads")
    joined = pages.join(shared, "digest", "left")
    own = F.col("ties").isNull() | F.col("page_id").eqNullSafe(F.col("first"))
    out = ("page_id", "url", "html", "size", "digest", "first")
    several = shared.filter("ties > 1")
    if several.isEmpty():
        return joined.select("page_id", "url", F.when(own, F.col("html")).alias("html"), "size", "digest", "first")
    # rows equal in page_id and payload, counted by url: one response, written once, and revisits without a payload
    tied = own & (F.col("ties") > 1)
    alone = joined.filter(~F.coalesce(tied, F.lit(False))).select("page_id", "url", F.when(own, F.col("html")).alias("html"), "size", "digest", "first")
    equal = joined.filter(tied)
    response = equal.groupBy("digest", "page_id", "first").agg(F.min("url").alias("url"), F.first("html").alias("html"), F.first("size").alias("size"))
    urls = equal.groupBy("digest", "page_id", "first", "size", "url").agg(F.count("*").alias("n")).join(response.select("digest", F.col("url").alias("chosen")), "digest")
    times_again = F.col("n") - (F.col("url") == F.col("chosen")).cast("long")
    again = urls.filter(times_again > 0).select("page_id", "url", F.lit(None).cast("binary").alias("html"), "size", "digest", "first", F.explode(F.sequence(F.lit(1).cast("long"), times_again)))
    return alone.unionByName(response.select(*out)).unionByName(again.select(*out).repartition("digest", F.rand(1)))


def write_archives(df: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, level: int = 6, file_bytes: int = 256 << 20) -> DataFrame:
    """Write df's rows under `folder` (shared by all executors); returns (path, size, records) of the archives."""
    rows = rows_to_write(df, id_col, url_col, html_col, least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        fs.create_dir(root)
        context, files, out, path, size, count, made = TaskContext.get(), 0, None, "", 0, 0, []
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                for page_id, url, html, length, sha1, first in zip(*(c.to_pylist() for c in whole.slice(at, 64).columns), strict=True):
                    if out is None:
                        path = f"part-{context.partitionId():05d}-{context.taskAttemptId()}-{files}.warc.gz"
                        out, size, count, files = fs.open_output_stream(f"{root}/{path}", compression=None), 0, 0, files + 1
                    data = member(page_id, url, html, length, sha1, first, level)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= file_bytes:
                        out.close()
                        made.append((f"{folder}/{path}", size, count))
                        out = None
        if out is not None:
            out.close()
            made.append((f"{folder}/{path}", size, count))
        yield pa.record_batch([pa.array([m[k] for m in made], pa.int64() if k else pa.string()) for k in range(3)], names=["path", "size", "records"])

    return cut(rows.mapInArrow(run, "path string, size long, records long"), "warc-files")


def parse_record(raw: bytes) -> dict:
    end = raw.index(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in raw[:end].decode().split("\r\n")[1:])
    stop = end + 4 + int(fields["Content-Length"])
    body = raw.index(b"\r\n\r\n", end + 4, stop) + 4
    length = next(int(x.split(b":")[1]) for x in raw[end + 4 : body].split(b"\r\n") if x.lower().startswith(b"content-length:"))
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    kind, payload = fields["WARC-Type"], None
    if kind == "response":
        payload = raw[body:stop]
        assert len(payload) == length, "a payload of another length than stated"
        assert base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest, "a payload of another digest than stated"
    number = lambda x: int(x) if x else None
    return {"page_id": number(fields["X-Page-Id"]), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": digest, "record_type": kind, "refers_to": number(fields.get("X-Refers-To-Page-Id")) if kind == "revisit" else None, "payload": payload}


class Source:
    """A file read piece by piece; only the stretch in use is held."""

    def __init__(self, file, size: int, piece: int = 1 << 20):
        self.file, self.size, self.piece, self.at, self.data = file, size, piece, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """n bytes from `at`, fewer at the end."""
        n = min(n, self.size - at)
        if at < self.at or at + n > self.at + len(self.data):
            self.at, self.data = at, self.file.read_at(min(max(n, self.piece), self.size - at), at)
        return self.data[at - self.at : at - self.at + n]


def starts_record(source: Source, at: int) -> bool:
    piece = source.get(at, 1 << 14)
    if not piece.startswith(MAGIC):
        return False
    try:
        return zlib.decompressobj(31).decompress(piece, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def decode(source: Source, at: int) -> tuple[bytes, int] | None:
    """The member's content and end, or None if it does not decode."""
    unpacker, parts, p = zlib.decompressobj(31), [], at
    try:
        while not unpacker.eof and p < source.size:
            piece = source.get(p, 1 << 16)
            parts.append(unpacker.decompress(piece))
            p += len(piece)
    except zlib.error:
        return None
    return (b"".join(parts), p - len(unpacker.unused_data)) if unpacker.eof else None


def records_of(source: Source, begin: int, end: int) -> Iterator[dict]:
    """Records whose first byte lies in [begin, end)."""
    at, sure = begin, begin == 0
    while at < end:
        if starts_record(source, at) and (found := decode(source, at)) and (sure or found[1] == source.size or starts_record(source, found[1])):
            yield parse_record(found[0])
            at, sure = found[1], True
            continue
        sure, step = False, 1 << 16
        piece = source.get(at + 1, step + 2)
        hit = piece.find(MAGIC)
        at += 1 + hit if hit >= 0 else max(1, len(piece) - 2)
        if not piece:
            break


READ = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}


def read_archives(files: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """The records of the archives that `files` lists as (path, size)."""
    names = [k for k in READ if payloads or k != "payload"]
    ranges = files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("begin"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, begin in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, local = filesystem(path)
                rows: list[dict] = []
                held = 0
                with fs.open_input_file(local) as file:
                    for r in records_of(Source(file, size), begin, min(begin + split, size)):
                        rows.append(r)
                        held += r["payload_bytes"] if payloads else 1
                        if held > (8 << 20) or len(rows) >= 4096:
                            yield pa.record_batch([pa.array([x[k] for x in rows], READ[k]) for k in names], names=names)
                            rows, held = [], 0
                yield pa.record_batch([pa.array([x[k] for x in rows], READ[k]) for k in names], names=names)

    kinds = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}
    # a number of its own for each range's task, which adaptive execution does not put together again
    tasks = files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1
    return ranges.repartitionByRange(min(int(tasks), TASKS), "path", "begin").mapInArrow(run, ", ".join(f"{k} {kinds[READ[k]]}" for k in names))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder and read all records back, without their payloads."""
    files = write_archives(pages, scratch(spark, "warc"))
    return read_archives(files, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
