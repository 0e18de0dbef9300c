"""Styled runs: a line's text in pieces of one style, as an array column of RUN.

All but alignment are expressions on arrays, so a line's runs stay in its row. Null arrays count as empty, null texts as
empty and null flags as false. Lengths and offsets count code points. Font sizes that differ by less than FONT are equal.
Trimming and cropping keep every attribute of what is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.blocks import marker_length
from threadloom.operators.payload import align

RUN = "struct<text:string,bold:boolean,italic:boolean,underline:boolean,link:string,font_size:double>"
STYLE = ("bold", "italic", "underline", "link", "font_size")
FONT = 0.1


def of(runs: Column) -> Column:
    return F.coalesce(runs, F.array()).cast(f"array<{RUN}>")


def run(text: Column, like: Column | None = None, **style: Column) -> Column:
    """A run of this text, its style that of `like` but for what is named."""
    kinds = {"bold": "boolean", "italic": "boolean", "underline": "boolean", "link": "string", "font_size": "double"}
    other = lambda k: style[k] if k in style else like[k] if like is not None else F.lit(None if k == "link" else 0.0 if k == "font_size" else False)
    return F.struct(text.alias("text"), *(other(k).cast(t).alias(k) for k, t in kinds.items()))


def plain(runs: Column) -> Column:
    return F.array_join(F.transform(of(runs), lambda r: F.coalesce(r["text"], F.lit(""))), "")


def same_style(a: Column, b: Column) -> Column:
    flag = lambda x, k: F.coalesce(x[k], F.lit(False))
    size = lambda x: F.coalesce(x["font_size"], F.lit(0.0))
    return (flag(a, "bold") == flag(b, "bold")) & (flag(a, "italic") == flag(b, "italic")) & (flag(a, "underline") == flag(b, "underline")) & a["link"].eqNullSafe(b["link"]) & (F.abs(size(a) - size(b)) < FONT)


def coalesced(runs: Column) -> Column:
    """Neighbours of one style as one run; empty runs go."""

    def add(found: Column, r: Column) -> Column:
        last = F.try_element_at(found, F.lit(-1))
        joined = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(run(F.concat(last["text"], r["text"]), last)))
        return F.when((F.size(found) > 0) & same_style(last, r), joined).otherwise(F.concat(found, F.array(r)))

    return F.aggregate(F.filter(of(runs), lambda r: r["text"] != ""), F.array().cast(f"array<{RUN}>"), add)


def trimmed(runs: Column) -> Column:
    """Without white space ahead of the first run's text and behind the last one's, then without empty runs."""
    found = of(runs)
    cut = F.transform(found, lambda r, i: run(F.regexp_replace(F.regexp_replace(r["text"], F.when(i == 0, r"^[\s\p{Z}]+").otherwise("$^"), F.lit("")), F.when(i == F.size(found) - 1, r"[\s\p{Z}]+$").otherwise("$^"), F.lit("")), r))
    return F.filter(cut, lambda r: r["text"] != "")


def placed(runs: Column) -> Column:
    """Each run with `at`, the characters ahead of it."""
    found = of(runs)
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<at:int,run:{RUN}>>").alias("out"))
    return F.aggregate(found, start, lambda a, r: F.struct((a["at"] + F.length(r["text"])).alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("at"), r.alias("run")))).alias("out")), lambda a: a["out"])


def cropped(runs: Column, offset: Column) -> Column:
    """What stands from a character on."""
    kept = F.transform(placed(runs), lambda p: run(F.substring(p["run"]["text"], F.greatest(offset - p["at"], F.lit(0)) + 1, F.length(p["run"]["text"])), p["run"]))
    return F.filter(kept, lambda r: r["text"] != "")


def without_marker(runs: Column) -> Column:
    """A list item's runs without its number or bullet."""
    return cropped(runs, marker_length(plain(runs)))


def flagged(runs: Column, flags: Column) -> Column:
    """Runs split where the characters' flags change, `underline` set by them; characters beyond the flags keep what they have, as one run each."""

    def pieces(p: Column) -> Column:
        text, at = p["run"]["text"], p["at"]
        own = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), lambda c, i: F.struct(c.alias("c"), F.try_element_at(flags, at + i + 1).alias("f")))

        def add(found: Column, x: Column) -> Column:
            last = F.try_element_at(found, F.lit(-1))
            grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), F.array(run(F.concat(last["text"], x["c"]), last)))
            now = F.coalesce(x["f"], p["run"]["underline"], F.lit(False))
            return F.when((F.size(found) > 0) & (F.coalesce(last["underline"], F.lit(False)) == now), grown).otherwise(F.concat(found, F.array(run(x["c"], p["run"], underline=now))))

        return F.aggregate(own, F.array().cast(f"array<{RUN}>"), add)

    return F.flatten(F.transform(placed(runs), pieces))


def joined(parts: Column) -> Column:
    """Wrapped lines' runs, an array of arrays, as one line: trimmed, a space between each two."""
    spaced = F.transform(parts, lambda r, i: F.concat(F.when(i > 0, F.array(run(F.lit(" ")))).otherwise(F.array().cast(f"array<{RUN}>")), trimmed(r)))
    return coalesced(F.flatten(spaced))


KINDS = {"bold": (pa.bool_(), False), "italic": (pa.bool_(), False), "underline": (pa.bool_(), False), "link": (pa.string(), None), "font_size": (pa.float64(), 0.0)}


def pieces_of(body: str, texts: list[str], styles: list[tuple]) -> list[list[tuple[str, int]]]:
    """For each line of a body its stretches of one style: text, and the first of the source's runs (texts, styles) that has the style, or -1 where the source lacks the character."""
    first: dict[tuple, int] = {}
    same = [first.setdefault(x, i) for i, x in enumerate(styles)]
    owner = np.append(np.repeat(np.asarray(same, np.int64), [len(x) for x in texts]), -1)
    which = owner[np.asarray(align(body, "".join(texts)), np.int64)] if body else np.zeros(0, np.int64)
    lines, at = [], 0
    for line in body.split("\n"):
        own = which[at : at + len(line)]
        begins = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]).tolist() if line else []
        lines.append([(line[a:b], int(own[a])) for a, b in zip(begins, [*begins[1:], len(line)], strict=False)])
        at += len(line) + 1
    return lines


def replayed_rows(part: pa.RecordBatch, keys: list[str]) -> pa.RecordBatch:
    """(keys, line, runs) of a few rows (keys, _b, _r): a row a line, so no line carries its document's runs."""
    source, bodies = part.column("_r"), part.column("_b").to_pylist()
    given = source.flatten()
    ends = np.concatenate([[0], np.cumsum(pc.list_value_length(source).to_numpy(zero_copy_only=False))]).astype(np.int64)
    texts = [x or "" for x in given.field("text").to_pylist()]
    styles = list(zip(*([x or None for x in given.field(k).to_pylist()] for k in STYLE), strict=True))
    rows, numbers, sizes, found, which = [], [], [], [], []
    for k, body in enumerate(bodies):
        a, b = int(ends[k]), int(ends[k + 1])
        for number, line in enumerate(pieces_of(body, texts[a:b], styles[a:b]), 1):
            rows.append(k)
            numbers.append(number)
            sizes.append(len(line))
            found += [text for text, _ in line]
            which += [a + run if run >= 0 else -1 for _, run in line]
    at = np.asarray(which, np.int64)
    lacking, taken = pa.array(at < 0, pa.bool_()), pa.array(np.maximum(at, 0), mask=at < 0)
    kinds = [pc.if_else(lacking, pa.scalar(none, kind), given.field(k).take(taken)) for k, (kind, none) in KINDS.items()]
    made = pa.StructArray.from_arrays([pa.array(found, pa.string()), *kinds], ["text", *KINDS])
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return pa.record_batch([*(part.column(k).take(pa.array(rows, pa.int64())) for k in keys), pa.array(numbers, pa.int32()), pa.ListArray.from_arrays(offsets, made)], names=[*keys, "line", "runs"])


def replayed(df: DataFrame, body: str, runs: str, keys: list[str]) -> DataFrame:
    """(keys, line, runs): the body's lines, from 1, with the styles of the source's characters they come from; a character that the source lacks has no style. Only equal font sizes are one style here."""
    given = df.select(*keys, F.coalesce(body, F.lit("")).alias("_b"), of(F.col(runs)).alias("_r"))

    def run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                yield replayed_rows(whole.slice(at, 64), keys)

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys), "line int", f"runs array<{RUN}>"])
    return given.mapInArrow(run_batches, schema)
