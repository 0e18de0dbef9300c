"""Places of regular-expression matches with built-in functions only: matches and the pieces between them give the lengths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

STEP = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def starts_of(steps: Column) -> Column:
    """Sums of the entries before each entry of an int array: by stretches of STEP entries, so that long arrays stay cheap."""
    zero = F.lit(0)
    add = lambda a, x: a + x

    def with_steps(s: Column) -> Column:
        count = F.floor((F.size(s) - 1) / STEP).cast("int")
        sums = F.transform(F.sequence(zero, count), lambda j: F.aggregate(F.slice(s, j * STEP + 1, F.lit(STEP)), zero, add))
        return let(sums, lambda b: let(F.transform(b, lambda x, j: F.aggregate(F.slice(b, F.lit(1), j), zero, add)), lambda before: F.transform(s, lambda x, i: F.element_at(before, F.floor(i / STEP).cast("int") + 1) + F.aggregate(F.slice(s, F.floor(i / STEP).cast("int") * STEP + 1, F.pmod(i, F.lit(STEP))), zero, add))))

    return let(steps, with_steps)


def highest_before(values: Column) -> Column:
    """The greatest entry before each entry of an int array, 0 at the first: by stretches of STEP entries."""
    zero = F.lit(0)
    most = lambda a, x: F.greatest(a, x)

    def with_values(s: Column) -> Column:
        count = F.floor((F.size(s) - 1) / STEP).cast("int")
        tops = F.transform(F.sequence(zero, count), lambda j: F.aggregate(F.slice(s, j * STEP + 1, F.lit(STEP)), zero, most))
        return let(tops, lambda b: let(F.transform(b, lambda x, j: F.aggregate(F.slice(b, F.lit(1), j), zero, most)), lambda before: F.transform(s, lambda x, i: F.greatest(F.element_at(before, F.floor(i / STEP).cast("int") + 1), F.aggregate(F.slice(s, F.floor(i / STEP).cast("int") * STEP + 1, F.pmod(i, F.lit(STEP))), zero, most)))))

    return let(values, with_values)


def chunks(text: Column, size: int) -> Column:
    """The text in pieces of `size` code points, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))


def cutout(pieces: Column, size: int, begin: Column, end: Column) -> Column:
    """The text between two places, from its pieces."""
    at = lambda k: F.coalesce(F.try_element_at(pieces, k + 1), F.lit(""))
    first, last = F.floor(begin / size).cast("int"), F.floor(end / size).cast("int")
    inside = F.substring(at(first), F.pmod(begin, F.lit(size)) + 1, end - begin)
    across = F.concat(F.substring(at(first), F.pmod(begin, F.lit(size)) + 1, F.lit(size)), F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.substring(at(last), F.lit(1), F.pmod(end, F.lit(size))))
    return F.when(first == last, inside).otherwise(across)


def spans(text: Column, pattern: str, kind: str) -> Column:
    """array<struct<start, end, kind, value, before, after>> of the leftmost non-overlapping matches, in code points, end exclusive.
    `before` has up to 48 code points ahead of the match, back to the match before it; `after` up to 16 behind it, as far as the next.

    The pattern must not match the empty string. Null where there is no match.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))

    def place(b: Column) -> Column:
        m, p = b["m"], b["p"]
        steps = F.transform(m, lambda x, i: F.length(x) + F.length(F.element_at(p, i + 1)))
        around = lambda i: (F.substring(F.element_at(p, i + 1), -48, 48).alias("before"), F.substring(F.element_at(p, i + 2), 1, 16).alias("after"))
        return F.when(F.size(m) > 0, let(starts_of(steps), lambda at: F.transform(m, lambda x, i: let(F.element_at(at, i + 1) + F.length(F.element_at(p, i + 1)), lambda s: F.struct(s.alias("start"), (s + F.length(x)).alias("end"), F.lit(kind).alias("kind"), x.alias("value"), *around(i))))))

    return let(found, place)


def none() -> Column:
    return F.array().cast("array<struct<start:int,end:int,kind:string,value:string,before:string,after:string>>")


def spans_if(condition: Column, text: Column, pattern: str, kind: str) -> Column:
    """As spans, empty where the condition does not hold."""
    return F.coalesce(F.when(condition, spans(text, pattern, kind)), none())


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def ordered(found: Column, kinds: list[str], kind_first: bool) -> Column:
    """Spans by start and kind, or by kind and start; kinds in the order given."""
    place = lambda k: F.array_position(F.array(*(F.lit(x) for x in kinds)), k).cast("int")
    keyed = F.transform(found, lambda x: F.struct(*((place(x["kind"]).alias("a"), x["start"].alias("b")) if kind_first else (x["start"].alias("a"), place(x["kind"]).alias("b"))), x["end"].alias("c"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda k: k["x"])
