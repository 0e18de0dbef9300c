"""Scalar functions on header fields, lines and names. All are expressions of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space, letters and digits of patterns are those of Unicode: a narrow no-break space may stand ahead of AM.
STAMP = r"(?U:\w{3},\s\w{3}\s\d{1,2},\s\d{4}\sat\s\d{1,2}:\d{2}\s(?:AM|PM))"
ADDRESS = r"<([^>]+)>"
LINK = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


def trim_ws(s: Column) -> Column:
    """Without space separators and tabs at both ends; line feeds stay."""
    return F.regexp_replace(s, r"^[\p{Zs}\t]+|[\p{Zs}\t]+$", "")


def norm_subject(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(s)), r"^((re|fw|fwd)\s*:\s*)+", ""), " +", " ")


def norm_email(s: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(trim_ws(s)), "^<", ""), ">$", "")


def norm_name(s: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(trim_ws(s)), r"\s*<[^>]*>", ""), r"\s+\S+@\S+$", "")
    return trim_ws(F.regexp_replace(bare, r"\s+", " "))


def norm_body(s: Column) -> Column:
    """Runs of white space, bullets, hyphens and asterisks as one space; lower case."""
    return F.lower(F.trim(F.regexp_replace(s, r"[\s\p{Z}•·*-]+", " ")))


def norm_line(s: Column) -> Column:
    return F.replace(F.lower(trim_ws(s)), F.lit("  "), F.lit(" "))


def address_set(s: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(s, F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"), F.lit(0)), lambda x: F.lower(x))))


# The forms of dates, with or without a weekday ahead, and what zones' names stand for.
WEEKDAY = r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun)"
FORMS = ((WEEKDAY + r",\s+", "MMM d, yyyy 'at' h:mm a"), (WEEKDAY + r"\s+", "M/d/yyyy h:mm a"), (None, "M/d/yyyy h:mm a"), (None, "MMMM d, yyyy 'at' h:mm:ss a zzz"), (None, "MMMM d, yyyy 'at' h:mm a zzz"))
ZONES = {"UTC": "+00:00", "GMT": "+00:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00", "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00", "HST": "-10:00"}


def parse_date(s: Column) -> Column:
    """The first of the known forms that fits, else null; a weekday has to be one, but is not compared with the date. A zone's name stands for its own offset all year."""
    offsets = F.create_map(*(F.lit(x) for pair in ZONES.items() for x in pair))

    def read(bare: Column) -> Column:
        day, numeric = F.regexp_replace(bare, WEEKDAY + r",?\s+", ""), F.concat(F.regexp_replace(bare, r"[A-Z]{3,4}$", ""), F.coalesce(F.try_element_at(offsets, F.regexp_extract(bare, r"\s([A-Z]{3,4})$", 1)), F.lit("?")))
        made = [F.try_to_timestamp(numeric if form.endswith(" zzz") else day if ahead else bare, F.lit(form.replace("zzz", "XXX"))) for ahead, form in FORMS]
        return F.coalesce(*(F.when(bare.rlike(ahead), x) if ahead else x for (ahead, _), x in zip(FORMS, made, strict=True)))

    # an array of one, so that the text is trimmed once and the expression stays small
    return F.element_at(F.transform(F.array(F.regexp_replace(trim_ws(s), r"\p{Zs}", " ")), read), 1)


def dates_match(a: Column, b: Column) -> Column:
    """Equal as text, or both parse and lie within a minute."""
    near = F.abs(F.unix_timestamp(parse_date(a)) - F.unix_timestamp(parse_date(b))) <= 60
    return (F.lower(trim_ws(a)) == F.lower(trim_ws(b))) | F.coalesce(near, F.lit(False))


def sanitize(s: Column) -> Column:
    """A file name's part: characters that file systems refuse become one underscore."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r'[\\/:*?"<>|\x00-\x1F]', "_"), "_+", "_"), " +", " "))


RESERVED = "CON PRN AUX NUL COM1 COM2 COM3 COM4 COM5 COM6 COM7 COM8 COM9 LPT1 LPT2 LPT3 LPT4 LPT5 LPT6 LPT7 LPT8 LPT9".split()  # fixed values


def safe_filename(stem: Column, extension: str = "pdf", most: int = 200) -> Column:
    """A stem of bounded bytes without trailing dots or spaces and no device's name; "thread" if nothing is left."""
    limit = most - len(extension) - 8
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("s"))
    add = lambda a, c: F.when(a["n"] + F.octet_length(c) <= limit, F.struct((a["n"] + F.octet_length(c)).alias("n"), F.concat(a["s"], c).alias("s"))).otherwise(F.struct(F.lit(most * 9).alias("n"), a["s"].alias("s")))
    clean = F.regexp_replace(sanitize(stem), r"[. ]+$", "")
    short = F.when(F.octet_length(clean) <= limit, clean).otherwise(F.aggregate(F.split(clean, ""), start, add, lambda a: a["s"]))
    named = F.when(F.upper(short).isin(*RESERVED), F.concat(F.lit("_"), short)).when(short == "", F.lit("thread")).otherwise(short)
    return F.concat(named, F.lit(f".{extension}"))


def thread_uid(subject: Column, first_date: Column) -> Column:
    """Eight characters of base 36 from the first five bytes of a SHA-256."""
    return F.lpad(F.conv(F.substring(F.sha2(F.concat_ws("|", subject, first_date), 256), 1, 10), 16, 36), 8, "0")


def snippet(s: Column) -> Column:
    flat = F.trim(F.regexp_replace(s, r"\s+", " "))
    return F.when(F.length(flat) > 90, F.concat(F.substring(flat, 1, 90), F.lit("…"))).otherwise(flat)


def linkify(s: Column) -> Column:
    """array<struct<text, start, link>>: a text's pieces in order, addresses with a mailto link; starts count from 0."""
    s = F.coalesce(s, F.lit(""))
    found, between = F.regexp_extract_all(s, F.lit(LINK), F.lit(0)), F.split(s, LINK, -1)
    pieces = F.flatten(F.transform(between, lambda x, i: F.array(F.struct(x.alias("text"), F.lit(None).cast("string").alias("link")), F.struct(F.coalesce(F.try_element_at(found, i + 1), F.lit("")).alias("text"), F.concat(F.lit("mailto:"), F.try_element_at(found, i + 1)).alias("link")))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,link:string>>").alias("out"))
    add = lambda a, x: F.struct((a["at"] + F.length(x["text"])).alias("at"), F.concat(a["out"], F.array(F.struct(x["text"].alias("text"), a["at"].alias("start"), x["link"].alias("link")))).alias("out"))
    return F.aggregate(F.filter(pieces, lambda x: x["text"] != ""), start, add, lambda a: a["out"])


def file_hash(content: Column) -> Column:
    """SHA-256 of bytes or text, in lowercase hexadecimal."""
    return F.sha2(content, 256)


def cell_text(value: Column) -> Column:
    """A table cell's value as text, null as empty."""
    return F.coalesce(value.cast("string"), F.lit(""))


def sampled(key: Column, n: int, seed: int = 0) -> Column:
    """Whether a row is in a sample of one in n, by a hash of its key: the same rows each time."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(n)) == 0


def output_name(address: Column, subject: Column, at: Column) -> Column:
    """`address subject - yyyy.MM.dd HH_mm.pdf`, safe for file systems; "thread" for a missing address."""
    stem = F.concat(sanitize(F.coalesce(address, F.lit("thread"))), F.lit(" "), sanitize(F.coalesce(subject, F.lit(""))), F.lit(" - "), F.date_format(at, "yyyy.MM.dd HH_mm"))
    return safe_filename(stem)


def collision_name(name: Column, place: Column) -> Column:
    """The name of the place-th output of one name: ` (2)` to ` (999)` before the extension, beyond it six digits of a hash of name and place."""
    stem, ext = F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"(?s)^(.*?)(\.[^.]*)?$", 2)
    mark = F.when(place <= 999, F.format_string(" (%d)", place)).otherwise(F.concat(F.lit("-"), F.substring(F.sha2(F.concat_ws("/", name, place.cast("string")), 256), 1, 6)))
    return F.when(place <= 1, name).otherwise(F.concat(stem, mark, ext))


def short_date(s: Column) -> Column:
    """A printed stamp as `MMM d · h:mm a`; anything else as it is."""
    ahead, form = FORMS[0]
    return F.coalesce(F.date_format(F.when(s.rlike(ahead), F.try_to_timestamp(F.regexp_replace(s, ahead, ""), F.lit(form))), "MMM d · h:mm a"), s)


def short_name(s: Column) -> Column:
    """The first name and the last one's initial; a single name as it is."""
    parts = F.filter(F.split(s, " "), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat(F.element_at(parts, 1), F.lit(" "), F.substring(F.element_at(parts, -1), 1, 1), F.lit("."))).otherwise(s)


def short_recipients(s: Column) -> Column:
    """The first of a comma-separated list, without its address, and how many more there are."""
    parts = F.filter(F.split(trim_ws(s), ","), lambda x: x != "")
    first = trim_ws(F.element_at(parts, 1))
    name = F.when(first.contains("<"), trim_ws(F.regexp_replace(first, "(?s)<.*$", ""))).otherwise(first)
    return F.when(F.size(parts) == 0, trim_ws(s)).when(F.size(parts) > 1, F.concat(name, F.lit(" +"), (F.size(parts) - 1).cast("string"))).otherwise(name)


def roman(n: Column) -> Column:
    """Roman numerals; nothing for zero and below."""
    place = lambda v, one, five, ten: F.element_at(F.array(*(F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten))), v.cast("int") + 1)
    digit = lambda k: F.floor(n / k) % 10
    return F.when(n <= 0, "").otherwise(F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), place(digit(100), "C", "D", "M"), place(digit(10), "X", "L", "C"), place(digit(1), "I", "V", "X")))


def nav_strip(idx: Column, total: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), total), lambda i: F.when(i == idx, F.concat(F.lit("["), i, F.lit("]"))).otherwise(i.cast("string"))), " · ")


def repair_sender(name: Column, email: Column) -> tuple[Column, Column]:
    """An address in the name's last brackets, else at its end behind a space, leaves the name and fills an empty address field."""
    name, email = trim_ws(name), trim_ws(email)
    bracketed = r"(?s)^(.*)<([^<]*)>[^<>]*$"
    inside = trim_ws(F.regexp_extract(name, bracketed, 2))
    lifted = inside.contains("@")
    email = F.when(lifted & (email == ""), inside).otherwise(email)
    name = F.when(lifted, trim_ws(F.regexp_extract(name, bracketed, 1))).otherwise(name)
    tail = r"\s+([\w._%+-]+@[\w.-]+\.[A-Za-z]{2,})\s*$"
    email = F.when(email == "", F.regexp_extract(name, tail, 1)).otherwise(email)
    return trim_ws(F.regexp_replace(name, tail, "")), trim_ws(F.regexp_replace(F.regexp_replace(email, "^<", ""), ">$", ""))
