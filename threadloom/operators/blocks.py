"""Body lines to paragraphs, lists and attachments.

Line tables have (doc_id, line_no, plain); `indent`, in points, and `is_bullet`, a drawn bullet ahead of the line, are read
where they are there and count as 0 and false where not. Null lines count as blank. All rules are windows within a stretch
of lines between blank ones, so a document without blank lines is one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadloom.functions.text import trim_ws
from threadloom.operators.pointers import with_starts
from threadloom.operators.segment import is_header

# Attachment extensions, abbreviations after which no paragraph starts, what a paragraph may start with, and lengths.
EXTENSIONS = "pdf|docx?|xlsx?|pptx?|png|jpe?g|gif|zip|txt|csv|rtf|heic"
ABBREVIATIONS = ("Mr.", "Mrs.", "Ms.", "Dr.", "St.", "Jr.", "Sr.")
STARTS = "^[\\p{Lu}\\p{N}\"'“‘(\\[]"
SHORT_SALUTATION, SHORT_SENTENCE, SHORT_LINE, SHORT_HEADING, LEAD = 50, 30, 45, 80, 60
OUTDENT, SMALL_FONT = 4.0, 9.0
COUNT, FILE, SIZE = r"(?i)^(\d+)\s+attachments?$", rf"(?i)^.+\.(?:{EXTENSIONS})$", r"(?i)^\d+(?:\.\d+)?\s*[KMG]B?$"
ORDERED, UNORDERED = r"^\s*(\d+[.)]\s+)\S", r"^\s*([-•*]\s+)\S"


def text(column: str = "plain") -> Column:
    return trim_ws(F.coalesce(F.col(column), F.lit("")))


def line_class(plain: Column) -> Column:
    t = trim_ws(F.coalesce(plain, F.lit("")))
    return F.when(t == "", "blank").when(t.rlike(COUNT), "attachment_count").when(t.rlike(FILE), "file").when(t.rlike(SIZE), "size").when(t.rlike(ORDERED), "ordered").when(t.rlike(UNORDERED), "unordered").otherwise("text")


def breaks(prev: Column, here: Column) -> Column:
    """Whether a paragraph starts between two trimmed lines: never beside a blank one or after an abbreviation; else after a short salutation, after a list item's end before a start, before a short closer, after a short sentence before a start."""
    start = here.rlike(STARTS)
    last = F.element_at(F.split(prev, " +"), -1)
    return (
        F.when(prev.isNull() | (prev == "") | (here == "") | last.isin(*ABBREVIATIONS), F.lit(False)).when((F.length(prev) <= SHORT_SALUTATION) & prev.rlike("[,:]$"), F.lit(True)).when(prev.rlike("[);]$") & start, F.lit(True))
        .when((F.length(here) <= SHORT_SALUTATION) & here.rlike("[,:]$"), F.lit(True)).otherwise((F.length(prev) <= SHORT_SENTENCE) & prev.rlike("[.!?:]$") & start)
    )


def paragraph_break(lines: DataFrame) -> DataFrame:
    """lines with brk: whether a paragraph starts here, by the line before."""
    return lines.withColumn("brk", breaks(F.lag(text()).over(Window.partitionBy("doc_id").orderBy("line_no")), text()))


def preformatted(lines: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, n_lines, short_ratio, small_ratio, preformatted): half the characters in a small font, or at least three lines of which 60 % are short. Without a column `runs` no font is known, and small_ratio is 0."""
    t = text()
    runs = F.col("runs") if "runs" in lines.columns else F.array().cast("array<struct<text:string,font_size:double>>")
    size = lambda keep: F.coalesce(F.aggregate(F.filter(runs, keep), F.lit(0), lambda a, r: a + F.length(r["text"])), F.lit(0))
    sized = lines.select(*keys, t.alias("t"), size(lambda r: (r["font_size"] > 0) & (r["font_size"] < SMALL_FONT)).alias("small"), size(lambda r: r["text"].isNotNull()).alias("all"))
    full = sized.groupBy(*keys).agg(F.count_if(F.col("t") != "").alias("n_lines"), F.count_if((F.col("t") != "") & (F.length("t") <= SHORT_LINE)).alias("short"), F.sum("small").alias("small"), F.sum("all").alias("all")).filter("n_lines > 0")
    hit = ((F.col("all") > 0) & (F.col("small") * 2 >= F.col("all"))) | ((F.col("n_lines") >= 3) & (F.col("short") * 100 >= F.col("n_lines") * 60))
    return full.select(*keys, "n_lines", F.round(F.col("short") / F.col("n_lines"), 6).alias("short_ratio"), F.round(F.when(F.col("all") > 0, F.col("small") / F.col("all")).otherwise(0.0), 6).alias("small_ratio"), hit.alias("preformatted"))


def sub_heading(plain: Column, any_bold: Column | None = None) -> Column:
    """A short line that starts with a capital, ends with a colon and is not bold already."""
    t = trim_ws(F.coalesce(plain, F.lit("")))
    hit = (F.length(t) <= SHORT_HEADING) & t.rlike("^\\p{Lu}") & t.endswith(":")
    return hit if any_bold is None else hit & ~F.coalesce(any_bold, F.lit(False))


def lead_in(plain: Column) -> Column:
    """The phrase, with its colon, that leads into a paragraph within its first 60 characters; empty without one."""
    return F.regexp_extract(F.substring(F.coalesce(plain, F.lit("")), 1, LEAD), r"^([A-Z][^:\n]{0,55}[a-zA-Z]:)\s", 1)


def marker_length(plain: Column) -> Column:
    """How many characters of a line its number or bullet takes, white space on both sides included; 0 without content behind it."""
    found = F.coalesce(F.regexp_extract(plain, r"^(\s*\d+[.)]\s+)\S", 1), F.lit(""))
    other = F.coalesce(F.regexp_extract(plain, r"^(\s*[-•*]\s+)\S", 1), F.lit(""))
    return F.greatest(F.length(found), F.length(other))


def label_blocks(lines: DataFrame) -> DataFrame:
    """lines without blank ones, with block, kind (paragraph, ordered, unordered, attachments), item (true where a list's item or an attachment run starts) and stated, the number that an attachment run's head states.

    A head takes all lines to the next blank one; files with sizes below them make a run without a head; a bullet takes the
    lines below it until another bullet or one further out by more than four points; all else goes by its own marker.
    """
    doc = Window.partitionBy("doc_id").orderBy("line_no")
    upto = doc.rowsBetween(Window.unboundedPreceding, 0)
    given = lines.withColumns({"indent": F.coalesce(F.col("indent").cast("double"), F.lit(0.0)) if "indent" in lines.columns else F.lit(0.0), "is_bullet": F.coalesce("is_bullet", F.lit(False)) if "is_bullet" in lines.columns else F.lit(False)})
    marked = given.withColumn("cls", line_class(F.col("plain"))).withColumn("stretch", F.sum((F.col("cls") == "blank").cast("int")).over(upto))
    own = Window.partitionBy("doc_id", "stretch").orderBy("line_no")
    so_far = own.rowsBetween(Window.unboundedPreceding, 0)
    full = marked.filter("cls <> 'blank'").withColumns({"file": (F.col("cls") == "file") & F.coalesce(F.lead("cls").over(own) == "size", F.lit(False))})
    full = full.withColumns({"starts": F.col("is_bullet") & (F.col("cls") != "attachment_count") & ~F.col("file"), "group": F.sum(F.col("is_bullet").cast("int")).over(so_far)})
    bullet = Window.partitionBy("doc_id", "stretch", "group").orderBy("line_no")
    first = F.first(F.when(F.col("starts"), F.col("indent"))).over(bullet.rowsBetween(Window.unboundedPreceding, 0))
    low = F.min("indent").over(bullet.rowsBetween(Window.unboundedPreceding, 0))
    full = full.withColumn("under", F.coalesce(low + OUTDENT >= first, F.lit(False)))
    free = ~F.col("under")
    full = full.withColumns({"file": F.col("file") & free, "head": F.max(F.when((F.col("cls") == "attachment_count") & free, 1).otherwise(0)).over(so_far) == 1})
    pair = F.col("file") | (F.coalesce(F.lag("file").over(own), F.lit(False)) & (F.col("cls") == "size"))
    kind = F.when(F.col("head"), "head").when(pair, "pair").when(F.col("under"), "unordered").when(F.col("cls").isin("ordered", "unordered"), F.col("cls")).otherwise("paragraph")
    full = full.withColumn("sub", kind)
    fresh = F.coalesce(F.lag("sub").over(own) != F.col("sub"), F.lit(True)) | ((F.col("sub") == "paragraph") & breaks(F.lag(text()).over(own), text()))
    full = full.withColumn("fresh", fresh)
    item = F.when(F.col("sub").isin("head", "pair", "paragraph"), F.col("fresh")).when(F.col("under"), F.col("starts")).otherwise(F.lit(True))
    stated = F.when((F.col("sub") == "head") & F.col("fresh"), F.regexp_extract(text(), COUNT, 1).try_cast("int"))
    out = full.withColumns({"item": item, "stated": stated, "block": F.sum(F.col("fresh").cast("int")).over(upto).cast("int"), "kind": F.when(F.col("sub").isin("head", "pair"), "attachments").otherwise(F.col("sub"))})
    return out.drop("stretch", "file", "starts", "group", "under", "head", "sub", "fresh")


def body_blocks(lines: DataFrame) -> DataFrame:
    """(doc_id, block, kind, first_line, n_lines, n_items): the blocks of label_blocks; an attachment run counts the items it states, else its files."""
    files = F.count_if(F.col("cls") == "file").cast("int")
    return label_blocks(lines).groupBy("doc_id", "block", "kind").agg(
        F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.when(F.first("kind") == "attachments", F.coalesce(F.max("stated"), files)).otherwise(F.count_if("item")).cast("int").alias("n_items")
    )


def attachment_rows(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, line_no, name, size) of labelled lines' attachments: a size belongs to the line before it, unless that is a size taken as one; size is empty without one."""
    run = Window.partitionBy("doc_id", "block").orderBy("line_no")
    some = blocks.filter("kind = 'attachments' and stated is null").withColumns({"t": text(), "is_size": text().rlike(SIZE)})
    # in a run of sizes every other one is a size, starting with the first if a name stands ahead of it
    counted = some.withColumn("stretch", F.sum((~F.col("is_size")).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    place = F.row_number().over(Window.partitionBy("doc_id", "block", "stretch").orderBy("line_no")) - (F.col("stretch") > 0).cast("int")
    odd = counted.withColumn("as_size", F.col("is_size") & (F.pmod(place, F.lit(2)) == F.when(F.col("stretch") > 0, 1).otherwise(0)))
    after = odd.withColumn("size", F.when(F.lead("as_size").over(run), F.lead("t").over(run)).otherwise(""))
    return after.filter("not as_size").select("doc_id", "block", "line_no", F.col("t").alias("name"), "size")


# The introduction of a reply, and what a prompt costs.
BOUNDARY_REPLY = r"(?U)^On\s+\w{3},?\s+.+?<.+@.+>\s+wrote:$"
OVERHEAD, LEAST, CHARS_A_TOKEN = 400, 1024, 4


def is_boundary(plain: Column) -> Column:
    """Whether a chunk may start at this line: a message's header or a reply's introduction."""
    t = trim_ws(F.coalesce(plain, F.lit("")))
    return is_header(t) | (t.endswith("wrote:") & t.rlike(BOUNDARY_REPLY))


def token_estimate(chars: Column) -> Column:
    """Tokens of a prompt over a text: a quarter of its characters, and the prompt's own."""
    return F.floor(chars / CHARS_A_TOKEN).cast("int") + OVERHEAD


def chunk_pack(lines: DataFrame, tokens: int) -> DataFrame:
    """(doc_id, line_no, chunk): a document within the token budget is one chunk; in others a chunk ends before a boundary's line that does not fit.

    A line that starts a chunk points to the next boundary that does not fit any more; chunks are the lines that such
    pointers lead to.
    """
    budget = max(LEAST, (tokens - OVERHEAD) * CHARS_A_TOKEN)
    whole = F.sum("size").over(Window.partitionBy("doc_id")) - 1
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("line_no"))
    sized = lines.select("doc_id", F.col("line_no").cast("int").alias("line_no"), at.alias("at"), (F.length(F.coalesce("plain", F.lit(""))) + 1).cast("long").alias("size"), is_boundary(F.col("plain")).alias("boundary"))
    sized = sized.withColumns({"may_start": F.col("boundary") & (token_estimate(whole) > tokens), "many": F.count("*").over(Window.partitionBy("doc_id"))})
    begun = with_starts(sized.drop("boundary"), "doc_id", budget + 1)
    chunk = F.sum(F.col("begins").cast("int")).over(Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return begun.select("doc_id", "line_no", chunk.cast("int").alias("chunk"))


def prompt(text_col: Column, failure: Column | None = None) -> Column:
    """What a second parser is asked: the text alone, or with why its last answer did not serve."""
    ask = F.concat(F.lit("Return the messages of this thread as JSON.\n\n"), text_col)
    return ask if failure is None else F.concat(F.lit("The last answer was not valid: "), failure, F.lit("\nReturn JSON only.\n\n"), text_col)
