"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions only.

Documents are leaves of a tree: domain, then language, then source; which domain a source belongs to is a table. The token
budget goes down the tree by the weights of siblings; a node holds at most its tokens times `max_epochs`. What a node cannot
hold goes to its siblings in proportion to their weights first, and only what the whole family cannot hold is left to its
ancestors' siblings: at each level the children of a node are filled like vessels to a common level of tokens per weight.
All arithmetic is on integers; rounding loses less than a token a child.

A leaf takes whole epochs and then the token-prefix of one more: documents in the order of the MD5 of seed, epoch, id and
text, as long as their sum stays within the rest. Prefix sums run over ranges of that order, about the root of the table's
rows per leaf, and then inside the one range where the budget ends, so a leaf with a third of all rows is never sorted in
one place. Rows equal in leaf, id and text count as one entry with a number; of the one entry where the budget ends, rows
are numbered part by part.

Defined results: null languages and sources are leaves of their own, named "?"; sources that `domains` does not name are of
domain OTHER, those it names several times of the least name; texts without words have no tokens and are drawn as often as
the whole epochs of their leaf; weights not listed are 1; of equal rows as many are drawn once more as the budget has room
for; an empty table gives an empty table. Only id, text, language and source are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, row_key, text_of

SPACE = " \t\n\x0b\x0c\r"
LEVELS = ("domain", "lang", "source")
LEAF = ("lang", "source")
OTHER = "other"
WEIGHTS = {"domain": {"web": 40, "reference": 35, "forum": 25}, "lang": {"en": 40, "de": 20, "fr": 20, "es": 20}, "source": {}}


def words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACE))
    return F.when(inner == "", 0).otherwise(F.size(F.split(inner, "[\\x20\\x09-\\x0D]+"))).cast("long")


def weight(level: str, weights: dict) -> Column:
    out = F.lit(1)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, w).otherwise(out)
    return out.cast("long")


def fill(children: DataFrame, parent: list[str], child: str, weights: dict) -> DataFrame:
    """children with (parent..., child, room, given): `given` tokens of the parent's `budget` by weight, up to room."""
    w = children.withColumn("w", weight(child, weights))
    order = Window.partitionBy(*parent).orderBy(F.col("room") / F.col("w"), child)
    before = F.coalesce(F.sum("room").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    after = F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))
    step = w.withColumns({"before": before, "after": after})
    step = step.withColumn("full", F.col("room") * F.col("after") <= F.col("w") * (F.col("budget") - F.col("before")))
    all_children = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(all_children), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("w"))).over(all_children)
    given = F.when(F.col("full"), F.col("room")).otherwise(F.expr("w * left_over div open_weight"))
    return step.withColumns({"left_over": left, "open_weight": open_weight}).withColumn("given", given).drop("w", "before", "after", "full", "left_over", "open_weight")


def budgets(leaves: DataFrame, total: Column, max_epochs: int, weights: dict) -> DataFrame:
    """leaves (domain, lang, source, tokens) with `given`, the tokens that each is to yield."""
    rooms = leaves.withColumn("room", F.col("tokens") * max_epochs)
    top = rooms.groupBy("domain").agg(F.sum("room").alias("room"))
    everything = rooms.agg(total.cast("long").alias("budget"))
    level = fill(top.crossJoin(F.broadcast(everything)).withColumn("root", F.lit(0)), ["root"], "domain", weights).select("domain", F.col("given").alias("budget"))
    second = rooms.groupBy("domain", "lang").agg(F.sum("room").alias("room")).join(level, "domain")
    level = fill(second, ["domain"], "lang", weights).select("domain", "lang", F.col("given").alias("budget"))
    return fill(rooms.join(level, ["domain", "lang"]), ["domain", "lang"], "source", weights).select(*LEVELS, "tokens", "given")


def numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __k, 1 and up among those of equal keys: counted for each part of `__seq` (the numbers of a written table's partitions) first, so that a hot key is not numbered in one place."""
    parted = rows.withColumn("__part", F.shiftright("__seq", 33))
    per = parted.groupBy(*keys, "__part").agg(F.count("*").alias("__in"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("__before", F.coalesce(F.sum("__in").over(before), F.lit(0))).drop("__in")
    place = F.row_number().over(Window.partitionBy(*keys, "__part").orderBy("__seq"))
    return parted.withColumn("__place", place).join(per, [*keys, "__part"]).withColumn("__k", F.col("__before") + F.col("__place")).drop("__part", "__place", "__before")


def mix(df: DataFrame, domains: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", share: float = 0.8, max_epochs: int = 2, seed: int = 17, weights: dict | None = None) -> DataFrame:
    """Per document: doc_id, row_key, domain, lang, source, n_tokens, copies; the budget is `share` of all tokens, rounded down. `domains` has (source, domain)."""
    weights = WEIGHTS if weights is None else weights
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    text = text_of(text_col)
    rows = df.select(*row_key(id_col, text_col), name(lang_col).alias("lang"), name(source_col).alias("source"), words(text).alias("n_tokens"), F.md5(text).alias("digest"), F.monotonically_increasing_id().alias("__seq"))
    rows = cut(rows, "mixing")
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    if domains is None:
        leaves = leaves.withColumn("domain", F.lit(OTHER))
    else:
        tree = domains.select(name("source").alias("source"), F.col("domain").cast("string").alias("domain")).groupBy("source").agg(F.min("domain").alias("domain"))
        leaves = leaves.join(tree, "source", "left").withColumn("domain", F.coalesce("domain", F.lit(OTHER)))
    percent = round(share * 1000)
    given = budgets(leaves, F.expr(f"sum(tokens) * {percent} div 1000"), max_epochs, weights)
    shares = cut(given.select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("given div tokens")).otherwise(0).alias("epochs"), F.when(F.col("tokens") > 0, F.col("given") % F.col("tokens")).otherwise(0).alias("rest")), "budgets")
    digits = round(math.log2(max(1, rows.count())) / 8)  # as many ranges as rows in each of them
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("digest")))
    keyed = rows.join(shares, list(LEAF)).withColumn("place", place).withColumn("bucket", F.substring("place", 1, digits)).drop("digest")
    sums = keyed.groupBy(*LEAF, "bucket").agg(F.sum("n_tokens").alias("in_bucket"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy(*LEAF).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("in_bucket").over(ahead), F.lit(0)))
    ends = cut(sums.filter("ahead + in_bucket > rest").groupBy(*LEAF).agg(F.min(F.struct("bucket", "ahead")).alias("end")), "mixing-ends")
    placed = keyed.join(ends, list(LEAF), "left")
    beyond = F.col("end").isNotNull() & (F.col("bucket") > F.col("end.bucket"))
    split = F.col("end").isNotNull() & (F.col("bucket") == F.col("end.bucket"))
    clear = placed.filter(~split).withColumn("more", (~beyond).cast("int"))
    # the range in which the budget ends: equal rows are an entry, of which `take` rows have room
    key = [*LEAF, "place", "n_tokens"]
    running = Window.partitionBy(*LEAF).orderBy("place", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    entries = placed.filter(split).groupBy(*key).agg(F.count("*").alias("n"), F.first("rest").alias("left_over"), F.first("end.ahead").alias("start"))
    room = F.col("left_over") - F.col("start") - F.coalesce(F.sum(F.col("n") * F.col("n_tokens")).over(running), F.lit(0))
    fits = F.when(F.col("n_tokens") == 0, F.when(room >= 0, F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least("n", F.floor(room / F.col("n_tokens")))))
    entries = entries.select(*key, "n", fits.cast("long").alias("take"))
    last = placed.filter(split).join(entries, key)
    whole = last.filter("take = 0 or take = n").withColumn("more", (F.col("take") > 0).cast("int"))
    part = numbered(last.filter("take > 0 and take < n"), key).withColumn("more", (F.col("__k") <= F.col("take")).cast("int"))
    # where nothing is left beyond whole epochs, rows without tokens are not drawn once more
    out = ["doc_id", "row_key", *LEVELS, "n_tokens", (F.col("epochs") + F.when(F.col("rest") > 0, F.col("more")).otherwise(0)).cast("int").alias("copies")]
    return clear.select(*out).unionByName(whole.select(*out)).unionByName(part.select(*out))


def draw(df: DataFrame, domains: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", **settings) -> DataFrame:
    """df's rows, each as often as `mix` says; rows equal in id, text, language and source share their copies as evenly as whole numbers allow."""
    key = ["__doc", "__row", "__lang", "__source"]
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    doc, row = row_key(id_col, text_col)
    drawn = mix(df, domains, id_col, text_col, lang_col, source_col, **settings).groupBy(F.col("doc_id").alias("__doc"), F.col("row_key").alias("__row"), F.col("lang").alias("__lang"), F.col("source").alias("__source"))
    chosen = cut(drawn.agg(F.sum("copies").alias("__all"), F.count("*").alias("__n")).filter("__all > 0"), "mixing-drawn")
    same = doc.eqNullSafe(F.col("__doc")) & (row == F.col("__row")) & (name(lang_col) == F.col("__lang")) & (name(source_col) == F.col("__source"))
    repeat = lambda d, n: d.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), n))).select(*df.columns)
    even = repeat(df.join(chosen.filter("__all % __n = 0"), same), F.expr("__all div __n"))
    uneven = chosen.filter("__all % __n <> 0")
    if uneven.isEmpty():
        return even
    several = cut(df.join(uneven, same).withColumn("__seq", F.monotonically_increasing_id()), "mixing-uneven")
    times = F.expr("__all div __n") + (F.col("__k") <= F.col("__all") % F.col("__n")).cast("long")
    return even.unionByName(repeat(numbered(several, key).withColumn("__times", times).filter("__times > 0"), F.col("__times")))


def mix_sql(domain: str = f"'{OTHER}'", share: float = 0.8, max_epochs: int = 2, seed: int = 17, weights: dict | None = None) -> str:
    """DuckDB SQL for mix(documents) without row_key; `domain` is SQL for the domain of `source`."""
    weights = WEIGHTS if weights is None else weights

    def case(level: str) -> str:
        found = "".join(f" WHEN {level} = '{n}' THEN {w}" for n, w in weights.get(level, {}).items())
        return f"(CASE{found} ELSE 1 END)" if found else "1"

    def level(name: str, source: str, parent: str, child: str, keys: str) -> str:
        return f"""
{name}_w AS (SELECT *, {case(child)}::BIGINT AS w FROM {source}),
{name}_o AS (SELECT *, coalesce(sum(room) OVER (PARTITION BY {parent} ORDER BY room / w::DOUBLE, {child} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before, (sum(w) OVER (PARTITION BY {parent} ORDER BY room / w::DOUBLE, {child} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS after FROM {name}_w),
{name}_f AS (SELECT *, room * after <= w * (budget - before) AS f FROM {name}_o),
{name} AS (SELECT {keys}, (CASE WHEN f THEN room ELSE w * (budget - coalesce(sum(room) FILTER (f) OVER (PARTITION BY {parent}), 0)::BIGINT) // (sum(w) FILTER (NOT f) OVER (PARTITION BY {parent}))::BIGINT END)::BIGINT AS given FROM {name}_f)"""

    percent = round(share * 1000)
    return f"""
WITH rows0 AS (SELECT doc_id, coalesce(lang, '?') AS lang, coalesce(source, '?') AS source, md5(coalesce(text, '')) AS digest, trim(coalesce(text, ''), E' \\t\\n\\x0b\\x0c\\r') AS inner_text FROM documents),
docs AS (SELECT doc_id, {domain} AS domain, lang, source, digest, CASE WHEN inner_text = '' THEN 0 ELSE len(string_split_regex(inner_text, '[\\x20\\x09-\\x0D]+')) END::BIGINT AS n_tokens FROM rows0),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS room FROM docs GROUP BY ALL),
top AS (SELECT 0 AS root, domain, sum(room)::BIGINT AS room, (SELECT (sum(tokens) * {percent})::BIGINT // 1000 FROM leaves) AS budget FROM leaves GROUP BY domain),{level("a", "top", "root", "domain", "domain")},
second AS (SELECT domain, lang, sum(room)::BIGINT AS room, any_value(a.given) AS budget FROM leaves JOIN a USING (domain) GROUP BY domain, lang),{level("b", "second", "domain", "lang", "domain, lang")},
third AS (SELECT l.*, b.given AS budget FROM leaves l JOIN b USING (domain, lang)),{level("c", "third", "domain, lang", "source", "domain, lang, source, tokens")},
shares AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN given // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN given % tokens ELSE 0 END AS rest FROM c),
placed AS (SELECT d.*, epochs, rest, md5('{seed}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '') || ':' || digest) AS place FROM docs d JOIN shares USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM placed)
SELECT doc_id, domain, lang, source, n_tokens, (epochs + CASE WHEN rest > 0 AND s <= rest THEN 1 ELSE 0 END)::INTEGER AS copies FROM summed"""


