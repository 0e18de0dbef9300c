"""PII by weak supervision, with DataFrame functions only.

Base kinds (email, ip, card, phone) are leftmost non-overlapping matches that pass their test; they always stay. Further
kinds (local phone numbers, social security numbers, account numbers) are candidates. Three labelers vote on every match
of either sort, failed ones included: the pattern labeler (format or check digits), the gazetteer labeler (tables of top
domains, issuers, calling codes, account countries with their lengths, and of reserved values) and the context labeler
(words on both sides). Expectation-maximisation over the counts of vote patterns, a table whose size depends only on the
kinds and labelers, estimates each labeler's reliability in both classes and each kind's share (Dawid and Skene). Its
posteriors are the soft labels of the span classifier, a logistic model over what the labelers do not see: the match's
length, separators and groups, and the characters on both sides, all by kind; it is fitted on the counts of vote patterns
and features together, a table of bounded size as well. A further span is added if classifier and label model together,
their logits summed, are for it and it overlaps no base span.

Defined results: null text counts as empty; texts without matches have counts of zero and empty lists; equal rows give
equal rows, null ids stay; without any match in the table nothing is learnt and nothing added; an empty table gives an
empty table. Columns other than the two named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, row_key, text_of
from .native_spans import chunks, cutout, highest_before, let, listed, ordered, spans_if

#: Character loops only, so that long matches need no deep recursion: where the definition repeats a group, a lazy loop stops before what the group could not take. A match may start inside a run of its characters only where the match before it ended.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++\.[A-Za-z0-9-][A-Za-z0-9.-]*?(?=\.\.|\.?(?![A-Za-z0-9.-]))",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?=(?:[ -]?[0-9]){12})[0-9 -]*?(?![0-9]|[ -][0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "local": r"(?<![0-9.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Z0-9])",
}
BASE = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
#: A cheap test that a text with a match of the kind passes.
MAY = {"email": "@", "phone": "+"}
# The gazetteers. Top domains; calling codes; issuers' first digits; accounts' countries with their lengths; reserved values.
TOP_DOMAINS = "com org net edu gov mil int info biz io co ai app dev me tv de fr es uk it nl at ch be pt pl se no dk fi ie cz ru ua jp cn in kr br mx ar ca us au nz za eu".split()
NO_DOMAINS = "example test invalid local localhost lan internal".split()
NO_ONE = "noreply no-reply donotreply postmaster mailer-daemon".split()
CALLING = "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 212 213 216 234 254 351 352 353 354 358 359 370 371 372 380 381 385 386 420 421 852 880 886 966 971 972".split()
ISSUERS = "^(?:4|5[1-5]|2[2-7]|3[47]|3[068]|35|6011|65)"
ACCOUNTS = {"AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
RESERVED_NETS = r"^(?:0|10|127|169\.254|192\.168|192\.0\.2|198\.51\.100|203\.0\.113|22[4-9]|2[34][0-9]|25[0-5])\."
#: Words ahead of a match that speak for or against a person's data, and words behind it that speak against.
SPEAKS = r"(?i)(?:e-?mail|mail|contact|reach|write|call|phone|tel|fax|mobile|card|visa|credit|account|iban|ssn|social|address|\bip\b|user|name)[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+)?$"
AGAINST = r"(?i)(?:version|order|invoice|isbn|issn|part|serial|ticket|build|release|sum|total|figure|page)[^A-Za-z]*(?:[A-Za-z]+[^A-Za-z]+)?$"
UNITS = r"(?i)^\s*(?:%|kg|km|ms|px|pages?|items?|euros?|dollars?|percent)\b"
LABELERS = ("pattern", "gazetteer", "context")


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits(value)), ""), lambda c, i: let(F.coalesce(c.try_cast("int"), F.lit(0)), lambda d: F.when(i % 2 == 1, doubled(d)).otherwise(d)))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    """The kind's test of a match."""
    if kind == "ip":
        return F.forall(F.split(value, "\\."), lambda p: let(F.regexp_replace(p, "^0+(?=[0-9])", ""), lambda q: (F.length(q) <= 3) & (q.try_cast("int") <= 255)))
    if kind == "card":
        return F.length(digits(value)).between(13, 19) & luhn(value)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    if kind == "ssn":
        return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")
    if kind == "iban":
        # the remainder of the rearranged number, letters as 10 to 35, digit by digit
        moved = F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))
        number = F.transform(F.split(moved, ""), lambda c: F.when(c.rlike("[A-Z]"), F.ascii(c) - 55).when(c.rlike("[0-9]"), c.try_cast("int")).otherwise(F.lit(0)))
        return F.aggregate(number, F.lit(0), lambda a, x: F.when(x > 9, (a * 100 + x) % 97).otherwise((a * 10 + x) % 97)) == 1
    return F.lit(True)


def gazetteer_vote(kind: str, value: Column) -> Column:
    """1 where a table knows the value, 0 where it names no one, 2 otherwise."""
    if kind == "email":
        top, who = F.lower(F.regexp_extract(value, r"\.([^.]+)$", 1)), F.lower(F.regexp_extract(value, "^([^@]+)@", 1))
        return F.when(top.isin(*NO_DOMAINS) | who.isin(*NO_ONE), 0).when(top.isin(*TOP_DOMAINS), 1).otherwise(2)
    if kind == "ip":
        return F.when(value.rlike(RESERVED_NETS), 0).otherwise(2)
    if kind == "card":
        return F.when(value.rlike(ISSUERS), 1).otherwise(0)
    if kind == "phone":
        number = digits(value)
        known = F.substring(number, 1, 1).isin(*(c for c in CALLING if len(c) == 1)) | F.substring(number, 1, 2).isin(*(c for c in CALLING if len(c) == 2)) | F.substring(number, 1, 3).isin(*(c for c in CALLING if len(c) == 3))
        return F.when(known, 1).otherwise(0)
    if kind == "local":
        number = digits(value)
        return F.when(number.rlike("^[01]|^.11|^...[01]"), 0).otherwise(1)
    if kind == "ssn":
        return F.when(value.rlike("^(?:000|666|9)"), 0).otherwise(2)
    length = F.lit(0)
    for country, n in ACCOUNTS.items():
        length = F.when(value.startswith(country), n).otherwise(length)
    return F.when(length == F.length(value), 1).otherwise(0)


def votes(kind: str, x: Column) -> list[Column]:
    """Each labeler's vote on a match: 1 for, 0 against, 2 none."""
    context = F.when(x["before"].rlike(AGAINST) | x["after"].rlike(UNITS), 0).when(x["before"].rlike(SPEAKS), 1).otherwise(2)
    return [F.when(passes(kind, x["value"]), 1).otherwise(0), gazetteer_vote(kind, x["value"]), context]


#: What the classifier sees of a match: each feature's name and how many values it has.
FEATURES = {"size": 6, "separators": 5, "left": 5, "right": 5}


def around(c: Column) -> Column:
    """0 at the text's end, 1 white space, 2 a letter or underscore, 3 a digit, 4 any other character."""
    return F.when(c == "", 0).when(c.rlike(r"^\s"), 1).when(c.rlike(r"^[\p{L}_]"), 2).when(c.rlike("^[0-9]"), 3).otherwise(4)


def features(x: Column) -> list[Column]:
    """FEATURES of a match: its length in fours from 8, the most frequent kind of separator, and the characters on both sides."""
    value = x["value"]
    size = F.least(F.greatest(F.floor((F.length(value) - 8) / 4), F.lit(0)), F.lit(FEATURES["size"] - 1)).cast("int")
    separators = F.when(~value.rlike("[^A-Za-z0-9]"), 0).when(value.rlike("@"), 1).when(value.contains("-") & ~value.rlike("[ .()]"), 2).when(value.contains(".") & ~value.rlike("[ ()-]"), 3).otherwise(4)
    return [size, separators, around(F.substring(x["before"], -1, 1)), around(F.substring(x["after"], 1, 1))]


def marked(kind: str) -> Callable[[Column], Column]:
    """Adds the labelers' votes and the features to a match."""
    return lambda x: F.struct(*(x[f].alias(f) for f in ("start", "end", "kind")), *(v.cast("int").alias(n) for v, n in zip(votes(kind, x), LABELERS, strict=True)), *(v.cast("int").alias(n) for v, n in zip(features(x), FEATURES, strict=True)))


def candidates(text: Column) -> Column:
    """array<struct<start, end, kind, votes by LABELERS, FEATURES>> of all kinds' matches."""
    out = []
    for kind, pattern in PATTERNS.items():
        may = F.contains(text, F.lit(MAY[kind])) if kind in MAY else text.rlike(pattern)
        found = spans_if(may, text, pattern, kind)
        out.append(F.transform(found, marked(kind)))
    return F.concat(*out)


@dataclass
class Model:
    """What was learnt: per kind its share of true matches, per labeler and class its votes' chances, and the classifier's weights, by feature and value, and by kind with them."""

    share: dict[str, float] = field(default_factory=dict)
    chances: dict[str, list[list[float]]] = field(default_factory=dict)
    weights: dict[tuple, float] = field(default_factory=dict)
    bias: float = -1.0

    def posterior(self, x: Column) -> Column:
        """The label model's logit for a match."""
        total = F.lit(0.0)
        for kind, share in self.share.items():
            total = F.when(x["kind"] == kind, math.log(share / (1 - share))).otherwise(total)
        for name, (no, yes) in self.chances.items():
            vote = F.lit(0.0)
            for value in (0, 1, 2):
                vote = F.when(x[name] == value, math.log(max(yes[value], 1e-6) / max(no[value], 1e-6))).otherwise(vote)
            total = total + vote
        return total

    def score(self, x: Column) -> Column:
        """The classifier's logit for a match."""
        total = F.lit(self.bias)
        for name in FEATURES:
            own = F.lit(0.0)
            for (feature, kind, value), w in self.weights.items():
                if feature == name:
                    own = F.when((x["kind"] == kind) & (x[name] == value), w).otherwise(own)
            total = total + own
        for (feature, kind, _), w in self.weights.items():
            if feature == "kind":
                total = total + F.when(x["kind"] == kind, w).otherwise(0.0)
        return total

    def takes(self, x: Column) -> Column:
        return self.score(x) + self.posterior(x) >= 0.0 if self.share else F.lit(False)


def expect(rows: list[tuple], steps: int = 60) -> tuple[dict, dict, list[float]]:
    """Expectation-maximisation over (kind, votes, count): shares, chances and each row's posterior."""
    chances = {n: [[0.55, 0.1, 0.35], [0.1, 0.55, 0.35]] for n in LABELERS}  # [class][vote]
    chances["pattern"] = [[0.8, 0.2, 0.0], [0.05, 0.95, 0.0]]
    share = {r[0]: 0.5 for r in rows}
    posterior: list[float] = []
    for _ in range(steps):
        posterior = []
        for kind, marks, _ in rows:
            yes, no = share[kind], 1 - share[kind]
            for n, v in zip(LABELERS, marks, strict=True):
                yes, no = yes * max(chances[n][1][v], 1e-6), no * max(chances[n][0][v], 1e-6)
            posterior.append(yes / (yes + no))
        for k in share:
            mine = [(p, r[2]) for p, r in zip(posterior, rows, strict=True) if r[0] == k]
            share[k] = (1 + sum(p * c for p, c in mine)) / (2 + sum(c for _, c in mine))
        for i, n in enumerate(LABELERS):
            for c in (0, 1):
                seen = [0.0, 0.0, 0.0]
                for p, (_, marks, count) in zip(posterior, rows, strict=True):
                    seen[marks[i]] += count * (p if c else 1 - p)
                prior = chances[n][c]
                seen = [s + 2 * q for s, q in zip(seen, prior, strict=True)]  # two rows' worth of the last estimate
                chances[n][c] = [s / sum(seen) for s in seen]
    return share, chances, posterior


def fit(rows: list[tuple[str, tuple[int, ...], float, float]], rounds: int = 30, penalty: float = 0.5) -> tuple[dict[tuple, float], float]:
    """Weights and bias of a logistic model by (kind, features, posterior, count): coordinate Newton steps with a quadratic penalty, a count weighing as its square root."""
    on: dict[tuple, list[int]] = {}
    for i, (kind, values, _, _) in enumerate(rows):
        for key in [("kind", kind, 0), *((n, kind, v) for n, v in zip(FEATURES, values, strict=True))]:
            on.setdefault(key, []).append(i)
    weight, target = [math.sqrt(r[3]) for r in rows], [r[2] for r in rows]
    w, logit = dict.fromkeys(sorted(on), 0.0), [0.0] * len(rows)
    chance = lambda i: 1 / (1 + math.exp(-min(max(logit[i], -30.0), 30.0)))
    for _ in range(rounds):
        for key in w:
            g, h = penalty * w[key], penalty
            for i in on[key]:
                p = chance(i)
                g, h = g + weight[i] * (p - target[i]), h + weight[i] * p * (1 - p)
            step = min(max(g / h, -2.0), 2.0)
            w[key] -= step
            for i in on[key]:
                logit[i] -= step
    return w, 0.0


def learn(table: list[tuple]) -> Model:
    """From (kind, votes by LABELERS, FEATURES, count), a row for each pattern that occurs: at most 18 vote patterns and 750 feature values a kind."""
    if not table:
        return Model()
    n = len(LABELERS)
    votes_of: dict[tuple, float] = {}
    for row in table:
        votes_of[row[0], tuple(row[1 : n + 1])] = votes_of.get((row[0], tuple(row[1 : n + 1])), 0) + row[-1]
    rows = sorted((k, marks, count) for (k, marks), count in votes_of.items())
    share, chances, posterior = expect(rows)
    known = {(k, marks): p for (k, marks, _), p in zip(rows, posterior, strict=True)}
    soft = sorted((row[0], tuple(row[n + 1 : -1]), known[row[0], tuple(row[1 : n + 1])], float(row[-1])) for row in table)
    return Model(share, chances, *fit(soft))


def learn_from(table: DataFrame, column: str = "all") -> Model:
    """Count the patterns of all candidates of a table and learn."""
    marks = table.select(F.explode(column).alias("x")).groupBy("x.kind", *(f"x.{n}" for n in (*LABELERS, *FEATURES))).agg(F.count("*").alias("n"))
    return learn([tuple(r) for r in marks.collect()])


def decide(found: Column, model: Model) -> Column:
    """From candidates: base matches that pass, and further ones that the classifier takes and no base match overlaps; by kind, then start."""

    def chosen(base: Column) -> Column:
        more = F.filter(found, lambda x: ~x["kind"].isin(*BASE) & model.takes(x) & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
        return ordered(F.concat(base, more), list(KINDS), True)

    return let(F.filter(found, lambda x: x["kind"].isin(*BASE) & (x["pattern"] == 1)), chosen)


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """Per document: doc_id, row_key, found. Without a model one is learnt from the table itself."""
    table = cut(df.select(*row_key(id_col, text_col), candidates(text_of(text_col)).alias("all")), "pii")
    model = learn_from(table) if model is None else model
    return table.select("doc_id", "row_key", decide(F.col("all"), model).alias("found"))


#: Code points of the pieces that texts are cut from.
PIECE = 4096


def masked(text: Column, found: Column) -> Column:
    """text with each span, or run of overlapping spans, replaced by its first one's kind in angle brackets."""
    by_start = F.array_sort(F.transform(found, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))

    def replaced(b: Column) -> Column:
        spans, pieces = b["spans"], b["pieces"]
        rest = cutout(pieces, PIECE, F.array_max(F.transform(spans, lambda x: x["end"])), b["length"])
        marked_up = lambda before: F.transform(spans, lambda x, i: let(F.element_at(before, i + 1), lambda at: F.when(x["start"] >= at, F.concat(cutout(pieces, PIECE, at, x["start"]), F.lit("<"), F.upper(x["kind"]), F.lit(">")))))
        return F.concat(F.array_join(F.array_compact(let(highest_before(F.transform(spans, lambda x: x["end"])), marked_up)), ""), rest)

    return F.when(F.size(found) == 0, text).otherwise(let(F.struct(by_start.alias("spans"), chunks(text, PIECE).alias("pieces"), F.length(text).alias("length")), replaced))


def mask(df: DataFrame, text_col: str = "text", model: Model | None = None) -> DataFrame:
    """df with personal data in its text column replaced; null stays null. Candidates are found once and written beside the rows."""
    table = cut(df.withColumn("__all", candidates(text_of(text_col))), "pii-mask")
    model = learn_from(table, "__all") if model is None else model
    new = let(F.struct(text_of(text_col).alias("t"), F.col("__all").alias("c")), lambda b: let(decide(b["c"], model), lambda found: masked(b["t"], found)))
    return table.withColumn(text_col, F.when(F.col(text_col).isNotNull(), new)).select(*df.columns)


def report(found: DataFrame) -> DataFrame:
    """Counts of the base kinds and digests of the lists of spans."""
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    own = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return found.select("doc_id", *(count(k) for k in BASE), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))


