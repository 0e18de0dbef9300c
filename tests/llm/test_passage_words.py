"""op9's passages by words, against a brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from threadloom.llm import queries, suffix_levels

DATA = "/root/testdata/sf0.001"


def brute(texts, size=51):
    """Of each text the words in strings of so many words that another text has as well."""
    words = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    rows = defaultdict(set)
    for k, w in enumerate(words):
        for i in range(len(w) - size + 1):
            rows[tuple(w[i : i + size])].add(k)
    return [len({j for i in range(len(w) - size + 1) if len(rows[tuple(w[i : i + size])]) > 1 for j in range(i, i + size)}) for w in words]


def rows():
    """Passages around 51 words between different words, repeats inside one text, long words, equal rows, other white space."""
    rng = random.Random(51)

    def some(n):
        return ["".join(rng.choices("abcdefghiß", k=rng.randint(2, 6))) for _ in range(n)]

    out = [(None, None), (1, ""), (2, "one")]
    for k in range(40):
        passage = some(rng.choice([50, 51, 52, 70]))
        out += [(100 + 2 * k + j, " ".join([*some(rng.randint(0, 60)), sep.join(passage), *some(30)])) for j, sep in enumerate([" ", " \n"])]
    twice, wide = " ".join(some(55)), " ".join(["x" * 9000, *some(60), "y" * 5000])
    equal = " ".join(some(60))
    return [*out, (200, f"{twice} and again {twice}"), (201, "a b " + wide), (202, wide.replace("y", "z")), (203, equal), (203, equal), (204, "one two " * 40), (205, "one two " * 30), (206, "two three " * 60)]


@pytest.mark.parametrize("settings", [{}, {"batches": 3, "hot": 1}])
def test_passage_words(spark, settings):
    made = spark.createDataFrame(rows(), "doc_id long, text string")
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select((F.col("doc_id") + 1000).alias("doc_id"), "text").unionByName(made).repartition(3)
    found = [(r.doc_id, r.text or "") for r in docs.collect()]
    got = suffix_levels.removed_passages(docs, words=True, **settings).drop("row_key")
    want = sorted((str(d), len(t.encode()), n) for (d, t), n in zip(found, brute([t for _, t in found]), strict=True))
    assert sorted((str(r.doc_id), r.n_bytes, r.n_passage_words) for r in got.collect()) == want
    plain = suffix_levels.removed_passages(docs, **settings).drop("row_key")
    assert sorted(map(str, got.drop("n_passage_words").collect())) == sorted(map(str, plain.collect()))
    by_id = {r.doc_id: r for r in got.collect()}
    assert by_id[200].n_passage_words == 0
    assert any(r.n_passage_words >= 51 and r.n_removed == 0 for r in by_id.values())


def test_query_tells_short_passages(spark):
    """The registered query names passages of over 50 words that have under 400 bytes."""
    got = queries.queries()["op9_suffix_levels"](spark, DATA)
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    found = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert {r.doc_id: r.n_passage_words for r in got.collect()} == dict(zip(found, brute(found.values()), strict=True))


def test_word_codes_over_stretches(monkeypatch):
    """Codes and segments do not depend on where a stretch ends."""
    text = " ".join(t or "" for _, t in rows()).encode()
    want = suffix_levels.word_codes(text)
    assert len(want) == len(text.split())
    monkeypatch.setattr(suffix_levels, "STRETCH", 1000)
    assert (suffix_levels.word_codes(text) == want).all()
