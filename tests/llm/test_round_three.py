"""Collocations, periodic runs and top products against brute force, over nulls, empties, repeats, ties and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from threadloom.llm import collocations, periodic_runs, pivot_topk

DATA = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark):
    real = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    own = [None, "", " \t", "É é. a b c; a b c! a b\x0bc " * 20, "x " * 4000, "ab cd\x85ef ab cd\x85ef " * 12, "a b a b a b a b a b a b c c c c c c c c c c c c c c"]
    rows = real + [(900_000 + i, x, None if i % 2 else "und") for i, x in enumerate(own)] + [(None, own[3], "xx"), (None, None, None), real[0], real[0]]
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, lang string, phrase string, n int").repartition(3).cache()


def collocations_by_hand(rows, least=10, top=2000, near=50):
    n, counts, out = Counter(), {}, set()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        f = counts.setdefault(lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f.update(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        phrases = {p: a for p, a in f.items() if a >= least and " " in p}
        longest = Counter()
        for p, a in phrases.items():
            x, *rest = p.split(" ")
            if len(rest) == 2:
                for q in (f"{x} {rest[0]}", f"{rest[0]} {rest[1]}"):
                    longest[q] = max(longest[q], a)
        scored = []
        for p, a in phrases.items():
            if 100 * longest[p] >= near * a and longest[p]:
                continue
            w = p.split(" ")
            score, k = min((1_000_000 * a * a // (f[" ".join(w[:k])] * f[" ".join(w[k:])]), k) for k in range(1, len(w)))
            scored.append((-score, -a, p.encode(), f[" ".join(w[:k])], f[" ".join(w[k:])]))
        out |= {(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top], 1)}
    return out


@pytest.mark.parametrize("least, top, near", [(10, 2000, 50), (3, 25, 30)])
def test_collocations(docs, least, top, near):
    got = [tuple(r) for r in collocations.collocations(docs, least=least, top=top, near=near).collect()]
    assert len(got) == len(set(got))
    assert set(got) == collocations_by_hand([(r.text, r.lang) for r in docs.collect()], least, top, near)


def test_collocations_of_nothing(docs):
    assert collocations.collocations(docs.filter("false")).count() == 0
    assert collocations.collocations(docs.filter("text is null")).count() == 0


def test_slots_are_minimal_perfect():
    rng = np.random.default_rng(1)
    for n in (1, 2, 100, 20_000):
        h1, h2 = rng.integers(0, 1 << 63, (2, n)).astype(np.uint64)
        h1[: n // 2] = h1[0]  # keys that only the second lane tells apart
        made, order = collocations.Slots.build(h1, h2)
        assert sorted(made.find(h1, h2)) == list(range(n))
        assert (made.h1 == h1[order]).all()
        assert (made.find(h1, h2 + np.uint64(1)) == -1).all()
    with pytest.raises(ValueError, match="128 bits"):
        collocations.Slots.build(np.array([5, 5], np.uint64), np.array([7, 7], np.uint64))


def runs_by_hand(words, least=12):
    """Every maximal stretch for each period, the smallest period of equal stretches."""
    out = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda x: (x[0], x[2]))


def kept_by_hand(words, runs):
    repeated = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in repeated)


def test_run_kernel():
    rng = random.Random(7)
    for least in (12, 4, 30):
        for _ in range(120):
            texts = []
            for _ in range(rng.randrange(1, 7)):
                n, kind, w = rng.randrange(0, 150), rng.randrange(4), []
                while len(w) < n:
                    block = [rng.choice("abc" if kind < 2 else "abcdefghijk") for _ in range(rng.randrange(1, 16))]
                    w += block * (rng.randrange(1, 6) if kind % 2 else 1)
                texts.append(w)
            for w, (runs, kept) in zip(texts, periodic_runs.texts_in([" ".join(w).encode() for w in texts], least), strict=True):
                assert runs == runs_by_hand(w, least)
                assert kept.decode() == kept_by_hand(w, runs)
    runs, kept = periodic_runs.texts_in([b"ab " * 30_000], 12)[0]
    assert (runs, kept) == ([(0, 30_000, 1)], b"ab")


def test_run_digest(docs):
    got = [tuple(r) for r in periodic_runs.run_digest(periodic_runs.periodic_runs(periodic_runs.with_planted_periods(docs))).collect()]
    want = []
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", r.text or "")
        if r.doc_id is not None and w and (h := zlib.crc32(str(r.doc_id).encode())) % 10 == 0:
            a, g = h // 10 % len(w), h // 10
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        runs = runs_by_hand(w)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{s},{n},{q}\n" for s, n, q in runs), kept_by_hand(w, runs))]
        want.append((r.doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha))
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any(x[1] > 1 for x in want)
    assert periodic_runs.periodic_runs(docs.filter("false")).count() == 0


@pytest.mark.parametrize("kind", ["near", "equal", "large"])
def test_top_products(spark, kind):
    rng = np.random.default_rng(3)
    scale = 1e6 if kind == "large" else 0.4
    centres = rng.normal(size=(4, 8))
    rows = [(int(i), [float(x) for x in (centres[i % 4] + rng.normal(size=8) * 0.1) * scale], "clash", 1) for i in range(400)]
    if kind == "equal":  # a third of all rows alike, repeated ids and rows, nulls, short and empty vectors
        rows = [(i, rows[7][1] if i % 3 == 0 else v, c, n) for i, v, c, n in rows]
        rows += [rows[50], rows[50], (None, rows[7][1], "", 1), (450, None, "", 1), (500, [1.0, None], "", 1), (550, [float("nan")], "", 1), (600, [0.5, -0.5], "", 1), (650, [], "", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int").repartition(5)
    got = sorted(map(tuple, pivot_topk.top_products(df, ring=16, width=2).collect()))
    found = [(i, [int(np.floor(256 * x)) for x in v]) for i, v, *_ in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, (i, v) in enumerate(found):
        if i is not None and i % 50 == 0:
            others = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j is None, j or 0, j) for o, (j, w) in enumerate(found) if o != q)[:5]
            want += [(i, k, j, -s) for k, (s, _, _, j) in enumerate(others, 1)]
    assert got == sorted(want)


def test_top_products_of_few(spark):
    kind = "vec_id long, embedding array<float>"
    assert pivot_topk.top_products(spark.createDataFrame([], kind)).count() == 0
    assert pivot_topk.top_products(spark.createDataFrame([(0, [1.0])], kind)).count() == 0
    assert sorted(map(tuple, pivot_topk.top_products(spark.createDataFrame([(0, []), (1, []), (None, [])], kind)).collect())) == [(0, 1, 1, 0), (0, 2, None, 0)]
