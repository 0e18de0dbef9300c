"""Alignment against a whole table, on random and edited texts."""

import random

from threadloom.operators import payload


def by_table(body, source):
    n, m = len(body), len(source)
    t = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            t[i][j] = t[i - 1][j - 1] + 1 if body[i - 1] == source[j - 1] else max(t[i - 1][j], t[i][j - 1])
    out, i, j = [-1] * n, n, m
    while i and j:
        if body[i - 1] == source[j - 1]:
            i, j = i - 1, j - 1
            out[i] = j
        elif t[i - 1][j] >= t[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out


def test_alignment_is_that_of_the_whole_table():
    rng = random.Random(1)
    for _ in range(300):
        source = "".join(rng.choice("abcé ") for _ in range(rng.randrange(60)))
        body = "".join(c if rng.random() < 0.8 else rng.choice("ab\nx") for c in source) if rng.random() < 0.6 else "".join(rng.choice("abcx") for _ in range(rng.randrange(60)))
        assert payload.align(body, source) == by_table(body, source)
    assert payload.align("a", "aa") == [1] and payload.align("ab", "") == [-1, -1] and payload.align("", "ab") == []


def test_a_large_alignment():
    rng = random.Random(2)
    source = "".join(rng.choice("abcdefgh ") for _ in range(1900))
    body = "".join(c for k, c in enumerate(source) if k % 13)
    found = payload.align(body, source)
    assert min(found) >= 0 and all(source[k] == c for c, k in zip(body, found, strict=True)) and found == sorted(set(found))
