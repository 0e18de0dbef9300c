"""Counts of one text, as bytes of UTF-8, that the quality operators share. Words are runs without ASCII white space."""

from __future__ import annotations

import numpy as np

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CONTINUATION = bytes(range(0x80, 0xC0))
UPPER = bytes(range(0x41, 0x5B))
LOWER = bytes(range(0x61, 0x7B))
DIGITS = b"0123456789"
ENDS = b".!?"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_lower", "n_digits", "n_marks", "n_bars", "n_ends", "n_lines", "n_distinct")


def how_many(raw: bytes, which: bytes) -> int:
    return len(raw) - len(raw.translate(None, which))


def repeated_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur at least twice in the text, the first occurrence included."""
    n = len(words) - 2
    if n < 2 or len(set(zip(words, words[1:], words[2:], strict=False))) == n:
        return 0
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, len(words))
    _, pairs = np.unique(ids[:-1] * len(index) + ids[1:], return_inverse=True)
    _, inverse, counts = np.unique(pairs[:-1] * len(index) + ids[2:], return_inverse=True, return_counts=True)
    twice = counts[inverse] > 1
    inside = np.zeros(len(words), bool)
    for k in range(3):
        inside[k : k + n] |= twice
    return int(inside.sum())


def counts(raw: bytes) -> tuple[int, ...]:
    """The numbers that COUNTS names."""
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = len(raw) - how_many(raw, CONTINUATION)
    return (
        len(words), chars - how_many(raw, SPACE), how_many(raw, SYMBOLS), len(lines) - len(set(lines)), repeated_words(words),
        how_many(raw, UPPER), how_many(raw, LOWER), how_many(raw, DIGITS), how_many(raw, b"!"), how_many(raw, b"|"), how_many(raw, ENDS), len(lines), len(set(words)),
    )
