"""Drawing tokens against a walk over them, one by one."""

import random

import pytest

from threadloom.operators import drawing

SCHEMA = "doc_id int, page int, pos int, op string, args array<double>, name string, text string"
ONE = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def times(m, n):
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return [a * p + b * r, a * q + b * s, c * p + d * r, c * q + d * s, e * p + f * r + t, e * q + f * s + u]


def at(point, m):
    x, y = point
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def walk(tokens):
    """(chunks, paths) of one page's tokens."""
    stack, text, leading, font, points, start, chunks, paths = [ONE], ONE, 0.0, "", [], None, [], []
    for _, _, pos, op, args, name, shown in tokens:
        args = list(args or [])
        need = drawing.NUMBERS.get(op, 0)
        if len(args) < need:
            continue
        n = args[len(args) - need :]
        if op == "q":
            stack.append(stack[-1])
        elif op == "Q" and len(stack) > 1:
            stack.pop()
        elif op == "cm":
            stack[-1] = times(n, stack[-1])
        elif op == "BT":
            text = ONE
        elif op == "Tm":
            text = n
        elif op == "TL":
            leading = n[0]
        elif op == "Tf":
            font = name or ""
        elif op in ("Td", "TD"):
            leading = -n[1] if op == "TD" else leading
            text = times([1, 0, 0, 1, *n], text)
        elif op == "m":
            points, start = [tuple(n)], tuple(n)
        elif op in ("l", "c", "v", "y"):
            points = [*points, tuple(n[-2:])]
        elif op == "re":
            xs, ys = sorted((n[0], n[0] + n[2])), sorted((n[1], n[1] + n[3]))
            points = [(x, y) for x in xs for y in ys]
        elif op == "h" and start:
            points = [*points, start]
        elif op == "n":
            points, start = [], None
        elif op in drawing.FILLS + drawing.STROKES:
            if points:
                where = [at(p, stack[-1]) for p in points]
                xs, ys = zip(*where, strict=True)
                paths.append((pos, min(xs), min(ys), max(xs), max(ys), len(points), op in drawing.FILLS))
            points, start = [], None
        if op in drawing.NEXT_LINE:
            text = times([1, 0, 0, 1, 0, -leading], text)
        if op in drawing.SHOWS and shown is not None and (shown or op != "TJ"):
            chunks.append((pos, *at(at((0, 0), text), stack[-1]), font, shown))
    return chunks, paths


def close(got, want):
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert [pytest.approx(x, rel=1e-6, abs=1e-6) if isinstance(x, float) else x for x in b] == list(a)


def test_tokens_as_a_walk_places_them(spark):
    rng = random.Random(3)
    ops = ["q", "q", "Q", "Q", "cm", "cm", "BT", "ET", "Tm", "Td", "TD", "T*", "TL", "Tf", "Tj", "Tj", "TJ", "'", '"', "m", "l", "c", "v", "y", "re", "h", "f", "S", "n", "B*", "gs"]
    tokens = []
    for doc in range(12):
        for pos in range(rng.choice([1, 20, 400])):
            op = rng.choice(ops)
            args = [rng.choice([-1.0, 0.5, 1.0, 2.0, 3.0]) for _ in range(drawing.NUMBERS.get(op, 0) + rng.choice([0, 0, 0, 0, 1, -1]))]
            tokens.append((doc, doc % 2, pos, op, args if rng.random() < 0.97 else None, rng.choice(["F1", None]), rng.choice([None, "", "text"])))
    deep = [("q", None), ("cm", [1.0, 0.0, 0.0, 1.0, 1.0, 2.0])] * 300 + [("Tj", None)] + [("Q", None)] * 700 + [("Tj", None), ("cm", [2.0, 0.0, 0.0, 2.0, 0.0, 0.0]), ("re", [1.0, 1.0, -2.0, 3.0]), ("f", None)]
    tokens += [(99, 0, i, op, args, None, "deep") for i, (op, args) in enumerate(deep)]
    frame = spark.createDataFrame(tokens, SCHEMA).repartition(4)
    chunks, paths = drawing.text_chunks(frame).collect(), drawing.painted_paths(frame).collect()
    for doc in {t[0] for t in tokens}:
        want = walk([t for t in tokens if t[0] == doc])
        close(sorted(tuple(r)[2:] for r in chunks if r.doc_id == doc), want[0])
        close(sorted(tuple(r)[2:] for r in paths if r.doc_id == doc), want[1])
    assert max(r.x for r in chunks if r.doc_id == 99) == 300.0
    assert drawing.text_chunks(frame.filter("false")).count() == drawing.painted_paths(frame.filter("false")).count() == 0


def test_scopes_go_on_over_batches_and_end_with_their_page(spark):
    """More tokens than a batch has rows, in scopes that stay open; a number that is null makes null what is computed from it."""
    grow = [2.0, 0.0, 0.0, 2.0, 0.0, 0.0]
    move = [1.0, 0.0, 0.0, 1.0, 1.0, 0.0]
    deep = [("q", None)] * 9_990 + [("cm", move)] + [("q", None), ("cm", move), ("Tj", None)] * 20 + [("Q", None)] * 15 + [("Tj", None)] + [("Q", None)] * 10_000 + [("Tj", None)]
    short = [("Tj", None), ("Q", None), ("Tj", None), ("q", None), ("cm", grow), ("cm", move), ("Tj", None)]
    lacking = [("cm", [1.0, 0.0, None, 1.0, 0.0, 0.0]), ("cm", [None, 0.0, 0.0, 2.0, 1.0, None]), ("Td", [3.0, 1.0]), ("Tj", None), ("cm", None), ("Tj", None)]
    pages = {(1, 1): deep, (1, 2): short, (None, 1): short, (2, 1): lacking}
    tokens = [(d, p, i, op, args, None, "x") for (d, p), given in pages.items() for i, (op, args) in enumerate(given)]
    found = {}
    for r in drawing.text_chunks(spark.createDataFrame(tokens, SCHEMA).repartition(1)).orderBy("pos").collect():
        found.setdefault((r.doc_id, r.page), []).append((r.x, r.y))
    assert found == {(1, 1): [(2.0 + k, 0.0) for k in range(20)] + [(6.0, 0.0), (0.0, 0.0)], (1, 2): [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0)], (None, 1): [(0.0, 0.0), (0.0, 0.0), (2.0, 0.0)], (2, 1): [(None, None)] * 2}


def test_paths_go_on_over_batches_and_lie_where_they_are_painted(spark):
    """Points of more rows than a batch, moved by what comes after them; nulls are left out of bounds, and no number is the largest, as in aggregates."""
    nan = float("nan")
    long = [("q", None), ("m", [0.0, 1.0])] + [("l", [float(k % 977), -float(k % 991)]) for k in range(21_000)] + [("cm", [2.0, 0.0, 0.0, 1.0, 5.0, 0.0]), ("S", None), ("Q", None), ("re", [1.0, 1.0, 2.0, 3.0]), ("f", None)]
    lacking = [("m", [None, 2.0]), ("l", [3.0, nan]), ("l", [4.0, 6.0]), ("S", None), ("m", [None, None]), ("f", None), ("m", [1.0, 1.0]), ("re", [0.0, 0.0, 4.0, 2.0]), ("h", None), ("f", None), ("S", None), ("l", [1.0, 1.0]), ("n", None), ("l", [1.0, 1.0])]
    pages = {(1, 1): long, (1, None): lacking, (2, 1): [("l", [1.0, 2.0]), ("cm", [None, 1.0, 0.0, 1.0, 0.0, 0.0]), ("f*", None)]}
    tokens = [(d, p, i, op, args, None, None) for (d, p), given in pages.items() for i, (op, args) in enumerate(given)]
    found = {}
    for r in drawing.painted_paths(spark.createDataFrame(tokens, SCHEMA).repartition(1)).orderBy("pos").collect():
        found.setdefault((r.doc_id, r.page), []).append(tuple(r)[3:])
    assert str(found.pop((1, None))) == str([(4.0, 6.0, nan, nan, 3, False), (None, None, None, None, 1, True), (0.0, 0.0, 4.0, 2.0, 5, True)])
    assert found == {(1, 1): [(5.0, -990.0, 1957.0, 1.0, 21_001, False), (1.0, 1.0, 3.0, 4.0, 4, True)], (2, 1): [(None, 3.0, None, 3.0, 1, True)]}
