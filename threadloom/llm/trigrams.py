"""From a regular expression to a Boolean query over trigrams that every match's text satisfies.

A query is True (anything may match), a trigram, or ("and"/"or", queries). Letters count in lower case, so an index over
lower-cased text serves patterns of either kind.
"""

from __future__ import annotations

import re._constants as K
import re._parser as parser
from dataclasses import dataclass

#: Sets of strings beyond this are no longer listed.
MANY = 24


def both(kind: str, queries: list) -> object:
    """The queries joined by "and" or "or", flattened and without repeats."""
    absorbing, out = kind == "or", []
    for q in queries:
        if q is True:
            if absorbing:
                return True
            continue
        out += [x for x in (q[1] if isinstance(q, tuple) and q[0] == kind else (q,)) if x not in out]
    if not out:
        return True
    return out[0] if len(out) == 1 else (kind, tuple(out))


def of_strings(strings: set[str]) -> object:
    """True of a text that holds one of the strings, as far as trigrams tell."""
    return both("or", [both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)]) if strings else True


@dataclass
class Part:
    """What is known of the strings that a part of a pattern matches: all of them, or their beginnings, ends and a query."""

    exact: set[str] | None
    begin: set[str]
    end: set[str]
    query: object = True

    def settled(self) -> Part:
        """Without the full list, when it has grown long."""
        if self.exact is None or len(self.exact) <= MANY and all(len(s) <= 40 for s in self.exact):
            return self
        return self.open()

    def open(self) -> Part:
        if self.exact is None:
            return self
        return Part(None, short({s[:2] for s in self.exact}), short({s[-2:] for s in self.exact}), of_strings(self.exact))


def short(strings: set[str]) -> set[str]:
    return strings if len(strings) <= MANY else {""}


ANY = Part(None, {""}, {""})
EMPTY = Part({""}, {""}, {""})


def joined(a: Part, b: Part) -> Part:
    if a.exact is not None and b.exact is not None:
        if len(a.exact) * len(b.exact) <= MANY:
            return Part({x + y for x in a.exact for y in b.exact}, set(), set()).settled()
    a_end = a.exact if a.exact is not None else a.end
    b_begin = b.exact if b.exact is not None else b.begin
    between = of_strings({x + y for x in a_end for y in b_begin}) if len(a_end) * len(b_begin) <= 4 * MANY else True
    x, y = a.open(), b.open()
    begin = short({(s + t)[:2] for s in a.exact for t in y.begin}) if a.exact is not None else x.begin
    end = short({(s + t)[-2:] for s in x.end for t in b.exact}) if b.exact is not None else y.end
    return Part(None, begin, end, both("and", [x.query, y.query, between]))


def either(parts: list[Part]) -> Part:
    if all(p.exact is not None for p in parts):
        return Part(set().union(*(p.exact for p in parts)), set(), set()).settled()
    opened = [p.open() for p in parts]
    return Part(None, short(set().union(*(p.begin for p in opened))), short(set().union(*(p.end for p in opened))), both("or", [p.query for p in opened]))


def characters(items: list) -> Part:
    found: set[str] = set()
    for op, value in items:
        if op == K.LITERAL:
            found.add(chr(value).lower())
        elif op == K.RANGE and value[1] - value[0] < 4:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return ANY
    return Part(found, set(), set()) if len(found) <= 5 else ANY


def sequence(items) -> Part:
    out = EMPTY
    for item in items:
        out = joined(out, part(item))
    return out


def part(item) -> Part:
    op, value = item
    if op == K.LITERAL:
        return Part({chr(value).lower()}, set(), set())
    if op == K.IN:
        return characters(value)
    if op == K.SUBPATTERN:
        return sequence(value[3])
    if op == K.BRANCH:
        return either([sequence(x) for x in value[1]])
    if op in (K.MAX_REPEAT, K.MIN_REPEAT, K.POSSESSIVE_REPEAT):
        least, most, inner = value
        own = sequence(inner)
        if (least, most) == (0, 1):
            return either([own, EMPTY])
        if least == 0:
            return ANY
        once = EMPTY
        for _ in range(min(least, 8)):
            once = joined(once, own)
        return once if least == most and least <= 8 else Part(None, once.open().begin, once.open().end, once.open().query)
    if op in (K.AT, K.ASSERT, K.ASSERT_NOT):
        return EMPTY
    return ANY


def query(pattern: str) -> object:
    """The query of a pattern in the syntax that Python and Java share."""
    return sequence(parser.parse(pattern)).open().query


def trigrams(q: object) -> set[str]:
    if q is True:
        return set()
    return {q} if isinstance(q, str) else set().union(*(trigrams(x) for x in q[1]))


def holds(q: object, present: set[str]) -> bool:
    if q is True:
        return True
    if isinstance(q, str):
        return q in present
    return (all if q[0] == "and" else any)(holds(x, present) for x in q[1])
