"""Boolean query language: words, "phrases", wildcards, parentheses, and / or / not, compiled to one Column.

Grammar (case-insensitive):  or := and ("or" and)*;  and := not (("and")? not)*;  not := "not" not | "(" or ")" | term.
A term is a word with ``*`` (any run) and ``?`` (one character), or a phrase of adjacent words.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:"([^"]*)"|([()])|([^\s()"]+))')


class QuerySyntaxError(ValueError):
    pass


def parse(text: str) -> tuple:
    tokens, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"unbalanced quote at {at}")
        tokens.append(("term", m[1]) if m[1] is not None else (m[2], m[2]) if m[2] else (m[3].lower(), m[3].lower()) if m[3].lower() in ("and", "or", "not") else ("term", m[3]))
        at = m.end()
    if not tokens:
        raise QuerySyntaxError("empty query")
    pos = 0

    def peek() -> str | None:
        return tokens[pos][0] if pos < len(tokens) else None

    def either() -> tuple:
        nonlocal pos
        parts = [both()]
        while peek() == "or":
            pos += 1
            parts.append(both())
        return parts[0] if len(parts) == 1 else ("or", *parts)

    def both() -> tuple:
        nonlocal pos
        parts = [single()]
        while peek() in ("and", "not", "(", "term"):
            pos += peek() == "and"
            parts.append(single())
        return parts[0] if len(parts) == 1 else ("and", *parts)

    def single() -> tuple:
        nonlocal pos
        kind = peek()
        pos += 1
        if kind == "not":
            return ("not", single())
        if kind == "(":
            inner = either()
            if peek() != ")":
                raise QuerySyntaxError("missing )")
            pos += 1
            return inner
        if kind == "term":
            return ("term", tokens[pos - 1][1])
        raise QuerySyntaxError(f"unexpected {kind or 'end'}")

    tree = either()
    if pos < len(tokens):
        raise QuerySyntaxError(f"unexpected {tokens[pos][1]}")
    return tree


def term_pattern(term: str) -> str:
    """Whole-word pattern of a term; ``*`` and ``?`` stay within a word."""
    words = ["".join({"*": r"\w*", "?": r"\w"}.get(c, re.escape(c)) for c in w) for w in term.lower().split()]
    return r"\b" + r"\W+".join(words) + r"\b"


def to_column(tree: tuple, field: Column) -> Column:
    kind, *rest = tree
    if kind == "term":
        return F.lower(field).rlike(term_pattern(rest[0]))
    parts = [to_column(r, field) for r in rest]
    if kind == "not":
        return ~parts[0]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if kind == "and" else out | p
    return out


def matches(query: str, field: Column) -> Column:
    """Whether field matches; null fields don't."""
    return F.coalesce(to_column(parse(query), F.coalesce(field, F.lit(""))), F.lit(False))


def near(field: Column, first: str, second: str, low: int, high: int) -> Column:
    """Whether ``second`` stands low..high words after ``first`` (negative: before): its places meet those reached from the other's in a hashed set."""
    words = F.split(F.lower(F.coalesce(field, F.lit(""))), r"\W+")

    def meets(words: Column) -> Column:
        at = lambda term: F.filter(F.transform(words, lambda w, i: F.when(w == term, i)), lambda i: i.isNotNull())
        reached = F.flatten(F.transform(at(first), lambda i: F.sequence(i + low, i + high)))
        return F.arrays_overlap(reached, at(second))

    return F.transform(F.array(words), meets)[0]  # the words are split once
