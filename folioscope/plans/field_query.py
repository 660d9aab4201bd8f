"""Field-qualified queries: scopes, exact and leading values, date ranges, phrases, wildcards and proximity, as one Column.

Grammar, case-insensitive in its words:

    or    := and ("or" and)*
    and   := not ("and" not | "not" not)*
    not   := "not" not | near
    near  := item ("[n,m]" item)*                  an item n to m words behind the one before (negative: ahead of it)
    item  := "(" or ")" ["@" FIELD ("," FIELD)* [",_L"]] | FIELD "=" value | phrase ["@" FIELD ...]

``(x)@TI,CL`` finds x in a field, ``,_L`` only where the field begins with it.  ``AX=x`` is the whole field, ``AX=x*`` its beginning,
``ID=2016``, ``ID=a:b``, ``ID=a:`` and ``ID=:b`` ranges of days from years, months or days.  Words side by side are a phrase.

A field is compared as tokens: each Han character, and each run of other letters, digits and ``%``; half and full width are the same, other
signs don't count.  Proximity expands alternatives to at most MOST_NEAR pairs.  Values on ``=`` compare the column itself, so they
reach the scan as filters.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.plans.boolean_query import QuerySyntaxError

MOST_NEAR = 25
_TOKEN = re.compile(r'\s*(?:"(?P<quoted>[^"]*)"|\[\s*(?P<low>[+-]?\d+)\s*,\s*(?P<high>[+-]?\d+)\s*\]|@(?P<scope>[A-Za-z_]+(?:\s*,\s*[A-Za-z_]+)*)|(?P<field>[A-Za-z]{2,3})=(?P<value>"[^"]*"|[^\s()]+)|(?P<mark>[()])|(?P<word>[^\s()"\[\]@]+))')
_HAN = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"
_PARTS = rf"[{_HAN}]|[\p{{L}}\p{{N}}%&&[^{_HAN}]]+"
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = "".join(map(chr, range(0x21, 0x7F)))


def parse(text: str) -> tuple:
    """The query as nested tuples: and, or, not, near, scope, is, term."""
    tokens, at, text = [], 0, text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise QuerySyntaxError(f"can't read from {at}: {text[at : at + 20]!r}")
        g = m.groupdict()
        if g["low"] is not None:
            low, high = int(g["low"]), int(g["high"])
            if low > high:
                raise QuerySyntaxError(f"[{low},{high}] is empty")
            tokens.append(("gap", (low, high)))
        elif g["scope"]:
            tokens.append(("scope", [f.strip().upper() for f in g["scope"].split(",")]))
        elif g["field"]:
            tokens.append(("is", (g["field"].upper(), g["value"].strip('"'))))
        elif g["mark"]:
            tokens.append((g["mark"], None))
        elif g["word"] and g["word"].lower() in ("and", "or", "not"):
            tokens.append((g["word"].lower(), None))
        else:
            tokens.append(("term", g["quoted"] if g["quoted"] is not None else g["word"]))
        at = m.end()
    if not tokens:
        raise QuerySyntaxError("empty query")
    pos = 0

    def peek() -> str | None:
        return tokens[pos][0] if pos < len(tokens) else None

    def take():
        nonlocal pos
        pos += 1
        return tokens[pos - 1][1]

    def joined(kind: str, parts: list) -> tuple:
        return parts[0] if len(parts) == 1 else (kind, *parts)

    def either() -> tuple:
        parts = [both()]
        while peek() == "or":
            take()
            parts.append(both())
        return joined("or", parts)

    def both() -> tuple:
        parts = [negated()]
        while peek() in ("and", "not"):
            if peek() == "and":
                take()
            parts.append(negated())
        return joined("and", parts)

    def negated() -> tuple:
        if peek() == "not":
            take()
            return ("not", negated())
        return close()

    def close() -> tuple:
        items, gaps = [item()], []
        while peek() == "gap":
            gaps.append(take())
            items.append(item())
        if not gaps:
            return items[0]
        node = ("near", items, gaps)
        expanded(node)
        return scoped(node)

    def scoped(node: tuple) -> tuple:
        if peek() != "scope":
            return node
        fields = take()
        lead = fields[-1] == "_L"
        fields = fields[:-1] if lead else fields
        if not fields:
            raise QuerySyntaxError("no field behind @")
        return ("scope", node, fields, lead)

    def item() -> tuple:
        kind = peek()
        if kind == "(":
            take()
            inner = either()
            if peek() != ")":
                raise QuerySyntaxError("missing )")
            take()
            return scoped(inner)
        if kind == "is":
            return ("is", *take())
        if kind == "term":
            words = [take()]
            while peek() == "term":
                words.append(take())
            return scoped(("term", " ".join(words)))
        raise QuerySyntaxError(f"unexpected {kind or 'end'}")

    tree = either()
    if pos < len(tokens):
        raise QuerySyntaxError(f"unexpected {tokens[pos][0]}")
    return tree


def alternatives(node: tuple) -> list[str]:
    if node[0] == "term":
        return [node[1]]
    if node[0] == "or" and all(n[0] == "term" for n in node[1:]):
        return [n[1] for n in node[1:]]
    raise QuerySyntaxError("only words joined by or stand beside [n,m]")


def expanded(node: tuple) -> int:
    """How many proximity pairs a near node stands for; too many are an error, as are alternatives in a chain."""
    groups = [alternatives(i) for i in node[1]]
    n = reduce(lambda a, g: a * len(g), groups, 1)
    if n > MOST_NEAR:
        raise QuerySyntaxError(f"{n} proximity pairs are more than {MOST_NEAR}")
    if n > 1 and len(node[2]) > 1:
        raise QuerySyntaxError("alternatives take one [n,m] only")
    return n


def token_text(field: Column) -> Column:
    """`` a b c `` of a field's tokens; a space for none."""
    low = F.lower(F.translate(F.coalesce(field.cast("string"), F.lit("")), _FULL, _HALF))
    return F.concat(F.lit(" "), F.array_join(F.transform(F.regexp_extract_all(low, F.lit(_PARTS), F.lit(0)), lambda t: F.concat(t, F.lit(" "))), ""))


def _token_pattern(term: str) -> str:
    """A term's tokens as a pattern over token_text; ``*`` is any run of characters, ``?`` one, within a token."""
    low, parts = term.translate(str.maketrans(_FULL, _HALF)).lower(), []
    for w in re.findall(r"[㐀-鿿豈-﫿぀-ヿ]|[^\W_㐀-鿿豈-﫿぀-ヿ%*?]*[%*?\w][^\W_㐀-鿿豈-﫿぀-ヿ]*(?:[%*?]+[^\W_㐀-鿿豈-﫿぀-ヿ]*)*", low):
        parts.append("".join({"*": r"[^ ]*", "?": r"[^ ]"}.get(c, re.escape(c)) for c in w if c != "_"))
    if not parts:
        raise QuerySyntaxError(f"no word in {term!r}")
    return " ".join(parts)


def has_term(tokens: Column, term: str, lead: bool = False) -> Column:
    pattern = _token_pattern(term)
    plain = re.sub(r"\\(.)", r"\1", pattern)
    if "[^ ]" in pattern:
        return tokens.rlike(f"{'^' if lead else ''} {pattern}{'' if lead else ' '}")
    # the beginning of a name may end within a word
    return F.startswith(tokens, F.lit(f" {plain}")) if lead else F.contains(tokens, F.lit(f" {plain} "))


def near(tokens: Column, groups: list[list[str]], gaps: list[tuple[int, int]]) -> Column:
    """Whether terms of the groups stand as far from each other as the gaps say, one after another: a gap runs from the last token of
    the one to the first of the next.

    Places are looked up once per word and reached through hashed sets, so the work is a text's words times the width of a gap.
    """
    inside = [[_token_pattern(t).split(r" ") if "[^ ]" not in _token_pattern(t) else [_token_pattern(t)] for t in g] for g in groups]

    def starts(words: Column, parts: list[str]) -> Column:
        """Places where a term's tokens follow each other."""
        fits = lambda w, i: reduce(lambda a, b: a & b, [w.rlike(f"^{parts[0]}$"), *[F.coalesce(F.get(words, i + k).rlike(f"^{p}$"), F.lit(False)) for k, p in enumerate(parts[1:], 1)]])
        return F.filter(F.transform(words, lambda w, i: F.when(fits(w, i), i)), lambda i: i.isNotNull())

    def ends(at: Column, parts: list[str]) -> Column:
        return F.transform(at, lambda i: i + (len(parts) - 1))

    def reach(words: Column) -> Column:
        here = F.flatten(F.array(*[ends(starts(words, g), g) for g in inside[0]]))
        for (low, high), group in zip(gaps, inside[1:], strict=True):
            steps = F.array(*[F.lit(k) for k in range(low, high + 1)])
            there = F.array_distinct(F.flatten(F.transform(here, lambda i: F.transform(steps, lambda k: i + k))))  # noqa: B023
            here = F.flatten(F.array(*[ends(F.array_intersect(there, starts(words, g)), g) for g in group]))
        return F.size(here) > 0

    return F.transform(F.array(F.split(F.trim(tokens), " ")), reach)[0]


def _range(field: Column, value: str) -> Column:
    if not re.fullmatch(r"\d{0,8}(?::\d{0,8})?", value) or not value.strip(":"):
        raise QuerySyntaxError(f"not a range of days: {value!r}")
    low, high = value.split(":") if ":" in value else (value, value)
    tests = [field >= low] * bool(low) + [field <= high.ljust(8, "9")] * bool(high)
    return reduce(lambda a, b: a & b, tests)


def compile(query: str, fields: dict[str, Column], default: list[str], dates: tuple[str, ...] = ("ID",)) -> Column:
    """Whether a row matches; fields: code -> column, default: where unscoped words are looked for, dates: days as YYYYMMDD text."""

    def of(code: str) -> Column:
        if code not in fields:
            raise QuerySyntaxError(f"no field {code}")
        return fields[code]

    def column(node: tuple, where: list[str], lead: bool) -> Column:
        kind, *rest = node
        if kind == "scope":
            return column(rest[0], rest[1], rest[2])
        if kind == "is":
            code, value = rest
            if code in dates:
                return _range(of(code), value)
            return F.startswith(of(code), F.lit(value[:-1])) if value.endswith("*") else of(code) == value
        if kind == "not":
            return ~column(rest[0], where, lead)
        if kind == "near":
            groups = [alternatives(i) for i in rest[0]]
            return reduce(lambda a, b: a | b, [near(token_text(of(f)), groups, rest[1]) for f in where])
        if kind == "term":
            return reduce(lambda a, b: a | b, [has_term(token_text(of(f)), rest[0], lead) for f in where])
        parts = [column(n, where, lead) for n in rest]
        return reduce((lambda a, b: a & b) if kind == "and" else (lambda a, b: a | b), parts)

    return F.coalesce(column(parse(query), default, False), F.lit(False))


def conditions(rows: list[tuple[str, str, str]], fields: dict[str, Column], dates: tuple[str, ...] = ("ID",)) -> Column:
    """Conditions (AND, OR or NOT; field; value) folded from left to right; the first one's operator doesn't count.

    A value is words, joined by and, or and not, in its field; numbers of the fields PN and AN are whole values joined by or, days are ranges.
    """

    def one(code: str, value: str) -> Column:
        if code in ("PN", "AN"):
            return fields[code].isin([v.strip() for v in re.split(r"(?i)\s+or\s+", value.strip(" ()"))])
        return _range(fields[code], value) if code in dates else compile(f"({value})@{code}", fields, [code], dates)

    out = None
    for op, code, value in rows:
        test = F.coalesce(one(code, value), F.lit(False))
        out = test if out is None else out & test if op == "AND" else out | test if op == "OR" else out & ~test
    return out
