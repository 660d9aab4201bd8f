"""Rewrites of boolean queries and date ranges: CQL text, shards that fit a length, and slices that fit a count."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.boolean_query import parse

# Longest condition, deepest recursion, largest slice and number of probes.
MAX_CONDITION, MAX_DEPTH, MAX_SLICE, MAX_PROBES = 900, 6, 2000, 32


class Irreducible(ValueError):
    """No OR group is left to halve, or the depth is used up."""


def cql(query: str, field: str = "txt") -> str:
    """The query as CQL: every word or phrase under the field, the query's own parentheses kept; empty for an empty query."""
    def one(m: re.Match) -> str:
        word = m[0]
        if word.lower() in ("and", "or", "not"):
            return word.lower()
        if m[1] is not None:
            return f'{field}="{m[1].strip()}"' if m[1].strip() else ""
        return f"{field}={word}"

    text = re.sub(r'"([^"]*)"|[^\s()"]+', one, " ".join(query.split()))
    return re.sub(r"\(\s+", "(", re.sub(r"\s+\)", ")", text))


def cql_of(keyword: str = "", cpc: str = "", ipc: str = "", applicant: str = "", number: str = "", since: str = "", until: str = "") -> str:
    """All given conditions joined by and."""
    span = f'pd within "{since} {until}"' if since and until else f"pd >= {since}" if since else f"pd <= {until}" if until else ""
    name = f'pa="{applicant}"' if " " in applicant else f"pa={applicant}" if applicant else ""
    return " and ".join(filter(None, [cpc and f"cpc={cpc}", ipc and f"ic={ipc}", cql(keyword), name, number and f"pn={number}", span]))


def render(tree: tuple, inner: bool = False) -> str:
    """A parsed query as text that parses to the same tree."""
    kind, *rest = tree
    if kind == "term":
        return f'"{rest[0]}"' if " " in rest[0] else rest[0]
    if kind == "not":
        return "not " + render(rest[0], True)
    text = f" {kind} ".join(render(r, True) for r in rest)
    return f"({text})" if inner else text


def shards(query: str, fits: Callable[[str], bool] = lambda q: len(q) <= MAX_CONDITION) -> list[str]:
    """Queries that fit and whose union selects the same rows: the widest positive OR group is halved until all fit."""
    def halve(tree: tuple, depth: int) -> list[tuple]:
        if fits(render(tree)):
            return [tree]
        parts = list(tree[1:]) if tree[0] == "and" else [tree]
        wide = max(range(len(parts)), key=lambda i: len(parts[i]) if parts[i][0] == "or" else 0)
        terms = parts[wide][1:]
        if depth == MAX_DEPTH or parts[wide][0] != "or":
            raise Irreducible(render(tree))
        out = []
        for half in (terms[: len(terms) // 2], terms[len(terms) // 2 :]):
            new = half[0] if len(half) == 1 else ("or", *half)
            now = [*parts[:wide], new, *parts[wide + 1 :]]
            out += halve(now[0] if len(now) == 1 else ("and", *now), depth + 1)
        return out

    return [render(t) for t in halve(parse(query), 0)]


def union_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of shards; of the rows with one key the first shard's stays, rows with a blank key all stay. ``shard`` tells which."""
    every = reduce(DataFrame.unionByName, [p.withColumn("shard", F.lit(i)) for i, p in enumerate(parts)])
    blank = F.coalesce(F.trim(F.col(key).cast("string")), F.lit("")) == ""
    rest = [c for c in every.columns if c != key]
    best = every.where(~blank).groupBy(key).agg(F.min(F.struct("shard", *[c for c in rest if c != "shard"])).alias("x"))
    return best.select(key, *[f"x.{c}" for c in rest]).unionByName(every.where(blank).select(key, *rest))


def date_slices(df: DataFrame, day: str, limit: int = MAX_SLICE, depth: int = MAX_DEPTH, probes: int = MAX_PROBES) -> list[tuple[date, date, int, bool]]:
    """(first day, last day, rows, truncated) of slices that cover the whole range, halved while over ``limit`` rows.

    One job counts the days; a day is one row on the driver, so that grows with the calendar, not with the data.
    """
    counts = sorted((r[0], r[1]) for r in df.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date")).count().collect())
    days, total = [d for d, _ in counts], [0, *accumulate(n for _, n in counts)]
    used = 0

    def cut(a: date, b: date, level: int) -> list:
        nonlocal used
        used += 1
        n = total[bisect_right(days, b)] - total[bisect_left(days, a)]
        if n <= limit or a == b or level == depth or used + 2 > probes:
            return [(a, b, n, n > limit)]
        mid = a + (b - a) // 2
        return cut(a, mid, level + 1) + cut(mid + timedelta(days=1), b, level + 1)

    return cut(days[0], days[-1], 0) if days else []
