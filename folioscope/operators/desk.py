"""Smaller operators of a search desk: chunks with labels and references, reranking, rotation, heads of families, matrices, point reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.patent_text import claim1_empty
from folioscope.operators.retrieval import chunks
from folioscope.plans.boolean_query import parse

# References that a chunk of law can hold, and the two flags made of them.
REFERENCES = {
    "has_mpep_ref": r"MPEP\s*Section ?\s*\d+",
    "has_usc_ref": r"35 U\.?S\.?C\.?\s*Section ?\s*\d+",
    "has_cfr_ref": r"37 C\.?F\.?R\.?\s*Section ?\s*\d+",
    "has_epc_ref": r"Art(?:icle)?\.?\s*\d+\s*(?:\(\d+\))?\s*(?:EPC)?",
    "has_pct_ref": r"(?:PCT\s+)?Rule\s+\d+",
    "has_epo_guideline_ref": r"(?:Part\s+[A-H]|Guidelines?\s+[A-H])",
}
COMBINED = {"has_statute": ("has_usc_ref", "has_epc_ref"), "has_rule_ref": ("has_cfr_ref", "has_pct_ref")}
# Codes of databases and regions by jurisdiction, and the first year of electronic records.
REGIONS = {"US": "US", "USA": "US", "USB": "US", "CN": "CN", "CNA": "CN", "CNB": "CN", "TW": "TW", "TWA": "TW", "TWB": "TW"}
FIRST_YEAR = 1976
# The header of a claims section, and a claim's number.
CLAIMS_HEADER = r"(?is)(?:^|\n)\s*(?:CLAIMS?|WHAT\s+IS\s+CLAIMED\s+IS)\s*:?\s*\n(.+)"
CLAIM_NUMBER = r"(?:^|\n)\s*(\d+)\.\s+"
# Fixed value: a claim that refers to a part of itself.
INTERNAL = r"(?i)as defined in (?:subsection|section|paragraph|limitation)\s+\(([a-z])\)(?:\(([ivx]+)\))?"


def labelled_chunks(docs: DataFrame, key: str, text: str, label: str, **sizes) -> DataFrame:
    """key, pos, text and flags of the chunks of texts: the label stands before each, references are looked for in the chunk alone."""
    cut = chunks(docs, key, text, **sizes).join(docs.select(key, F.col(label).alias("_label")), key)
    flags = {name: F.col("chunk").rlike(p) for name, p in REFERENCES.items()}
    return cut.select(key, "pos", F.concat(F.lit("["), "_label", F.lit("] "), "chunk").alias("text"), *[c.alias(n) for n, c in flags.items()], *[(flags[a] | flags[b]).alias(n) for n, (a, b) in COMBINED.items()])


def closeness(distance: Column) -> Column:
    """A distance as a score: 1 at none, towards 0."""
    return 1 / (1 + distance)


def rerank(candidates: DataFrame, key: str, score: str, text: str, query: str, retrieve: int, top: int) -> DataFrame:
    """key, rerank, score: the ``top`` of the ``retrieve`` best candidates in the order of a second scorer.

    The scorer is lexical: the share of the query's words that a text has, and a little for words in the query's order.
    """
    words = list(dict.fromkeys(query.lower().split()))
    first = candidates.orderBy(F.desc(score), key).limit(retrieve)
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    wanted = F.array(*map(F.lit, words)) if words else F.array().cast("array<string>")
    pairs = F.array(*[F.lit(f" {a} {b} ") for a, b in zip(words, words[1:], strict=False)]) if len(words) > 1 else F.array().cast("array<string>")

    def scored(t: Column) -> Column:
        line = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
        return F.size(F.array_intersect(wanted, t)) / max(len(words), 1) + 0.1 * F.size(F.filter(pairs, lambda p: F.contains(line, p)))

    return first.withColumn("rerank", F.round(F.transform(F.array(tokens), scored)[0], 9)).select(key, "rerank", score).orderBy(F.desc("rerank"), F.desc(score), key).limit(top)


def newest_with(df: DataFrame, needle: str, fields: list[str], updated: str, key: str, n: int) -> DataFrame:
    """The n newest rows of which a field contains a short needle; only A to Z are the same in both cases, ``%`` and ``_`` are plain."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    low = lambda c: F.translate(F.coalesce(c, F.lit("")), upper, lower)
    plain = needle.translate(str.maketrans(upper, lower))
    found = reduce(lambda a, b: a | b, [F.contains(low(F.col(f)), F.lit(plain)) for f in fields])
    return df.where(found).orderBy(F.desc(updated), key).limit(n)


def rotate(attempts: DataFrame, request: str, order: str, outcome: str, spent: str = "over_quantity") -> DataFrame:
    """request, the attempt that counts and its outcome: the first account that isn't spent; without a record is an answer, no reason to go on.

    If all accounts are spent, the last attempt counts.
    """
    best = F.min(F.when(~F.col(outcome).eqNullSafe(spent), F.struct(order, outcome)))
    last = F.max(F.struct(order, outcome))
    return attempts.groupBy(request).agg(F.coalesce(best, last).alias("x"), F.count_if(F.col(outcome).eqNullSafe(spent)).alias("spent")).select(request, f"x.{order}", f"x.{outcome}", "spent")


def heads(df: DataFrame, family: Column, key: str, order: str, most: int = 1000) -> DataFrame:
    """The first record of each family with n (its size) and members: the keys of the others in order, the ``most`` first of them.

    Records without a family are heads of their own.  The list is a report for one cell; ``members`` of the pool operators has all as rows.
    """
    named = df.withColumn("_family", F.coalesce(family.cast("string"), F.concat(F.lit("\0"), F.col(key).cast("string"))))
    w = Window.partitionBy("_family").orderBy(order, key)
    # a bound on the rank keeps each partition's first ones before a family meets
    few = named.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most + 1)
    listed = few.groupBy("_family").agg(F.array_sort(F.collect_list(F.struct("_n", F.col(key).alias("k")))).alias("l"))
    sizes = named.groupBy("_family").agg(F.count(F.lit(1)).alias("n"))
    out = few.where("_n = 1").join(listed, "_family").join(sizes, "_family")
    return out.withColumn("members", F.transform(F.slice("l", 2, most), lambda x: x["k"])).drop("_family", "_n", "l")


def family_cell(family: Column, n: Column) -> Column:
    """``F (+n)`` of a head with n other members; the family alone without any."""
    return F.when(n > 1, F.concat(family, F.lit(" (+"), (n - 1).cast("string"), F.lit(")"))).otherwise(F.coalesce(family, F.lit("")))


def matrix(rows: DataFrame, first: str, second: str, key: str, axes: tuple[list[str], list[str]], hot: int) -> DataFrame:
    """first, second, n, representative (smallest key), state of every cell of two axes: hot from ``hot`` rows on, empty without any.

    first and second are lists of labels; the grid is the product of the axes' given labels, not of rows.
    """
    cells = rows.select(key, F.explode(F.array_distinct(first)).alias("a"), F.col(second).alias("_b")).select(key, "a", F.explode(F.array_distinct("_b")).alias("b"))
    count = cells.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("representative"))
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, axes[0]))).alias("a")).select("a", F.explode(F.array(*map(F.lit, axes[1]))).alias("b"))
    out = grid.join(count, ["a", "b"], "left").na.fill(0, ["n"])
    return out.select(F.col("a").alias(first), F.col("b").alias(second), "n", "representative", F.when(F.col("n") >= hot, "hot").when(F.col("n") == 0, "empty").otherwise("some").alias("state"))


def point_read(store: DataFrame, key: str, wanted: list[str]) -> DataFrame:
    """The records of some keys; the test reaches the scan."""
    return store.where(F.col(key).isin(wanted))


def flattened(df: DataFrame, key: str, items: Column) -> DataFrame:
    """key, num (from 1), text of a list's items."""
    return df.select(key, F.posexplode(items).alias("at", "text")).select(key, (F.col("at") + 1).alias("num"), "text")


def ordered_distinct(df: DataFrame, key: str, order: str) -> DataFrame:
    """Each key once, with the place where it came first."""
    return df.groupBy(key).agg(F.min(order).alias("first"))


def section(pieces: DataFrame, label: str, wanted: str, order: str, most: int) -> DataFrame:
    """The first pieces whose label has the wanted section in it."""
    return pieces.where(F.contains(label, F.lit(wanted))).orderBy(order).limit(most)


def claim1_audit(records: DataFrame, by: str, key: str, claim: str) -> tuple[DataFrame, DataFrame]:
    """(by, n, empty; by, key): how many records have no claim 1, or a header in its place, and which."""
    marked = records.select(by, key, claim1_empty(F.col(claim)).alias("empty"))
    return marked.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.count_if("empty").alias("empty")), marked.where("empty").select(by, key)


def as_json(df: DataFrame, columns: list[str]) -> DataFrame:
    """Lists, structs and maps of some columns as JSON text, other values as they are; null stays null."""
    nested = {f.name: f.dataType.typeName() in ("array", "struct", "map") for f in df.schema.fields}
    return df.withColumns({c: F.to_json(c) if nested[c] else F.col(c).cast("string") for c in columns})


def from_json_text(column: Column, schema: str) -> Column:
    """A JSON cell as the type asked for; what can't be read, or is blank, is null."""
    return F.try_variant_get(F.try_parse_json(F.nullif(F.trim(column), F.lit(""))), "$", schema)


def jurisdiction(code: Column) -> Column:
    """CN, TW or US of a database or region code; null for others."""
    name = F.upper(F.trim(code))
    table = F.create_map(*[F.lit(x) for pair in REGIONS.items() for x in pair])
    two = F.substring(name, 1, 2)
    return F.coalesce(F.try_element_at(table, name), F.when(two.isin("CN", "TW", "US"), two))


def databases(country: Column) -> Column:
    """The two databases, of publications and of grants, that a country's records are in."""
    name = F.upper(F.trim(country))
    return F.when(name.isin("CN", "TW", "US", "JP", "KR", "EP"), F.array(F.concat(name, F.lit("A")), F.concat(name, F.lit("B")))).otherwise(F.array().cast("array<string>"))


def claims_format(text: Column) -> Column:
    """(numbers, none, not_consecutive) of an application's claims: what stands behind the claims header, else the whole text."""
    section = F.coalesce(F.nullif(F.regexp_extract(text, CLAIMS_HEADER, 1), F.lit("")), text)
    numbers = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(section, F.lit(CLAIM_NUMBER), F.lit(1)), lambda x: x.cast("int"))))
    # an empty sequence would count down
    right = F.when(F.size(numbers) > 0, F.sequence(F.lit(1), F.size(numbers)))
    return F.struct(numbers.alias("numbers"), (F.size(numbers) == 0).alias("none"), F.coalesce(numbers != right, F.lit(False)).alias("not_consecutive"))


def internal_references(body: Column) -> Column:
    """The references of a claim to its own parts, as written."""
    return F.regexp_extract_all(body, F.lit(INTERNAL), F.lit(0))


def simple_search(df: DataFrame, text: str, words: str, day: str, this_year: int, start: int | None = None, end: int | None = None, recent: tuple[str, int] | None = None, **equal: str) -> DataFrame:
    """Rows with all words in a text, of the years asked for (from FIRST_YEAR, or to this year, where only the other end is given), or of the
    ``recent`` (day, number) days up to a day, whose other columns equal what is asked."""
    tests = [F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lit(w.lower())) for w in words.split()]
    if start or end:
        tests += [F.year(day) >= (start or FIRST_YEAR), F.year(day) <= (end or this_year)]
    if recent:
        last = F.to_date(F.lit(recent[0]))
        tests += [F.col(day).cast("date") > F.date_sub(last, recent[1]), F.col(day).cast("date") <= last]
    tests += [F.col(c) == v for c, v in equal.items()]
    return df.where(reduce(lambda a, b: a & b, tests, F.lit(True)))


def query_groups(text: str) -> dict[str, list[list[str]]]:
    """A boolean query's groups of alternatives: those a record needs one of each, and those it may have none of; phrases keep their quotes."""

    def terms(node: tuple) -> list[str]:
        if node[0] == "term":
            return [f'"{node[1]}"' if " " in node[1] else node[1]]
        return [t for n in node[1:] for t in terms(n)]

    out: dict[str, list[list[str]]] = {"positive": [], "not": []}

    def collect(node: tuple, side: str) -> None:
        if node[0] == "and":
            for n in node[1:]:
                collect(n, side)
        elif node[0] == "not":
            collect(node[1], "not" if side == "positive" else "positive")
        else:
            out[side].append(terms(node))

    collect(parse(text), "positive")
    return out
