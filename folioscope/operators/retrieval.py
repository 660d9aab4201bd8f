"""Lexical and vector ranking, and their fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B, RRF = 1.5, 0.75, 60


def knn(vectors: DataFrame, query: list[float], n: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The n nearest vectors by squared L2 distance; a top-k without a full sort."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dist = F.aggregate(F.zip_with(F.col(vector).cast("array<double>"), q, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return vectors.select(key, F.round(dist, 6).alias("dist")).orderBy("dist", key).limit(n)


def _is(term: str):
    return lambda w: w == term


def bm25(docs: DataFrame, terms: list[str], n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n best documents by BM25 over lower-cased white-space words; statistics cover all documents."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+")
    counted = lambda w: F.struct(F.size(w).alias("len"), *[F.size(F.filter(w, _is(t))).alias(f"tf{i}") for i, t in enumerate(terms)])
    base = docs.select(key, F.inline(F.transform(F.array(words), counted)))  # the words are split once
    stats = base.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"), *[F.count_if(F.col(f"tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log(1 + (F.col("n_docs") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + idf * F.col(f"tf{i}") * (K1 + 1) / (F.col(f"tf{i}") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    out = base.where(reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))]))
    # statistics are one row
    return out.join(F.broadcast(stats)).select(key, F.round(score, 6).alias("score")).orderBy(F.desc("score"), key).limit(n)


def fuse(ranked: list[DataFrame], key: str, n: int) -> DataFrame:
    """Reciprocal-rank fusion of short lists with a column rank."""
    every = reduce(DataFrame.unionByName, [r.select(key, "rank") for r in ranked])
    return every.groupBy(key).agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 9).alias("score")).orderBy(F.desc("score"), key).limit(n)


def ranks(top: DataFrame, *order) -> DataFrame:
    """rank of the rows of a list that a limit has bounded."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def cosine(vectors: DataFrame, query: list[float], n: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The n vectors with the largest cosine to the query; a vector of length 0 has 0."""
    q, v = F.array(*[F.lit(float(x)) for x in query]), F.col(vector).cast("array<double>")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    sim = F.coalesce(F.try_divide(dot(v, q), F.sqrt(dot(v, v)) * F.sqrt(dot(q, q))), F.lit(0.0))
    return vectors.select(key, F.round(sim, 6).alias("sim")).orderBy(F.desc("sim"), key).limit(n)


def chunks(docs: DataFrame, key: str, text: str, width: int = 500, step: int = 400, least: int = 50) -> DataFrame:
    """key, pos, chunk: windows of ``width`` characters at every ``step``; those under ``least`` trimmed characters go."""
    at = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(step))
    cut = docs.where(F.col(text).isNotNull()).select(key, text, F.explode(at).alias("pos"))
    return cut.select(key, "pos", F.substr(text, F.col("pos") + 1, F.lit(width)).alias("chunk")).where(F.length(F.trim("chunk")) >= least)


def contains_any(df: DataFrame, needle: str, fields: list[str]) -> DataFrame:
    """Rows of which a field contains the needle, whatever the case; ``%`` and ``_`` are plain characters."""
    return df.where(reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(f), F.lit(needle.lower())), F.lit(False)) for f in fields]))
