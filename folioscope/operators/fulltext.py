"""Full text over a store: substring phrases ranked by BM25, the ladder of ways to ask a store, weighted fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B, RRF = 1.2, 0.75, 60
OKAPI_K1, OKAPI_EPSILON = 1.5, 0.25


def _text(fields: list[str]) -> Column:
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]))


def _is(term: str):
    return lambda w: w == term


def search(store: DataFrame, fields: list[str], terms: list[str], keep: list[str], n: int | None = None, order: list[Column] | None = None) -> DataFrame:
    """Rows that hold every term (of three characters or more) as a substring, whatever its case, with their rank, best first.

    rank: negative BM25 over trigrams: a term is a phrase of them, a row as long as its fields have trigrams, an idf
    never under 10^-6.  Statistics are one row; rows are scored in one pass and only the n best are sorted out.
    """
    low, hit = _text(fields), []
    for i, t in enumerate(terms):
        t = t.lower()
        hit.append(((F.length(low) - F.length(F.replace(low, F.lit(t), F.lit("")))) / len(t)).cast("long").alias(f"_tf{i}"))
    size = reduce(lambda a, b: a + b, [F.greatest(F.length(F.coalesce(F.col(f).cast("string"), F.lit(""))) - 2, F.lit(0)) for f in fields])
    base = store.select(*keep, size.alias("_len"), *hit)
    stats = base.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"), *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5)), F.lit(1e-6))
        score = score + idf * F.col(f"_tf{i}") * (K1 + 1) / (F.col(f"_tf{i}") + K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    for i in range(len(terms)):
        base = base.where(F.col(f"_tf{i}") > 0)
    out = base.join(F.broadcast(stats)).select(*keep, (-score).alias("rank"))
    return out if n is None else out.orderBy("rank", *(order or keep[:1])).limit(n)


def store_query(store: DataFrame, key: str, fields: list[str], keep: list[str], updated: str, country: str, number: str | None = None, text: str | None = None, place: str | None = None, n: int = 20) -> tuple[DataFrame, int | None]:
    """(rows, total): by exact number, else full text by rank, else a country's newest rows, else the newest of all.

    The total is counted only where nothing narrows the rows.
    """
    newest = [F.desc(updated), F.col(key)]
    if number:
        return store.where(F.col(key) == number).select(*keep).limit(n), None
    if text:
        return search(store, fields, text.split(), keep, n), None
    if place:
        return store.where(F.col(country) == place).orderBy(*newest).select(*keep).limit(n), None
    return store.orderBy(*newest).select(*keep).limit(n), store.count()


def planned(objects: DataFrame, fields: list[str], keep: list[str], plan: dict, kind: Column | None = None, n: int = 20, updated: str = "updated_at") -> DataFrame:
    """Objects for a match plan: long words by full text, short ones by scanning; scanned rows alone come newest first."""
    rows = objects if kind is None else objects.where(kind)
    for w in plan["short"]:
        rows = rows.where(F.contains(_text(fields), F.lit(w.lower())))
    if plan["terms"]:
        return search(rows, fields, plan["terms"], keep, n)
    return rows.orderBy(F.desc(updated), keep[0]).select(*keep, F.lit(0.0).alias("rank")).limit(n)


def graded(objects: DataFrame, edges: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """Objects with the largest source_weight of their edges of some kinds; null where no edge is graded."""
    weight = F.get_json_object("metadata_json", "$.source_weight").cast("double")
    best = edges.where(F.col("edge_type").isin(kinds)).groupBy(F.col("source_id").alias(key)).agg(F.max(weight).alias("source_weight"))
    return objects.join(best, key, "left")


def okapi(docs: DataFrame, terms: list[str], n: int | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The n best documents, or all in no order, those without a score included: BM25Okapi over lower-cased white-space words.

    Its idf is log((N - df + 0.5) / (df + 0.5)); where that is negative it is a quarter of the mean idf of all words.  The
    mean comes from one count of words by document, which combines on the map side.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    tf = F.map_from_entries(F.array(*[F.struct(F.lit(t), F.size(F.filter("_w", _is(t)))) for t in terms]))
    base = docs.select(key, words.alias("_w")).select(key, F.size("_w").alias("_len"), tf.alias("_tf"), F.array_distinct("_w").alias("_set"))
    df = base.select(F.explode("_set").alias("_t")).groupBy("_t").agg(F.count(F.lit(1)).alias("_df"))
    total = base.agg(F.count(F.lit(1)).alias("_n"), F.avg("_len").alias("_avg"))
    idf = F.log(F.col("_n") - F.col("_df") + 0.5) - F.log(F.col("_df") + 0.5)
    of = [F.max(F.when(F.col("_t") == t, idf)).alias(f"_i{i}") for i, t in enumerate(terms)]
    stats = df.join(F.broadcast(total)).agg(F.max("_n").alias("_n"), F.max("_avg").alias("_avg"), F.avg(idf).alias("_mean"), *of)
    score, out = F.lit(0.0), base.join(F.broadcast(stats))
    for i, t in enumerate(terms):
        f, w = F.col("_tf")[t], F.coalesce(F.when(F.col(f"_i{i}") < 0, OKAPI_EPSILON * F.col("_mean")).otherwise(F.col(f"_i{i}")), F.lit(0.0))
        score = score + w * f * (OKAPI_K1 + 1) / (f + OKAPI_K1 * (1 - B + B * F.col("_len") / F.col("_avg")))
    out = out.select(key, F.round(score, 6).alias("score"))
    return out if n is None else out.orderBy(F.desc("score"), key).limit(n)


def fuse_weighted(lists: dict[str, tuple[DataFrame, float]], key: str, n: int, allowed: DataFrame | None = None) -> DataFrame:
    """Weighted reciprocal-rank fusion of short ranked lists: key, score, and each list's own score (0 where it lacks the key).

    allowed: keys that a metadata filter keeps, looked up after fusion, before the n best are taken.
    """
    every = reduce(DataFrame.unionByName, [d.select(key, "rank", F.lit(name).alias("_list"), F.lit(float(w)).alias("_w")) for name, (d, w) in lists.items()])
    part = F.col("_w") / (RRF + F.col("rank"))
    out = every.groupBy(key).agg(F.round(F.sum(part), 9).alias("score"), *[F.round(F.sum(F.when(F.col("_list") == name, part).otherwise(0.0)), 9).alias(f"{name}_score") for name in lists])
    if allowed is not None:
        out = out.join(allowed.select(key).distinct(), key, "left_semi")
    return out.orderBy(F.desc("score"), key).limit(n)


def accumulate(hits: DataFrame, key: str, score: str, subs: list[str]) -> DataFrame:
    """Candidates over several queries: scores add up, of sub-scores the largest counts."""
    return hits.groupBy(key).agg(F.round(F.sum(score), 9).alias(score), *[F.max(s).alias(s) for s in subs], F.count(F.lit(1)).alias("queries"))


def merge_hits(hits: DataFrame, number: str, link: str, title: str, order: list[str]) -> DataFrame:
    """The first hit of each patent: by number, else link, else the first 120 characters of the title."""
    name = F.coalesce(F.nullif(F.trim(F.col(number)), F.lit("")), F.nullif(F.trim(F.col(link)), F.lit("")), F.substring(title, 1, 120))
    rest = F.struct(*[F.col(f"`{c}`") for c in hits.columns])
    return hits.groupBy(name.alias("_key")).agg(F.min_by(rest, F.struct(*order)).alias("x")).select("x.*")


def fan_out(ranked: dict[str, DataFrame], key: str, n: int) -> DataFrame:
    """The n best of the lists of several sources, with the source they come from."""
    every = reduce(DataFrame.unionByName, [d.select(key, "score", F.lit(s).alias("source")) for s, d in ranked.items()])
    return every.orderBy(F.desc("score"), "source", key).limit(n)


def build_index(docs: DataFrame, key: str, text: str, path: str) -> None:
    """Writes the postings (word, key, tf, len) of white-space words, clustered by word, for score() to read."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != "")
    rows = docs.select(key, F.size(words).alias("len"), F.explode(words).alias("word"))
    postings = rows.groupBy("word", key, "len").agg(F.count(F.lit(1)).alias("tf"))
    postings.repartitionByRange("word").sortWithinPartitions("word").write.parquet(f"{path}/postings")
    docs.select(F.size(words).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg")).write.parquet(f"{path}/stats")


def score_index(spark, path: str, terms: list[str], key: str, n: int) -> DataFrame:
    """The n best documents of a written index; only row groups that can hold the terms are read."""
    hits = spark.read.parquet(f"{path}/postings").where(F.col("word").isin(terms))
    df = hits.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    all_ = hits.join(F.broadcast(df), "word").join(F.broadcast(spark.read.parquet(f"{path}/stats")))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (OKAPI_K1 + 1) / (F.col("tf") + OKAPI_K1 * (1 - B + B * F.col("len") / F.col("avg")))
    return all_.groupBy(key).agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.desc("score"), key).limit(n)
