"""Exact dedup with skew-safe combining, DataFrame operations only.

1. Digests (SHA-256) of all texts are written once with their doc_id; counts per digest combine on the map side.
2. A digest is hot if it has more than rows / (4 * shuffle partitions) rows; there are at most 4 * partitions of
   those, which bounds what is broadcast.  Rows of hot digests get a salt.
3. Texts are grouped by (digest, salt, full text): equal texts combine locally before the shuffle, then per salt.
4. The salt winners of hot digests are combined globally, by (digest, full text).
5. Rows look up the winner by digest.  Only where one digest has several texts (a collision) by full text too.

So whole texts are shuffled once, after local combining, and the text is compared at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import shuffle_width, written


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row.

    The largest doc_id of equal texts stays.  Null text counts as empty.  A null doc_id never wins over a real one.
    Rows that repeat doc_id and text are one document: they count in group_size and share ``kept``.  An empty
    table gives an empty result.  Other columns don't take part.
    """
    spark = docs.sparkSession
    width = shuffle_width(spark)
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("digest", F.sha2("text", 256))
    rows = written(base.select("doc_id", "digest"), "digests")
    limit = rows.count() // (4 * width) + 1
    hot = written(rows.groupBy("digest").count().where(F.col("count") > limit).select("digest", F.lit(True).alias("hot")), "hot")  # at most 4 * width rows
    salted = base.join(F.broadcast(hot), "digest", "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.monotonically_increasing_id(), F.lit(width))))
    local = salted.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    local = written(local.select("digest", "keep_id", "group_size", F.when(F.col("salt").isNotNull(), F.col("text")).alias("hot_text"), F.col("salt").isNotNull().alias("hot")), "winners")
    whole = local.where("hot").groupBy("digest", "hot_text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    cold, warm = local.where("not hot").select("digest", "keep_id", "group_size"), whole.select("digest", "keep_id", "group_size")

    def single(winners: DataFrame) -> DataFrame:
        return winners.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("variants"))

    clash = written(single(cold.unionByName(warm)).where("variants > 1").select("digest"), "clash")
    flagged = rows.join(F.broadcast(hot), "digest", "left")
    found = [flagged.where("hot is null").join(single(cold), "digest"), flagged.where("hot").join(F.broadcast(single(warm)), "digest")]
    if not clash.isEmpty():  # texts that share a digest: the full text decides
        found = [x.join(F.broadcast(clash), "digest", "left_anti") for x in found]
        texts = base.join(F.broadcast(clash), "digest", "left_semi")
        winners = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        found.append(texts.join(winners, ["digest", "text"]))
    out = None
    for x in found:
        x = x.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))
        out = x if out is None else out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns. doc_id must be unique and not null here."""
    stay = exact_groups(docs, id_col, text_col).where("kept").select(F.col("doc_id").alias("_stay"))
    return docs.join(stay, docs[id_col] == F.col("_stay"), "left_semi")
