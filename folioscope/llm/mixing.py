"""Mixing sources to target weights: Efraimidis-Spirakis order, prefix sums to budgets, DataFrame operations only.

Every document gets an exponential key -ln(u) / weight, u from a hash of its doc_id, weight its quality.  A
source's budget is met by whole epochs first; the rest is a prefix of the documents in key order, which is a
weighted sample without replacement.

Scale: texts are read once, to sizes.  The prefix sum has two levels: keys map to (source, range of keys), sums of
ranges are added up per source, and only the documents of one range are sorted in one task.  A hot source is thus
spread over ``4 * shuffle partitions`` ranges, and source totals combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.common import shuffle_width, written

WORD = r"[^\x20\x09-\x0D]+"
MAX_EPOCHS = 3
SEED = "mix-1"


def budgets(sizes: DataFrame, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0) -> DataFrame:
    """source, source_size, target for (source, size) rows: weights repeat over the sources by code point, null last.

    The total is share * all sizes.  A target stops at MAX_EPOCHS times its source's size; what is cut is dealt to
    the other sources by weight, until none is above.  In closed form: by rising cap / weight, sources are cut
    while cap / weight is below (total - caps so far) / (weights left).
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())  # as many rows as there are sources
    rank = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), rank + 1)).withColumn("at", F.row_number().over(order))
    per = per.withColumn("cap", F.lit(MAX_EPOCHS) * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("w"))
    rising = Window.orderBy("ratio", "at")
    total = F.sum("source_size").over(Window.partitionBy())
    before = F.sum("cap").over(rising.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("cap")
    left = F.sum("w").over(rising.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.lit(float(share)) * total - before) / left).withColumn("cut", F.col("ratio") < F.col("level"))
    level = F.min(F.when(~F.col("cut"), F.struct("ratio", "at", "level"))).over(Window.partitionBy())["level"]
    target = F.when(F.col("cut"), F.col("cap").cast("double")).otherwise(F.col("w") * level)
    return per.select("source", "source_size", F.round(target, 6).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", quality: DataFrame | None = None, weights: tuple[float, ...] = (1.0, 2.0, 3.0), share: float = 1.0, seed: str = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every row; taken / size is how often the mix takes the document.

    ``quality``: (doc_id, weight) rows, the largest weight of a doc_id counts, 1 where there is none.  The document
    on the border of the budget is taken if that brings the source nearer to its target.  Null or empty text: size
    0, taken 0.  A null source is a source of its own.  Rows that repeat a doc_id are documents of their own with
    one key, taken by size.  Empty table: empty result.
    """
    base = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)).cast("long"), F.lit(0).cast("long")).alias("size"))
    weight = F.lit(1.0)
    if quality is not None:
        best = quality.groupBy(F.col("doc_id").alias("q_id")).agg(F.max("weight").cast("double").alias("q"))
        base = base.join(best, base["doc_id"] == best["q_id"], "left")
        weight = F.coalesce(F.when(F.col("q") > 0, F.col("q")), F.lit(1.0))
    bits = F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double")
    base = base.select("doc_id", "source", "size", (-F.log((bits + 0.5) / F.lit(float(1 << 48))) / weight).alias("key"))
    base = written(base, "sizes")
    ranges = 4 * shuffle_width(docs.sparkSession)
    plan = budgets(base, weights, share)
    base = base.withColumn("range", F.floor((1 - F.exp(-F.col("key"))) * ranges).cast("int"))
    sums = base.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("before", F.sum("range_size").over(upto) - F.col("range_size"))
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    sums = sums.join(p, F.col("source").eqNullSafe(F.col("p_source"))).select(F.col("source").alias("s_source"), F.col("range").alias("s_range"), "before", "source_size", "target")
    rows = base.join(sums, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("range") == F.col("s_range")))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("upto", F.col("before") + F.sum("size").over(inside))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.col("target") - epochs * F.col("source_size")
    more = (2 * F.col("upto") - F.col("size") < 2 * rest).cast("long")
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.least(epochs + more, F.lit(MAX_EPOCHS).cast("long"))).alias("taken"))
