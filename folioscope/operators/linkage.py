"""Representatives, first-wins dedup, key ladders, family coverage and dual-key reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representatives(df: DataFrame, group: str, score: str, order: list[Column], key: str) -> DataFrame:
    """One row per group: the best row by score, then ``order``.  A max of structs combines on the map side: no sort of groups."""
    rank = F.struct((-F.col(score)).alias("s"), *[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(key).alias("k"))
    got = df.groupBy(group).agg(F.min(rank).alias("best"), F.count(F.lit(1)).alias("group_size"))
    return got.select(group, F.col("best.k").alias(f"rep_{key}"), (-F.col("best.s")).alias("rep_score"), "group_size", (F.col("group_size") - 1).alias("collapsed"))


def summary(reps: DataFrame, group: str) -> DataFrame:
    family = F.col(group).startswith("FAM:")
    return reps.agg(
        F.count(F.lit(1)).alias("total_groups"),
        F.count_if(family).alias("family_groups"),
        F.count_if(~family).alias("single_groups"),
        F.count_if(F.col("group_size") > 1).alias("multi_member"),
        F.coalesce(F.sum("collapsed"), F.lit(0)).alias("collapsed"),
        F.count(F.lit(1)).alias("representatives"),
    )


def first_wins(df: DataFrame, family: Column, pos: str) -> DataFrame:
    """The first row of each family by ``pos`` with the number of rows behind it; rows without a family pass through."""
    some = df.withColumn("family", family)
    heads = some.where("family is not null").groupBy("family").agg(F.min(pos).alias(pos), (F.count(F.lit(1)) - 1).alias("members"))
    alone = some.where("family is null").select("family", pos, F.lit(0).cast("long").alias("members"))
    return heads.unionByName(alone)


def key_ladder(levels: list[DataFrame], key: str, value: str) -> DataFrame:
    """key, value, level of the first level that has a substantive (not blank) value for the key."""
    every = reduce(DataFrame.unionByName, [d.where(F.length(F.trim(value)) > 0).select(key, value, F.lit(i).alias("level")) for i, d in enumerate(levels)])
    return every.groupBy(key).agg(F.min(F.struct("level", value)).alias("x")).select(key, f"x.{value}", "x.level")


def coverage(targets: DataFrame, members: DataFrame, key: str, family: str) -> DataFrame:
    """Per family how many targets one lookup of a member fills: all of them, at the cost of one call."""
    return targets.join(members, key).groupBy(family).agg(F.min(key).alias("queried"), F.count(F.lit(1)).alias("filled"), (F.count(F.lit(1)) - 1).alias("family_covered"))


def with_variants(df: DataFrame, key: str) -> DataFrame:
    """Each row under its key as it is and under the key without trailing letters."""
    bare = F.regexp_replace(key, "[A-Z]+[0-9]?$", "")
    return df.withColumn("variant", F.explode(F.array_distinct(F.array(F.col(key), bare))))


def islands(df: DataFrame, by: list[str], order: list[str], label: str) -> DataFrame:
    """Runs of equal labels: by, label, island number, first row, length."""
    w = Window.partitionBy(*by).orderBy(*order)
    change = (~F.col(label).eqNullSafe(F.lag(label).over(w))).cast("int")
    change = F.when(F.row_number().over(w) == 1, 1).otherwise(change)
    numbered = df.withColumn("_c", change).withColumn("island", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "island", label).agg(F.min(F.struct(*order)).alias("first"), F.count(F.lit(1)).alias("run"))


def evict(df: DataFrame, by: str, used: list[str], size: str, cap: int) -> DataFrame:
    """The rows that go when, newest use first, the sizes of a group exceed ``cap``."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in used]).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_held", F.sum(size).over(w)).where(F.col("_held") > cap).drop("_held")
