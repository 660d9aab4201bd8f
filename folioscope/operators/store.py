"""Record store: progressive-merge upsert, completeness, pool membership and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c.cast("string")) == "")


def upsert(old: DataFrame, new: DataFrame, key: str, fields: list[str], overwrite: bool = False) -> DataFrame:
    """Merged rows with ``action`` and the number of merged fields.

    An existing value that is not blank wins unless ``overwrite``; a blank one never writes.  Keys are unique in both.
    """
    o, n = old.select(key, *fields).alias("o"), new.select(key, *fields).alias("n")
    has_old, cols, changes = F.col(f"o.{key}").isNotNull(), [], []
    for f in fields:
        a, b = F.col(f"o.{f}"), F.col(f"n.{f}")
        take = ~blank(b) & (F.lit(overwrite) | blank(a))
        cols.append(F.when(take, b).otherwise(a).alias(f))
        changes.append((take & ~a.eqNullSafe(b)).cast("int"))
    merged = sum(changes[1:], changes[0])
    action = F.when(~has_old, "created").when(merged > 0, "updated").otherwise("unchanged")
    return o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full").select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *cols, action.alias("action"), merged.alias("merged_fields"))


def completeness(df: DataFrame, key: str, fields: dict[str, Column]) -> DataFrame:
    """has_<field> for each field; empty lists and objects in JSON text count as empty."""
    return df.select(key, *[(~blank(c) & ~F.trim(c.cast("string")).isin("[]", "{}")).alias(f"has_{f}") for f, c in fields.items()])


def pool_hits(pool: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return pool.join(store, key)


def pool_misses(pool: DataFrame, store: DataFrame, key: str) -> DataFrame:
    return pool.join(store, key, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key and state (added, removed, changed) of the rows that differ."""
    b, a = before.alias("b"), after.alias("a")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f"b.{f}").eqNullSafe(F.col(f"a.{f}"))
    state = F.when(F.col(f"b.{key}").isNull(), "added").when(F.col(f"a.{key}").isNull(), "removed").when(~same, "changed")
    return b.join(a, F.col(f"b.{key}") == F.col(f"a.{key}"), "full").select(F.coalesce(f"b.{key}", f"a.{key}").alias(key), state.alias("state")).where("state is not null")
