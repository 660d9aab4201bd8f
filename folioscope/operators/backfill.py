"""Filling a pool from sources in phases: each sees what the ones before left empty, checks whom a record is of, and stops at a fuse."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.audit import fuse
from folioscope.operators.pool import core
from folioscope.operators.store import blank
from folioscope.sources.tables import checkpointed

#: Characters from which on a text counts as filled, and equal failures in a row that stop a phase.
LEAST, LIMIT = 25, 8


@dataclass
class Phase:
    """A source: ``records`` have the key (unique), the fields they can fill, perhaps ``error`` and ``ids``.

    error: why the source failed for a key, null where it didn't; a key it hasn't is not found, which is no failure.
    ids: the numbers that the record itself shows; a record that shows some, and not the key's digits, is of another document.
    skip: keys that the source isn't asked for.
    """

    name: str
    records: DataFrame
    fields: list[str]
    error: str | None = None
    ids: str | None = None
    skip: Column | None = None


def filled(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) >= LEAST


def backfill(pool: DataFrame, by: str, order: str, key: str, fields: list[str], phases: list[Phase], limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(pool with its fields filled and <field>_source; a report: by, phase, asked, filled, missed, rejected, failed, skipped, cut, reason).

    A phase asks for the keys that still lack one of its fields, all in one join.  Within a batch (``by``) keys are asked in order;
    ``limit`` equal failures in a row, with no success between, stop the batch: nothing behind the cut is filled by this phase or a later one.
    A field that is filled is never written over; a value under LEAST characters doesn't fill.
    """
    state = pool.select(by, order, key, *fields, *[F.lit(None).cast("string").alias(f"{f}_source") for f in fields], F.lit(False).alias("_stopped"))
    reports = []
    for phase in phases:
        state = checkpointed(state)
        lacks = reduce(lambda a, b: a | b, [~filled(F.col(f)) for f in phase.fields])
        wanted = lacks & ~F.col("_stopped")
        skip = F.coalesce(phase.skip, F.lit(False)) if phase.skip is not None else F.lit(False)
        got = phase.records.select(F.col(key).alias("_key"), *[F.col(f).alias(f"_{f}") for f in phase.fields], (F.col(phase.error) if phase.error else F.lit(None).cast("string")).alias("_error"), (F.col(phase.ids) if phase.ids else F.array().cast("array<string>")).alias("_ids"))
        rows = state.withColumns({"_asked": wanted & ~skip, "_skipped": wanted & skip})
        rows = rows.join(got, (rows[key] == got["_key"]) & rows["_asked"], "left")
        other = F.coalesce((F.size("_ids") > 0) & ~F.exists("_ids", lambda x: core(x) == core(F.col(key))), F.lit(False))
        useful = reduce(lambda a, b: a | b, [~filled(F.col(f)) & filled(F.col(f"_{f}")) for f in phase.fields])
        outcome = F.when(~F.col("_asked"), None).when(F.col("_error").isNotNull(), "failed").when(F.col("_key").isNotNull() & other, "rejected").when(F.col("_key").isNotNull() & useful, "filled").otherwise("missed")
        rows = checkpointed(rows.withColumn("_outcome", outcome))
        # what was not found says nothing about the source's health
        tried = rows.where("_outcome in ('failed', 'filled')")
        cuts = fuse(tried, by, [order], F.when(F.col("_outcome") == "failed", F.col("_error")), limit).select(by, F.col(f"cut.{order}").alias("_cut"), F.col("reason").alias("_reason"))
        rows = rows.join(cuts, by, "left").withColumn("_done", F.col("_asked") & (F.col("_cut").isNull() | (F.col(order) <= F.col("_cut"))))
        took = F.col("_done") & (F.col("_outcome") == "filled")
        cols = {f: F.when(took & ~filled(F.col(f)) & filled(F.col(f"_{f}")), F.trim(F.col(f"_{f}"))).otherwise(F.col(f)) for f in phase.fields}
        sources = {f"{f}_source": F.when(took & ~filled(F.col(f)) & filled(F.col(f"_{f}")), F.lit(phase.name)).otherwise(F.col(f"{f}_source")) for f in phase.fields}
        count = lambda c: F.count_if(c)
        report = rows.groupBy(by).agg(count(F.col("_done")).alias("asked"), *[count(F.col("_done") & (F.col("_outcome") == o)).alias(o) for o in ("filled", "missed", "rejected", "failed")], count(F.col("_skipped")).alias("skipped"), F.max("_cut").alias("cut"), F.max("_reason").alias("reason"))
        reports.append(report.select(by, F.lit(phase.name).alias("phase"), "asked", "filled", "missed", "rejected", "failed", "skipped", "cut", "reason"))
        state = rows.select(by, order, key, *[cols.get(f, F.col(f)).alias(f) for f in fields], *[sources.get(f"{f}_source", F.col(f"{f}_source")).alias(f"{f}_source") for f in fields], (F.col("_stopped") | F.col("_cut").isNotNull()).alias("_stopped"))
    return state.drop("_stopped"), reduce(DataFrame.unionByName, reports)


def absorb(store: DataFrame, records: DataFrame, key: str, fields: list[str], names: dict[str, Column], canonical: Column, now: Column) -> tuple[DataFrame, DataFrame]:
    """(store with records absorbed; counts: imported, updated, unchanged, skipped).

    canonical: a record's key in the store's form; records that give none are skipped.  names: what each field is taken
    from; other columns of the records, such as scores, are ignored.  Of records with one key the first non-blank value of each field in order
    of ``_order``, where the records have that column, counts.  A value of the store that isn't blank stays.  ``updated_at`` is ``now`` where
    something was written.
    """
    taken = records.select(F.nullif(F.trim(F.coalesce(canonical, F.lit(""))), F.lit("")).alias(key), (F.col("_order") if "_order" in records.columns else F.lit(0)).alias("_order"), *[F.when(~blank(c), c).alias(f) for f, c in names.items()])
    fresh = taken.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.struct("_order", f))).alias(f) for f in names])
    old, new = store.alias("o"), fresh.alias("n")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    take = {f: blank(F.col(f"o.{f}")) & F.col(f"n.{f}").isNotNull() for f in names}
    wrote = reduce(lambda a, b: a | b, list(take.values())) | (F.col(f"o.{key}").isNull())
    cols = [(F.when(take[f], F.col(f"n.{f}")).otherwise(F.col(f"o.{f}")) if f in take else F.col(f"o.{f}")).alias(f) for f in fields]
    state = F.when(F.col(f"n.{key}").isNull(), None).when(F.col(f"o.{key}").isNull(), "imported").when(wrote, "updated").otherwise("unchanged")
    out = checkpointed(both.select(F.coalesce(f"o.{key}", f"n.{key}").alias(key), *cols, F.when(state.isin("imported", "updated"), now).otherwise(F.col("o.updated_at")).alias("updated_at"), state.alias("_state")))
    skipped = taken.agg(F.count_if(F.col(key).isNull()).alias("skipped"))
    counts = out.agg(*[F.count_if(F.col("_state") == s).alias(s) for s in ("imported", "updated", "unchanged")]).join(F.broadcast(skipped))
    return out.drop("_state"), counts
