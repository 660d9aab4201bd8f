"""A monthly usage ledger: own usage added up, reconciled figures with a time to live.  A stream keeps it as state with timers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds for which a reconciled figure counts as current.
TTL = 900
SCHEMA = "month string, local_bytes long, reconciled_bytes long, reconciled_at timestamp, usage long, due boolean, as_of timestamp"
_STATE = "local long, reconciled long, at double, seen double"


def month(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def ledger(events: DataFrame, ts: str, amount: str, kind: str, now: Column | None = None, ttl: int = TTL) -> DataFrame:
    """A row per month: local_bytes (positive amounts of kind ``local``), the latest amount of kind ``reconciled`` and its time, usage (the
    larger one), due: whether to reconcile anew, as there is no figure or it is ``ttl`` seconds old at ``now`` (the month's last event).

    Of reconciled figures of one moment the larger one counts.
    """
    when, told = F.col(ts).cast("timestamp"), F.col(kind) == "reconciled"
    own = F.sum(F.when((F.col(kind) == "local") & (F.col(amount) > 0), F.col(amount)).otherwise(0)).cast("long")
    last = F.max(F.when(told, F.struct(when.alias("at"), F.col(amount).cast("long").alias("bytes"))))
    rows = events.groupBy(month(when).alias("month")).agg(own.alias("local_bytes"), last.alias("last"), F.max(when).alias("seen"))
    as_of = F.col("seen") if now is None else now
    age = as_of.cast("double") - F.col("last.at").cast("double")
    return rows.select("month", "local_bytes", F.col("last.bytes").alias("reconciled_bytes"), F.col("last.at").alias("reconciled_at"), F.greatest("local_bytes", F.coalesce("last.bytes", F.lit(0))).alias("usage"), F.coalesce(age >= ttl, F.lit(True)).alias("due"), as_of.alias("as_of"))


def ledger_stream(events: DataFrame, ts: str, amount: str, kind: str, delay: str = "1 hour", ttl: int = TTL) -> DataFrame:
    """The same of a stream: a month's row whenever it changes, and once more, with ``due``, when its reconciled figure has
    lived for ``ttl`` seconds of event time.  State is four numbers a month."""

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        local, told, at, seen = state.get if state.exists else (0, None, None, 0.0)
        if state.hasTimedOut:
            seen = max(seen, at + ttl)
        for f in frames:
            own = f.loc[(f["kind"] == "local") & (f["amount"] > 0), "amount"]
            local += int(own.sum())
            new = f[f["kind"] == "reconciled"].sort_values(["at", "amount"])
            if len(new) and (at is None or (new["at"].iloc[-1], new["amount"].iloc[-1]) >= (at, told)):
                at, told = float(new["at"].iloc[-1]), int(new["amount"].iloc[-1])
            seen = max(seen, float(f["at"].max()))
        state.update((local, told, at, seen))
        due = at is None or seen - at >= ttl
        if not due and (until := int((at + ttl) * 1000)) > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        stamp = lambda x: pd.to_datetime(x, unit="s", utc=True) if x is not None else pd.NaT
        yield pd.DataFrame({"month": [key[0]], "local_bytes": [local], "reconciled_bytes": pd.array([told], "Int64"), "reconciled_at": [stamp(at)], "usage": [max(local, told or 0)], "due": [due], "as_of": [stamp(seen)]})

    when = F.col(ts).cast("timestamp")
    rows = events.select(when.alias("ts"), when.cast("double").alias("at"), F.col(amount).cast("long").alias("amount"), F.col(kind).alias("kind"), month(when).alias("month"))
    return rows.withWatermark("ts", delay).groupBy("month").applyInPandasWithState(update, SCHEMA, _STATE, "update", GroupStateTimeout.EventTimeTimeout)
