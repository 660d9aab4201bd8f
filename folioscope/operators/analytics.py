"""Counts, terms, percentiles, budgets, coverage of query logs, and event classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_counts(df: DataFrame, key: str, n: int = 10, skip: str = "Unknown") -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.where(F.col(key) != skip).groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(n)


def term_counts(df: DataFrame, text: str, stop: list[str], n: int = 50, cjk: bool = True) -> DataFrame:
    """The n most frequent terms: lower-cased words that are three ASCII letters or more (letters beyond ASCII belong to
    words), and with cjk runs of 2 to 4 ideographs, longest first from the left."""
    low = F.lower(text)
    terms = F.regexp_extract_all(low, F.lit(r"(?<![\p{L}\p{N}_])([a-z]{3,})(?![\p{L}\p{N}_])"), F.lit(1))
    if cjk:
        terms = F.concat(terms, F.regexp_extract_all(low, F.lit(r"[\u4e00-\u9fa5]{2,4}"), F.lit(0)))
    words = df.select(F.explode(terms).alias("term"))
    return words.where(~F.col("term").isin(stop)).groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(n)


def latency_stats(df: DataFrame, by: str, value: str, order: list[str], ring: int = 1024) -> DataFrame:
    """count, min, max, mean and the elements at int(n * q) of the sorted last ``ring`` samples of each operation."""
    w = Window.partitionBy(by).orderBy(*[F.desc(c) for c in order])
    s = df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= ring).groupBy(by).agg(F.sort_array(F.collect_list(value)).alias("v"))
    at = lambda q: F.element_at("v", F.floor(F.size("v") * q).cast("int") + 1)
    return s.select(by, F.size("v").cast("long").alias("n"), F.array_min("v").alias("least"), F.array_max("v").alias("most"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 6).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


def rigor(log: DataFrame, campaign: str, group: str, code: Column) -> DataFrame:
    """Queries, distinct concept groups and distinct class codes of each campaign."""
    return log.groupBy(campaign).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct(group).alias("concept_groups"), F.count_distinct(F.upper(F.replace(code, F.lit(" "), F.lit("")))).alias("class_codes"))


def window_key(ts: Column) -> Column:
    """Calendar date of a moment with off-hours (weekend, or before 8 and from 18 on) or daytime. Nights and weekends are cut
    at midnight; ``quota_window`` has the windows in which a quota holds."""
    day = F.date_format(ts, "yyyy-MM-dd")
    off = (F.weekday(ts) >= 5) | (F.hour(ts) < 8) | (F.hour(ts) >= 18)
    return F.concat(day, F.when(off, "-off").otherwise("-day"))


def quota_window(ts: Column, monday_fix: bool = False) -> Column:
    """Quota window of a moment in Taipei (UTC+8): ``date:narrow`` on weekdays from 8 to 18, else ``date:wide``.

    A wide window has the date it began on: a weekday before 8 the day before, Saturday and Sunday their Friday.  So
    Monday before 8 has Sunday's date, as in the reference; with monday_fix it has Friday's.  A timestamp without a
    zone is Taipei's own clock.
    """
    zoned, seconds = F.typeof(ts) == "timestamp", F.unix_seconds(ts.cast("timestamp")) + 8 * 3600
    day = F.when(zoned, F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))).otherwise(ts.cast("date"))
    hour = F.when(zoned, F.floor(F.pmod(seconds, F.lit(86400)) / 3600).cast("int")).otherwise(F.hour(ts))
    weekday = F.weekday(day)
    early = F.when(weekday == 0, 3).otherwise(1) if monday_fix else F.lit(1)
    back = F.when(weekday >= 5, weekday - 4).when(hour < 8, early).otherwise(0)
    narrow = (weekday < 5) & (hour >= 8) & (hour < 18)
    return F.concat(F.date_format(F.date_sub(day, back), "yyyy-MM-dd"), F.when(narrow, ":narrow").otherwise(":wide"))


def sessions(df: DataFrame, by: str, ts: str, tie: str, gap_seconds: int) -> DataFrame:
    """Sessions by gaps: start, end and number of rows."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    seconds = F.unix_micros(F.col(ts).cast("timestamp"))
    new = F.coalesce((seconds - F.lag(seconds).over(w) > gap_seconds * 1_000_000).cast("int"), F.lit(1))
    s = df.withColumn("_new", new).withColumn("session", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(by, "session").agg(F.count(F.lit(1)).alias("n"), F.min(tie).alias("first_id"), F.max(tie).alias("last_id"))
