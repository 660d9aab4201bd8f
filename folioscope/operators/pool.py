"""Pools of records: members of groups, lookups by number, backfills, tags, sparse directions, sampled gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import pubno

#: Label of a dimension in which nothing of a record gives a signal.
UNLABELED = "unlabeled"


def members(df: DataFrame, reps: DataFrame, group: str, key: str) -> DataFrame:
    """Every row with the representative of its group (``linkage.representatives``) and whether it is that one.

    Members are rows, not a list in the representative's row: a group may hold a third of all records.
    """
    return df.join(reps.select(group, f"rep_{key}"), group).withColumn("is_rep", F.col(key) == F.col(f"rep_{key}"))


def collapsed(df: DataFrame, family: Column, pos: str) -> DataFrame:
    """family, head, pos: the rows that stand behind the first one of their family; rows without a family have none."""
    some = df.withColumn("family", family).where("family is not null")
    heads = some.groupBy("family").agg(F.min(pos).alias("head"))
    return some.join(heads, "family").where(F.col(pos) != F.col("head")).select("family", "head", pos)


def core(number: Column) -> Column:
    """All digits of a number without leading zeros; empty for null."""
    return F.regexp_replace(F.regexp_replace(F.coalesce(number, F.lit("")), r"\D", ""), "^0+", "")


def resolve(requests: DataFrame, rows: DataFrame, key: str, want: str, number: str, pos: str, strict: bool = False) -> DataFrame:
    """Per request the row of its result list (``key``) whose number has the same digits, the first by ``pos`` where several do.

    Without such a row the first one of the list, or none if ``strict``: rows are then selected by digits, never by position.
    Requests without a row come back with nulls; a request without digits matches none.
    """
    got = requests.join(rows, key, "left").withColumn("_hit", (core(F.col(number)) == core(F.col(want))) & (core(F.col(want)) != ""))
    best = F.struct(~F.col("_hit"), F.col(pos), F.col(number), F.col("_hit").alias("matched"))
    found = F.col(pos).isNotNull() & (F.col("_hit") if strict else F.lit(True))
    out = got.groupBy(key, want).agg(F.min(F.when(found, best)).alias("x"))
    return out.select(key, want, f"x.{pos}", f"x.{number}", F.coalesce("x.matched", F.lit(False)).alias("matched"))


def forms(raw: Column) -> Column:
    """Forms under which a number may be stored, in the order of trying: its key, as it is, without kind, without the country
    where a US number bears its own letters."""
    own = F.when(raw.rlike("^US[A-Z]{2}"), F.substr(raw, F.lit(3)))
    return F.array_distinct(F.array_compact(F.array(pubno.key(raw), raw, pubno.family_key(raw), own, pubno.family_key(own))))


def first_form(requests: DataFrame, key: str, tried: Column, store: DataFrame, stored: str) -> DataFrame:
    """key, form, attempt (from 0): the first of a request's forms that the store has; requests without one are left out."""
    each = requests.select(key, F.posexplode(tried).alias("attempt", "form"))
    hits = each.join(store.select(F.col(stored).alias("form")).distinct(), "form")
    return hits.groupBy(key).agg(F.min(F.struct("attempt", "form")).alias("x")).select(key, "x.form", "x.attempt")


def metadata(pool: DataFrame, key: str, levels: list[tuple[DataFrame, Column | None]], fields: list[str], unknown: list[str], defaults: dict[str, Column] | None = None) -> DataFrame:
    """key, fields, level for every row of the pool: the record of the first source that has the key.

    levels: (records, condition on the key or None) in the order of trying.  A key that no source has is a gap: level null,
    the fields in ``unknown`` hold "Unknown" and the others are blank.  Blank values of a found record count likewise.
    defaults: what a field is where no source tells it, such as the country that a number begins with.
    """
    every = reduce(DataFrame.unionByName, [(d if when is None else d.where(when)).select(key, F.struct(F.lit(i).alias("level"), *fields).alias("x")) for i, (d, when) in enumerate(levels)])
    best = every.groupBy(key).agg(F.min("x").alias("x"))
    told = lambda f: [F.nullif(F.col(f"x.{f}"), F.lit("")), *([F.nullif(defaults[f], F.lit(""))] if f in (defaults or {}) else [])]
    said = [F.coalesce(*told(f), F.lit("Unknown" if f in unknown else "")).alias(f) for f in fields]
    return pool.select(key).join(best, key, "left").select(key, *said, "x.level")


def gaps(filled: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, reason of the rows of ``metadata`` that no source had (no record), or whose fields are all blank or unknown (no fields)."""
    bare = F.lit(True)
    for f in fields:
        bare = bare & F.col(f).isin("", "Unknown")
    return filled.select(key, F.when(F.col("level").isNull(), "no record").when(bare, "no fields").alias("reason")).where("reason is not null")


def fill_claims(records: DataFrame, found: DataFrame, key: str, source: str = "fallback") -> DataFrame:
    """records with claim1, claim1_empty and claim1_source: an empty claim takes the one found for its key, where that isn't blank."""
    other = found.groupBy(key).agg(F.min("claim1").alias("_claim"))
    got = records.join(other, key, "left").withColumn("_take", F.col("claim1_empty") & F.coalesce(F.length(F.col("_claim")) > 0, F.lit(False)))
    out = got.withColumn("claim1", F.when(F.col("_take"), F.col("_claim")).otherwise(F.col("claim1"))).withColumn("claim1_empty", F.col("claim1_empty") & ~F.col("_take"))
    return out.withColumn("claim1_source", F.when(F.col("_take"), source)).drop("_claim", "_take")


def tags(text: Column, rules: dict[str, dict[str, str]]) -> list[Column]:
    """One Column per dimension: its labels whose pattern the text has, joined by ``|``, or ``unlabeled``."""
    low, out = F.lower(F.coalesce(text, F.lit(""))), []
    for dimension, labels in rules.items():
        found = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(name)) for name, p in labels.items()]))
        out.append(F.when(F.size(found) > 0, F.array_join(found, "|")).otherwise(UNLABELED).alias(dimension))
    return out


def sparse(tagged: DataFrame, rules: dict[str, dict[str, str]], least: float) -> DataFrame:
    """dimension, label, n, share, sparse for every label of the rules, those without any record too; one pass, no shuffle of rows."""
    names = [(d, name) for d, labels in rules.items() for name in labels]
    count = [F.count_if(F.array_contains(F.split(F.col(d), "[|]"), name)).alias(f"n{i}") for i, (d, name) in enumerate(names)]
    one = tagged.agg(F.count(F.lit(1)).alias("total"), *count)
    rows = F.array(*[F.struct(F.lit(d).alias("dimension"), F.lit(name).alias("label"), F.col(f"n{i}").alias("n")) for i, (d, name) in enumerate(names)])
    share = F.when(F.col("total") > 0, F.round(F.col("n") / F.col("total"), 6)).otherwise(0.0)
    return one.select("total", F.inline(rows)).select("dimension", "label", "n", share.alias("share"), (share < least).alias("sparse"))


def lost_seeds(seeds: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """Records known to exist that the pool doesn't have."""
    return seeds.join(pool.select(key).distinct(), key, "left_anti")


def gate(quarantined: DataFrame, batch: str, key: str, on_topic: str, most: int = 30, least: int = 20, share: float = 0.7) -> DataFrame:
    """batch, sampled, on_topic, rate, passes: a sample of each batch, by hash of the key, judged; a batch of fewer than
    ``least`` is judged whole.  Sampling is the feature: rows beyond the sample are not looked at."""
    w = Window.partitionBy(batch).orderBy(F.md5(F.col(key).cast("string")), key)
    taken = quarantined.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    out = taken.groupBy(batch).agg(F.count(F.lit(1)).alias("sampled"), F.count_if(on_topic).alias("on_topic"))
    rate = F.round(F.col("on_topic") / F.col("sampled"), 6)
    return out.select(batch, "sampled", "on_topic", rate.alias("rate"), (F.col("sampled") < least).alias("whole"), (rate >= share).alias("passes"))
