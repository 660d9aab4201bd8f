"""Search audits: coverage of a query log, boolean shapes, verdicts; fill rates, fuses, page choice, pool quality."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Least coverage of a campaign, and jurisdictions by database or region code.
FLOORS = {"min_class_anchors": 3, "min_concept_groups": 3, "min_jurisdictions": 3, "min_boolean_combos": 2, "min_queries": 12}
JURISDICTIONS = ["CN", "TW", "US"]


def jurisdiction(database: Column) -> Column:
    """TW, CN or US of a database or region code, by its first two letters; else null."""
    two = F.substring(F.upper(F.trim(database)), 1, 2)
    return F.when(two.isin(JURISDICTIONS), two)


def overrides(text: str) -> dict:
    """Thresholds that a campaign raises, and jurisdictions that it excludes, from ``key=value`` marks; lower ones don't count."""
    out: dict = {}
    for key, value in re.findall(r"(\S+?)=(\S+)", text):
        key, value = key.lstrip("#"), value.strip('"')
        if key == "exclude_jurisdiction":
            out.setdefault(key, set()).add(value.upper())
        elif key in FLOORS and re.fullmatch(r"[+-]?\d+", value) and int(value) > FLOORS[key]:
            out[key] = int(value)
    return out


def thresholds(raised: dict) -> dict[str, int]:
    return FLOORS | {k: v for k, v in raised.items() if k in FLOORS}


def shapes(boolean: Column, classes: Column, keywords: Column) -> Column:
    """Boolean shapes of one query: parts of a compound, OR over several classes or words, AND that joins two clauses or more."""
    said = F.upper(F.trim(F.coalesce(boolean, F.lit(""))))
    real = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    c, k = F.size(real(classes)), F.size(real(keywords))
    parts = F.when(F.contains(said, F.lit("+")), F.filter(F.transform(F.split(said, r"\+"), F.trim), lambda x: (x != "") & (x != "SINGLE"))).otherwise(F.array().cast("array<string>"))
    more = F.array_compact(F.array(F.when((c >= 2) | (k >= 2) | (said == "OR"), "OR"), F.when((said == "AND") & ((c > 0).cast("int") + k >= 2), "AND")))
    return F.array_distinct(F.concat(parts, more))


def coverage(log: DataFrame, campaign: str) -> DataFrame:
    """Coverage by campaign of a log with database, class_codes, keywords, concept_group and boolean."""
    code = F.explode_outer(F.filter(F.transform("class_codes", lambda x: F.upper(F.replace(F.trim(x), F.lit(" "), F.lit("")))), lambda x: x != ""))
    group = F.upper(F.trim(F.col("concept_group")))
    base = log.withColumn("_j", jurisdiction(F.col("database"))).withColumn("_shapes", shapes(F.col("boolean"), F.col("class_codes"), F.col("keywords")))
    per = [F.count_if(F.col("_j") == j).alias(f"n_{j.lower()}") for j in JURISDICTIONS]
    one = base.groupBy(campaign).agg(F.count(F.lit(1)).alias("queries"), F.count_distinct(F.when(group != "", group)).alias("concept_groups"), F.array_sort(F.collect_set("_j")).alias("present"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("_shapes")))).alias("boolean_shapes"), *per)
    codes = base.select(campaign, code.alias("_code")).groupBy(campaign).agg(F.count_distinct("_code").alias("class_anchors"))
    return one.join(codes, campaign)


def verdict(log: DataFrame, campaign: str, raised: dict | None = None) -> DataFrame:
    """Coverage, gaps (axes under their threshold), missing jurisdictions, warnings and PASS, WARN or FAIL by campaign.

    WARN: no gap, but a required jurisdiction has fewer than two queries.
    """
    raised = raised or {}
    least, required = thresholds(raised), [j for j in JURISDICTIONS if j not in raised.get("exclude_jurisdiction", set())]
    c = coverage(log, campaign)
    need = F.array(*map(F.lit, required)) if required else F.array().cast("array<string>")
    met = F.size(F.array_intersect("present", need)) >= min(least["min_jurisdictions"], len(required))
    low = lambda name, value: F.when(value < least[f"min_{name}"], name)
    gaps = F.array_compact(F.array(low("class_anchors", F.col("class_anchors")), low("concept_groups", F.col("concept_groups")), F.when(~met, "jurisdictions"), low("boolean_combos", F.size("boolean_shapes")), low("queries", F.col("queries"))))
    out = c.withColumn("missing", F.array_sort(F.array_except(need, "present"))).withColumn("gaps", gaps)
    few = F.array_compact(F.array(*[F.when(F.col(f"n_{j.lower()}") < 2, j) for j in required])) if required else F.array().cast("array<string>")
    out = out.withColumn("warnings", F.when(F.size("gaps") == 0, few).otherwise(F.array().cast("array<string>")))
    return out.withColumn("verdict", F.when(F.size("gaps") > 0, "FAIL").when(F.size("warnings") > 0, "WARN").otherwise("PASS"))


def fill_rate(df: DataFrame, value: str, by: str | None = None) -> DataFrame:
    """filled, missing, distinct values and the filled share in per cent, of all rows or by a column."""
    filled = F.coalesce(F.trim(F.col(value).cast("string")), F.lit("")) != ""
    rows = df.groupBy(by) if by else df.groupBy()
    out = rows.agg(F.count_if(filled).alias("filled"), F.count_if(~filled).alias("missing"), F.count_distinct(F.when(filled, F.col(value))).alias("distinct_values"))
    total = F.col("filled") + F.col("missing")
    return out.withColumn("pct", F.when(total > 0, F.round(100.0 * F.col("filled") / total, 1)).otherwise(0.0))


def error_counts(df: DataFrame, by: str, failed: Column, order: str, message: str, samples: int = 10) -> DataFrame:
    """by, errors, successes, and the first ``samples`` messages of errors in order."""
    marked = df.withColumn("_failed", failed)
    counts = marked.groupBy(by).agg(F.count_if("_failed").alias("errors"), F.count_if(~F.col("_failed")).alias("successes"))
    # a limit on the rank: each partition keeps its first rows before any are sorted together
    few = marked.where("_failed").withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") <= samples)
    few = few.groupBy(F.col(by).alias("_by")).agg(F.array_sort(F.collect_list(F.struct("_n", F.col(message).alias("m")))).alias("s"))
    out = counts.join(few, counts[by].eqNullSafe(few["_by"]), "left")
    return out.select(by, "errors", "successes", F.coalesce(F.array_join(F.transform("s", lambda x: x["m"].cast("string")), ","), F.lit("")).alias("samples"))


def fuse(df: DataFrame, by: str, order: list[str], failure: Column, limit: int = 8) -> DataFrame:
    """by, and the first row (its order columns) at which ``limit`` equal failures stand in a row.

    failure: a reason, null where the call went well, which starts the count anew, as another reason does.
    """
    w = Window.partitionBy(by).orderBy(*order)
    marked = df.withColumn("_f", failure)
    new = (~F.col("_f").eqNullSafe(F.lag("_f").over(w))) | (F.row_number().over(w) == 1)
    runs = marked.withColumn("_run", F.sum(new.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.row_number().over(Window.partitionBy(by, "_run").orderBy(*order))
    cut = runs.withColumn("_at", at).where((F.col("_at") == limit) & F.col("_f").isNotNull())
    return cut.groupBy(by).agg(F.min(F.struct(*order)).alias("cut"), F.min_by("_f", F.struct(*order)).alias("reason"))


def longest_run(df: DataFrame, by: str, page: str, flag: Column) -> DataFrame:
    """by, first page and length of the longest run of consecutive flagged pages; of equal runs the earliest."""
    w = Window.partitionBy(by).orderBy(page)
    runs = df.where(flag).select(by, page, (F.col(page) - F.row_number().over(w)).alias("_run"))
    runs = runs.groupBy(by, "_run").agg(F.min(page).alias("first"), F.count(F.lit(1)).alias("length"))
    best = runs.groupBy(by).agg(F.max(F.struct(F.col("length"), (-F.col("first")).alias("at"))).alias("b"))
    return best.select(by, (-F.col("b.at")).alias("first"), F.col("b.length").alias("length"))


def figure_page(df: DataFrame, by: str, page: str, text: str, least: int = 5) -> DataFrame:
    """by, page: the first page from the second on that names figure 1, else the one with most reference numerals if there
    are ``least`` or more (of equal ones the earliest), else null."""
    named = F.col(text).rlike(r"(?i)fig\.?\s*1\b") & (F.col(page) >= 2)
    n = F.size(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b\d{2,3}\b"), F.lit(0))))
    out = df.groupBy(by).agg(F.min(F.when(named, F.col(page))).alias("a"), F.max(F.when(n >= least, F.struct(n.alias("n"), (-F.col(page)).alias("p")))).alias("b"))
    return out.select(by, F.coalesce("a", -F.col("b.p")).alias("page"))


def reap(df: DataFrame, kind: str, idle: Column, limits: dict[str, int], warn: int) -> DataFrame:
    """df with state: ``expired`` when idle for its class's limit or longer, ``warn`` in the last ``warn`` seconds, else ``live``."""
    limit = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in limits.items()], F.lit(min(limits.values())))
    return df.withColumn("state", F.when(idle >= limit, "expired").when(idle >= limit - warn, "warn").otherwise("live"))


def pool_quality(pool: DataFrame, relevant: DataFrame, key: str) -> DataFrame:
    """hits, precision, recall and f1 of a pool against the relevant keys; null where nothing can be divided by."""
    both = pool.select(key).distinct().withColumn("p", F.lit(1)).join(relevant.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    n = both.agg(F.count("p").alias("pool"), F.count("r").alias("relevant"), F.count_if(F.col("p").isNotNull() & F.col("r").isNotNull()).alias("hits"))
    p, r = F.try_divide("hits", "pool"), F.try_divide("hits", "relevant")
    return n.select("hits", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.try_divide(2 * p * r, p + r), 6).alias("f1"))


def reconcile(ledger: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows of a ledger, files there are, and references without a file or files without a reference."""
    both = ledger.select(key).withColumn("l", F.lit(1)).join(files.select(key).distinct().withColumn("f", F.lit(1)), key, "full")
    return both.agg(F.count("l").alias("ledger"), F.count_distinct(F.when(F.col("f").isNotNull(), F.col(key))).alias("files"), F.count_if(F.col("f").isNull()).alias("dangling"), F.count_if(F.col("l").isNull()).alias("unlisted"))


def slice_sum(parts: DataFrame, parent: str, part: str, total: str, tolerance: float = 0.05) -> DataFrame:
    """parent, sum of the slices, total, and whether they agree within ``tolerance`` of the total."""
    out = parts.groupBy(parent).agg(F.sum(part).alias("slices"), F.max(total).alias("total"))
    return out.withColumn("agrees", F.abs(F.col("slices") - F.col("total")) <= tolerance * F.col("total"))
