"""Support of claims in a description: ladder of matches, functional language, coverage, vague terms, limits of an abstract."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.tables import checkpointed

# Functional language (United States, Europe), vague relative terms, terms an abstract should avoid.
FUNCTIONAL = ["configured to", "operable to", "adapted to", "capable of", "designed to", "arranged to"]
RELATIVE = ["about", "approximately", "substantially", "essentially", "generally", "typically", "normally", "usually"]
#: Letters from which on a word of an element counts, and how many of them a paragraph must have.
LONG, SIGNIFICANT = 3, 2
_WORD = r"[\p{L}\p{N}_]+"


def _tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(_WORD), F.lit(0))


def support(elements: DataFrame, paragraphs: DataFrame, key: list[str], element: str, para: str, body: str) -> DataFrame:
    """key, element, para of the paragraphs that support each element of a filing (``key``): those with the whole phrase; if there
    are none, for phrases of several words, those with at least SIGNIFICANT (or all, if fewer) of its words longer than LONG letters.

    The words of a filing's paragraphs are an index, met by the words of its elements: no element meets every paragraph.  Only
    paragraphs with all words of a phrase are compared as texts.
    """
    asked = elements.select(*key, element).distinct().withColumn("_w", _tokens(F.col(element)))
    asked = asked.withColumn("_phrase", F.concat(F.lit(" "), F.array_join("_w", " "), F.lit(" "))).withColumn("_all", F.size(F.array_distinct("_w")))
    asked = asked.withColumn("_big", F.size(F.array_distinct(F.filter("_w", lambda w: F.length(w) > LONG))))
    texts = paragraphs.select(*key, para, F.concat(F.lit(" "), F.array_join(_tokens(F.col(body)), " "), F.lit(" ")).alias("_text"))
    index = paragraphs.select(*key, para, F.explode(F.array_distinct(_tokens(F.col(body)))).alias("_word"))
    words = asked.select(*key, element, "_phrase", "_all", "_big", F.explode(F.array_distinct("_w")).alias("_word"))
    hits = words.join(index, [*key, "_word"]).groupBy(*key, element, para).agg(F.first("_phrase").alias("_phrase"), F.first("_all").alias("_all"), F.first("_big").alias("_big"), F.count(F.lit(1)).alias("_n"), F.count_if(F.length("_word") > LONG).alias("_m"))
    whole = hits.where("_n = _all").join(texts, [*key, para]).where(F.contains("_text", F.col("_phrase"))).select(*key, element, para)
    several = (F.size(F.split(F.trim("_phrase"), " ")) > 1) & (F.col("_big") > 0) & (F.col("_m") >= F.least(F.lit(SIGNIFICANT), F.col("_big")))
    part = hits.where(several).select(*key, element, para).join(whole.select(*key, element).distinct(), [*key, element], "left_anti")
    return whole.unionByName(part)


def support_issues(elements: DataFrame, found: DataFrame, key: list[str], element: str) -> DataFrame:
    """elements with n_paragraphs and severity: CRITICAL without support, IMPORTANT with one paragraph."""
    n = found.groupBy(*key, element).agg(F.count(F.lit(1)).alias("n_paragraphs"))
    out = elements.join(n, [*key, element], "left").na.fill(0, ["n_paragraphs"])
    return out.withColumn("severity", F.when(F.col("n_paragraphs") == 0, "CRITICAL").when(F.col("n_paragraphs") == 1, "IMPORTANT"))


def functions(body: Column, terms: list[str] | None = None) -> Column:
    """(term, function) of functional language: what stands behind each term up to a comma, semicolon or full stop."""
    one = lambda t: F.transform(F.regexp_extract_all(body, F.lit(rf"(?i){t}\s+([^,;.]+)"), F.lit(1)), lambda x: F.struct(F.lit(t).alias("term"), x.alias("function")))
    return F.concat(*[one(t) for t in terms or FUNCTIONAL])


def coverage(claims: DataFrame, issues: DataFrame, key: str, number: str, independent: str) -> DataFrame:
    """key, total, supported, percentage: independent claims without a CRITICAL issue; 0 where there is none."""
    bad = issues.where("severity = 'CRITICAL'").select(key, number).distinct().withColumn("_bad", F.lit(True))
    out = claims.where(independent).select(key, number).distinct().join(bad, [key, number], "left").groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("_bad").isNull()).alias("supported"))
    out = claims.select(key).distinct().join(out, key, "left").na.fill(0, ["total", "supported"])
    return out.withColumn("percentage", F.when(F.col("total") > 0, F.floor(F.col("supported") * 100 / F.col("total"))).otherwise(0).cast("int"))


def relative_terms(body: Column) -> Column:
    """The vague relative terms that a claim has as whole words, in order of the list."""
    return F.array_compact(F.array(*[F.when(body.rlike(rf"(?i)\b{t}\b"), t) for t in RELATIVE]))


def carried(members: DataFrame, found: DataFrame, key: str, family_key: Column, family: str) -> tuple[DataFrame, DataFrame]:
    """(members with their family, family -> asked, members, carried): a family that one member's answer tells is stamped on
    every member of the pool that belongs to it and has none.

    found: family and member numbers of the answers to some keys (``key``: the one that was asked).  Members meet by ``family_key``, a
    function of their number; of several families of one number the smallest counts.  A family that is there stays.
    """
    told = found.select(F.col(key).alias("_asked"), F.col(family).alias("_family"), F.explode("members").alias("_number"))
    told = told.select("_asked", "_family", family_key(F.col("_number")).alias("_fam")).groupBy("_fam").agg(F.min(F.struct("_family", "_asked")).alias("x")).select("_fam", "x.*")
    out = members.withColumn("_fam", family_key(F.col(key))).join(told, "_fam", "left")
    fresh = F.col(family).isNull() & F.col("_family").isNotNull()
    out = out.withColumn("how", F.when(F.col(family).isNotNull(), "there").when(fresh & (F.col("_asked") == F.col(key)), "asked").when(fresh, "carried").otherwise("missing"))
    out = out.withColumn(family, F.coalesce(F.col(family), F.col("_family"))).drop("_fam", "_family", "_asked")
    report = out.where(F.col(family).isNotNull()).groupBy(family).agg(*[F.count_if(F.col("how") == h).alias(h) for h in ("there", "asked", "carried")])
    return out, report


def progress(pool: DataFrame, by: list[str], family: str) -> DataFrame:
    """by, total, filled, missing, families, percent (to one place) of a pool's families."""
    some = F.coalesce(F.trim(F.col(family).cast("string")), F.lit("")) != ""
    out = pool.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(some).alias("filled"), F.count_distinct(F.when(some, F.col(family))).alias("families"))
    return out.select(*by, "total", "filled", (F.col("total") - F.col("filled")).alias("missing"), "families", F.round(100 * F.col("filled") / F.col("total"), 1).alias("percent"))


def charts(pool: DataFrame, country: str, category: str, year: str, assignee: str, classes: str, n: int = 10) -> DataFrame:
    """chart, rank, label, count: countries, categories (but Unknown), years in order, the n first assignees (but Unknown) and single classes.

    One pass makes a row per chart and record; counts are aggregated before they are ranked.
    """
    label = lambda chart, c: F.struct(F.lit(chart).alias("chart"), c.cast("string").alias("label"))
    known = lambda chart, c: F.when(F.coalesce(F.col(c), F.lit("Unknown")) != "Unknown", label(chart, F.col(c)))
    single = F.transform(F.filter(F.array_distinct(classes), lambda x: x.isNotNull() & (F.trim(x) != "")), lambda x: label("class", x))
    rows = F.concat(F.array_compact(F.array(F.when(F.col(country).isNotNull(), label("country", F.col(country))), known("category", category), F.when(F.col(year).isNotNull(), label("year", F.col(year))), known("assignee", assignee))), F.coalesce(single, F.array().cast("array<struct<chart:string,label:string>>")))
    count = pool.select(F.inline(rows)).groupBy("chart", "label").agg(F.count(F.lit(1)).alias("count"))
    by_count, by_year = Window.partitionBy("chart").orderBy(F.desc("count"), "label"), Window.partitionBy("chart").orderBy("label")
    ranked = count.withColumn("rank", F.when(F.col("chart") == "year", F.row_number().over(by_year)).otherwise(F.row_number().over(by_count)))
    return ranked.where(~F.col("chart").isin("assignee", "class") | (F.col("rank") <= n))


def slices(df: DataFrame, day: str, limit: int, depth: int, share: float = 0.05, total: int | None = None) -> DataFrame:
    """first_day, last_day, n, truncated, agrees of slices that cover the whole range of days, halved while over ``limit`` rows, ``depth`` times at most.

    Days are counted once; then a round per level tells each day its half.  agrees: whether the slices' sum differs from ``total`` (all
    rows with a day, if not given) by ``share`` at most.  2^depth slices at most, so a level's counts are a small table.
    """
    days = df.where(F.col(day).isNotNull()).groupBy(F.col(day).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    ends = days.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    rows = checkpointed(days.join(F.broadcast(ends)))
    for _ in range(depth):
        over = rows.groupBy("a", "b").agg(F.sum("n").alias("all")).where((F.col("all") > limit) & (F.col("a") < F.col("b"))).select("a", "b", F.lit(True).alias("cut"))
        middle = F.date_add("a", F.floor(F.datediff("b", "a") / 2).cast("int"))
        left = F.col("day") <= middle
        part = rows.join(F.broadcast(over), ["a", "b"], "left")
        rows = checkpointed(part.select("day", "n", F.when(F.col("cut") & ~left, F.date_add(middle, 1)).otherwise(F.col("a")).alias("a"), F.when(F.col("cut") & left, middle).otherwise(F.col("b")).alias("b")))
    out = rows.groupBy("a", "b").agg(F.sum("n").alias("n"))
    said = F.lit(total).cast("long") if total is not None else F.col("all")
    out = out.join(F.broadcast(out.agg(F.sum("n").alias("all"))))
    return out.select(F.col("a").alias("first_day"), F.col("b").alias("last_day"), "n", (F.col("n") > limit).alias("truncated"), (F.abs(F.col("all") - said) <= share * said).alias("agrees"))


def abort(df: DataFrame, by: str, order: str, outcome: Column, resets: list[str], limit: int = 8) -> DataFrame:
    """by, cut, reason: the first row at which ``limit`` failures in a row stand, whatever their reasons; rows without a reason and those whose
    reason is in ``resets`` start the count anew."""
    w = Window.partitionBy(by).orderBy(order)
    marked = df.withColumn("_o", outcome).withColumn("_bad", F.col("_o").isNotNull() & ~F.coalesce(F.col("_o").isin(resets), F.lit(False)))
    runs = marked.withColumn("_run", F.sum((~F.col("_bad")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    at = runs.where("_bad").withColumn("_at", F.row_number().over(Window.partitionBy(by, "_run").orderBy(order)))
    return at.where(F.col("_at") == limit).groupBy(by).agg(F.min(order).alias("cut"), F.min_by("_o", order).alias("reason"))


def family_rows(store: DataFrame, family: str, wanted: list[str], country: str, day: str, keep: list[str]) -> DataFrame:
    """A family's records by country, the newest first."""
    return store.where(F.col(family).isin(wanted)).orderBy(family, country, F.desc(day), *keep).select(family, country, day, *keep)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, count of several columns in one pass; nulls don't count."""
    each = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"))) for c in columns]))
    return df.select(F.inline(each)).groupBy("facet", "value").agg(F.count(F.lit(1)).alias("count"))


def enrich(hits: DataFrame, records: DataFrame, key: str, order: str, fields: list[str], most: int = 15) -> DataFrame:
    """The first ``most`` hits with their records; what a record lacks, or a key without one, is blank."""
    first = hits.orderBy(order, key).limit(most)
    return first.join(records.select(key, *fields), key, "left").select(key, order, *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in fields])

