"""Rules for whole filings: abstracts, titles, descriptions, terminology, claim sets and their support."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.patterns import as_sql

# Marks of trade names, longest titles, abstract sizes and the number of claims without a fee.
TRADEMARKS = ["(TM)", "(R)", "(c)", "™", "®", "©"]
TITLE_CRITICAL, TITLE_INFO = 500, 100
ABSTRACT_LEAST, ABSTRACT_MOST = 20, 150
FREE_CLAIMS = 15
# Matter that is excluded as such, whole words.
EXCLUDED = ["computer program", "business method", "mathematical method", "presentation of information", "game", "mental act"]
# Units to be given in metric terms.
UNITS = {
    "inches": r"\b\d+\s*(?:inches?|in\.)\b",
    "feet": r"\b\d+\s*(?:feet|ft\.?)\b",
    "yards": r"\b\d+\s*(?:yards?|yd\.?)\b",
    "miles": r"\b\d+\s*(?:miles?|mi\.?)\b",
    "pounds": r"\b\d+\s*(?:pounds?|lbs?\.?)\b",
    "ounces": r"\b\d+\s*(?:ounces?|oz\.?)\b",
    "gallons": r"\b\d+\s*(?:gallons?|gal\.?)\b",
    "fahrenheit": r"\b\d+\s*(?:degrees?\s+)?(?:Fahrenheit|F)\b",
    "fahrenheit_sign": r"\b\d+\s*°\s*F\b",
}
# Parts of an international description, each found by any of its patterns.
DESCRIPTION = {
    "technical_field": [r"technical\s+field", r"field\s+of\s+(?:the\s+)?invention"],
    "background_art": [r"background\s+(?:art|of\s+(?:the\s+)?invention)", r"prior\s+art", r"related\s+art"],
    "disclosure": [r"(?:disclosure|summary)\s+of\s+(?:the\s+)?invention", r"technical\s+problem", r"object\s+of\s+(?:the\s+)?invention"],
    "drawings": [r"brief\s+description\s+of\s+(?:the\s+)?(?:drawings?|figures?)", r"description\s+of\s+(?:the\s+)?(?:drawings?|figures?)"],
    "best_mode": [r"best\s+mode", r"detailed\s+description", r"description\s+of\s+(?:the\s+)?(?:preferred\s+)?embodiments?", r"modes?\s+(?:of|for)\s+carrying\s+out"],
}
# How the claims of each category open; a product otherwise.
OPENINGS = {"process": r"^(a\s+method\b|a\s+process\b|method\s+)", "use": r"^use\s+of\b", "apparatus": r"^(a\s+device\b|a\s+system\b|a\s+apparatus\b|an\s+apparatus\b)"}
TWO_PART = r"(?i)characteri[sz]ed\s+in\s+that|wherein\s+the\s+improvement\s+comprises"
SEVERITIES = ["CRITICAL", "IMPORTANT", "MINOR", "WARNING", "INFO"]


def words(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^ \t\n\r\f]+"), F.lit(0)))


def unit_counts(text: Column) -> list[Column]:
    """Occurrences of each unit that should be metric."""
    return [F.size(F.regexp_extract_all(text, F.lit(as_sql(p, fold=True)), F.lit(0))).alias(name) for name, p in UNITS.items()]


def missing_parts(text: Column, parts: dict[str, list[str]] | None = None) -> Column:
    """Names of the parts of a description that none of their patterns finds, in order."""
    parts = DESCRIPTION if parts is None else parts
    return F.array_compact(F.array(*[F.when(~text.rlike("(?i)" + "|".join(f"(?:{p})" for p in ps)), name) for name, ps in parts.items()]))


def abstract_issues(text: Column, drawings: Column | None = None) -> Column:
    """Too long, too short, no reference sign in parentheses, several paragraphs; with drawings also no figure indication."""
    found = [F.when(words(text) > ABSTRACT_MOST, "too_long"), F.when(words(text) < ABSTRACT_LEAST, "too_short")]
    found += [F.when(~text.rlike(r"\(\d+[a-z]?\)"), "no_reference_sign"), F.when(text.rlike(r"\n[ \t]*\n"), "paragraphs")]
    if drawings is not None:
        found.append(F.when(drawings & ~text.rlike(r"(?i)fig(?:ure|\.)\s*\d+"), "no_figure"))
    return F.array_compact(F.array(*found))


def title_issues(title: Column) -> Column:
    """(severity, problem) of a title: over 500 or 100 characters, a leading article, under two words, a trade mark."""
    t = F.trim(title)
    issue = lambda test, severity, problem: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem")))
    marked = F.lit(False)
    for mark in TRADEMARKS:
        marked = marked | F.contains(t, F.lit(mark))
    n = F.length(t)
    return F.array_compact(F.array(issue(n > TITLE_CRITICAL, "CRITICAL", "length"), issue((n > TITLE_INFO) & (n <= TITLE_CRITICAL), "INFO", "length"), issue(t.rlike(r"(?i)^(a|an|the)\s"), "INFO", "article"), issue(words(t) < 2, "CRITICAL", "short"), issue(marked, "WARNING", "trademark")))


def category(body: Column) -> Column:
    """process, use, apparatus or product, by how a claim opens."""
    low, out = F.lower(body), None
    for name, pattern in OPENINGS.items():
        out = (F if out is None else out).when(low.rlike(pattern), name)
    return out.otherwise("product")


def two_part(body: Column) -> Column:
    """Whether a claim has a characterising part."""
    return body.rlike(TWO_PART)


def excluded(body: Column) -> Column:
    """The excluded terms that a claim holds as whole words."""
    return F.array_compact(F.array(*[F.when(F.lower(body).rlike(rf"\b{t}\b"), t) for t in EXCLUDED]))


def conciseness(claims: DataFrame, key: str, independent: str, kind: str) -> DataFrame:
    """key, issue, term, severity: more claims than are free, several independent claims of one category."""
    many = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FREE_CLAIMS)
    many = many.select(key, F.lit("fee").alias("issue"), F.concat(F.col("n").cast("string"), F.lit(" claims")).alias("term"), F.lit("MINOR").alias("severity"))
    per = claims.where(independent).groupBy(key, kind).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    term = F.concat(F.col("n").cast("string"), F.lit(" independent "), F.col(kind), F.lit(" claims"))
    return many.unionByName(per.select(key, F.lit("category").alias("issue"), term.alias("term"), F.lit("IMPORTANT").alias("severity")))


def numbering(claims: DataFrame, key: str, number: str, independent: str) -> DataFrame:
    """key, n_claims, no_independent, not_consecutive: whether a claim set's numbers are 1 to n."""
    out = claims.groupBy(key).agg(F.count_distinct(number).alias("n_claims"), F.min(number).alias("low"), F.max(number).alias("high"), F.bool_or(independent).alias("any"))
    row = (F.col("low") == 1) & (F.col("high") == F.col("n_claims"))
    return out.select(key, "n_claims", (~F.col("any")).alias("no_independent"), (~row).alias("not_consecutive"))


def issue_counts(issues: DataFrame, kind: str = "issue_type", severity: str = "severity") -> DataFrame:
    """Issues by severity and type."""
    return issues.groupBy(severity, kind).agg(F.count(F.lit(1)).alias("n"))


def sorted_issues(issues: DataFrame, key: str, number: str, severity: str = "severity") -> DataFrame:
    """rank of each issue in its filing: by severity, then claim number, then term."""
    place = F.coalesce(*[F.when(F.col(severity) == s, F.lit(i)) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))
    return issues.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(place, number, "issue_type", "term")))


def ancestors(claims: DataFrame, key: str, number: str, parent: str) -> DataFrame:
    """key, number, root, depth: the claim that each claim goes back to; a cycle, or a parent that isn't there, has no root.

    Rows double their reach in every round until that covers the largest filing, so a chain of n claims takes log2(n) joins.
    """
    from folioscope.sources.tables import checkpointed

    up = claims.select(key, number, F.coalesce(parent, number).alias("at"), F.col(parent).isNotNull().cast("int").alias("steps"))
    most = claims.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    reach = 1
    while reach < most:
        far = up.select(F.col(key).alias("_k"), F.col(number).alias("_n"), F.col("at").alias("_at"), F.col("steps").alias("_steps"))
        up = up.join(far, (up[key] == far["_k"]) & (up["at"] == far["_n"]), "left").select(key, number, F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"))
        reach *= 2
        up = checkpointed(up)
    ends = claims.where(F.col(parent).isNull()).select(F.col(key).alias("_k"), F.col(number).alias("_n"))
    out = up.join(ends, (up[key] == ends["_k"]) & (up["at"] == ends["_n"]), "left")
    return out.select(key, number, F.col("_n").alias("root"), F.when(F.col("_n").isNotNull(), F.col("steps")).alias("depth"))


def paragraphs(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, paragraph, body: text after each ``[0001]`` mark; without marks the non-empty lines that aren't headers in capitals."""
    marked = F.regexp_extract_all(text, F.lit(r"(?s)\[\d{4}\].*?(?=\[\d{4}\]|$)"), F.lit(0))
    lines = F.filter(F.split(text, r"\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[^a-z]*$"))
    found = F.when(F.size(marked) > 0, marked).otherwise(lines)
    return df.select(key, F.posexplode(found).alias("at", "body")).select(key, (F.col("at") + 1).alias("paragraph"), F.regexp_replace("body", r"^\[\d{4}\]\s*|^\s+|\s+$", "").alias("body"))


def support(elements: DataFrame, paras: DataFrame, element: str, key: list[str], body: str) -> DataFrame:
    """element, n_paragraphs, severity: paragraphs that hold every word of an element; none CRITICAL, one IMPORTANT.

    Paragraphs become an index of words once and elements look their words up, so no element meets every paragraph.
    """
    token = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[a-z0-9]+"), F.lit(0)))
    wanted = elements.select(element).distinct().withColumn("_words", token(F.col(element)))
    asked = wanted.select(element, F.size("_words").alias("_n"), F.explode("_words").alias("_word"))
    index = paras.select(*key, F.explode(token(F.col(body))).alias("_word"))
    hits = asked.join(index, "_word").groupBy(element, "_n", *key).agg(F.count(F.lit(1)).alias("_m")).where("_m = _n").groupBy(element).agg(F.count(F.lit(1)).alias("n_paragraphs"))
    out = wanted.select(element).join(hits, element, "left").na.fill(0, ["n_paragraphs"])
    return out.withColumn("severity", F.when(F.col("n_paragraphs") == 0, "CRITICAL").when(F.col("n_paragraphs") == 1, "IMPORTANT"))


# Lines and terms of a United States abstract, and the parts of a European description.
ABSTRACT_LINES, CLAIM_TERMS = 15, ["means", "said", "whereby"]
EP_DESCRIPTION = {
    "Technical field": [r"technical\s+field", r"field\s+of\s+(?:the\s+)?invention"],
    "Background art": [r"background\s+(?:art|of\s+(?:the\s+)?invention)", r"prior\s+art", r"related\s+art"],
    "Disclosure of the invention": [r"(?:disclosure|summary)\s+of\s+(?:the\s+)?invention", r"technical\s+problem", r"object\s+of\s+(?:the\s+)?invention"],
    "Brief description of drawings": [r"brief\s+description\s+of\s+(?:the\s+)?(?:drawings?|figures?)", r"description\s+of\s+(?:the\s+)?(?:drawings?|figures?)"],
    "Detailed description": [r"detailed\s+description", r"description\s+of\s+(?:the\s+)?(?:preferred\s+)?embodiments?", r"modes?\s+(?:of|for)\s+carrying\s+out\s+(?:the\s+)?invention", r"best\s+mode"],
    "Industrial applicability": [r"industrial\s+applicab", r"(?:technical\s+)?application\s+(?:of|in)\s+industry"],
}


def us_abstract_issues(text: Column, least: int = 50, most: int = 150) -> Column:
    """(severity, problem, detail) of an abstract: words, lines, terms of claims, paragraphs."""
    issue = lambda test, severity, problem, detail: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), detail.cast("string").alias("detail")))
    n, lines = words(text), F.size(F.split(text, "\n"))
    terms = F.array_compact(F.array(*[F.when(text.rlike(rf"(?i)\b{t}\b"), t) for t in CLAIM_TERMS]))
    return F.array_compact(F.array(issue(n < least, "WARNING", "short", n), issue(n > most, "WARNING", "long", n), issue(lines > ABSTRACT_LINES, "WARNING", "lines", lines), issue(F.size(terms) > 0, "INFO", "terms", F.array_join(terms, ",")), issue(F.contains(text, F.lit("\n\n")), "INFO", "paragraphs", F.lit(""))))


def ep_missing_parts(text: Column) -> Column:
    """(severity, part) of the parts that a European description hasn't; industrial applicability is only IMPORTANT."""
    return F.transform(missing_parts(text, EP_DESCRIPTION), lambda p: F.struct(F.when(p == "Industrial applicability", "IMPORTANT").otherwise("CRITICAL").alias("severity"), p.alias("part")))
