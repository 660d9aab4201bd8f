"""URL filters: a sort-merge range join of reversed-host keys with nested host rules, DataFrame operations only.

A host's canonical key is its labels in reverse, each followed by U+0001 (``a.example.org`` gives
``org|example|a|``), so that a host and its subdomains fill one interval of the key order and the rules'
intervals nest.  Every rule host carries the stack of rules that is active at the start of its interval.  One
sorted sweep over rule starts and urls carries the last stack forward; the urls then pop the entries whose
interval has ended (whose key is no prefix of theirs) and, of the rest, take the longest rule whose path their
path starts with.

Scale: sweeps run in groups of (last label, salt).  The salt spreads a hot top-level domain; every group gets the
rule starts of its label, so the rules are multiplied by the salts, of which there are at most
``RULE_COPIES / rules``.  Nothing is broadcast and no rule list is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most salts, and most copies of rule starts that salting may make.
MAX_SALTS, RULE_COPIES = 1024, 4_000_000
SEP = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"://([^/?#]*)([^?#]*)"


def parts(url):
    """(host, path) columns of a url: after the first ://; both empty for null or where there is none."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, _PARTS, 1), UPPER, LOWER), F.regexp_extract(url, _PARTS, 2)


def host_key(host):
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), SEP), F.lit(SEP))


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(verdict, host, path) triples as a DataFrame."""
    rows = F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules])
    return spark.range(1).select(F.inline(rows))


def _starts(rules: DataFrame) -> DataFrame:
    """Each rule host's key with the stack of the rules that hold from there on: its own and those it is nested in."""
    entry = F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "verdict", "path", "hkey")
    keyed = rules.select("verdict", F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path")).dropna().distinct().withColumn("hkey", host_key(F.col("host")))
    labels = F.split(F.expr("substring(hkey, 1, length(hkey) - 1)"), SEP, -1)
    outer = keyed.select("hkey").distinct().withColumn("labels", labels)
    outer = outer.select("hkey", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat(F.array_join(F.slice("labels", F.lit(1), i), SEP), F.lit(SEP)))).alias("at"))
    inner = keyed.select(F.col("hkey").alias("at"), entry.alias("entry"))
    return outer.join(inner, "at").groupBy("hkey").agg(F.collect_list("entry").alias("stack"))


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The columns of pages plus host, path, rule (text of the longest rule that fits, else null) and verdict.

    A rule fits its host and all subdomains where the path starts with the rule's path.  Longest is by host and
    path together, then by host, then by text; of equal rules with opposite verdicts ``block`` wins.  Null and
    malformed urls have empty host and path.  Rules with a null host or verdict are ignored; no rules: the
    default everywhere.  Repeated rows stay.  Columns of pages named host, path, rule or verdict are replaced.
    """
    keep = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    starts = _starts(rules)
    n = max(1, starts.count())
    salts = max(1, min(MAX_SALTS, RULE_COPIES // n))
    host, path = parts(F.col(f"`{url_col}`"))
    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    points = pages.select(row.alias("row"), host.alias("host"), path.alias("path"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int").alias("salt"))
    points = points.withColumn("hkey", host_key(F.col("host"))).withColumn("kind", F.lit(1))
    heads = starts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).withColumn("kind", F.lit(0))
    events = points.unionByName(heads, allowMissingColumns=True).withColumn("top", F.substring_index("hkey", SEP, 1))
    sweep = Window.partitionBy("top", "salt").orderBy("hkey", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = events.withColumn("stack", F.last("stack", ignorenulls=True).over(sweep)).where("kind = 1")
    active = F.filter("stack", lambda e: F.startswith(F.col("hkey"), e["hkey"]) & F.startswith(F.col("path"), e["path"]))
    best = F.array_max(F.transform(active, lambda e: F.struct(e["size"].alias("size"), e["host_size"].alias("host_size"), e["rule"].alias("rule"), e["verdict"].alias("verdict"))))
    out = swept.withColumn("best", best)
    return out.select("row.*", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
