"""Antecedent basis of claims: what a claim or its parents introduce, what it uses, and uses without an introduction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.operators.claims import limitations
from folioscope.sources.tables import checkpointed

# How a claim introduces an element and refers to one; the name is group 2, 1 and 1.
INTRODUCES = r"\b(a|an|at least one|one or more|more than one|two or more|plurality of|one|two|three|four|five|six|seven|eight|nine|ten)\s+([a-z][a-z\s-]+?)(?=\s+(?:configured|comprising|wherein|that|for|to|with|,|;|\.))"
THE = r"\bthe\s+([a-z][a-z\s-]+?)(?=\s+(?:configured|comprising|wherein|that|for|to|with|is|are|was|were|,|;|\.))"
SAID = r"\bsaid\s+([a-z][a-z\s-]+?)(?=\s+(?:configured|comprising|wherein|that|for|to|with|is|are|was|were|,|;|\.))"


def normal(name: Column) -> Column:
    """An element's name in lower case, one space between words, no marks behind it."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), r"\s+", " ")), r"[.,;:]+$", "")


def singular(word: Column) -> Column:
    """A name's singular by its ending."""
    ends = lambda *x: F.lower(word).rlike(f"(?:{'|'.join(x)})$")
    less = lambda n, more="": F.concat(F.substr(word, F.lit(1), F.length(word) - n), F.lit(more))
    return F.when(ends("ies"), less(3, "y")).when(ends("ses", "xes", "zes", "ches", "shes"), less(2)).when(ends("[^s]s", "^s"), less(1)).otherwise(word)


def plural(word: Column) -> Column:
    """A name's plural by its ending."""
    changed = F.concat(F.substr(word, F.lit(1), F.length(word) - 1), F.lit("ies"))
    return F.when(word.rlike(r"[^aeiou]y$"), changed).when(word.rlike(r"(?:s|x|z|ch|sh)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def occurrences(text: Column, pattern: str, group: int) -> Column:
    """(at, name) of every match of a pattern, in order; at counts characters from 0."""
    found = lambda g: F.regexp_extract_all(text, F.lit(rf"(?si)\G(.*?)(?:{pattern})"), F.lit(g))
    rows = F.arrays_zip(found(1).alias("gap"), found(0).alias("all"), found(group + 1).alias("name"))
    none = F.from_json(F.lit("[]"), "array<struct<at:int,name:string>>")
    step = lambda s, x: F.struct((s["to"] + F.length(x["all"])).alias("to"), F.concat(s["out"], F.array(F.struct((s["to"] + F.length(x["gap"])).alias("at"), normal(x["name"]).alias("name")))).alias("out"))
    return F.aggregate(rows, F.struct(F.lit(0).alias("to"), none.alias("out")), step, lambda s: s["out"])


def _sorted(side: DataFrame) -> DataFrame:
    """A side that grows with the claims, for a join by sorting: by its compressed size it would be broadcast, whole on the driver."""
    return side.hint("merge")


def lineage(claims: DataFrame, key: str, number: str, parent: str) -> DataFrame:
    """key, number, ancestor, steps: every claim with itself (0) and all claims it goes back to; the least steps count.

    Reach doubles in every round, so a chain of n claims takes log2(n) joins, however long; a cycle ends as no pair is new.
    A parent that isn't there is no ancestor.
    """
    known = claims.select(F.col(key).alias("key"), F.col(number).alias("number")).distinct()
    up = claims.where(F.col(parent).isNotNull()).select(F.col(key).alias("key"), F.col(number).alias("number"), F.col(parent).alias("ancestor"), F.lit(1).alias("steps"))
    pairs = checkpointed(up.join(_sorted(known.withColumnRenamed("number", "ancestor")), ["key", "ancestor"]).groupBy("key", "number", "ancestor").agg(F.min("steps").alias("steps")))
    n = pairs.count()
    while n:
        far = pairs.select("key", F.col("number").alias("ancestor"), F.col("ancestor").alias("beyond"), F.col("steps").alias("more"))
        further = pairs.join(_sorted(far), ["key", "ancestor"]).select("key", "number", F.col("beyond").alias("ancestor"), (F.col("steps") + F.col("more")).alias("steps"))
        pairs = checkpointed(pairs.unionByName(further).groupBy("key", "number", "ancestor").agg(F.min("steps").alias("steps")))
        before, n = n, pairs.count()
        if n == before:
            break
    own = known.select("key", "number", F.col("number").alias("ancestor"), F.lit(0).alias("steps"))
    return own.unionByName(pairs.where("number != ancestor")).select(F.col("key").alias(key), F.col("number").alias(number), "ancestor", "steps")


def place(body: Column, at: Column) -> Column:
    """The limitation that has a place of a claim; ``preamble`` in a claim without limitations."""
    start = lambda x: F.instr(body, x) - 1
    inside = F.get(F.filter(limitations(body), lambda x: (start(x["text"]) >= 0) & (start(x["text"]) <= at) & (at < start(x["text"]) + F.length(x["text"]))), F.lit(0))
    return F.when(F.size(limitations(body)) == 0, "preamble").when(inside.isNull(), "unknown location").otherwise(F.concat(F.lit("limitation ("), inside["letter"], F.lit(")")))


def missing_basis(claims: DataFrame, key: str, number: str, parent: str, body: str, ordered: bool = False) -> DataFrame:
    """key, number, term, at, location of every ``the X`` or ``said X`` whose X neither the claim nor a claim it goes back to introduces.

    For ``the`` the singular or plural of X will do.  ordered: an introduction in the claim itself counts only if it stands
    before the use.  Introductions and uses meet in joins on (filing, claim) and name; no claim's text travels with them.
    """
    two = claims.select(F.col(key).alias("key"), F.col(number).alias("number"), F.col(body).alias("body"))
    new = two.select("key", F.col("number").alias("ancestor"), F.inline(occurrences(F.col("body"), INTRODUCES, 2)))
    new = new.groupBy("key", "ancestor", "name").agg(F.min("at").alias("since"))
    ancestors = lineage(claims, key, number, parent).select(F.col(key).alias("key"), F.col(number).alias("number"), "ancestor", "steps")
    known = ancestors.join(_sorted(new), ["key", "ancestor"])
    known = known.groupBy("key", "number", F.col("name").alias("form")).agg(F.min(F.when(F.col("steps") > 0, -1).otherwise(F.col("since"))).alias("since"))
    said = lambda word, pattern: F.transform(occurrences(F.col("body"), pattern, 1), lambda x: F.struct(F.lit(word).alias("word"), x["at"].alias("at"), x["name"].alias("name")))
    uses = two.select("key", "number", "body", F.explode(F.concat(said("the", THE), said("said", SAID))).alias("u"))
    uses = uses.select("key", "number", "u.*", place(F.col("body"), F.col("u.at")).alias("location"))
    forms = F.when(F.col("word") == "the", F.array(F.col("name"), singular(F.col("name")), plural(F.col("name")))).otherwise(F.array("name"))
    asked = uses.withColumn("form", F.explode(F.array_distinct(forms)))
    met = asked.join(_sorted(known), ["key", "number", "form"])
    if ordered:
        met = met.where("since < at")
    met = met.select("key", "number", "word", "at").distinct()
    out = uses.join(_sorted(met), ["key", "number", "word", "at"], "left_anti")
    return out.select(F.col("key").alias(key), F.col("number").alias(number), F.concat_ws(" ", "word", "name").alias("term"), "at", "location")
