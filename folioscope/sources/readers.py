"""File sources: tolerant JSON, JSON lines, record lists and header-mapped CSV; and the ladder over sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class BadInput(ValueError):
    """The whole input is unusable."""


def tolerant_json(text: Column) -> Column:
    """VARIANT of a text: strict, else with control characters escaped, else with stray backslashes doubled, else null."""
    escaped = lambda x: reduce(lambda c, k: F.replace(c, F.lit(chr(k)), F.lit(f"\\u{k:04x}")), range(32), x)
    parts = F.regexp_extract_all(text, F.lit(r'(?s)"(?:[^"\\]++|\\.)*+"|[^"]++|"'), F.lit(0))
    plain = F.array_join(F.transform(parts, lambda x: F.when(F.startswith(x, F.lit('"')), escaped(x)).otherwise(x)), "")
    return F.coalesce(F.try_parse_json(text), F.try_parse_json(plain), F.try_parse_json(F.regexp_replace(plain, r'\\(?!["\\/bfnrtu])', r"\\\\")))


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, int]:
    """(rows, number of bad lines); blank lines don't count, and only an input without one good line fails."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    got = lines.select(F.from_json("value", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"), F.startswith(F.trim("value"), F.lit("{")).alias("object"))
    ok = F.col("object") & F.col("r").isNotNull() & F.col("r._bad").isNull()
    n, good = got.agg(F.count(F.lit(1)), F.count_if(ok)).first()
    if n and not good:
        raise BadInput(f"none of {n} lines is a JSON object")
    return got.where(ok).select("r.*").drop("_bad"), n - good


def records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that hold a list of records, or an object with such a list under ``records``."""
    text = spark.read.text(path, wholetext=True).select(F.trim("value").alias("t"))
    one = F.when(F.startswith("t", F.lit("[")), F.from_json("t", f"array<struct<{schema}>>")).otherwise(F.from_json("t", f"records array<struct<{schema}>>")["records"])
    parsed = text.select(one.alias("r"))
    if not parsed.where("r is null").isEmpty():
        raise BadInput("neither a list of records nor an object with records")
    return parsed.select(F.inline("r"))


def mapped_csv(spark: SparkSession, path: str, names: dict[str, str], drop: tuple[str, ...] = ()) -> DataFrame:
    """Strings of a CSV file under the names that its headers map to; a byte-order mark is no part of a header."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    pairs = [(c, c.lstrip("﻿").strip()) for c in df.columns]
    return df.select(*[F.col(f"`{c}`").alias(names[h]) for c, h in pairs if h in names and h not in drop])


def ladder(levels: list[tuple[str, set[str], DataFrame]], axes: set[str]) -> tuple[DataFrame | None, list[dict]]:
    """(rows of the first level that has any, what was tried): levels that lack a needed axis are skipped, failing ones noted."""
    tried = []
    for name, able, df in levels:
        if axes - able:
            tried.append({"level": name, "outcome": "skipped", "detail": ",".join(sorted(axes - able))})
            continue
        try:
            empty = df.isEmpty()
        except Exception as error:  # noqa: BLE001 - a broken source is an outcome of the ladder
            tried.append({"level": name, "outcome": "error", "detail": str(error)[:200]})
            continue
        tried.append({"level": name, "outcome": "miss" if empty else "hit", "detail": ""})
        if not empty:
            return df.withColumn("source_level", F.lit(name)), tried
    return None, tried


def ladder_rows(levels: list[DataFrame]) -> DataFrame:
    """The same as one plan: the rows of the lowest level that has any."""
    every = reduce(DataFrame.unionByName, [d.withColumn("level", F.lit(i)) for i, d in enumerate(levels)])
    # the lowest level is one row
    return every.join(F.broadcast(every.agg(F.min("level").alias("first"))), F.col("level") == F.col("first")).drop("first")
