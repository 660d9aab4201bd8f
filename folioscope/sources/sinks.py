"""Sinks: rendered CSV, appended JSON lines, and checks before a delivery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ExportError(ValueError):
    pass


def columns_for(core: list[str], presets: dict[str, list[str]], purpose: str, known: set[str], extra: tuple[str, ...] = (), exclude: tuple[str, ...] = (), last: tuple[str, ...] = ()) -> list[str]:
    """Core, the purpose's and extra columns in order, each once, without the excluded; core and ``last`` can't be excluded."""
    wanted = [*core, *presets.get(purpose, []), *extra]
    return list(dict.fromkeys([c for c in wanted if c in core or (c in known and c not in exclude and c not in last)])) + [c for c in last]


def rendered(df: DataFrame, headers: dict[str, str]) -> DataFrame:
    """All cells as strings under their headers: lists joined by ``; ``, null as empty."""
    def cell(name: str) -> Column:
        c = F.col(f"`{name}`")
        return F.coalesce(F.array_join(c.cast("array<string>"), "; ") if df.schema[name].dataType.typeName() == "array" else c.cast("string"), F.lit(""))

    return df.select(*[cell(n).alias(h) for n, h in headers.items()])


def write_csv(df: DataFrame, path: str, headers: dict[str, str], mark: bool = False) -> None:
    """Files with headers, cells quoted where needed; rows end by CR LF.  mark: a byte-order mark before the headers."""
    first = next(iter(headers))
    headers = {k: f"\ufeff{h}" if mark and k == first else h for k, h in headers.items()}
    rendered(df, headers).write.option("header", True).option("escape", '"').option("emptyValue", "").option("lineSep", "\r\n").csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def preflight(files: DataFrame, least: int = 1, not_empty: bool = False, contains: tuple[str, ...] = ()) -> None:
    """Raises ExportError for a listing (rel, size) without files, or against what the delivery asks for."""
    n, empty, *found = files.agg(F.count(F.lit(1)), F.count_if(F.col("size") <= 0), *[F.count_if(F.contains("rel", F.lit(c))) for c in contains]).first()
    if not n:
        raise ExportError("EXPORT_EMPTY")
    lacking = [c for c, k in zip(contains, found, strict=True) if not k]
    if n < least or (not_empty and empty) or lacking:
        raise ExportError(f"ASSERTION_FAILED: {n} files, {empty} empty, lacking {lacking}")
