"""Classification of call results: friction, its normal reason, and cut event fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Longest event fields.
LIMITS = {"reason": 300, "detail": 500, "uri": 500, "ua": 300}


def _http(message: Column) -> Column:
    code = F.regexp_extract(message, r"\b([45]\d\d)\b", 1)
    return F.when(code != "", F.concat(F.lit("http_error:"), code))


def reason(message: Column) -> Column:
    """Of a message: http_error:NNN for the first 4xx or 5xx, else its first 200 characters, ``unknown`` without any."""
    return F.coalesce(_http(message), F.nullif(F.substring(message, 1, 200), F.lit("")), F.lit("unknown"))


def code_reason(code: Column) -> Column:
    """Of an error code: http_error:NNN, else ``envelope:`` and what stands before the first colon or blank where that is in
    capitals and 40 characters at most, else ``envelope:`` and the first 60 characters."""
    head = F.regexp_extract(F.trim(code), r"^[^: ]*", 0)
    capitals = (head == F.upper(head)) & (head != F.lower(head)) & (F.length(head) <= 40)
    return F.coalesce(_http(code), F.concat(F.lit("envelope:"), F.when(capitals, head).otherwise(F.substring(code, 1, 60))))


def friction(success: Column, code: Column, advisory: Column, fine: list[str]) -> Column:
    """Reason why a result needs a follow-up, or null.

    A failed result is friction unless its code is in ``fine``; so is a code where success is not given.  A result
    that is no failure counts through ``advisory``, the name of a raised flag.
    """
    known = F.coalesce(code.isin(fine), F.lit(False))
    flag = F.when(advisory.isNotNull(), F.concat(F.lit("advisory:"), advisory))
    failed = F.coalesce(~success, F.lit(False))
    return F.when(failed & known, F.lit(None)).when(failed, code_reason(F.coalesce(code, F.lit("unknown")))).when(success.isNull() & code.isNotNull() & ~known, code_reason(code)).otherwise(flag)


def cut(fields: dict[str, Column]) -> list[Column]:
    return [F.substring(c, 1, LIMITS.get(name, 500)).alias(name) for name, c in fields.items()]
