"""Publication numbers as Columns: canonical keys, reconciliation variants and the forms that sources expect."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-letter codes that may lead a number.
CODES = [
    "TW", "US", "EP", "WO", "CN", "KR", "JP", "CA", "AU", "DE", "GB", "FR", "ES", "FI", "PL", "MX", "IT",
    "NL", "SE", "CH", "AT", "BE", "DK", "NO", "RU", "IN", "BR", "SG", "IL", "HK", "MO", "CZ", "GR", "TR",
]
_CODE = f"^({'|'.join(CODES)})"


def compact(raw: Column) -> Column:
    """Upper case without white space, / - , and dots; null is empty."""
    return F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)[\s/\-,.]+", ""))


def _bare(raw: Column) -> Column:
    return F.regexp_replace(compact(raw), _CODE, "")


def country(raw: Column) -> Column:
    """The leading code; without one TW for certificate numbers and for nine digits, else US."""
    c, found = compact(raw), F.regexp_extract(compact(raw), _CODE, 1)
    return F.when(found != "", found).when(c.rlike(r"^([IMD]\d|\d{9}$)"), "TW").otherwise("US")


def number(raw: Column) -> Column:
    """The body; letters behind plain digits or behind a certificate number go, kinds with a digit stay."""
    return F.regexp_replace(_bare(raw), r"^([IMD]?\d+)[A-Z]*$", "$1")


def key(raw: Column) -> Column:
    return F.concat(country(raw), number(raw))


def key_variants(raw: Column) -> Column:
    """The key, and the number as it is where that differs."""
    return F.array_distinct(F.array(key(raw), compact(raw)))


def family_key(raw: Column) -> Column:
    """The compact number without its kind (a letter with digits); something of the body always stays."""
    return F.regexp_replace(compact(raw), r"^((?:[A-Z]{2})?.+?)(?:[A-Z]\d*)?$", "$1")


def digits(raw: Column) -> Column:
    """The first run of digits behind the leading letters."""
    return F.regexp_extract(F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), "^[A-Za-z]+", ""), r"\d+", 0)


def tw_kind(raw: Column) -> Column:
    """apply, identifier or unknown; nine digits are an application unless they start with a western year."""
    c = compact(raw)
    return F.when(c.rlike(r"^TW(19|20)\d{7}$"), "identifier").when(c.rlike(r"^TW\d{9}$"), "apply").when(c.rlike(r"^TW([IMD]\d+[A-Z]*|\d+[A-Z]+)$"), "identifier").otherwise("unknown")


def web_form(raw: Column, axis: str | None = None) -> Column:
    """struct(number, axis) for a web form: digits without code and kind; axis apply or pub."""
    if axis not in (None, "pub", "apply"):
        raise ValueError(f"axis is pub, apply or None, not {axis!r}")
    guess = F.when(compact(raw).rlike(r"^TW\d{9}$"), "apply").otherwise("pub") if axis is None else F.lit(axis)
    lead = F.regexp_extract(_bare(raw), r"^[IMD]?\d+", 0)
    return F.struct(F.when(lead != "", lead).otherwise(_bare(raw)).alias("number"), guess.alias("axis"))


def dotted(raw: Column) -> Column:
    """CODE.NUMBER or CODE.NUMBER.KIND; null where the number has no such form."""
    c = F.upper(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?U)[\s\-]", ""))
    part = lambda k: F.regexp_extract(c, r"^([A-Z]{2})([0-9A-Z]+?)([A-Z][0-9]?)?$", k)
    return F.when(part(1) != "", F.concat_ws(".", part(1), part(2), F.nullif(part(3), F.lit(""))))


def dotted_variants(raw: Column) -> Column:
    """The dotted form, then the other spelling of US serials: pre-grant with six or seven digits, or without leading zeros."""
    d = dotted(raw)
    longer, shorter, padded = r"^(US\.\d{4})0(\d{6})(?=\.|$)", r"^(US\.\d{4})(\d{6})(?=\.|$)", r"^(US\.)0+([1-9]\d*)(?=\.|$)"
    head = F.substring(d, 1, 7)
    other = F.when(d.rlike(longer), F.regexp_replace(d, longer, "$1$2")).when(d.rlike(shorter), F.concat(head, F.lit("0"), F.substr(d, F.lit(8)))).when(d.rlike(padded), F.regexp_replace(d, padded, "$1$2"))
    return F.when(d.isNull(), F.array().cast("array<string>")).otherwise(F.array_compact(F.array(d, other)))


def unpadded(raw: Column) -> Column:
    """Code and serial without leading zeros; null unless the body is digits, perhaps behind I, M or D."""
    body = web_form(raw)["number"]
    return F.when(body.rlike(r"^[IMD]?\d+$"), F.concat(country(raw), F.regexp_replace(body, r"^0+(?=\d)", "")))
