"""Texts of records: claim 1, boilerplate, entities, tokens that are numbers, dates and years."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers of claim blocks that aren't a claim.
BOILERPLATE = ["what is claimed is", "we claim", "i claim", "claims", "the claims", "what i claim", "what we claim", "what is claimed", "what we claim is", "what i claim is"]
# How claim 1 is found, the first that matches counts.
CLAIM1 = [r"(?s)1\.\s+(.*?)(?=\s+2\.\s+|\n2\.)", r"(?s)1\.\s+(.*)", r"(?s)1[\.、](.*?)(?=\s*2[\.、]|\n2[\.、])", r"(?s)1[\.、](.*)"]
# Entities; the ampersand is the last to be replaced.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&amp;": "&"}
# Numbers in running text; a Taiwanese kind letter is tried before the country code.
COUNTRY = r"(?:TW[IMD]|[A-Z]{2})"
NUMBER = rf"(?<![A-Z0-9])({COUNTRY}\d{{6,}}(?:[A-Z]\d?)?)"
KINDED = rf"^{COUNTRY}\d{{6,}}[A-Z]\d?$"
APPLICATION = rf"^(?:{COUNTRY}\d{{6,}}(?:\.\d+)?|\d{{7,}}(?:\.\d+)?)$"
MARKED = rf"\b({COUNTRY}\d{{6,}}[A-Z]?\d?)\b"


def unescape(text: Column) -> Column:
    """Named entities and the apostrophe's number as characters."""
    return reduce(lambda c, e: F.replace(c, F.lit(e), F.lit(ENTITIES[e])), ENTITIES, text)


def plain_lines(html: Column) -> Column:
    """A fragment without tags and entities; blanks collapse, newlines stay."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]+>", " ")), r"[ \t\r\f ]+", " "))


def claim1(text: Column, full: bool = True) -> Column:
    """Claim 1 of a claims text on one line; the whole text where no claim is numbered, a note where there is none."""
    t = F.trim(text)
    found = [F.when(t.rlike(p), F.trim(F.regexp_replace(F.regexp_extract(t, p, 1), r"\s+", " "))) for p in CLAIM1]
    out = F.coalesce(*found, t)
    if not full:
        out = F.when(F.length(out) > 1000, F.concat(F.trim(F.substring(out, 1, 1000)), F.lit("..."))).otherwise(out)
    return F.when(F.coalesce(text, F.lit("")) == "", "Claim 1 not found.").otherwise(out)


def claim1_empty(text: Column) -> Column:
    """Whether a claim 1 is blank, or a header alone, whatever its punctuation."""
    norm = F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " ")), r"^[ :：.。,，;；\-—]+|[ :：.。,，;；\-—]+$", ""))
    return (norm == "") | norm.isin(BOILERPLATE)


def first_claim(claims: Column) -> Column:
    """The first of a list of claims that isn't boilerplate; null without one."""
    return F.try_element_at(F.filter(claims, lambda c: ~claim1_empty(c)), F.lit(1))


def numbers(text: Column) -> Column:
    """Publication numbers in a text, in order."""
    return F.regexp_extract_all(text, F.lit(NUMBER), F.lit(1))


def identity(found: Column, core: Column) -> Column:
    """true or false: whether the ids that a file shows hold the wanted digits; null (unknown) if it shows none."""
    return F.when(F.size(found) > 0, F.exists(found, lambda x: F.regexp_replace(x, r"\D", "") == core))


def date_digits(value: Column) -> Column:
    """Digits of a date; null if there are none."""
    return F.nullif(F.regexp_replace(value, r"\D", ""), F.lit(""))


def date_text(day: Column) -> Column:
    """YYYY-MM-DD of a number YYYYMMDD; other lengths as they are, 0 as null."""
    s = day.cast("string")
    return F.when(day == 0, None).when(F.length(s) == 8, F.concat_ws("-", F.substring(s, 1, 4), F.substring(s, 5, 2), F.substring(s, 7, 2))).otherwise(s)


def year(day: Column, number: Column) -> Column:
    """First four characters of a date, else the first year from 1900 to 2099 in a number."""
    there = F.regexp_extract(number, r"(20\d{2}|19\d{2})", 1)
    return F.when(F.length(day) >= 4, F.substring(day, 1, 4)).otherwise(F.nullif(there, F.lit("")))


def markdown(number: Column, abstract: Column, claims: Column, description: Column) -> Column:
    """A document of a record; claims: list of (num, text)."""
    listed = F.array_join(F.transform(claims, lambda c: F.concat(c["num"].cast("string"), F.lit(". "), c["text"])), "\n")
    return F.concat(F.lit("# "), number, F.lit("\n\n## Abstract\n"), abstract, F.lit("\n\n## Claims\n"), listed, F.lit("\n\n## Description\n"), description, F.lit("\n"))


def _without_kind(body: Column) -> Column:
    return F.regexp_replace(body, r"[A-Z]\d?$", "")


def epodoc(number: Column) -> Column:
    """Reference form of a publication number by its country's rules; null where it isn't one."""
    cc, body = F.substring(number, 1, 2), F.substring(number, 3, 100)
    digits = _without_kind(body)
    plain = digits.rlike(r"^\d+$")
    us = F.when(body.rlike(r"^[A-Za-z]{2}."), F.concat(F.substring(body, 1, 2), _without_kind(F.substring(body, 3, 100))))
    us = us.when(~plain, number).when(F.length(digits) == 11, F.concat(F.lit("US"), F.substring(digits, 1, 4), F.substring(digits, 6, 100)))
    us = us.when((F.length(digits) == 10) & F.startswith(digits, F.lit("20")), F.concat(F.lit("US"), digits)).otherwise(F.concat(F.lit("US"), F.regexp_replace(digits, r"^0+(?=\d)", "")))
    cn = F.concat(F.lit("CN"), digits, F.when(plain & (F.length(digits) == 9) & F.startswith(digits, F.lit("2")), "U").otherwise(""))
    tw = F.when(body.rlike(r"^I\d+$"), F.concat(F.lit("TW"), body, F.lit("B"))).when(body.rlike(r"^M\d+$"), F.concat(F.lit("TW"), body, F.lit("U"))).otherwise(F.concat(F.lit("TW"), digits))
    return F.when(number.rlike(r"^[A-Z]{2,5}\w{4,}$"), F.when(cc == "US", us).when(cc == "CN", cn).when(cc == "TW", tw).otherwise(F.concat(cc, digits)))


def counts_by_name(text: Column) -> Column:
    """name -> count of ``name (1,234)`` items; the last of a name counts."""
    items = F.regexp_extract_all(text, F.lit(r"([^\s<>()]+\s*\(\s*[\d,]*\d[\d,]*\s*\))"), F.lit(1))
    pairs = F.transform(items, lambda x: F.struct(F.regexp_extract(x, r"^([^\s<>()]+)", 1), F.replace(F.regexp_extract(x, r"\(\s*([\d,]+)", 1), F.lit(","), F.lit("")).cast("long")))
    return F.map_from_entries(F.reverse(F.array_distinct(F.transform(pairs, lambda p: F.struct(p["col1"].alias("key"), p["col2"].alias("value"))))))


def result_count(html: Column) -> Column:
    """The number between 共 and 筆, whatever tags are around it; null without such a line."""
    return F.nullif(F.replace(F.regexp_extract(html, r"共[\s:：]*(?:<[^>]+>\s*)*([\d,]+)\s*(?:</[^>]+>\s*)*\s*筆", 1), F.lit(","), F.lit("")), F.lit("")).cast("long")
