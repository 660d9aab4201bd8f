"""HTML scalars as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(html: Column) -> Column:
    """Text of a page: script and style bodies and tags go, white space folds to one space."""
    bare = F.regexp_replace(html, r"(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"[ \t\n\r]+", " "))


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def abstract(html: Column) -> Column:
    """The description meta tag, else the article's text."""
    meta = F.regexp_extract(html, r'<meta name="description" content="([^"]*)"', 1)
    return F.coalesce(F.nullif(meta, F.lit("")), strip(F.regexp_extract(html, r"(?s)<article[^>]*>(.*?)</article>", 1)))


_CLAIM = r'<div\s+id="[^"]*"\s+num="(\d+)"\s+class="claim">'


def claims(html: Column) -> Column:
    """(num, text) of every claim of a page's claims section; claims without text are left out."""
    section = F.regexp_extract(html, r'(?s)itemprop="claims"[^>]*>(.*?)</section>', 1)
    bodies = F.split(section, _CLAIM.replace("(", "").replace(")", ""))
    nums = F.regexp_extract_all(section, F.lit(_CLAIM), F.lit(1))
    rows = F.transform(nums, lambda n, i: F.struct(n.cast("int").alias("num"), strip(F.get(bodies, i + 1)).alias("text")))
    return F.filter(rows, lambda c: c["text"] != "")


def description(html: Column) -> Column:
    """Text of a page's description section, empty without one."""
    return strip(F.regexp_extract(html, r'(?s)itemprop="description"[^>]*>(.*?)</section>', 1))


def pdf_link(html: Column) -> Column:
    """The page's link to its document; null without one, or for a guessed one: in a folder pdfs, with a last part under 20 characters."""
    url = F.nullif(F.regexp_extract(html, r'<meta\s+name="citation_pdf_url"\s+content="([^"]+)"', 1), F.lit(""))
    guessed = F.contains(url, F.lit("/pdfs/")) & (F.length(F.substring_index(url, "/", -1)) < 20)
    return F.when(~guessed, url)


def link_of(html: Column, number: Column) -> Column:
    """The address of the page's first link whose text has the digits of a number; null without one, whatever place it has."""
    digits = lambda c: F.regexp_replace(F.regexp_replace(c, r"\D", ""), "^0+", "")
    anchors = F.regexp_extract_all(html, F.lit(r'(?is)<a\s[^>]*href="?[^\s">]+"?[^>]*>.*?</a>'), F.lit(0))
    wanted = F.filter(anchors, lambda a: (digits(number) != "") & (digits(F.regexp_replace(a, r"<[^>]+>", " ")) == digits(number)))
    return F.nullif(F.regexp_extract(F.get(wanted, F.lit(0)), r'(?i)href="?([^\s">]+)', 1), F.lit(""))
