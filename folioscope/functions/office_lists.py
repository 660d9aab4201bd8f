"""Result lists of a publication office in three layouts: table rows, cards with abstracts, bare links; the first that has hits counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Numbers, what marks the search form's own rows, labels of a card, and what links to a record have in them.
ROW_NUMBER = r"(?i)(CN\s*\d{9,}[A-Z]\s*|ZL\s*\d{9,}\.\d+)"
LINK_NUMBER = r"(?i)(CN\s*\d{9,}[A-Z]?|ZL\s*\d{9,}\.\d+)"
FORM_ROWS = ["indexquery", "searchstr"]
CARD_NUMBER = r"(?i)(?:申请公布号|授权公告号)[：:]\s*</dt>\s*<dd>([^<]+?)</dd>"
CARD_ABSTRACT = r"(?is)<dt[^>]*>\s*摘要\s*[：:]\s*</dt>\s*<dd[^>]*>(.*?)</dd>"
RECORD_LINKS = ["/dxb/", "/sw/", "/patent/", "detail", "show"]


def _some(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    return _some(F.regexp_extract(text, pattern, group))


def _plain(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def _number(text: Column, pattern: str) -> Column:
    return _some(F.replace(F.regexp_extract(text, pattern, 1), F.lit(" "), F.lit("")))


def absolute(link: Column, base: str) -> Column:
    """A link with the site's address where it has none."""
    return F.when(link.rlike("^https?://"), link).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, "^/+", "")))


def _hit(title: Column, number: Column, link: Column, abstract: Column | None = None) -> Column:
    return F.struct(title.alias("title"), number.alias("pub_number"), link.alias("link"), (abstract if abstract is not None else F.lit(None).cast("string")).alias("abstract"))


def _firsts(hits: Column, key) -> Column:
    """Each key's first hit, in order."""

    def once(bound: Column) -> Column:
        keys = F.transform(bound, key)
        return F.filter(bound, lambda h, i: F.array_position(keys, key(h)) == i + 1)

    return F.transform(F.array(hits), once)[0]


def table_hits(html: Column, base: str) -> Column:
    """Hits of table rows; the form's rows, and short ones without a number, are none."""

    def one(row: Column) -> Column:
        title = F.coalesce(_found(row, r'(?i)title="([^"]+)"'), _found(row, r">([^<]{6,200})<"), _some(F.substring(_plain(row), 1, 200)))
        return F.struct(_hit(title, _number(row, ROW_NUMBER), absolute(_found(row, r'href="([^"]+)"'), base)).alias("h"), F.length(_plain(row)).alias("n"), F.substring(row, 1, 80).alias("raw"))

    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    rows = F.filter(rows, lambda r: ~(F.contains(F.lower(r), F.lit(FORM_ROWS[0])) | F.contains(F.lower(r), F.lit(FORM_ROWS[1]))))
    hits = F.filter(F.transform(rows, one), lambda x: (x["n"] >= 8) | x["h"]["pub_number"].isNotNull())
    return F.transform(_firsts(hits, lambda x: F.coalesce(x["h"]["pub_number"], x["h"]["title"], x["raw"])), lambda x: x["h"])


def card_hits(html: Column, base: str) -> Column:
    """Hits of cards: title, number, the link on the card or made of its number, abstract of four characters or more."""

    def one(card: Column) -> Column:
        title = _some(F.regexp_replace(F.regexp_extract(card, r'(?is)<h1\s+class="title">\s*([^<]+?)\s*</h1>', 1), r"\s+", " "))
        said = _number(card, CARD_NUMBER)
        said = F.when(said.rlike("(?i)^(?:CN|ZL)"), said)
        there = _found(card, r'(?i)title="(https?://[^"/]+/patent/[^"]+)"')
        link = F.coalesce(there, F.concat(F.lit(base.rstrip("/") + "/patent/"), said))
        abstract = _plain(F.regexp_extract(card, CARD_ABSTRACT, 1))
        return _hit(title, F.coalesce(said, _found(link, r"(?i)/patent/((?:CN|ZL)[^/?#]+)")), link, F.when(F.length(abstract) >= 4, abstract))

    cards = F.slice(F.split(html, r'(?i)<div\s+class="item"\s*>'), 2, 1 << 30)
    hits = F.filter(F.transform(cards, one), lambda h: F.coalesce(h["title"], h["pub_number"], h["link"]).isNotNull())
    return _firsts(hits, lambda h: F.coalesce(h["pub_number"], h["link"], F.substring(h["title"], 1, 120)))


def link_hits(html: Column, base: str) -> Column:
    """Hits of links that lead to a record, by their address or the site's name."""
    site = base.split("//")[-1].strip("/")

    def one(link: Column) -> Column:
        href, title = _found(link, r'(?is)href="([^"]+)"'), _some(F.regexp_extract(link, r"(?is)>([^<]*)</a>", 1))
        return _hit(title, _number(F.concat(F.coalesce(href, F.lit("")), F.coalesce(title, F.lit(""))), LINK_NUMBER), href)

    def record(h: Column) -> Column:
        low = F.lower(h["link"])
        there = F.startswith(h["link"], F.lit("/")) | F.contains(h["link"], F.lit(site))
        leads = F.contains(low, F.lit(RECORD_LINKS[0]))
        for part in RECORD_LINKS[1:]:
            leads = leads | F.contains(low, F.lit(part))
        own = F.contains(h["link"], F.lit("indexForm")) | F.contains(low, F.lit("javascript:")) | (F.contains(low, F.lit("article")) & F.contains(low, F.lit("indexquery")))
        return F.coalesce(there & leads & ~own & ((F.length(h["title"]) >= 2) | h["pub_number"].isNotNull()), F.lit(False))

    found = F.filter(F.transform(F.regexp_extract_all(html, F.lit(r'(?is)<a\s+[^>]*href="[^"]+"[^>]*>[^<]*</a>'), F.lit(0)), one), record)
    full = F.transform(found, lambda h: _hit(h["title"], h["pub_number"], absolute(h["link"], base)))
    return _firsts(full, lambda h: F.coalesce(h["link"], h["title"], F.lit("")))


def hits(html: Column, base: str) -> Column:
    """title, pub_number, link, abstract of a page's hits, each once, from the first layout that has any."""
    table, cards = table_hits(html, base), card_hits(html, base)
    return F.when(F.size(table) > 0, table).when(F.size(cards) > 0, cards).otherwise(link_hits(html, base))
