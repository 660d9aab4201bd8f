"""Result pages whose rows and cells are often not closed: rows of a list, labelled records, mark lists and page totals.

Pages part at opening tags.  A cell's meaning comes from the shape of its text, never from its place, so columns may be in any order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.patent_text import APPLICATION, KINDED, NUMBER

# What marks a record's row, an empty mark list, and the labels of a record.
ROW_MARK = "clickselect(this"
EMPTY_MARKS, RESULTS = "無標記資料", "檢索結果"
LABELS = {"pat_no": "公開公告號", "apply_no": "申請號", "apply_date": "申請日", "title": "專利名稱", "abstract": "摘要"}
# Shapes of cells, tried in this order.
MARKED = r"^(?:TW[IMD]|[A-Z]{2})\d{6,}[A-Z]?\d?$"
DATE, SLASHED = r"^\d{4}[/-]\d{2}[/-]\d{2}$", r"^\d{4}/\d{2}/\d{2}$"
SCRIPT_TEXT = r"^\s*(?:function|var |window\.|if\s*\()"
# Totals of a page; numbers stand in elements of class numfmt.
TOTAL = r"(?s)共.*?numfmt[^>]*>\s*(\d[\d,]*)\s*<.*?筆"
PAGE_OF = r"(?s)第.*?numfmt[^>]*>\s*(\d+)\s*<.*?/.*?numfmt[^>]*>\s*(\d+)\s*<"
FAMILIES = r"(?s)專利家族數量.*?numfmt[^>]*>\s*(\d+)\s*<"
COUNT = r"檢索結果[：:]\s*共\s*(\d+)\s*筆"


def _plain(html: Column, gap: str = " ") -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", gap), r"\s+", " "))


def _opened(html: Column, tag: str) -> Column:
    """The pieces of html that begin with an opening tag."""
    return F.filter(F.split(html, rf"(?=<{tag}[\s>])"), lambda x: x.rlike(rf"^<{tag}[\s>]"))


def _first(cells: Column, *kinds: str) -> Column:
    return F.get(F.filter(cells, lambda c: c["kind"].isin(*kinds)), F.lit(0))["text"]


def _shape(text: Column) -> Column:
    kinds = [("ordinal", r"^\d+$"), ("member", r"^\d+\.\d+$"), ("date", DATE), ("kinded", KINDED), ("application", APPLICATION), ("figures", r"^[\d/\-.]+$")]
    out = None
    for kind, pattern in kinds:
        out = (F if out is None else out).when(text.rlike(pattern), kind)
    return out.when(F.length(text) > 4, "words").otherwise("short")


def _record(row: Column) -> Column:
    bare = F.regexp_replace(row, r"(?s)<script[^>]*>.*?</script>", " ")
    texts = F.filter(F.transform(_opened(bare, "td"), lambda c: _plain(c)), lambda t: (t != "") & ~t.rlike(SCRIPT_TEXT))
    cells = F.transform(texts, lambda t: F.struct(_shape(t).alias("kind"), t.alias("text")))
    number = F.coalesce(_first(cells, "kinded"), F.nullif(F.regexp_extract(bare, NUMBER, 1), F.lit("")))
    other = F.filter(cells, lambda c: ~c["text"].eqNullSafe(number))
    words = F.filter(other, lambda c: c["kind"] == "words")
    sequence, member = _first(cells, "ordinal"), _first(cells, "member")
    return F.struct(
        sequence.alias("seq"), F.coalesce(F.substring_index(member, ".", 1), sequence).alias("family_group"), number.alias("pat_no"), _first(other, "application").alias("apply_no"),
        _first(cells, "date").alias("apply_date"), F.get(words, F.lit(0))["text"].alias("title"), F.when(F.size(words) > 1, F.element_at(words, -1)["text"]).alias("abstract"), texts.alias("cells"),
    )


def list_rows(html: Column) -> Column:
    """seq, family_group, pat_no, apply_no, apply_date, title, abstract, cells of every record of a result list.

    A row is what stands from one ``<tr`` to the next and has a record's mark.  Scripts in cells aren't text.  A member number ``N.M``
    puts the row in family N, else the row is a family of its own.
    """
    return F.transform(F.filter(_opened(html, "tr"), lambda x: F.contains(x, F.lit(ROW_MARK))), _record)


def labelled_rows(html: Column) -> Column:
    """The same of pages that show each record as labelled fields; a field is found by its label, the last one of a label counts."""
    label, value = r'<td class="?sumth1"?[^>]*>\s*([^<]+?)\s*</td>\s*<td[^>]*>', r"(.*?)(?=<tr[\s>]|<td class=\"?sumth1|</table)"

    def record(part: Column) -> Column:
        both = [F.regexp_extract_all(part, F.lit(f"(?s){label}{value}"), F.lit(k)) for k in (1, 2)]
        pairs = F.filter(F.arrays_zip(F.transform(both[0], lambda c: F.trim(c)).alias("label"), F.transform(both[1], lambda c: _plain(c)).alias("value")), lambda p: p["value"] != "")
        field = {k: F.try_element_at(F.filter(pairs, lambda p: p["label"] == name), F.lit(-1))["value"] for k, name in LABELS.items()}  # noqa: B023
        sequence = F.nullif(F.regexp_extract(part, r'class="?link602"?[^>]*>\s*(\d+)\s*<', 1), F.lit(""))
        number = F.nullif(F.regexp_extract(field["pat_no"], r"[A-Z]{2}[0-9][0-9A-Z]{5,}", 0), F.lit(""))
        apply = F.nullif(F.regexp_replace(F.regexp_extract(field["apply_no"], r"[A-Z]{2}\s*[0-9][0-9A-Z.\-]*", 0), r"\s+", ""), F.lit(""))
        cells = F.transform(pairs, lambda p: F.concat(p["label"], F.lit(": "), p["value"]))
        return F.struct(
            sequence.alias("seq"), sequence.alias("family_group"), number.alias("pat_no"), F.coalesce(apply, F.substring_index(field["apply_no"], " ", 1)).alias("apply_no"),
            field["apply_date"].alias("apply_date"), field["title"].alias("title"), field["abstract"].alias("abstract"), cells.alias("cells"),
        )

    parts = F.split(html, r'(?=<table class="?sumtab"?)')
    return F.transform(F.filter(parts, lambda x: F.contains(x, F.lit(ROW_MARK))), record)


def result_rows(html: Column) -> Column:
    """Records of a page of either kind."""
    return F.when(F.contains(html, F.lit(LABELS["pat_no"])), labelled_rows(html)).otherwise(list_rows(html))


def page_totals(html: Column) -> Column:
    """total (0 without one), page and pages (1), families (null) of a result page."""
    n = lambda pattern, k=1: F.nullif(F.replace(F.regexp_extract(html, pattern, k), F.lit(","), F.lit("")), F.lit("")).cast("long")
    return F.struct(F.coalesce(n(TOTAL), F.lit(0)).alias("total"), F.coalesce(n(PAGE_OF), F.lit(1)).alias("page"), F.coalesce(n(PAGE_OF, 2), F.lit(1)).alias("pages"), n(FAMILIES).alias("families"))


def mark_list(html: Column) -> Column:
    """count, is_empty and rows (seq, apply_date, pub_date, apply_no, pub_no, cells) of a list of marks.

    A page that says there are no marks, and doesn't name results, is an empty shell.  Rows here are closed; a row without a number
    isn't a record.  The first two dates and the first two numbers are those of application and publication.
    """
    shell = F.contains(html, F.lit(EMPTY_MARKS)) & ~F.contains(html, F.lit(RESULTS))
    cells = lambda row: F.transform(F.regexp_extract_all(row, F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)), lambda c: F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", ""), r"^\s+|\s+$", ""))
    rows = F.transform(F.regexp_extract_all(html, F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)), cells)
    like = lambda c, pattern: F.filter(c, lambda x: x.rlike(pattern))
    at = lambda c, k: F.get(c, F.lit(k))

    def record(c: Column) -> Column:
        dates, numbers = like(c, SLASHED), like(c, MARKED)
        return F.struct(F.when(at(c, 0).rlike(r"^\d+$"), at(c, 0)).alias("seq"), at(dates, 0).alias("apply_date"), at(dates, 1).alias("pub_date"), at(numbers, 0).alias("apply_no"), at(numbers, 1).alias("pub_no"), c.alias("cells"))

    found = F.transform(F.filter(rows, lambda c: F.size(like(c, MARKED)) > 0), record)
    found = F.when(shell, F.slice(found, 1, 0)).otherwise(found)
    said = F.when(shell, 0).otherwise(F.coalesce(F.nullif(F.regexp_extract(html, COUNT, 1), F.lit("")).cast("int"), F.lit(0)))
    return F.struct(F.when(said > 0, said).otherwise(F.size(found)).alias("count"), ((said == 0) & (F.size(found) == 0)).alias("is_empty"), found.alias("rows"))
