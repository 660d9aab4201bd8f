"""Figures of a specification: those it refers to, missing drawings and sections, figures that nothing discusses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# References to figures, the sections that belong to them, and reference numerals, each in one piece.
FIGURE = r"(?i)FIGS?(?:URES?)?\.?\s*(\d+[A-Z]?(?:\([a-z]\))?(?:\s*-\s*\d+[A-Z]?)?)"
MENTION = r"FIG(?:URE)?\.?\s*"
DETAIL = r"(?i)DETAILED\s+DESCRIPTION"
BRIEF = {"us": r"(?i)BRIEF\s+DESCRIPTION\s+OF\s+(?:THE\s+)?DRAWINGS?", "ep": r"(?i)(?:brief\s+)?description\s+of\s+(?:the\s+)?(?:drawings?|figures?)"}
NUMERAL = (
    r"(?i)\b(?:element|component|module|system|device|unit|block|step|interface|engine|manager|entry|field|scope|layer|endpoint|queue|mark|panel|button|area|section|view|card|loop|method)\s+(\d{2,4})\b"
    r"|\b(\d{2,4})\s*(?:\([a-z]\))?(?:\s*,\s*\d{2,4})*\b"
)
SECTIONS = {
    "BACKGROUND": r"(?i)BACKGROUND(?:\s+OF)?(?:\s+THE)?(?:\s+INVENTION)?",
    "SUMMARY": r"(?i)(?:BRIEF\s+)?SUMMARY(?:\s+OF)?(?:\s+THE)?(?:\s+INVENTION)?",
    "BRIEF DESCRIPTION OF DRAWINGS": r"(?i)BRIEF\s+DESCRIPTION\s+OF\s+(?:THE\s+)?DRAWINGS?",
    "DETAILED DESCRIPTION": r"(?i)DETAILED\s+DESCRIPTION(?:\s+OF)?(?:\s+THE)?(?:\s+INVENTION)?",
}
NEAR = 500
#: A list of figures behind one mark: FIGS. 1-3, 5A and 7.
_LIST = r"(?i)FIGS?(?:URES?)?\.?\s*(\d+[A-Z]?(?:\([a-z]\))?(?:\s*(?:-|–|,|&|to|through|and|or)\s*(?:and\s+)?\d+[A-Z]?(?:\([a-z]\))?)*)"
_RANGE = r"^(\d+)[A-Z]?\s*(?:-|–|to|through)\s*(\d+)[A-Z]?$"
MOST_IN_RANGE = 1000


def referenced(text: Column) -> Column:
    """The distinct references to figures as written (1, 2A, 3-5), in order."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(FIGURE), F.lit(1))))


def numbers(text: Column) -> Column:
    """The distinct figures that lists and ranges of them name: FIGS. 1-3 and 5A are 1, 2, 3 and 5A.

    A range counts its whole numbers; one that falls, or is longer than MOST_IN_RANGE, stands for its two ends.
    """
    items = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(_LIST), F.lit(1)), lambda x: F.split(x, r"(?i)\s*(?:,|&|\band\b|\bor\b)\s*(?:and\s+)?")))
    ends = lambda x: [F.regexp_extract(x, _RANGE, k).cast("int") for k in (1, 2)]

    def spread(x: Column) -> Column:
        low, high = ends(x)
        tokens = F.split(x, r"(?i)\s*(?:-|–|to|through)\s*")
        count = F.transform(F.sequence(low, high), lambda n: n.cast("string"))
        # the ends keep their letters, between them stand whole numbers
        between = F.array_union(F.array_union(F.slice(tokens, 1, 1), F.slice(count, 2, MOST_IN_RANGE)), F.slice(tokens, 2, 1))
        between = F.filter(between, lambda t: (t == F.element_at(tokens, 2)) | (t != high.cast("string")))
        return F.when(x.rlike(_RANGE) & (low < high) & (high - low < MOST_IN_RANGE), between).otherwise(tokens)

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(items, spread)), lambda t: t != "")))


def missing_sections(text: Column, sections: dict[str, str] | None = None) -> Column:
    """Names of the required sections that a specification hasn't, in order."""
    return F.array_compact(F.array(*[F.when(~text.rlike(p), n) for n, p in (sections or SECTIONS).items()]))


def coverage(text: Column) -> Column:
    """(figure, discussed, numerals) of every reference: whether the detailed description mentions it, and has a
    reference numeral from the mention to NEAR characters behind it.  None without a detailed description.

    A mention takes the characters behind it along without passing over them, so mentions that are close have each its own.
    """
    start = F.regexp_instr(text, F.lit(DETAIL))
    detail = F.when(start > 0, F.substr(text, start))

    def one(figure: Column) -> Column:
        pattern = F.concat(F.lit(f"(?si){MENTION}"), F.regexp_replace(figure, r"([^0-9A-Za-z])", r"\\$1"), F.lit(rf"\b(?=(.{{0,{NEAR}}}))"))
        found = F.arrays_zip(F.regexp_extract_all(detail, pattern, F.lit(0)).alias("all"), F.regexp_extract_all(detail, pattern, F.lit(1)).alias("after"))
        return F.struct(figure.alias("figure"), (F.size(found) > 0).alias("discussed"), F.exists(found, lambda x: F.concat(x["all"], x["after"]).rlike(NUMERAL)).alias("numerals"))

    return F.when(start > 0, F.transform(referenced(text), one))


def drawing_issues(text: Column, drawings: Column, office: str = "us") -> Column:
    """(severity, problem, figure) of a specification: drawings that aren't there, no section that lists the figures, and, in the
    United States, figures that the detailed description doesn't discuss (WARNING) or without numerals (INFO)."""
    issue = lambda test, severity, problem: F.when(test, F.struct(F.lit(severity).alias("severity"), F.lit(problem).alias("problem"), F.lit(None).cast("string").alias("figure")))
    some = F.size(referenced(text)) > 0
    out = F.array_compact(F.array(issue(some & ~drawings, "CRITICAL", "no_drawings"), issue(some & ~text.rlike(BRIEF[office]), "CRITICAL", "no_brief_description")))
    if office != "us":
        return out
    bad = F.filter(coverage(text), lambda x: ~x["discussed"] | ~x["numerals"])
    said = F.transform(bad, lambda x: F.struct(F.when(x["discussed"], "INFO").otherwise("WARNING").alias("severity"), F.when(x["discussed"], "no_numerals").otherwise("not_discussed").alias("problem"), x["figure"].alias("figure")))
    return F.concat(out, F.coalesce(said, F.slice(out, 1, 0)))
