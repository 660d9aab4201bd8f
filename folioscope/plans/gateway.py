"""What happens to one query before it runs: normalising, validating, folding dates, planning and expanding (driver side)."""

from __future__ import annotations

import json
import re
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

# Field tag at the end of a number query, a list of numbers, pages.
AXIS = re.compile(r"(?s)\s*(?P<body>.*?)\s*(?P<tag>@(?:PN|AN|PD))?\s*", re.I)
NUMBER_LIST = re.compile(r"^[\w\-/]+(\s+or\s+[\w\-/]+)*$", re.I)
DEFAULT_ROWS, SHORT_TERM = 30, 3
# Argument names that are never shown.
SECRET = ["password", "passwd", "secret", "token", "api_key", "apikey", "key", "consumer_key", "consumer_secret", "user_code", "usercode", "credential", "authorization", "auth", "owner_identity"]


class QueryError(ValueError):
    """A query that cannot mean what was intended."""


def date_digits(value) -> str | None:
    return re.sub(r"\D", "", str(value or "")) or None


def safe_int(value) -> int | None:
    try:
        return int(str(value).replace(",", ""))
    except ValueError:
        return None


def dig(node, *keys, default=""):
    """Nested value of dicts; the default where a key or a dict is missing."""
    for k in keys:
        node = node.get(k) if isinstance(node, dict) else None
    return default if node is None else node


def as_list(x) -> list:
    return [] if x is None else x if isinstance(x, list) else [x]


def closing(text: str) -> int:
    """Where the parenthesis that the text begins with is closed; -1 if it begins with none, or none closes it."""
    marks = [(m.start(), 1 if m.group() == "(" else -1) for m in re.finditer("[()]", text)] if text.startswith("(") else []
    return next((at for (at, _), open_ in zip(marks, accumulate(step for _, step in marks), strict=True) if not open_), -1)


def number_axis(keyword: str) -> dict:
    """A keyword as numbers, tag and wrapped: what is left of it, the field tag at its end, whether one pair of parentheses was around it all."""
    body, tag = AXIS.fullmatch(keyword).group("body", "tag")
    wrapped = bool(body) and closing(body) == len(body) - 1
    return {"numbers": body[1:-1].strip() if wrapped else body, "tag": tag, "wrapped": wrapped}


def clean_number_axis(keyword: str) -> tuple[str, list[str]]:
    """The keyword without a field tag at its end and without its outermost parentheses, and what went; else as it was."""
    axis = number_axis(keyword)
    gone = [x for x, there in ((axis["tag"], axis["tag"]), ("outer_parens", axis["wrapped"])) if there]
    return axis["numbers"] if gone else keyword, gone


def looks_like_numbers(keyword: str | None) -> bool:
    """Whether a query without hits was a list of numbers: it has a field tag, or is words joined by or, and a digit."""
    axis = number_axis((keyword or "").strip())
    return bool(axis["tag"]) or bool(NUMBER_LIST.match(axis["numbers"]) and re.search(r"\d", axis["numbers"]))


def _keyword(q: dict) -> str | None:
    """The keyword; on a number axis without what only forms take, and an error if then no list of numbers is left."""
    word = q.get("keyword")
    if not word or not (number_axis(word)["tag"] or str(q.get("keyword_field") or "").upper() == "PN"):
        return word
    numbers, gone = clean_number_axis(word)
    if gone and not NUMBER_LIST.match(numbers):
        raise QueryError(f"no list of numbers is left of {word!r}")
    return numbers


#: What each part of a query becomes; a rule sees the whole query.
RULES = {
    "keyword": _keyword,
    "keyword_field": lambda q: q.get("keyword_field") or "TI/AB",
    "num": lambda q: max(1, int(q.get("num") or DEFAULT_ROWS)),
    "skip": lambda q: max(0, int(q.get("skip") or 0)),
    "date_from": lambda q: date_digits(q.get("date_from")),
    "date_to": lambda q: date_digits(q.get("date_to")),
    "databases": lambda q: list(filter(None, (str(d).strip() for d in q.get("databases") or ()))) or None,
}


def normalise(**query) -> dict:
    """A query with trimmed strings (blank: None), at least one row, no negative skip, digits for dates, clean databases."""
    trimmed = {k: (v.strip() or None) if isinstance(v, str) else v for k, v in query.items()}
    return trimmed | {k: rule(trimmed) for k, rule in RULES.items() if k != "keyword" or k in trimmed}


def check_expression(text: str | None, fields: set[str]) -> str | None:
    """What is wrong with a field-qualified expression, else None: empty, parentheses, an unknown ``@FIELD[,FIELD]``."""
    if not text or not text.strip():
        return "empty"
    depth = 0
    for c in text:
        depth += (c == "(") - (c == ")")
        if depth < 0:
            return "unbalanced: closed too early"
    if depth:
        return "unbalanced: left open"
    for codes in re.findall(r"@([A-Za-z]+(?:,[A-Za-z]+)*)", text):
        for code in codes.upper().split(","):
            if code not in fields:
                return f"unknown field @{code}"
    return None


def fold_dates(expr: str, date_from: str | None, date_to: str | None) -> str:
    return f"({expr.strip()}) and ID={date_from or ''}:{date_to or ''}" if date_from or date_to else expr.strip()


def within(day: Column, date_from: str | None, date_to: str | None) -> Column:
    """Whether a date lies in a range with open ends; bounds are YYYY, YYYYMM or YYYYMMDD and hold their whole span."""
    digits = F.date_format(day, "yyyyMMdd")
    low = F.lit(True) if not date_from else digits >= date_from.ljust(8, "0")
    return low & (F.lit(True) if not date_to else digits <= date_to.ljust(8, "9"))


def full_text_query(uspc=None, cpc=None, ipc=None, keyword=None, applicant=None, date_from=None, date_to=None) -> str:
    """A query in the syntax of full-text services."""
    parts = [uspc if uspc and uspc.upper().startswith("CCL/") else uspc and f"CCL/{uspc}", cpc and f"CPC/{cpc}", ipc and f"IPC/{ipc}", keyword and f'"{keyword}"', applicant and f'"{applicant}".as.']
    bounds = "".join(f'{sign}"{d}"' for sign, d in ((">=", date_from), ("<=", date_to)) if d)
    return " AND ".join(filter(None, parts)) + (f" AND @pd{bounds}" if bounds else "")


def as_cql(text: str) -> str:
    """A query that has no CQL of its own, as one on title and abstract."""
    return text if re.search(r'\b\w+\s*(=|<=|>=|within\b|all\b|any\b)\s*"?', text) else 'ta="' + text.replace('"', "") + '"'


def name_prefix(column: Column, names: list[str]) -> Column:
    """Whether a name starts with one of the words, whatever its case."""
    up, out = F.upper(F.trim(column)), F.lit(False)
    for n in names:
        out = out | F.startswith(up, F.lit(n.upper()))
    return out


def match_plan(text: str) -> dict:
    """Words of three characters or more are looked up as quoted phrases, shorter ones scanned for."""
    words = text.split()
    long, short = ([w for w in words if (len(w) >= SHORT_TERM) is side] for side in (True, False))
    phrases = " AND ".join('"' + w.replace('"', '""') + '"' for w in long) or None
    return {"phrases": phrases, "terms": long, "short": short, "mode": "fts" if not short else "hybrid" if long else "like-scan"}


def facets(filters: dict | None = None, ranges: dict | None = None, sort: list | None = None, fields: list | None = None, facets: list | None = None, offset: int = 0, limit: int = 25) -> dict:
    """A faceted search as it is sent: at most 100 rows, no negative offset, only what was given."""
    body = {"pagination": {"offset": max(0, offset), "limit": min(max(1, limit), 100)}}
    given = {"filters": [{"name": k, "value": as_list(v)} for k, v in (filters or {}).items()], "rangeFilters": [{"field": k, "valueFrom": a, "valueTo": b} for k, (a, b) in (ranges or {}).items()], "sort": [{"field": f, "order": o} for f, o in sort or []], "fields": fields, "facets": facets}
    return body | {k: v for k, v in given.items() if v}


def checked(value, name: str, kind: type, low=None, high=None, choices=None):
    """A value that keeps its contract: type, range (length of strings) and choices; else QueryError."""
    if not isinstance(value, kind) or isinstance(value, bool) and kind is int:
        raise QueryError(f"{name}: {kind.__name__} wanted")
    size = len(value) if isinstance(value, str) else value
    if low is not None and size < low or high is not None and size > high or choices and value not in choices:
        raise QueryError(f"{name}: out of range")
    return value


#: How a value is shown, by the first of these types that it is of.
SHOWN = [
    (str, lambda v: v[:80] + "…" * (len(v) > 80)),
    ((int, float, type(None)), lambda v: v),
    ((list, tuple), lambda v: f"<{type(v).__name__} len={len(v)}>"),
    (dict, lambda v: f"<dict keys={len(v)}>"),
    (object, lambda v: f"<{type(v).__name__}>"),
]


def summarise(arguments: dict, cap: int = 300) -> str:
    """Arguments as a short JSON text: secrets masked, strings cut at 80, containers as their size, the whole at ``cap``."""
    shown = {k: "***" if k.lower() in SECRET else next(show for kind, show in SHOWN if isinstance(v, kind))(v) for k, v in arguments.items()}
    text = json.dumps(shown, ensure_ascii=False, default=str)
    return text[:cap] + "…" * (len(text) > cap)


def fetch_size(top_k: int, asked: int | None = None) -> int:
    """Candidates to retrieve for top_k (20 at most) results: four times as many, 50 at most; as asked up to 100."""
    return min(asked, 100) if asked else min(4 * min(top_k, 20), 50)


def expand(query: str, templates: list[str], n: int) -> list[str]:
    """The query and the first n - 1 templates, filled in."""
    return [query, *(t.format(query=query) for t in templates[: max(0, n - 1)])]
