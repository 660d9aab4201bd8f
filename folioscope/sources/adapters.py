"""Adapters from the nested answers of search services to flat records; what a source lacks stays empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.patent_text import claim1_empty

#: Class codes that a record keeps of a list.
CODES = 6
FIELDS = ["pubno", "appno", "title", "abstract", "claim1", "family_id", "cpc", "ipc", "prio_date", "app_date", "pub_date", "grant_date", "assignee", "inventor"]


def text(node: Column, *paths: str) -> Column:
    """First non-empty string under the paths, else empty."""
    got = [F.nullif(F.try_variant_get(node, p, "string"), F.lit("")) for p in paths]
    return F.coalesce(*got, F.lit(""))


def many(node: Column, path: str) -> Column:
    """What stands under a path as a list: one value is a list of one, nothing an empty list."""
    one = F.try_variant_get(node, path, "variant")
    return F.coalesce(F.try_variant_get(node, path, "array<variant>"), F.when(one.isNotNull() & ~F.is_variant_null(one), F.array(one)), F.array().cast("array<variant>"))


def joined(node: Column, *paths: str, sep: str = "; ", most: int | None = None) -> Column:
    """Strings of the first path with anything, joined."""
    out = F.lit("")
    for p in reversed(paths):
        items = many(node, p)
        items = F.slice(items, 1, most) if most else items
        here = F.array_join(F.transform(items, lambda x: F.try_variant_get(x, "$", "string")), sep)
        out = F.when(here != "", here).otherwise(out)
    return out


def named(node: Column, path: str, *keys: str, most: int | None = None) -> Column:
    """Like joined, for items that are strings or objects with the string under one of the keys."""
    items = many(node, path)
    items = F.slice(items, 1, most) if most else items
    of = F.transform(items, lambda x: F.coalesce(*[F.nullif(F.try_variant_get(x, f"$['{k}']", "string"), F.lit("")) for k in keys], F.try_variant_get(x, "$", "string"), F.lit("")))
    return F.array_join(F.filter(of, lambda x: (x != "") & ~F.startswith(x, F.lit("{"))), "; ")


def _records(df: DataFrame, items: Column, columns) -> DataFrame:
    """One row per item with the given columns and all other fields empty."""
    found = df.select(F.explode(items).alias("r"))
    have = columns(F.col("r"))
    return found.select(*[have.get(f, F.lit("")).alias(f) for f in [*FIELDS, *(k for k in have if k not in FIELDS)]])


def office_records(df: DataFrame, answer: str) -> DataFrame:
    """Records of a national office's answers (JSON text), whose nodes are objects or lists of them."""

    def columns(r: Column) -> dict[str, Column]:
        first = F.try_element_at(many(r, "$.claims.claim"), F.lit(1))
        claim = F.coalesce(F.nullif(F.array_join(F.transform(many(first, "$['claim-text']"), lambda x: F.try_variant_get(x, "$", "string")), " "), F.lit("")), F.when(F.schema_of_variant(first) == "STRING", F.try_variant_get(first, "$", "string")), F.lit(""))
        prio = F.try_element_at(many(r, "$['priority-claims']['priority-claim']"), F.lit(1))
        codes = lambda kind: named(r, f"$['classifications-{kind}'].{kind}", "keyValue", most=CODES)
        return {
            "pubno": text(r, "$['publication-reference']['doc-number']"), "appno": text(r, "$['application-reference']['doc-number']"),
            "title": text(r, "$['patent-title']['english-title']", "$['patent-title']['chinese-title']"), "abstract": joined(r, "$.abstract.p", sep=" "),
            "claim1": claim, "claim1_empty": claim1_empty(claim), "cpc": codes("cpc"), "ipc": codes("ipc"),
            "prio_date": F.coalesce(F.try_variant_get(prio, "$.date", "string"), F.when(F.schema_of_variant(prio) == "STRING", F.try_variant_get(prio, "$", "string")), F.lit("")),
            "app_date": text(r, "$['application-reference'].date"), "pub_date": text(r, "$['publication-reference'].date"),
            "assignee": named(r, "$.parties.applicants.applicant", "english-name", "name"), "inventor": named(r, "$.parties.inventors.inventor", "english-name", "name"),
        }

    node = F.try_parse_json(F.col(answer))
    wrapped, bare = many(node, "$.data['gpss-API'].patent.patentcontent"), many(node, "$['gpss-API'].patent.patentcontent")
    return _records(df, F.when(F.size(wrapped) > 0, wrapped).otherwise(bare), columns)


def web_records(df: DataFrame, answer: str) -> DataFrame:
    """Records of a web search's hits (a JSON list); the snippet, unescaped, stands for the abstract."""
    from folioscope.functions.patent_text import unescape

    def columns(r: Column) -> dict[str, Column]:
        return {"pubno": text(r, "$.publication_number"), "title": text(r, "$.title"), "abstract": unescape(text(r, "$.snippet")), "prio_date": text(r, "$.priority_date"), "app_date": text(r, "$.filing_date"), "pub_date": text(r, "$.publication_date"), "grant_date": text(r, "$.grant_date"), "assignee": text(r, "$.assignee"), "inventor": text(r, "$.inventor")}

    return _records(df, many(F.try_parse_json(F.col(answer)), "$"), columns)


def full_text_records(df: DataFrame, answer: str) -> DataFrame:
    """Records of a full-text service's answers: numbers, names and codes come under several names, single or as lists."""

    def columns(r: Column) -> dict[str, Column]:
        plain = F.trim(F.regexp_replace(F.regexp_replace(joined(r, "$.abstractHtml", "$.abstractText", sep=" "), r"<[^>]+>", " "), r"\s+", " "))
        return {
            "pubno": text(r, "$.publicationReferenceDocumentNumber", "$.patentNumber", "$.guid"), "appno": text(r, "$.applicationNumberText"), "title": text(r, "$.inventionTitle", "$.title"),
            "abstract": plain, "cpc": joined(r, "$.cpcCombinationClassificationText", "$.cpcAdditionalFlattened", most=CODES), "ipc": joined(r, "$.ipcCodeFlattened", most=CODES),
            "uspc": joined(r, "$.uspcFullClassificationFlattened", most=CODES), "app_date": text(r, "$.applicationFilingDate"), "pub_date": text(r, "$.datePublished", "$.publicationDate"),
            "grant_date": text(r, "$.grantDate"), "assignee": joined(r, "$.applicantName", "$.assigneeEntityName"), "inventor": joined(r, "$.inventorsShort", "$.inventorName"),
        }

    node = F.try_parse_json(F.col(answer))
    a, b = many(node, "$.patents"), many(node, "$.docs")
    return _records(df, F.filter(F.when(F.size(a) > 0, a).otherwise(b), lambda x: F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))), columns)


def biblio_record(df: DataFrame, pubno: str, biblio: str) -> DataFrame:
    """One record per (number, bibliographic JSON): title, abstract, applicants and the first codes."""
    node = F.try_parse_json(F.col(biblio))
    have = {"pubno": F.col(pubno), "title": text(node, "$.title"), "abstract": text(node, "$.abstract"), "ipc": joined(node, "$.ipc", most=CODES), "assignee": joined(node, "$.applicants")}
    return df.select(*[have.get(f, F.lit("")).alias(f) for f in FIELDS])


def hit_rows(df: DataFrame, answer: str, images: str = "") -> DataFrame:
    """Flat rows of a clustered hit list (clusters of results, each with a patent), with urls derived from file names."""
    clusters = many(F.try_parse_json(F.col(answer)), "$.results.cluster")
    results = df.select(F.explode(F.flatten(F.transform(clusters, lambda c: many(c, "$.result")))).alias("r"))
    names = ["publication_number", "title", "snippet", "priority_date", "filing_date", "publication_date", "grant_date", "inventor", "assignee", "language"]
    value = lambda n: F.try_variant_get("r", f"$.patent.{n}", "string")
    url = lambda n: F.when(F.coalesce(value(n), F.lit("")) != "", F.concat(F.lit(images), value(n)))
    cols = [F.trim(F.coalesce(value(n), F.lit(""))).alias(n) if n in ("title", "snippet") else value(n).alias(n) for n in names]
    figures = F.size(many(F.col("r"), "$.patent.figures")).alias("num_figures")
    return results.select(F.try_variant_get("r", "$.rank", "int").alias("rank"), *cols, url("thumbnail").alias("figure_url"), url("pdf").alias("pdf_url"), figures)
