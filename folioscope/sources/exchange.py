"""Nested answers of an exchange service: bibliographic data, families, id-to-family blocks, and the text of any nested value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.sources.adapters import many
from folioscope.sources.tables import checkpointed

IPC_MOST = 8
#: Characters of a block that are its head, and that can hold its own numbers.
HEAD, BLOCK = 400, 3000


def said(node: Column) -> Column:
    """Text of a node: a string, a number, or what an object has under ``$``; trimmed, empty without one."""
    value = F.when(F.startswith(F.schema_of_variant(node), F.lit("OBJECT")), F.try_variant_get(node, "$['$']", "string")).otherwise(F.try_variant_get(node, "$", "string"))
    return F.trim(F.coalesce(value, F.lit("")))


def _at(node: Column, path: str) -> Column:
    return F.try_variant_get(node, path, "variant")


def _attribute(node: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(node, f"$['@{name}']", "string"), F.lit(""))


def _first(items: Column, test) -> Column:
    return F.get(F.filter(items, test), F.lit(0))


def _number(d: Column) -> Column:
    return F.concat(said(_at(d, "$.country")), said(_at(d, "$['doc-number']")), said(_at(d, "$.kind")))


def biblio(df: DataFrame, key: str, answer: str) -> DataFrame:
    """key, found, title, abstract, applicants, ipc, apply_no, apply_date of bibliographic answers (JSON text).

    The title is the English one, else the first; the abstract the English one, else the last; applicants those in the plain format;
    at most IPC_MOST codes.  The application's number is the one with country and kind, else the plain one, with its date.
    """
    doc = F.get(many(F.try_parse_json(F.col(answer)), "$['ops:world-patent-data']['exchange-documents']['exchange-document']"), F.lit(0))
    # steps of their own: an answer is parsed once, and each node found once
    nodes = df.select(F.col(key), doc.alias("doc")).withColumn("bib", _at(F.col("doc"), "$['bibliographic-data']"))
    nodes = nodes.select(
        key, "bib", many(F.col("bib"), "$['invention-title']").alias("titles"), many(F.col("doc"), "$.abstract").alias("abstracts"), many(F.col("bib"), "$.parties.applicants.applicant").alias("parties"),
        many(F.col("bib"), "$['classifications-ipcr']['classification-ipcr']").alias("codes"), F.get(many(F.col("bib"), "$['application-reference']"), F.lit(0)).alias("reference"),
    ).withColumn("ids", many(F.col("reference"), "$['document-id']"))
    english = lambda items: _first(F.col(items), lambda t: _attribute(t, "lang") == "en")
    numbered = lambda d: said(_at(d, "$['doc-number']")) != ""
    typed = lambda kind: F.filter("ids", lambda d: _attribute(d, "document-id-type") == kind)
    picked = nodes.select(
        key, "bib", "parties", "codes", english("titles").alias("title"), F.get("titles", F.lit(0)).alias("first_title"), F.coalesce(english("abstracts"), F.try_element_at("abstracts", F.lit(-1))).alias("abstract"),
        _first(typed("docdb"), numbered).alias("full"), F.try_element_at(typed("epodoc"), F.lit(-1)).alias("plain"),
    )
    applicants = F.filter("parties", lambda a: (_attribute(a, "data-format") == "epodoc") & _at(a, "$['applicant-name'].name").isNotNull())
    full, plain, empty, none = F.col("full"), F.col("plain"), F.lit(""), F.array().cast("array<string>")
    of = lambda path, c: said(_at(c, path))
    return picked.select(
        key, F.col("bib").isNotNull().alias("found"), F.coalesce(F.nullif(said(F.col("title")), empty), said(F.col("first_title")), empty).alias("title"),
        F.coalesce(F.array_join(F.transform(many(F.col("abstract"), "$.p"), lambda x: said(x)), " "), empty).alias("abstract"),
        F.coalesce(F.transform(applicants, lambda a: of("$['applicant-name'].name", a)), none).alias("applicants"), F.coalesce(F.slice(F.transform("codes", lambda c: of("$.text", c)), 1, IPC_MOST), none).alias("ipc"),
        F.when(full.isNotNull(), _number(full)).otherwise(of("$['doc-number']", plain)).alias("apply_no"), F.when(full.isNotNull(), of("$.date", full)).when(numbered(plain), of("$.date", plain)).otherwise(empty).alias("apply_date"),
    )


def _let(value: Column, use) -> Column:
    """use(value), where the value is worked out once, however often it stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def family(answer: Column) -> Column:
    """family_id, members of a family answer: numbers in the order met, of each country and number the first one with its kind.

    The id stands on the family, else on its first member.  Time grows with the members as a sort does.
    """
    there = lambda d: (_attribute(d, "document-id-type") == "docdb") & (said(_at(d, "$.country")) != "") & (said(_at(d, "$['doc-number']")) != "")
    own = lambda d, i: F.struct(F.concat(said(_at(d, "$.country")), said(_at(d, "$['doc-number']"))).alias("key"), i.alias("i"), _number(d).alias("number"))
    leads = lambda x: F.filter(x, lambda e, i: (i == 0) | (F.get(x, i - 1)["key"] != e["key"]))  # noqa: E731 - of each key, when sorted

    def found(fam, members):
        ids = F.flatten(F.transform(members, lambda m: many(m, "$['publication-reference']['document-id']")))
        first = _let(F.sort_array(F.transform(F.filter(ids, there), own)), leads)
        numbers = F.transform(F.sort_array(F.transform(first, lambda x: F.struct(x["i"].alias("i"), x["number"].alias("number")))), lambda x: x["number"])
        name = F.coalesce(F.nullif(_attribute(fam, "family-id"), F.lit("")), F.nullif(_attribute(F.get(members, F.lit(0)), "family-id"), F.lit("")))
        return F.struct(name.alias("family_id"), F.coalesce(numbers, F.array().cast("array<string>")).alias("members"))

    fam = _at(F.try_parse_json(answer), "$['ops:world-patent-data']['ops:patent-family']")
    return _let(fam, lambda f: _let(many(f, "$['ops:family-member']"), lambda m: found(f, m)))


def family_ids(df: DataFrame, key: str, xml: str) -> DataFrame:
    """key, id, family_id: every number that a document block of an XML answer has, in any form, with the block's family.

    The head gives country and number, the block its other numbers; of a number in several blocks the last one counts.
    """
    blocks = df.select(key, F.posexplode(F.split(xml, r"<exchange-document\s")).alias("nth", "block")).where("nth > 0")
    head = F.substring("block", 1, HEAD)
    attribute = lambda name, of: F.regexp_extract(head, rf'{name}="({of})"', 1)
    lead = F.when((attribute("country", r"\w+") != "") & (attribute("doc-number", r"\w+") != ""), F.concat(attribute("country", r"\w+"), attribute("doc-number", r"\w+")))
    ids = F.array_compact(F.concat(F.array(lead), F.regexp_extract_all(F.substring("block", 1, BLOCK), F.lit(r"<doc-number>(\w+)</doc-number>"), F.lit(1))))
    rows = blocks.select(key, "nth", F.nullif(attribute("family-id", r"\d+"), F.lit("")).alias("family_id"), ids.alias("ids")).where("family_id is not null")
    return rows.select(key, "nth", "family_id", F.explode("ids").alias("id")).groupBy(key, "id").agg(F.max_by("family_id", "nth").alias("family_id"))


def nested_text(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, text: all text of a nested JSON value, in order and with white space folded; keys must be unique.

    An object gives what is under ``$`` first, then its other members but attributes (``@...``), in the order written.  Nothing,
    zero and false give nothing, but under ``$`` their names.  JSON that can't be read gives an empty text.

    Walks one level of all values a round, as rows with their path, as many rounds as the deepest value has levels.
    """
    kind = lambda v: F.substring(F.schema_of_variant(v), 1, 5)
    root = F.try_parse_json(F.col(value))
    raw = F.when(kind(root) == "STRIN", F.try_variant_get(root, "$", "string")).otherwise(F.trim(value))
    open_ = df.select(key, F.array(F.lit(0)).alias("path"), kind(root).alias("kind"), raw.alias("raw"), F.lit(False).alias("named"))
    leaves = [df.select(key, F.array(F.lit(0)).alias("path"), F.lit("").alias("text"))]  # every key has a text
    while True:
        open_ = checkpointed(open_)
        word = F.when(F.col("kind") == "BOOLE", F.when(F.col("raw") == "true", "True").when(F.col("named"), "False").otherwise("")).when(F.col("kind") == "VOID", F.when(F.col("named"), "None").otherwise(""))
        zero = ~F.col("named") & (F.col("kind") != "STRIN") & F.coalesce(F.try_to_number("raw", F.lit("S9999999999D9999999999")) == 0, F.lit(False))
        word = word.when(zero, "").otherwise(F.col("raw"))
        leaves.append(open_.where("kind not in ('OBJEC', 'ARRAY')").select(key, "path", F.coalesce(word, F.lit("")).alias("text")))
        inner = open_.where("kind in ('OBJEC', 'ARRAY')")
        if inner.isEmpty():
            break
        lists = inner.where("kind = 'ARRAY'").select(key, "path", F.posexplode(F.arrays_zip(F.from_json("raw", "array<variant>").alias("v"), F.from_json("raw", "array<string>").alias("raw"))).alias("i", "x"), F.lit(False).alias("named"))
        pairs = F.arrays_zip(F.map_keys(F.from_json("raw", "map<string,variant>")).alias("k"), F.map_values(F.from_json("raw", "map<string,variant>")).alias("v"), F.map_values(F.from_json("raw", "map<string,string>")).alias("raw"))
        members = inner.where("kind = 'OBJEC'").select(key, "path", F.posexplode(pairs).alias("i", "x")).where(~F.startswith("x.k", F.lit("@")))
        members = members.select(key, "path", F.when(F.col("x.k") == "$", -1).otherwise(F.col("i")).alias("i"), "x", (F.col("x.k") == "$").alias("named"))
        child = [key, F.concat("path", F.array("i")).alias("path"), F.coalesce(kind(F.col("x.v")), F.lit("VOID")).alias("kind"), F.col("x.raw").alias("raw"), "named"]
        open_ = lists.select(*child).unionByName(members.select(*child))
    every = reduce(DataFrame.unionByName, leaves)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "text"))), lambda x: x["text"]), "")
    return every.groupBy(key).agg(F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"))
