"""Registered queries for records: files written and read back, number forms, dates, texts of records, search over objects, elements."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import patent_text, pubno
from folioscope.operators import claims, filings, fulltext, retrieval
from folioscope.plans import gateway
from folioscope.registry import query
from folioscope.sources import readers, sinks
from folioscope.sources.tables import scratch, table

_BAD = "doc_id % 7 = 3"


@query(f"SELECT doc_id, lang, source, n_chars, (SELECT count(*) FROM documents WHERE {_BAD}) AS bad_lines FROM documents WHERE NOT ({_BAD})")
def json_lines_scan(spark, d):
    """Documents as JSON lines, some of them broken, no object or blank."""
    path, docs = scratch(spark, "lines"), table(spark, d, "documents")
    row = F.to_json(F.struct("doc_id", "text", "lang", "source", "n_chars"))
    line = F.when(F.expr(_BAD), F.when(F.col("doc_id") % 2 == 0, F.lit("[1, 2]")).otherwise(F.concat(F.lit('{"doc_id": '), F.substring(row, 20, 30)))).otherwise(row)
    docs.select(F.explode(F.array(line, F.lit(""), F.lit("  "))).alias("value")).write.text(path)
    rows, bad = readers.json_lines(spark, path, "doc_id long, text string, lang string, source string, n_chars long")
    return rows.select("doc_id", "lang", "source", "n_chars", F.lit(bad).cast("long").alias("bad_lines"))


@query("SELECT p_partkey, p_name, p_type FROM part")
def record_lists(spark, d):
    """Lists of records, bare ones and such under ``records``, a file of a hundred parts each."""
    path, part = scratch(spark, "records"), table(spark, d, "part")
    listed = part.groupBy(F.floor(F.col("p_partkey") / 100).alias("k")).agg(F.to_json(F.collect_list(F.struct("p_partkey", "p_name", "p_type"))).alias("j"))
    value = F.when(F.col("k") % 2 == 0, F.col("j")).otherwise(F.concat(F.lit('{"of": 1, "records": '), "j", F.lit("}")))
    listed.select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return readers.records(spark, path, "p_partkey long, p_name string, p_type string")


@query("SELECT doc_id::VARCHAR AS id, replace(coalesce(text, ''), chr(13), '') AS text_, coalesce(array_to_string([lang, source], '; '), '') AS labels FROM documents")
def csv_round_trip(spark, d):
    """Documents as rendered CSV cells, read back under other names."""
    path = scratch(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", F.replace("text", F.lit("\r"), F.lit("")).alias("text"), F.array("lang", "source").alias("labels"), F.lit("never").alias("secret"))
    sinks.write_csv(docs, path, {"doc_id": "No.", "text": "Full text", "labels": "Labels", "secret": "Secret"})
    back = readers.mapped_csv(spark, path, {"No.": "id", "Full text": "text_", "Labels": "labels", "Secret": "secret"}, drop=("Secret",))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) for c in back.columns])


_RAW = {
    0: ("'us 20' || lpad(k::VARCHAR, 2, '0') || '/' || lpad(n::VARCHAR, 7, '0') || ' a1'", "'US'", "'20' || lpad(k::VARCHAR, 2, '0') || lpad(n::VARCHAR, 7, '0') || 'A1'"),
    1: ("'TWI' || (600000 + n) || 'B'", "'TW'", "'I' || (600000 + n)"),
    2: ("'EP-' || (1000000 + n)", "'EP'", "(1000000 + n)::VARCHAR"),
    3: ("'10' || lpad(n::VARCHAR, 7, '0')", "'TW'", "'10' || lpad(n::VARCHAR, 7, '0')"),
    4: ("(8000000 + n)::VARCHAR", "'US'", "(8000000 + n)::VARCHAR"),
}
_RAWS = f"r AS (SELECT p_partkey, p_partkey % 5 AS m, p_partkey // 5 AS n, p_size % 24 AS k FROM part), f AS (SELECT p_partkey, m, CASE m {' '.join(f'WHEN {m} THEN {raw}' for m, (raw, _, _) in _RAW.items())} END AS raw, CASE m {' '.join(f'WHEN {m} THEN {c}' for m, (_, c, _) in _RAW.items())} END AS country, CASE m {' '.join(f'WHEN {m} THEN {b}' for m, (_, _, b) in _RAW.items())} END AS body FROM r)"


def _raws(spark, d):
    n, k = F.floor(F.col("p_partkey") / 5), F.col("p_size") % 24
    pad = lambda c, w: F.lpad(c.cast("string"), w, "0")
    kinds = [F.concat(F.lit("us 20"), pad(k, 2), F.lit("/"), pad(n, 7), F.lit(" a1")), F.concat(F.lit("TWI"), (n + 600000).cast("string"), F.lit("B")), F.concat(F.lit("EP-"), (n + 1000000).cast("string")), F.concat(F.lit("10"), pad(n, 7)), (n + 8000000).cast("string")]
    raw = None
    for m, c in enumerate(kinds):
        raw = (F if raw is None else raw).when(F.col("p_partkey") % 5 == m, c)
    return table(spark, d, "part").select("p_partkey", raw.alias("raw"))


@query(f"""WITH {_RAWS}, c AS (SELECT *, upper(regexp_replace(raw, '[ /-]', '', 'g')) AS compact FROM f)
SELECT p_partkey, compact, country || body AS key, CASE WHEN compact = country || body THEN compact ELSE country || body || ',' || compact END AS variants, regexp_extract(body, '^[IMD]?[0-9]+') AS web, 'pub' AS axis FROM c""")
def number_keys(spark, d):
    raw = F.col("raw")
    web = pubno.web_form(raw)
    return _raws(spark, d).select("p_partkey", pubno.compact(raw).alias("compact"), pubno.key(raw).alias("key"), F.array_join(pubno.key_variants(raw), ",").alias("variants"), web["number"].alias("web"), web["axis"].alias("axis"))


@query(r"""WITH t AS (SELECT p_partkey, 'see US' || lpad(p_partkey::VARCHAR, 8, '0') || 'B2, TWI' || lpad(p_size::VARCHAR, 6, '0') || ' or XUS1234567 and EP12345; CN' || lpad(p_size::VARCHAR, 9, '0') || 'A' AS t FROM part)
SELECT p_partkey, 'US' || lpad(p_partkey::VARCHAR, 8, '0') || 'B2,TWI' || regexp_extract(t, 'TWI([0-9]+)', 1) || ',CN' || regexp_extract(t, 'CN([0-9]+)A', 1) || 'A' AS numbers, CASE WHEN p_partkey % 3 = 0 THEN true WHEN p_partkey % 3 = 1 THEN false END AS same FROM t""")
def number_tokens(spark, d):
    size, k = F.lpad(F.col("p_size").cast("string"), 6, "0"), F.col("p_partkey")
    number = F.concat(F.lit("US"), F.lpad(k.cast("string"), 8, "0"), F.lit("B2"))
    t = F.concat(F.lit("see "), number, F.lit(", TWI"), size, F.lit(" or XUS1234567 and EP12345; CN"), F.lpad(F.col("p_size").cast("string"), 9, "0"), F.lit("A"))
    digits = F.regexp_replace(F.substring(number, 1, 10), r"\D", "")
    found = F.when(k % 3 == 0, F.array(F.lit("EP1"), F.concat(F.lit("US "), digits))).when(k % 3 == 1, F.array(F.lit("EP1"))).otherwise(F.array().cast("array<string>"))
    # a number without a letter and figure behind it ends at its figures
    return table(spark, d, "part").select("p_partkey", F.array_join(patent_text.numbers(t), ",").alias("numbers"), patent_text.identity(found, digits).alias("same"))


@query("""SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS digits, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y%m') END AS shown,
CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%Y') ELSE '2017' END AS year FROM orders""")
def record_dates(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    digits = patent_text.date_digits(F.concat(day, F.lit("T")))
    number = F.when(F.col("o_orderkey") % 3 == 0, digits.cast("int")).when(F.col("o_orderkey") % 3 == 1, 0).otherwise(F.substring(digits, 1, 6).cast("int"))
    year = patent_text.year(F.when(F.col("o_orderkey") % 2 == 0, day).otherwise("19"), F.lit("US2017123456"))
    return table(spark, d, "orders").select("o_orderkey", digits.alias("digits"), patent_text.date_text(number).alias("shown"), year.alias("year"))


@query(r"""WITH c AS (SELECT conv_id, string_agg((turn + 1) || '. ' || text, chr(10) ORDER BY turn) AS claims, max(text) FILTER (turn = 0) AS abstract, max(role) AS description FROM conversations GROUP BY conv_id)
SELECT conv_id, md5('# US' || conv_id || chr(10) || chr(10) || '## Abstract' || chr(10) || coalesce(abstract, '') || chr(10) || chr(10) || '## Claims' || chr(10) || claims || chr(10) || chr(10) || '## Description' || chr(10) || description || chr(10)) AS page FROM c""")
def record_pages(spark, d):
    rows = F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).alias("num"), "text")))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(rows.alias("claims"), F.max(F.when(F.col("turn") == 0, F.col("text"))).alias("abstract"), F.max("role").alias("description"))
    page = patent_text.markdown(F.concat(F.lit("US"), "conv_id"), F.coalesce("abstract", F.lit("")), F.col("claims"), F.col("description"))
    return c.select("conv_id", F.md5(page).alias("page"))


@query("""SELECT d.doc_id, max(CASE WHEN quality IS NOT NULL THEN quality + toxic / 2.0::DOUBLE END) AS source_weight FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id AND toxic + quality > 0 GROUP BY d.doc_id""")
def graded_objects(spark, d):
    labels = table(spark, d, "labels")
    weight = F.to_json(F.struct((F.col("quality") + F.col("toxic") / 2).alias("source_weight")))
    edges = labels.select(F.col("doc_id").alias("source_id"), F.when(F.col("toxic") + F.col("quality") > 0, "derived").otherwise("seen").alias("edge_type"), weight.alias("metadata_json"))
    return fulltext.graded(table(spark, d, "documents").select("doc_id"), edges, "doc_id", ["derived", "made"])


@query("""SELECT doc_id, 0.0::DOUBLE AS rank FROM documents WHERE lang = 'en' AND contains(lower(coalesce(text, '') || chr(10) || coalesce(source, '')), 'is') AND contains(lower(coalesce(text, '') || chr(10) || coalesce(source, '')), 'he') ORDER BY n_chars DESC, doc_id LIMIT 20""")
def planned_scan(spark, d):
    return fulltext.planned(table(spark, d, "documents"), ["text", "source"], ["doc_id"], gateway.match_plan("is HE"), F.col("lang") == "en", 20, "n_chars")


_LISTS = """a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50), b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS rank FROM labels QUALIFY rank <= 50)"""


@query(f"""WITH {_LISTS}, e AS (SELECT doc_id, 0.7::DOUBLE / (60 + rank) AS a, 0.0::DOUBLE AS b FROM a UNION ALL SELECT doc_id, 0.0, 0.3::DOUBLE / (60 + rank) FROM b),
s AS (SELECT doc_id, round(sum(a + b), 9) AS score, round(sum(a), 9) AS long_score, round(sum(b), 9) AS new_score FROM e GROUP BY doc_id)
SELECT * FROM s WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang <> 'fr') ORDER BY score DESC, doc_id LIMIT 30""")
def fused_and_filtered(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    top = lambda df, *order: retrieval.ranks(df.orderBy(*order).limit(50), *order)
    lists = {"long": (top(docs.select("doc_id", "n_chars"), F.desc("n_chars"), "doc_id"), 0.7), "new": (top(labels.select("doc_id"), F.desc("doc_id")), 0.3)}
    return fulltext.fuse_weighted(lists, "doc_id", 30, docs.where("lang <> 'fr'"))


@query("SELECT doc_id, score, source FROM (SELECT doc_id, n_chars AS score, 'documents' AS source FROM documents UNION ALL SELECT doc_id, quality * 30000, 'labels' FROM labels) ORDER BY score DESC, source, doc_id LIMIT 40")
def fanned_out(spark, d):
    a = table(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score"))
    b = table(spark, d, "labels").select("doc_id", (F.col("quality") * 30000).cast("long").alias("score"))
    return fulltext.fan_out({"documents": a, "labels": b}, "doc_id", 40)


@query("""WITH i AS (SELECT o_custkey, o_orderkey AS claim, o_orderstatus AS term, CASE o_orderpriority WHEN '1-URGENT' THEN 'CRITICAL' WHEN '2-HIGH' THEN 'IMPORTANT' WHEN '3-MEDIUM' THEN 'INFO' ELSE 'other' END AS severity FROM orders)
SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE severity WHEN 'CRITICAL' THEN 0 WHEN 'IMPORTANT' THEN 1 WHEN 'MINOR' THEN 2 WHEN 'WARNING' THEN 3 WHEN 'INFO' THEN 4 ELSE 5 END, claim, term) AS rank FROM i""")
def issues_in_order(spark, d):
    names = F.when(F.col("o_orderpriority") == "1-URGENT", "CRITICAL").when(F.col("o_orderpriority") == "2-HIGH", "IMPORTANT").when(F.col("o_orderpriority") == "3-MEDIUM", "INFO").otherwise("other")
    rows = table(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("term"), names.alias("severity"), F.lit("order").alias("issue_type"))
    return filings.sorted_issues(rows, "o_custkey", "claim").drop("issue_type")


@query(r"""WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS paragraph, regexp_replace(replace(text, '[', '('), '^[ \t\n\x0b\f\r]+|[ \t\n\x0b\f\r]+$', '', 'g') AS body FROM conversations)
SELECT conv_id, paragraph, body FROM p""")
def spec_paragraphs(spark, d):
    one = F.concat(F.lit("["), F.lpad((F.col("turn") + 1).cast("string"), 4, "0"), F.lit("]  "), F.replace("text", F.lit("["), F.lit("(")), F.lit("\n"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("x")))).alias("x"))
    return filings.paragraphs(c.select("conv_id", F.concat(F.lit("TITLE\n"), F.array_join(F.transform("x", lambda r: r["x"]), "")).alias("t")), "conv_id", "t")


@query("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_name || ' box,' || lower(p_type) || ' lid' WHEN p_size % 3 = 1 THEN lower(p_type) || ' part' ELSE '' END AS elements, CASE WHEN p_size % 3 = 0 THEN 2 WHEN p_size % 3 = 1 THEN 0 ELSE 1 END::INT AS depth FROM part""")
def claim_elements(spark, d):
    name, kind, k = F.col("p_name"), F.lower("p_type"), F.col("p_size") % 3
    body = F.when(k == 0, F.concat(F.lit("A  "), F.upper(name), F.lit("  box comprising (a (the system)) the "), kind, F.lit(" lid, said "), name, F.lit(" box; a device.")))
    body = body.when(k == 1, F.concat(F.lit("the "), kind, F.lit(" part is what the method for"))).otherwise("no name (here)")
    return table(spark, d, "part").select("p_partkey", F.array_join(claims.elements(body), ",").alias("elements"), claims.nesting(body).alias("depth"))
