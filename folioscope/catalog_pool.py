"""Registered queries for pools: members, lookups by number, backfills, tags, gates, page sections and places in claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import catalog
from folioscope.functions import markup
from folioscope.operators import claims, pool
from folioscope.registry import query
from folioscope.sources.tables import table

# whole words by letters of any script: \b differs between engines
_WORD = r"(^|[^\p{{L}}\p{{N}}_]){}"
RULES = {"subject": {"wind": "wind", "rock": "rock|stone", "there": _WORD.format("ther"), "none": "qqqq"}, "tongue": {w: _WORD.format(w) + r"([^\p{L}\p{N}_]|$)" for w in ("the", "und", "que")}}


@query(catalog._SCORED + "SELECT s.group_key, s.doc_id, g.rep_doc_id, s.doc_id = g.rep_doc_id AS is_rep FROM s JOIN g USING (group_key)")
def rep_members(spark, d):
    return pool.members(catalog._scored(spark, d).select("group_key", "doc_id"), catalog._reps(spark, d), "group_key", "doc_id")


@query("""WITH f AS (SELECT md5(text) AS family, doc_id, min(doc_id) OVER (PARTITION BY md5(text)) AS head FROM documents WHERE n_chars >= 50)
SELECT family, head, doc_id FROM f WHERE doc_id <> head""")
def family_collapsed(spark, d):
    return pool.collapsed(table(spark, d, "documents").select("doc_id", "text", "n_chars"), F.when(F.col("n_chars") >= 50, F.md5("text")), "doc_id").select("family", "head", "doc_id")


# a result list of suppliers for each nation, and a number that is sometimes in it
_LISTS = """WITH q AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 6 < 5 THEN 'EP' || lpad((n_nationkey + 1)::VARCHAR, 6, '0') || 'A' END AS want FROM nation WHERE n_nationkey < 20),
r AS (SELECT (s_suppkey % 25)::INT AS k, s_suppkey AS pos, 'EP ' || (s_suppkey % 40) || 'B' AS number FROM supplier WHERE s_suppkey % 25 <> 7),
core AS (SELECT q.k, want, pos, number, coalesce(ltrim(regexp_replace(want, '\\D', '', 'g'), '0') = ltrim(regexp_replace(number, '\\D', '', 'g'), '0'), false) AS hit FROM q LEFT JOIN r USING (k)),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY NOT hit, pos) AS rn FROM core)
"""


def _lists(spark, d):
    k = F.col("n_nationkey")
    want = F.when(k % 6 < 5, F.concat(F.lit("EP"), F.lpad((k + 1).cast("string"), 6, "0"), F.lit("A")))
    requests = table(spark, d, "nation").where("n_nationkey < 20").select(k.alias("k"), want.alias("want"))
    s = F.col("s_suppkey")
    rows = table(spark, d, "supplier").where(s % 25 != 7).select((s % 25).cast("int").alias("k"), s.alias("pos"), F.concat(F.lit("EP "), (s % 40).cast("string"), F.lit("B")).alias("number"))
    return requests, rows, "k", "want", "number", "pos"


@query(_LISTS + "SELECT k, want, pos, number, hit AS matched FROM n WHERE rn = 1")
def resolve_numbers(spark, d):
    return pool.resolve(*_lists(spark, d))


@query(_LISTS + "SELECT k, want, CASE WHEN hit THEN pos END AS pos, CASE WHEN hit THEN number END AS number, hit AS matched FROM n WHERE rn = 1")
def select_by_digits(spark, d):
    return pool.resolve(*_lists(spark, d), strict=True)


@query("""WITH s AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'US' || s_suppkey || 'A1' WHEN s_suppkey % 3 = 0 THEN 'US' || s_suppkey ELSE 'us' || s_suppkey || 'a1' END AS form FROM supplier),
t AS (SELECT c_custkey, unnest(['us' || c_custkey || 'a1', 'US' || c_custkey || 'A1', 'US' || c_custkey]) AS form, unnest([0, 1, 2]) AS attempt FROM customer),
h AS (SELECT c_custkey, form, attempt, row_number() OVER (PARTITION BY c_custkey ORDER BY attempt) AS rn FROM t WHERE form IN (SELECT form FROM s))
SELECT c_custkey, form, attempt FROM h WHERE rn = 1""")
def first_form(spark, d):
    s, c = F.col("s_suppkey"), F.col("c_custkey").cast("string")
    stored = F.when(s % 2 == 0, F.concat(F.lit("US"), s.cast("string"), F.lit("A1"))).when(s % 3 == 0, F.concat(F.lit("US"), s.cast("string"))).otherwise(F.concat(F.lit("us"), s.cast("string"), F.lit("a1")))
    tried = F.array(F.concat(F.lit("us"), c, F.lit("a1")), F.concat(F.lit("US"), c, F.lit("A1")), F.concat(F.lit("US"), c))
    return pool.first_form(table(spark, d, "customer"), "c_custkey", tried, table(spark, d, "supplier").select(stored.alias("number")), "number")


@query("""SELECT c.c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_name WHEN c_nationkey < 5 THEN c_mktsegment ELSE '' END AS title,
CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE 'Unknown' END WHEN c_nationkey < 5 THEN c_name WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE 'Unknown' END AS assignee,
CASE WHEN c_custkey % 3 = 0 THEN 0 WHEN c_nationkey < 5 THEN 1 WHEN c_custkey % 5 > 0 THEN 2 END AS level FROM customer c""")
def pool_metadata(spark, d):
    c = table(spark, d, "customer")
    n, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    first = c.where(n % 3 == 0).select("c_custkey", "c_nationkey", name.alias("title"), F.when(n % 2 == 0, segment).otherwise("").alias("assignee"))
    second = c.select("c_custkey", "c_nationkey", segment.alias("title"), name.alias("assignee"))
    third = c.where(n % 5 > 0).select("c_custkey", "c_nationkey", F.lit("").alias("title"), segment.alias("assignee"))
    return pool.metadata(c, "c_custkey", [(first, None), (second, F.col("c_nationkey") < 5), (third, None)], ["title", "assignee"], ["assignee"])


@query("""WITH r AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_name END AS claim1 FROM part),
f AS (SELECT s_suppkey AS p_partkey, CASE WHEN s_nationkey % 4 > 0 THEN s_name ELSE '' END AS found FROM supplier),
j AS (SELECT r.*, found, claim1 = '' AND coalesce(length(found), 0) > 0 AS take FROM r LEFT JOIN f USING (p_partkey))
SELECT p_partkey, CASE WHEN take THEN found ELSE claim1 END AS claim1, claim1 = '' AND NOT take AS claim1_empty, CASE WHEN take THEN 'fallback' END AS claim1_source FROM j""")
def claim_backfill(spark, d):
    records = table(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_name")).alias("claim1")).withColumn("claim1_empty", F.col("claim1") == "")
    found = table(spark, d, "supplier").select(F.col("s_suppkey").alias("p_partkey"), F.when(F.col("s_nationkey") % 4 > 0, F.col("s_name")).otherwise("").alias("claim1"))
    return pool.fill_claims(records, found, "p_partkey")


def _tag_sql(labels):
    found = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{name}' END" for name, p in labels.items())
    return f"coalesce(nullif(array_to_string(list_filter([{found}], lambda x: x IS NOT NULL), '|'), ''), 'unlabeled')"


_TAGGED = "SELECT doc_id, " + ", ".join(f"{_tag_sql(labels)} AS {dim}" for dim, labels in RULES.items()) + " FROM documents"
_SHARES = " UNION ALL ".join(
    f"SELECT '{dim}' AS dimension, '{name}' AS label, count_if(list_contains(string_split({dim}, '|'), '{name}'))::BIGINT AS n, round(count_if(list_contains(string_split({dim}, '|'), '{name}')) / count(*), 6) AS share FROM t"
    for dim, labels in RULES.items()
    for name in labels
)


def _tagged(spark, d):
    return table(spark, d, "documents").select("doc_id", *pool.tags(F.col("text"), RULES))


@query(_TAGGED)
def multi_tags(spark, d):
    return _tagged(spark, d)


@query(f"WITH t AS ({_TAGGED}) SELECT *, share < 0.04 AS sparse FROM ({_SHARES})")
def sparse_directions(spark, d):
    return pool.sparse(_tagged(spark, d), RULES, 0.04)


@query(f"WITH t AS ({_TAGGED}) SELECT doc_id FROM labels WHERE quality = 1 AND doc_id NOT IN (SELECT doc_id FROM t WHERE tongue <> 'unlabeled')")
def lost_seeds(spark, d):
    seeds = table(spark, d, "labels").where("quality = 1").select("doc_id")
    return pool.lost_seeds(seeds, _tagged(spark, d).where(F.col("tongue") != pool.UNLABELED), "doc_id")


@query("""WITH q AS (SELECT source, doc_id, coalesce(quality = 1, false) AS good, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) AS rn FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS sampled, count_if(good)::BIGINT AS on_topic, round(count_if(good) / count(*), 6) AS rate, count(*) < 20 AS whole, round(count_if(good) / count(*), 6) >= 0.7 AS passes FROM q WHERE rn <= 30 GROUP BY source""")
def precision_gate(spark, d):
    judged = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels"), "doc_id").select("doc_id", "source", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("good"))
    return pool.gate(judged, "source", "doc_id", "good")


# pages with sections, made of documents
_PAGE = """'<meta name="citation_pdf_url" content="https://x/' || CASE doc_id % 3 WHEN 0 THEN 'pdfs/US1.pdf' WHEN 1 THEN 'pdfs/' || md5(doc_id::VARCHAR) || '.pdf' ELSE 'US1.pdf' END || '"><section itemprop="description" x><p>' || coalesce(source, '')
|| ' </p><b>body</b></section><section itemprop="claims" y><h2>Claims</h2><div id="CLM-1" num="1" class="claim"><b>First</b> of ' || coalesce(lang, '') || '</div><div id="" num="2" class="claim"> <i></i></div><div id="en-cl0003" num="3" class="claim">' || coalesce(text, '') || '</div></section>'"""
_BARE = r"trim(regexp_replace(regexp_replace({}, '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))"


def _page():
    n, text = F.col("doc_id"), lambda c: F.coalesce(F.col(c), F.lit(""))
    name = F.when(n % 3 == 0, "pdfs/US1.pdf").when(n % 3 == 1, F.concat(F.lit("pdfs/"), F.md5(n.cast("string")), F.lit(".pdf"))).otherwise("US1.pdf")
    parts = ['<meta name="citation_pdf_url" content="https://x/', name, '"><section itemprop="description" x><p>', text("source"), ' </p><b>body</b></section><section itemprop="claims" y><h2>Claims</h2><div id="CLM-1" num="1" class="claim"><b>First</b> of ']
    parts += [text("lang"), '</div><div id="" num="2" class="claim"> <i></i></div><div id="en-cl0003" num="3" class="claim">', text("text"), "</div></section>"]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


_DIV = r'<div\s+id="[^"]*"\s+num="\d+"\s+class="claim">'


@query(rf"""WITH p AS (SELECT doc_id, regexp_extract({_PAGE}, '(?s)itemprop="claims"[^>]*>(.*?)</section>', 1) AS s FROM documents),
c AS (SELECT doc_id, unnest(regexp_extract_all(s, '{_DIV.replace("num=", "num=").replace(chr(92) + "d+", "(" + chr(92) + "d+)")}', 1))::INT AS num, unnest(string_split_regex(s, '{_DIV}')[2:]) AS body FROM p)
SELECT doc_id, num, md5({_BARE.format("body")}) AS text_md5 FROM c WHERE {_BARE.format("body")} <> ''""")
def html_claims(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.inline(markup.claims(_page())))
    return rows.select("doc_id", "num", F.md5("text").alias("text_md5"))


@query(f"""SELECT doc_id, {_BARE.format("regexp_extract(p, '(?s)itemprop=\"description\"[^>]*>(.*?)</section>', 1)")} AS description,
CASE doc_id % 3 WHEN 1 THEN 'https://x/pdfs/' || md5(doc_id::VARCHAR) || '.pdf' WHEN 2 THEN 'https://x/US1.pdf' END AS pdf FROM (SELECT doc_id, {_PAGE} AS p FROM documents)""")
def html_sections(spark, d):
    page = _page()
    return table(spark, d, "documents").select("doc_id", markup.description(page).alias("description"), markup.pdf_link(page).alias("pdf"))


@query("""WITH c AS (SELECT p_partkey, 'A ' || p_name || CASE p_size % 3 WHEN 0 THEN ' comprising:' WHEN 1 THEN ' wherein: a bolt' ELSE '' END || chr(10) || '  a) a ' || lower(p_brand) || ' part' || chr(10) || 'b) the ' || lower(p_type) || ' ring' AS body, p_size FROM part)
SELECT p_partkey, CASE WHEN contains(lower(body[strpos(body, '  a)'):strpos(body, chr(10) || 'b)')]), 'ring') THEN 'limitation (a)' ELSE 'limitation (b)' END AS ring,
CASE WHEN contains(body[strpos(body, '  a)'):], 'bolt') THEN 'limitation' WHEN contains(CASE p_size % 3 WHEN 0 THEN split_part(body, 'comprising:', 1) WHEN 1 THEN split_part(body, 'wherein:', 1) ELSE body END, 'bolt') THEN 'preamble' ELSE 'body' END AS bolt FROM c""")
def phrase_location(spark, d):
    k = F.col("p_size") % 3
    opening = F.when(k == 0, " comprising:").when(k == 1, " wherein: a bolt").otherwise("")
    body = F.concat(F.lit("A "), F.col("p_name"), opening, F.lit("\n  a) a "), F.lower("p_brand"), F.lit(" part\nb) the "), F.lower("p_type"), F.lit(" ring"))
    return table(spark, d, "part").select("p_partkey", claims.location(body, F.lit("RING")).alias("ring"), claims.location(body, F.lit("bolt")).alias("bolt"))
