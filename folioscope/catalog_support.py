"""Registered queries for support and coverage of claims, families carried over, charts, slices, aborts and facets."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import pubno
from folioscope.operators import claims, review
from folioscope.registry import query
from folioscope.sources.tables import table

# filings of conversations: the user's turns are claims, all other turns paragraphs; elements are pairs of a claim's words
_SUPPORT = r"""WITH c AS (SELECT conv_id, turn, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations WHERE role = 'user'),
e AS (SELECT DISTINCT conv_id, turn, w[1] || ' ' || w[2] AS element, ' ' || w[1] || ' ' || w[2] || ' ' AS phrase, w[1] AS a, w[2] AS b FROM c WHERE len(w) > 1),
p AS (SELECT conv_id, turn AS para, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM conversations WHERE role <> 'user'),
x AS (SELECT conv_id, para, w, ' ' || array_to_string(w, ' ') || ' ' AS t FROM p),
h AS (SELECT e.conv_id, element, para, contains(t, phrase) AS whole, (length(a) > 3 OR length(b) > 3) AND (CASE WHEN length(a) > 3 AND list_contains(w, a) THEN 1 ELSE 0 END + CASE WHEN a <> b AND length(b) > 3 AND list_contains(w, b) THEN 1 ELSE 0 END) >= (CASE WHEN length(a) > 3 AND length(b) > 3 AND a <> b THEN 2 ELSE 1 END) AS part
FROM (SELECT DISTINCT conv_id, element, phrase, a, b FROM e) e JOIN x USING (conv_id)),
f AS (SELECT conv_id, element, para FROM h WHERE whole UNION ALL SELECT conv_id, element, para FROM h WHERE part AND NOT EXISTS (SELECT 1 FROM h g WHERE g.whole AND g.conv_id = h.conv_id AND g.element = h.element)),
n AS (SELECT e.conv_id, e.turn, e.element, count(f.para) AS n_paragraphs FROM e LEFT JOIN f ON f.conv_id = e.conv_id AND f.element = e.element GROUP BY ALL)
"""


def _supported(spark, d):
    t = table(spark, d, "conversations")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))
    elements = t.where("role = 'user'").withColumn("w", words).where(F.size("w") > 1).select("conv_id", "turn", F.concat_ws(" ", F.col("w")[0], F.col("w")[1]).alias("element")).distinct()
    paras = t.where("role <> 'user'").select("conv_id", F.col("turn").alias("para"), "text")
    found = review.support(elements, paras, ["conv_id"], "element", "para", "text")
    return review.support_issues(elements, found, ["conv_id"], "element")


@query(_SUPPORT + "SELECT *, CASE n_paragraphs WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'IMPORTANT' END AS severity FROM n")
def element_support(spark, d):
    return _supported(spark, d).select("conv_id", "turn", "element", "n_paragraphs", "severity")


@query(_SUPPORT + """, i AS (SELECT conv_id, turn, turn % 4 < 2 AS ind FROM conversations WHERE role = 'user')
SELECT conv_id, count(*) FILTER (ind) AS total, count(*) FILTER (ind AND NOT bad) AS supported, CASE WHEN count(*) FILTER (ind) > 0 THEN floor(count(*) FILTER (ind AND NOT bad) * 100 / count(*) FILTER (ind)) ELSE 0 END::INT AS percentage
FROM (SELECT i.*, EXISTS (SELECT 1 FROM n WHERE n.conv_id = i.conv_id AND n.turn = i.turn AND n_paragraphs = 0) AS bad FROM i) GROUP BY conv_id""")
def support_coverage(spark, d):
    rows = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", (F.col("turn") % 4 < 2).alias("ind"))
    return review.coverage(rows, _supported(spark, d), "conv_id", "turn", "ind")


# claims with functional language made of part names
_BODY = """CASE p_size % 4 WHEN 0 THEN 'a part Configured  to hold a ' || p_name || ', and about one ' || p_type WHEN 1 THEN 'capable of ' || p_name || '; designed to turn. Substantially round' WHEN 2 THEN p_name || ' roundabout and usually typically new' ELSE 'adapted to it' END"""


@query(rf"""WITH c AS (SELECT p_partkey, {_BODY} AS body FROM part), t AS (SELECT unnest([{', '.join(repr(x) for x in review.FUNCTIONAL)}]) AS term)
SELECT p_partkey, term, unnest(regexp_extract_all(body, '(?i)' || replace(term, ' ', ' ') || '\s+([^,;.]+)', 1)) AS function FROM c, t""")
def functional_language(spark, d):
    return table(spark, d, "part").select("p_partkey", F.expr(_BODY).alias("body")).select("p_partkey", F.inline(review.functions(F.col("body"))))


@query(rf"""WITH c AS (SELECT p_partkey, {_BODY} AS body FROM part) SELECT p_partkey, array_to_string(list_filter([{', '.join(rf"CASE WHEN regexp_matches(body, '(?i)\b{t}\b') THEN '{t}' END" for t in review.RELATIVE)}], lambda x: x IS NOT NULL), ',') AS terms FROM c""")
def relative_terms(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(review.relative_terms(F.expr(_BODY)), ",").alias("terms"))


@query("""WITH p AS (SELECT conv_id, (turn + 1)::INT AS claim, text FROM conversations), c AS (SELECT conv_id, claim, unnest(['a', 'b']) AS letter, unnest([text, lower(text)]) AS body FROM p WHERE length(trim(text)) > 0)
SELECT conv_id, claim, letter, regexp_replace(body, '^[ \\t\\n\\x0b\\f\\r]+|[ \\t\\n\\x0b\\f\\r]+$', '', 'g') AS text FROM c""".replace("\\\\", "\\"))
def claim_limitations(spark, d):
    t = table(spark, d, "conversations").where(F.length(F.trim("text")) > 0)
    body = F.concat(F.lit("A thing comprising:\n a) "), "text", F.lit("\n  b)  "), F.lower("text"), F.lit("  "))
    return t.select("conv_id", (F.col("turn") + 1).cast("int").alias("claim"), F.inline(claims.limitations(body)))


# families of customers by nation; each nation's first order tells the family of all with its digits
_CARRIED = """WITH m AS (SELECT 'US' || (c_custkey + 1000000) || CASE WHEN c_custkey % 2 = 0 THEN 'A1' ELSE 'B2' END AS pubno, 'US' || (c_custkey + 1000000) AS k, CASE WHEN c_custkey % 10 = 0 THEN 'F' || c_custkey END AS family_id, c_nationkey FROM customer),
q AS (SELECT 'US' || (min(c_custkey) + 1000000) || CASE WHEN min(c_custkey) % 2 = 0 THEN 'A1' ELSE 'B2' END AS asked, 'N' || c_nationkey AS fam, list('US' || (c_custkey + 1000000) || 'C9') AS members FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY c_nationkey),
t AS (SELECT unnest(members)[:-3] AS k, fam, asked FROM q),
o AS (SELECT m.pubno, coalesce(m.family_id, t.fam) AS family_id, CASE WHEN m.family_id IS NOT NULL THEN 'there' WHEN t.fam IS NULL THEN 'missing' WHEN t.asked = m.pubno THEN 'asked' ELSE 'carried' END AS how, m.c_nationkey FROM m LEFT JOIN t ON t.k = m.k)
"""


def _carried(spark, d):
    c = table(spark, d, "customer")
    base = F.concat(F.lit("US"), (F.col("c_custkey") + 1000000).cast("string"))
    number = F.concat(base, F.when(F.col("c_custkey") % 2 == 0, "A1").otherwise("B2"))
    members = c.select(number.alias("pubno"), F.when(F.col("c_custkey") % 10 == 0, F.concat(F.lit("F"), "c_custkey")).alias("family_id"), "c_nationkey")
    found = c.where("c_mktsegment <> 'BUILDING'").groupBy("c_nationkey").agg(F.min_by(number, "c_custkey").alias("pubno"), F.collect_list(F.concat(base, F.lit("C9"))).alias("members"))
    return review.carried(members, found.select("pubno", F.concat(F.lit("N"), "c_nationkey").alias("family_id"), "members"), "pubno", pubno.family_key, "family_id")


@query(_CARRIED.replace("unnest(members)[:-3]", "left(unnest(members), -2)") + "SELECT pubno, family_id, how FROM o")
def family_carried(spark, d):
    return _carried(spark, d)[0].select("pubno", "family_id", "how")


@query(_CARRIED.replace("unnest(members)[:-3]", "left(unnest(members), -2)") + "SELECT family_id, count(*) FILTER (how = 'there') AS there, count(*) FILTER (how = 'asked') AS asked, count(*) FILTER (how = 'carried') AS carried FROM o WHERE family_id IS NOT NULL GROUP BY family_id")
def family_calls(spark, d):
    return _carried(spark, d)[1]


@query(_CARRIED.replace("unnest(members)[:-3]", "left(unnest(members), -2)") + "SELECT c_nationkey, count(*) AS total, count(family_id) AS filled, count(*) - count(family_id) AS missing, count(DISTINCT family_id) AS families, round(100 * count(family_id) / count(*), 1) AS percent FROM o GROUP BY c_nationkey")
def family_progress(spark, d):
    return review.progress(_carried(spark, d)[0], ["c_nationkey"], "family_id")


@query("""WITH o AS (SELECT n_name AS country, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Unknown' ELSE c_mktsegment END AS category, year(o_orderdate) AS year, CASE WHEN c_custkey % 9 > 0 THEN c_name END AS assignee, CASE WHEN o_orderkey % 4 > 0 THEN list_distinct([o_orderpriority, o_orderstatus, o_orderstatus]) ELSE [] END AS classes
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
r AS (SELECT 'country' AS chart, country AS label FROM o UNION ALL SELECT 'category', category FROM o WHERE category <> 'Unknown' UNION ALL SELECT 'year', year::VARCHAR FROM o UNION ALL SELECT 'assignee', assignee FROM o WHERE assignee IS NOT NULL UNION ALL SELECT 'class', unnest(classes) FROM o),
c AS (SELECT chart, label, count(*) AS count FROM r GROUP BY ALL), k AS (SELECT *, CASE WHEN chart = 'year' THEN row_number() OVER (PARTITION BY chart ORDER BY label) ELSE row_number() OVER (PARTITION BY chart ORDER BY count DESC, label) END AS rank FROM c)
SELECT chart, label, count, rank FROM k WHERE chart NOT IN ('assignee', 'class') OR rank <= 10""")
def pool_charts(spark, d):
    c = table(spark, d, "customer").join(table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"), "c_nationkey")
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey").join(c, "c_custkey")
    classes = F.when(F.col("o_orderkey") % 4 > 0, F.array("o_orderpriority", "o_orderstatus", "o_orderstatus"))
    pool = o.select(F.col("n_name").alias("country"), F.when(F.col("c_mktsegment") == "BUILDING", "Unknown").otherwise(F.col("c_mktsegment")).alias("category"), F.year("o_orderdate").alias("year"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_name")).alias("assignee"), classes.alias("classes"))
    return review.charts(pool, "country", "category", "year", "assignee", "classes")


@query("""WITH RECURSIVE d AS (SELECT o_orderdate::DATE AS day FROM orders), s AS (SELECT min(day) AS a, max(day) AS b, 0 AS depth FROM d UNION ALL
SELECT CASE WHEN h = 0 THEN a ELSE a + ((b - a) // 2)::INT + 1 END, CASE WHEN h = 0 THEN a + ((b - a) // 2)::INT ELSE b END, depth + 1 FROM s, (VALUES (0), (1)) v(h) WHERE depth < 6 AND a < b AND (SELECT count(*) FROM d WHERE day BETWEEN a AND b) > 400),
n AS (SELECT a, b, depth, (SELECT count(*) FROM d WHERE day BETWEEN a AND b) AS n FROM s)
SELECT a::VARCHAR AS first_day, b::VARCHAR AS last_day, n, n > 400 AS truncated, true AS agrees FROM n WHERE (n <= 400 OR depth = 6 OR a = b) AND n > 0""")
def counted_slices(spark, d):
    out = review.slices(table(spark, d, "orders"), "o_orderdate", 400, 6)
    return out.withColumns({"first_day": F.col("first_day").cast("string"), "last_day": F.col("last_day").cast("string")})


@query("""WITH e AS (SELECT user_id, event_id, CASE WHEN event_type <> 'purchase' THEN event_type END AS o FROM events),
r AS (SELECT *, sum((o IS NULL OR o = 'login')::INT) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e),
c AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS n FROM r WHERE o IS NOT NULL AND o <> 'login')
SELECT user_id, min(event_id) AS cut, arg_min(o, event_id) AS reason FROM c WHERE n = 8 GROUP BY user_id""")
def error_abort(spark, d):
    return review.abort(table(spark, d, "events"), "user_id", "event_id", F.when(F.col("event_type") != "purchase", F.col("event_type")), ["login"])


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS count FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facet_counts(spark, d):
    return review.facets(table(spark, d, "documents"), ["lang", "source"])


@query("SELECT doc_id, score, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM (SELECT doc_id, -doc_id AS score FROM labels WHERE toxic = 1 ORDER BY score, doc_id LIMIT 15) LEFT JOIN (SELECT * FROM documents WHERE doc_id % 3 > 0) USING (doc_id)")
def enriched_hits(spark, d):
    hits = table(spark, d, "labels").where("toxic = 1").select("doc_id", (-F.col("doc_id")).alias("score"))
    return review.enrich(hits, table(spark, d, "documents").where("doc_id % 3 > 0"), "doc_id", "score", ["lang", "source"])


@query("SELECT c_mktsegment, c_nationkey, c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def family_lookup(spark, d):
    return review.family_rows(table(spark, d, "customer"), "c_mktsegment", ["BUILDING", "MACHINERY"], "c_nationkey", "c_custkey", ["c_name"])
