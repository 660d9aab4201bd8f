"""All registered queries of the engine with the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import markup
from folioscope.operators import analytics, linkage, retrieval, store
from folioscope.plans import boolean_query
from folioscope.registry import ORACLE_SQL, QUERIES, query  # noqa: F401
from folioscope.sources.tables import table

STOP = ["the", "and", "for", "that", "with", "this"]
BOOLEAN = '(red or "small ring") and not promo* or bl?e'
TERMS = ["the", "que", "und"]
# events.ts has no zone: Taipei's own clock
QUOTA_WINDOW = """CASE WHEN isodow(ts) < 6 AND hour(ts) >= 8 AND hour(ts) < 18 THEN strftime(ts, '%Y-%m-%d') || ':narrow'
ELSE strftime(ts - to_days(CASE WHEN isodow(ts) >= 6 THEN isodow(ts)::INT - 5 WHEN hour(ts) < 8 THEN 1 ELSE 0 END), '%Y-%m-%d') || ':wide' END"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    key = F.when(F.col("n_chars") >= 200, F.concat_ws(":", F.lit("FAM"), "lang", "source")).otherwise(F.concat(F.lit("SINGLE:"), F.col("doc_id").cast("string")))
    score = 2 * F.length("text") + F.col("n_chars") + F.when(F.col("quality") == 1, 500).otherwise(0)
    return docs.select("doc_id", "quality", key.alias("group_key"), score.alias("score"))


_SCORED = """WITH s AS (SELECT d.doc_id, l.quality, CASE WHEN n_chars >= 200 THEN concat_ws(':', 'FAM', lang, source) ELSE 'SINGLE:' || d.doc_id END AS group_key,
  2 * length(text) + n_chars + CASE WHEN quality = 1 THEN 500 ELSE 0 END AS score FROM documents d LEFT JOIN labels l USING (doc_id)),
r AS (SELECT *, row_number() OVER (PARTITION BY group_key ORDER BY score DESC, quality NULLS LAST, doc_id) AS rn, count(*) OVER (PARTITION BY group_key) AS group_size FROM s),
g AS (SELECT group_key, doc_id AS rep_doc_id, score AS rep_score, group_size, group_size - 1 AS collapsed FROM r WHERE rn = 1)
"""


def _reps(spark: SparkSession, d: str) -> DataFrame:
    return linkage.representatives(_scored(spark, d), "group_key", "score", [F.coalesce("quality", F.lit(9))], "doc_id")


@query(_SCORED + "SELECT * FROM g")
def rep_select(spark, d):
    return _reps(spark, d)


@query(_SCORED + """SELECT count(*) AS total_groups, count(*) FILTER (group_key LIKE 'FAM:%') AS family_groups, count(*) FILTER (group_key NOT LIKE 'FAM:%') AS single_groups,
  count(*) FILTER (group_size > 1) AS multi_member, sum(collapsed)::BIGINT AS collapsed, count(*) AS representatives FROM g""")
def rep_summary(spark, d):
    return linkage.summary(_reps(spark, d), "group_key")


@query("SELECT CASE WHEN n_chars >= 50 THEN md5(text) END AS family, min(doc_id) AS doc_id, count(*) - 1 AS members FROM documents GROUP BY CASE WHEN n_chars >= 50 THEN md5(text) ELSE doc_id::VARCHAR END, 1")
def family_dedup_first(spark, d):
    return linkage.first_wins(table(spark, d, "documents"), F.when(F.col("n_chars") >= 50, F.md5("text")), "doc_id")


@query("SELECT l.doc_id, quality, lang FROM labels l JOIN documents d USING (doc_id)")
def pool_join(spark, d):
    return store.pool_hits(table(spark, d, "labels"), table(spark, d, "documents"), "doc_id").select("doc_id", "quality", "lang")


@query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def pool_miss(spark, d):
    return store.pool_misses(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").select("doc_id", "lang")


@query("""WITH k AS (SELECT c_custkey, c_custkey || CASE WHEN c_custkey % 3 = 0 THEN 'B1' ELSE '' END AS k FROM customer),
v AS (SELECT DISTINCT c_custkey, unnest([k, regexp_replace(k, '[A-Z]+[0-9]?$', '')]) AS variant FROM k)
SELECT variant, count(*) AS orders FROM v JOIN orders o ON v.variant = o.o_custkey::VARCHAR GROUP BY variant""")
def dual_key_reconcile(spark, d):
    key = F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 3 == 0, "B1").otherwise(""))
    left = linkage.with_variants(table(spark, d, "customer").select(key.alias("k")), "k")
    right = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("variant"))
    return left.join(right, "variant").groupBy("variant").agg(F.count(F.lit(1)).alias("orders"))


@query("SELECT c_nationkey, min(c_custkey) AS queried, count(*) AS filled, count(*) - 1 AS family_covered FROM (SELECT DISTINCT o_custkey AS c_custkey FROM orders) JOIN customer USING (c_custkey) GROUP BY c_nationkey")
def family_coverage(spark, d):
    targets = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return linkage.coverage(targets, table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey", "c_nationkey")


@query("""SELECT id, arg_min(value, level) AS value, min(level) AS level FROM (
SELECT item_id AS id, text AS value, 0 AS level FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT doc_id, text, 1 FROM documents UNION ALL SELECT conv_id, max(role), 2 FROM conversations GROUP BY conv_id) WHERE length(trim(value)) > 0 GROUP BY id""")
def ladder_per_key(spark, d):
    levels = [table(spark, d, "benchmark").where("item_id % 2 = 0").select(F.col("item_id").alias("id"), F.col("text").alias("value")), table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("value")), table(spark, d, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.max("role").alias("value"))]
    return linkage.key_ladder(levels, "id", "value")


@query("""WITH o AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN ' ' ELSE p_name END AS p_name, CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_type END AS p_type FROM part WHERE p_partkey % 7 <> 0),
n AS (SELECT p_partkey, upper(p_name) AS p_name, p_type FROM part WHERE p_partkey % 6 <> 0),
j AS (SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, o.p_partkey AS ok, o.p_name AS a1, n.p_name AS b1, o.p_type AS a2, n.p_type AS b2 FROM o FULL JOIN n ON o.p_partkey = n.p_partkey),
m AS (SELECT *, trim(coalesce(b1, '')) <> '' AND trim(coalesce(a1, '')) = '' AS t1, trim(coalesce(b2, '')) <> '' AND trim(coalesce(a2, '')) = '' AS t2 FROM j)
SELECT p_partkey, CASE WHEN t1 THEN b1 ELSE a1 END AS p_name, CASE WHEN t2 THEN b2 ELSE a2 END AS p_type,
  CASE WHEN ok IS NULL THEN 'created' WHEN t1 OR t2 THEN 'updated' ELSE 'unchanged' END AS action, t1::INT + t2::INT AS merged_fields FROM m""")
def upsert_merge(spark, d):
    part = table(spark, d, "part")
    old = part.where("p_partkey % 7 <> 0").select("p_partkey", F.when(F.col("p_partkey") % 4 == 0, " ").otherwise(F.col("p_name")).alias("p_name"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")).alias("p_type"))
    new = part.where("p_partkey % 6 <> 0").select("p_partkey", F.upper("p_name").alias("p_name"), "p_type")
    return store.upsert(old, new, "p_partkey", ["p_name", "p_type"])


@query("SELECT doc_id, trim(coalesce(text, '')) <> '' AS has_text, lang IS NOT NULL AND trim(lang) <> '' AS has_lang, quality IS NOT NULL AS has_quality FROM documents LEFT JOIN labels USING (doc_id)")
def completeness(spark, d):
    df = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return store.completeness(df, "doc_id", {"text": F.col("text"), "lang": F.col("lang"), "quality": F.col("quality")})


@query("""SELECT coalesce(a.c_custkey, b.c_custkey) AS c_custkey, CASE WHEN b.c_custkey IS NULL THEN 'added' WHEN a.c_custkey IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM (SELECT c_custkey, c_name FROM customer WHERE c_custkey % 5 <> 0) b FULL JOIN (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE c_name END AS c_name FROM customer WHERE c_custkey % 7 <> 0) a ON a.c_custkey = b.c_custkey
WHERE a.c_custkey IS NULL OR b.c_custkey IS NULL OR a.c_name IS DISTINCT FROM b.c_name""")
def snapshot_diff(spark, d):
    c = table(spark, d, "customer")
    after = c.where("c_custkey % 7 <> 0").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "x").otherwise(F.col("c_name")).alias("c_name"))
    return store.snapshot_diff(c.where("c_custkey % 5 <> 0").select("c_custkey", "c_name"), after, "c_custkey", ["c_name"])


@query(r"""SELECT p_partkey, p_name, p_type FROM (SELECT *, lower(p_name || ' ' || p_type) AS t FROM part)
WHERE ((regexp_matches(t, '\bred\b') OR regexp_matches(t, '\bsmall\W+ring\b')) AND NOT regexp_matches(t, '\bpromo\w*\b')) OR regexp_matches(t, '\bbl\we\b')""")
def boolean_filter(spark, d):
    return table(spark, d, "part").where(boolean_query.matches(BOOLEAN, F.concat_ws(" ", "p_name", "p_type"))).select("p_partkey", "p_name", "p_type")


@query(r"""WITH t AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^a-z0-9_]+') AS w FROM documents),
u AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM t)
SELECT DISTINCT a.doc_id FROM u a JOIN u b ON a.doc_id = b.doc_id AND a.word = 'the' AND b.word = 'of' AND b.pos - a.pos BETWEEN -3 AND 5""")
def proximity(spark, d):
    return table(spark, d, "documents").where(boolean_query.near(F.col("text"), "the", "of", -3, 5)).select("doc_id")


@query("SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100")
def page_cursor(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(100).limit(50).select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (length(trim(text)) > 0) AS with_text, count(*) FILTER (length(trim(coalesce(text, ''))) < 25) AS short_text FROM documents GROUP BY lang")
def store_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.length(F.trim("text")) > 0).alias("with_text"), F.count_if(F.length(F.trim(F.coalesce("text", F.lit("")))) < 25).alias("short_text"))


@query("SELECT p_type, count(*) AS n FROM part WHERE p_type <> 'Unknown' GROUP BY p_type ORDER BY n DESC, p_type LIMIT 10")
def pool_chart_class(spark, d):
    return analytics.top_counts(table(spark, d, "part"), "p_type")


@query("SELECT s_name, count(*) AS n FROM supplier WHERE s_name <> 'Unknown' GROUP BY s_name ORDER BY n DESC, s_name LIMIT 10")
def pool_chart_assignee(spark, d):
    return analytics.top_counts(table(spark, d, "supplier"), "s_name")


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders GROUP BY 1")
def pool_chart_year(spark, d):
    return table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"""SELECT term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+')) AS term FROM documents)
WHERE regexp_full_match(term, '[a-z]{{3,}}') AND term NOT IN ({', '.join(repr(w) for w in STOP)}) GROUP BY term ORDER BY n DESC, term LIMIT 50""")
def term_top50(spark, d):
    # the SQL is of ASCII words
    return analytics.term_counts(table(spark, d, "documents"), "text", STOP, cjk=False)


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events),
s AS (SELECT event_type, list_sort(list(value)) AS v FROM r WHERE rn <= 1024 GROUP BY event_type)
SELECT event_type, len(v) AS n, v[1] AS least, v[-1] AS most, round(list_sum(v) / len(v), 6) AS mean, v[floor(len(v) * 0.5)::INT + 1] AS p50, v[floor(len(v) * 0.95)::INT + 1] AS p95, v[floor(len(v) * 0.99)::INT + 1] AS p99 FROM s""")
def percentiles(spark, d):
    return analytics.latency_stats(table(spark, d, "events"), "event_type", "value", ["ts", "event_id"])


@query("SELECT user_id, count(*) AS queries, count(DISTINCT event_type) AS concept_groups, count(DISTINCT json_extract_string(props, '$.k')) AS class_codes FROM events GROUP BY user_id")
def rigor_audit(spark, d):
    return analytics.rigor(table(spark, d, "events"), "user_id", "event_type", F.get_json_object("props", "$.k"))


@query("SELECT strftime(ts, '%Y-%m-%d') || CASE WHEN isodow(ts) >= 6 OR hour(ts) < 8 OR hour(ts) >= 18 THEN '-off' ELSE '-day' END AS window_key, count(*) AS n FROM events GROUP BY 1")
def window_key(spark, d):
    return table(spark, d, "events").groupBy(analytics.window_key(F.col("ts")).alias("window_key")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT " + QUOTA_WINDOW + " AS window_key, count(*) AS n FROM events GROUP BY 1")
def quota_window(spark, d):
    return table(spark, d, "events").groupBy(analytics.quota_window(F.col("ts")).alias("window_key")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH c AS (SELECT *, event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1 AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(c::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT user_id, island::BIGINT AS island, event_type, arg_min(event_id, ts) AS first_id, count(*) AS run FROM i GROUP BY user_id, island, event_type HAVING count(*) >= 3""")
def failure_fuse(spark, d):
    runs = linkage.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.where("run >= 3").select("user_id", "island", "event_type", F.col("first.event_id").alias("first_id"), "run")


@query("""WITH n AS (SELECT *, coalesce(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) > 7200000000, true) AS c FROM events),
s AS (SELECT *, sum(c::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM n)
SELECT user_id, session::BIGINT AS session, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM s GROUP BY user_id, session""")
def session_counts(spark, d):
    return analytics.sessions(table(spark, d, "events"), "user_id", "ts", "event_id", 7200)


@query(r"""SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '[ \t\n\r]+', ' ', 'g'))) AS text_md5,
len(regexp_extract_all(html, 'href="([^"]*)"', 1))::INT AS n_links FROM pages""")
def html_strip(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(markup.strip(F.col("html"))).alias("text_md5"), F.size(markup.links(F.col("html"))).alias("n_links"))


@query("""SELECT vec_id, round(list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 6) AS dist
FROM embeddings ORDER BY dist, vec_id LIMIT 20""")
def knn_l2(spark, d):
    vectors = table(spark, d, "embeddings")
    return retrieval.knn(vectors, vectors.where("vec_id = 0").first()["embedding"], 20)


_BM25 = r"""WITH b AS (SELECT doc_id, regexp_split_to_array(lower(coalesce(text, '')), '\s+') AS w FROM documents),
t AS (SELECT unnest(['the', 'que', 'und']) AS term),
f AS (SELECT doc_id, len(w) AS len, term, len(list_filter(w, lambda x: x = term)) AS tf FROM b, t),
s AS (SELECT term, count(*) AS n, count(*) FILTER (tf > 0) AS df, avg(len) AS al FROM f GROUP BY term),
k AS (SELECT doc_id, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS score FROM f JOIN s USING (term) WHERE tf > 0 GROUP BY doc_id)
"""


@query(_BM25 + "SELECT doc_id, score FROM k ORDER BY score DESC, doc_id LIMIT 50")
def bm25_topk(spark, d):
    return retrieval.bm25(table(spark, d, "documents"), TERMS, 50)


@query("SELECT strftime(l_shipdate, '%Y-%m') AS month, count(*) AS n, greatest(sum(l_quantity::BIGINT), 15000)::BIGINT AS usage, sum(l_quantity::BIGINT) > 15000 AS exceeded FROM lineitem GROUP BY 1")
def month_budget(spark, d):
    used = table(spark, d, "lineitem").groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("long")).alias("q"))
    return used.select("month", "n", F.greatest("q", F.lit(15000).cast("long")).alias("usage"), (F.col("q") > 15000).alias("exceeded"))


@query("SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY p_type, p_brand")
def tech_effect_matrix(spark, d):
    return table(spark, d, "part").groupBy("p_type", "p_brand").agg(F.count(F.lit(1)).alias("n"))


from folioscope import catalog_answers, catalog_desk, catalog_documents, catalog_filings, catalog_pool, catalog_records, catalog_review, catalog_search, catalog_support  # noqa: E402, F401 - register their queries
