"""Registered queries for filings, audits, full text, records and number texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import patent_text
from folioscope.operators import audit, filings, fulltext
from folioscope.plans import gateway
from folioscope.registry import query
from folioscope.sources import adapters
from folioscope.sources.tables import table

_W = r"len(regexp_extract_all({}, '[^ \t\n\r\f]+'))"
_UNITS = ", ".join(f"len(regexp_extract_all(text, '(?i){p}')) AS {n}" for n, p in filings.UNITS.items())


@query(f"SELECT doc_id, {_UNITS} FROM documents")
def unit_terms(spark, d):
    return table(spark, d, "documents").select("doc_id", *filings.unit_counts(F.col("text")))


_PARTS = ", ".join(f"CASE WHEN NOT regexp_matches(text, '(?i){'|'.join(f'(?:{p})' for p in ps)}') THEN '{n}' END" for n, ps in filings.DESCRIPTION.items())


@query(f"SELECT doc_id, array_to_string(list_filter([{_PARTS}], lambda x: x IS NOT NULL), ',') AS missing FROM documents")
def description_parts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(filings.missing_parts(F.col("text")), ",").alias("missing"))


@query(f"""SELECT doc_id, array_to_string(list_filter([CASE WHEN {_W.format('text')} > 150 THEN 'too_long' END, CASE WHEN {_W.format('text')} < 20 THEN 'too_short' END,
CASE WHEN NOT regexp_matches(text, '\\(\\d+[a-z]?\\)') THEN 'no_reference_sign' END, CASE WHEN regexp_matches(text, '\\n[ \\t]*\\n') THEN 'paragraphs' END,
CASE WHEN source LIKE '%1' AND NOT regexp_matches(text, '(?i)fig(?:ure|\\.)\\s*\\d+') THEN 'no_figure' END], lambda x: x IS NOT NULL), ',') AS issues FROM documents""")
def abstract_issues(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(filings.abstract_issues(F.col("text"), F.endswith("source", F.lit("1"))), ",").alias("issues"))


_TITLE = "CASE p_partkey % 5 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN p_name || ' (TM)' WHEN 2 THEN p_type WHEN 3 THEN repeat(p_name || ' ', 10) ELSE split_part(p_name, ' ', 1) END"


@query(f"""WITH t AS (SELECT p_partkey, trim({_TITLE}) AS t FROM part)
SELECT p_partkey, array_to_string(list_filter([CASE WHEN length(t) > 500 THEN 'CRITICAL:length' END, CASE WHEN length(t) > 100 AND length(t) <= 500 THEN 'INFO:length' END,
CASE WHEN regexp_matches(t, '(?i)^(a|an|the)\\s') THEN 'INFO:article' END, CASE WHEN {_W.format('t')} < 2 THEN 'CRITICAL:short' END, CASE WHEN contains(t, '(TM)') OR contains(t, '(R)') OR contains(t, '(c)') THEN 'WARNING:trademark' END], lambda x: x IS NOT NULL), ',') AS issues FROM t""")
def title_issues(spark, d):
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    title = F.when(k == 0, F.concat(F.lit("The "), name)).when(k == 1, F.concat(name, F.lit(" (TM)"))).when(k == 2, F.col("p_type")).when(k == 3, F.repeat(F.concat(name, F.lit(" ")), 10)).otherwise(F.split_part(name, F.lit(" "), F.lit(1)))
    said = F.transform(filings.title_issues(title), lambda x: F.concat_ws(":", x["severity"], x["problem"]))
    return table(spark, d, "part").select("p_partkey", F.array_join(said, ",").alias("issues"))


# claims of a filing: ten parts, in their own words
_CLAIMS = """WITH c AS (SELECT p_partkey // 10 AS filing, (p_partkey % 10 + 1)::INT AS claim, CASE WHEN p_partkey % 10 > 0 AND p_size % 4 > 0 THEN (p_size % (p_partkey % 10) + 1)::INT END AS depends_on,
CASE p_size % 5 WHEN 0 THEN 'A method of ' || p_name WHEN 1 THEN 'Use of ' || p_name WHEN 2 THEN 'An apparatus, characterised in that ' || p_name WHEN 3 THEN p_name || ' by a computer program for a game' ELSE p_name END AS body FROM part)
"""


def _claims(spark, d):
    n = (F.col("p_partkey") % 10).cast("int")
    size, name = F.col("p_size"), F.col("p_name")
    body = F.when(size % 5 == 0, F.concat(F.lit("A method of "), name)).when(size % 5 == 1, F.concat(F.lit("Use of "), name)).when(size % 5 == 2, F.concat(F.lit("An apparatus, characterised in that "), name))
    body = body.when(size % 5 == 3, F.concat(name, F.lit(" by a computer program for a game"))).otherwise(name)
    up = F.when((n > 0) & (size % 4 > 0), F.try_mod(size, n) + 1)
    return table(spark, d, "part").select(F.floor(F.col("p_partkey") / 10).alias("filing"), (n + 1).alias("claim"), up.alias("depends_on"), body.alias("body"))


@query(_CLAIMS + r"""SELECT filing, claim, CASE WHEN regexp_matches(lower(body), '^(a\s+method\b|a\s+process\b|method\s+)') THEN 'process' WHEN regexp_matches(lower(body), '^use\s+of\b') THEN 'use'
WHEN regexp_matches(lower(body), '^(a\s+device\b|a\s+system\b|a\s+apparatus\b|an\s+apparatus\b)') THEN 'apparatus' ELSE 'product' END AS category, contains(body, 'characterised in that') AS two_part,
CASE WHEN contains(body, 'computer program') THEN 'computer program,game' ELSE '' END AS excluded FROM c""")
def claim_categories(spark, d):
    body = F.col("body")
    return _claims(spark, d).select("filing", "claim", filings.category(body).alias("category"), filings.two_part(body).alias("two_part"), F.array_join(filings.excluded(body), ",").alias("excluded"))


@query(_CLAIMS + r""", k AS (SELECT filing, depends_on IS NULL AS ind, CASE WHEN body LIKE 'A method%' THEN 'process' WHEN body LIKE 'Use of%' THEN 'use' WHEN body LIKE 'An app%' THEN 'apparatus' ELSE 'product' END AS kind FROM c)
SELECT filing, 'fee' AS issue, count(*) || ' claims' AS term, 'MINOR' AS severity FROM k GROUP BY filing HAVING count(*) > 15
UNION ALL SELECT filing, 'category', count(*) || ' independent ' || kind || ' claims', 'IMPORTANT' FROM k WHERE ind GROUP BY filing, kind HAVING count(*) > 1""")
def claims_conciseness(spark, d):
    claims = _claims(spark, d).withColumn("kind", filings.category(F.col("body"))).withColumn("ind", F.col("depends_on").isNull())
    return filings.conciseness(claims, "filing", "ind", "kind")


@query(_CLAIMS + """SELECT filing, count(DISTINCT claim) AS n_claims, NOT bool_or(depends_on IS NULL) AS no_independent, NOT (min(claim) = 1 AND max(claim) = count(DISTINCT claim)) AS not_consecutive FROM c GROUP BY filing""")
def claims_numbering(spark, d):
    return filings.numbering(_claims(spark, d).withColumn("ind", F.col("depends_on").isNull()), "filing", "claim", "ind")


@query("WITH RECURSIVE " + _CLAIMS[5:] + """, u AS (SELECT filing, claim, claim AS at, 0 AS depth FROM c UNION ALL SELECT u.filing, u.claim, c.depends_on, u.depth + 1 FROM u JOIN c ON u.filing = c.filing AND u.at = c.claim WHERE c.depends_on IS NOT NULL)
SELECT u.filing, u.claim, u.at AS root, u.depth::INT AS depth FROM u JOIN c ON u.filing = c.filing AND u.at = c.claim WHERE c.depends_on IS NULL""")
def claim_ancestors(spark, d):
    return filings.ancestors(_claims(spark, d), "filing", "claim", "depends_on")


@query(r"""WITH e AS (SELECT DISTINCT array_to_string(list_slice(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), 1, 2), ' ') AS element FROM benchmark),
w AS (SELECT element, unnest(list_distinct(regexp_extract_all(element, '[a-z0-9]+'))) AS word, len(list_distinct(regexp_extract_all(element, '[a-z0-9]+'))) AS n FROM e),
p AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+'))) AS word FROM documents),
h AS (SELECT element, doc_id FROM w JOIN p USING (word) GROUP BY element, doc_id, n HAVING count(*) = n)
SELECT element, count(doc_id) AS n_paragraphs, CASE count(doc_id) WHEN 0 THEN 'CRITICAL' WHEN 1 THEN 'IMPORTANT' END AS severity FROM e LEFT JOIN h USING (element) GROUP BY element""")
def claim_support(spark, d):
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]{4,}"), F.lit(0))
    elements = table(spark, d, "benchmark").select(F.array_join(F.slice(words, 1, 2), " ").alias("element"))
    return filings.support(elements, table(spark, d, "documents"), "element", ["doc_id"], "text")


# a query log made of events
_LOG = """WITH e AS (SELECT event_id, user_id % 25 AS campaign, json_extract_string(props, '$.k')::INT AS k, event_type FROM events),
l AS (SELECT campaign, ['TWA', 'US', 'cnb', 'EP', 'usb', ''][k % 6 + 1] AS database, CASE WHEN k % 3 = 0 THEN ['h01m ' || k, 'B60L'] WHEN k % 3 = 1 THEN ['G06F'] ELSE [] END AS class_codes,
CASE WHEN k % 2 = 0 THEN ['cell', event_type] ELSE [' '] END AS keywords, CASE WHEN k % 7 > 0 THEN substr(event_type, 1, 1) END AS concept_group, ['AND', 'or', 'AND+NOT', 'SINGLE', NULL][k % 5 + 1] AS boolean FROM e WHERE k % 5 = campaign % 5 OR campaign < 15),
s AS (SELECT *, upper(trim(coalesce(boolean, ''))) AS b, len(list_filter(class_codes, lambda x: trim(x) <> '')) AS nc, len(list_filter(keywords, lambda x: trim(x) <> '')) AS nk, CASE WHEN substr(upper(trim(database)), 1, 2) IN ('CN', 'TW', 'US') THEN substr(upper(trim(database)), 1, 2) END AS j FROM l),
b AS (SELECT *, list_distinct(list_concat(CASE WHEN contains(b, '+') THEN list_filter(string_split(b, '+'), lambda x: x NOT IN ('', 'SINGLE')) ELSE [] END, CASE WHEN nc >= 2 OR nk >= 2 OR b = 'OR' THEN ['OR'] ELSE [] END, CASE WHEN b = 'AND' AND least(nc, 1) + nk >= 2 THEN ['AND'] ELSE [] END)) AS shapes FROM s),
c AS (SELECT campaign, count(*) AS queries, count(DISTINCT nullif(upper(trim(concept_group)), '')) AS concept_groups, len(list_distinct(flatten(list(shapes)))) AS combos,
count(DISTINCT j) AS jurisdictions, count(*) FILTER (j = 'CN') AS n_cn, count(*) FILTER (j = 'TW') AS n_tw, count(*) FILTER (j = 'US') AS n_us FROM b GROUP BY campaign),
a AS (SELECT campaign, count(DISTINCT nullif(replace(upper(trim(x)), ' ', ''), '')) AS class_anchors FROM (SELECT campaign, unnest(CASE WHEN len(class_codes) = 0 THEN [NULL] ELSE class_codes END) AS x FROM b) GROUP BY campaign),
g AS (SELECT *, (class_anchors < 3)::INT + (concept_groups < 3)::INT + (jurisdictions < 3)::INT + (combos < 2)::INT + (queries < 40)::INT AS n_gaps, (n_cn < 2)::INT + (n_tw < 2)::INT + (n_us < 2)::INT AS few FROM c JOIN a USING (campaign))
SELECT campaign, queries, class_anchors, concept_groups, jurisdictions::INT AS jurisdictions, combos::INT AS boolean_combos, n_cn, n_tw, n_us, n_gaps::INT AS n_gaps, CASE WHEN n_gaps > 0 THEN 'FAIL' WHEN few > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM g"""


@query(_LOG)
def audit_verdict(spark, d):
    k = F.get_json_object("props", "$.k").cast("int")
    pick = lambda options, i: F.element_at(F.array(*map(F.lit, options)), i + 1)
    none = F.array().cast("array<string>")
    log = table(spark, d, "events").select(
        (F.col("user_id") % 25).alias("campaign"), k.alias("k"), pick(["TWA", "US", "cnb", "EP", "usb", ""], k % 6).alias("database"),
        F.when(k % 3 == 0, F.array(F.concat(F.lit("h01m "), k.cast("string")), F.lit("B60L"))).when(k % 3 == 1, F.array(F.lit("G06F"))).otherwise(none).alias("class_codes"),
        F.when(k % 2 == 0, F.array(F.lit("cell"), F.col("event_type"))).otherwise(F.array(F.lit(" "))).alias("keywords"),
        F.when(k % 7 > 0, F.substring("event_type", 1, 1)).alias("concept_group"), pick(["AND", "or", "AND+NOT", "SINGLE", None], k % 5).alias("boolean"),
    ).where("k % 5 = campaign % 5 or campaign < 15")
    out = audit.verdict(log, "campaign", audit.overrides("min_queries=40 min_class_anchors=2"))
    return out.select("campaign", "queries", "class_anchors", "concept_groups", F.size("present").alias("jurisdictions"), F.size("boolean_shapes").alias("boolean_combos"), "n_cn", "n_tw", "n_us", F.size("gaps").alias("n_gaps"), "verdict")


@query("SELECT lang, count(*) FILTER (quality IS NOT NULL) AS filled, count(*) FILTER (quality IS NULL) AS missing, count(DISTINCT quality) AS distinct_values, round(100.0::DOUBLE * count(*) FILTER (quality IS NOT NULL) / count(*), 1) AS pct FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def fill_rates(spark, d):
    return audit.fill_rate(table(spark, d, "documents").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left"), "quality", "lang")


@query("""WITH e AS (SELECT *, row_number() OVER (PARTITION BY event_type, value < 20 ORDER BY event_id) AS n FROM events)
SELECT event_type, count(*) FILTER (value < 20) AS errors, count(*) FILTER (NOT value < 20) AS successes, array_to_string(list(event_id::VARCHAR ORDER BY n) FILTER (value < 20 AND n <= 10), ',') AS samples FROM e GROUP BY event_type""")
def error_samples(spark, d):
    return audit.error_counts(table(spark, d, "events"), "event_type", F.col("value") < 20, "event_id", "event_id")


@query("""WITH f AS (SELECT *, CASE WHEN event_type IN ('click', 'view', 'error') THEN 'bad' WHEN value < 60 THEN 'worse' END AS f FROM events),
g AS (SELECT *, f IS DISTINCT FROM lag(f) OVER w OR row_number() OVER w = 1 AS c FROM f WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(c::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS run FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS nth FROM r)
SELECT user_id, min(event_id) AS cut, arg_min(f, event_id) AS reason FROM n WHERE nth = 8 AND f IS NOT NULL GROUP BY user_id""")
def failure_cut(spark, d):
    failure = F.when(F.col("event_type").isin("click", "view", "error"), "bad").when(F.col("value") < 60, "worse")
    return audit.fuse(table(spark, d, "events"), "user_id", ["event_id"], failure).select("user_id", F.col("cut.event_id").alias("cut"), "reason")


@query("""WITH r AS (SELECT o_custkey, o_orderkey, o_orderkey - row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) AS run, o_custkey % 50 AS grp FROM orders WHERE o_orderkey % 7 < 6 AND o_custkey % 3 < 2),
g AS (SELECT grp, run, min(o_orderkey) AS first, count(*) AS length FROM r GROUP BY grp, run)
SELECT grp, arg_max(first, {'l': length, 'f': -first}) AS first, max(length) AS length FROM g GROUP BY grp""")
def longest_runs(spark, d):
    o = table(spark, d, "orders").withColumn("grp", F.col("o_custkey") % 50)
    return audit.longest_run(o, "grp", "o_orderkey", (F.col("o_orderkey") % 7 < 6) & (F.col("o_custkey") % 3 < 2))


@query(r"""WITH p AS (SELECT conv_id, turn, text || CASE WHEN conv_id % 3 = 0 AND turn = 2 THEN ' see FIG. 1 here' WHEN turn % 2 = 1 THEN ' parts 12, 14, 116, 18, 20 and ' || (100 + turn) ELSE '' END AS t FROM conversations),
q AS (SELECT conv_id, turn, regexp_matches(t, '(?i)fig\.?\s*1\b') AND turn >= 2 AS named, len(list_distinct(regexp_extract_all(t, '\b\d{2,3}\b'))) AS n FROM p)
SELECT conv_id, coalesce(min(turn) FILTER (named), arg_max(turn, {'n': n, 't': -turn}) FILTER (n >= 5)) AS page FROM q GROUP BY conv_id""")
def figure_pages(spark, d):
    more = F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") == 2), " see FIG. 1 here").when(F.col("turn") % 2 == 1, F.concat(F.lit(" parts 12, 14, 116, 18, 20 and "), (100 + F.col("turn")).cast("string"))).otherwise("")
    return audit.figure_page(table(spark, d, "conversations").withColumn("text", F.concat("text", more)), "conv_id", "turn", "text")


@query("SELECT o_orderkey, CASE WHEN age >= lim THEN 'expired' WHEN age >= lim - 200 THEN 'warn' ELSE 'live' END AS state FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '2001-08-01') AS age, CASE o_orderstatus WHEN 'F' THEN 2000 WHEN 'O' THEN 1500 ELSE 1500 END AS lim FROM orders)")
def idle_states(spark, d):
    idle = F.datediff(F.lit("2001-08-01").cast("date"), F.col("o_orderdate").cast("date"))
    return audit.reap(table(spark, d, "orders"), "o_orderstatus", idle, {"F": 2000, "O": 1500}, 200).select("o_orderkey", "state")


@query("""WITH p AS (SELECT doc_id FROM documents WHERE n_chars >= 500), r AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1), n AS (SELECT (SELECT count(*) FROM p) AS p, (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM p JOIN r USING (doc_id)) AS h)
SELECT h AS hits, round(h::DOUBLE / p, 6) AS precision, round(h::DOUBLE / r, 6) AS recall, round(2 * (h::DOUBLE / p) * (h::DOUBLE / r) / (h::DOUBLE / p + h::DOUBLE / r), 6) AS f1 FROM n""")
def pool_quality(spark, d):
    return audit.pool_quality(table(spark, d, "documents").where("n_chars >= 500"), table(spark, d, "labels").where("quality = 1"), "doc_id")


@query("SELECT (SELECT count(*) FROM labels) AS ledger, (SELECT count(*) FROM documents WHERE doc_id % 3 > 0) AS files, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 > 0)) AS dangling, (SELECT count(*) FROM documents WHERE doc_id % 3 > 0 AND doc_id NOT IN (SELECT doc_id FROM labels)) AS unlisted")
def ledger_check(spark, d):
    return audit.reconcile(table(spark, d, "labels"), table(spark, d, "documents").where("doc_id % 3 > 0"), "doc_id")


@query("WITH p AS (SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT o_custkey, sum(q) AS slices, max(o_custkey % 200 + 0.0::DOUBLE) AS total, abs(sum(q) - max(o_custkey % 200)) <= 0.05 * max(o_custkey % 200) AS agrees FROM orders JOIN p ON o_orderkey = l_orderkey GROUP BY o_custkey")
def slice_sums(spark, d):
    per = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").alias("q"))
    return audit.slice_sum(table(spark, d, "orders").join(per, "o_orderkey").withColumn("t", (F.col("o_custkey") % 200).cast("double")), "o_custkey", "q", "t")


_FTS = """WITH t AS (SELECT doc_id, lang, lower(coalesce(text, '') || chr(10) || coalesce(source, '')) AS low, greatest(length(coalesce(text, '')) - 2, 0) + greatest(length(coalesce(source, '')) - 2, 0) AS len FROM documents),
f AS (SELECT *, ((length(low) - length(replace(low, 'ation', ''))) / 5)::BIGINT AS a, ((length(low) - length(replace(low, 'the ', ''))) / 4)::BIGINT AS b FROM t),
s AS (SELECT count(*) AS n, avg(len) AS al, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM f),
r AS (SELECT doc_id, lang, round(-(greatest(ln((n - da + 0.5::DOUBLE) / (da + 0.5::DOUBLE)), 1e-6::DOUBLE) * a * 2.2::DOUBLE / (a + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al)) + greatest(ln((n - db + 0.5::DOUBLE) / (db + 0.5::DOUBLE)), 1e-6::DOUBLE) * b * 2.2::DOUBLE / (b + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))), 6) AS rank FROM f, s WHERE a > 0 AND b > 0)
SELECT doc_id, lang, rank FROM r"""


@query(_FTS)
def fts_rank(spark, d):
    return fulltext.search(table(spark, d, "documents"), ["text", "source"], ["ation", "the "], ["doc_id", "lang"]).withColumn("rank", F.round("rank", 6))


@query("""SELECT 'number' AS mode, doc_id, lang FROM documents WHERE doc_id = 7
UNION ALL (SELECT 'place', doc_id, lang FROM documents WHERE lang = 'fr' ORDER BY n_chars DESC, doc_id LIMIT 20) UNION ALL (SELECT 'newest', doc_id, lang FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20)""")
def store_modes(spark, d):
    out = None
    for mode, how in (("number", {"number": 7}), ("place", {"place": "fr"}), ("newest", {})):
        rows, _ = fulltext.store_query(table(spark, d, "documents"), "doc_id", ["text"], ["doc_id", "lang"], "n_chars", "lang", **how)
        rows = rows.select(F.lit(mode).alias("mode"), "doc_id", "lang")
        out = rows if out is None else out.unionByName(rows)
    return out


@query(r"""WITH b AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS w FROM documents),
u AS (SELECT DISTINCT doc_id, unnest(w) AS t FROM b), df AS (SELECT t, count(*) AS df FROM u GROUP BY t), n AS (SELECT count(*) AS n, avg(len(w)) AS al FROM b),
i AS (SELECT t, ln(n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM df, n), e AS (SELECT avg(idf) AS mean FROM i),
q AS (SELECT t, CASE WHEN idf < 0 THEN 0.25::DOUBLE * mean ELSE idf END AS w FROM i, e WHERE t IN ('the', 'que', 'und')),
f AS (SELECT doc_id, len(b.w) AS len, coalesce(sum(q.w * len(list_filter(b.w, lambda x: x = q.t)) * 2.5::DOUBLE / (len(list_filter(b.w, lambda x: x = q.t)) + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len(b.w) / al))), 0) AS score FROM b LEFT JOIN q ON true, n GROUP BY doc_id, b.w, al)
SELECT doc_id, round(score, 6) AS score FROM f""")
def okapi_scores(spark, d):
    docs = table(spark, d, "documents")
    return fulltext.okapi(docs, ["the", "que", "und"])


@query("SELECT user_id, round(sum(value), 9) AS value, max(event_id) AS event_id, count(*) AS queries FROM events GROUP BY user_id")
def candidate_sums(spark, d):
    e = table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(20,6)"))
    return fulltext.accumulate(e, "user_id", "value", ["event_id"]).withColumn("value", F.round(F.col("value").cast("double"), 9))


@query("""WITH k AS (SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN 'P' || page_id % 10 ELSE '' END), ''), nullif(trim(CASE WHEN page_id % 2 = 0 THEN split_part(url, '/', 3) END), ''), substr(html, 1, 120)) AS key FROM pages)
SELECT min(page_id) AS page_id FROM k GROUP BY key""")
def merged_hits(spark, d):
    k = F.col("page_id")
    hits = table(spark, d, "pages").select("page_id", F.when(k % 3 == 0, F.concat(F.lit("P"), (k % 10).cast("string"))).otherwise("").alias("number"), F.when(k % 2 == 0, F.split_part("url", F.lit("/"), F.lit(3))).alias("link"), F.col("html").alias("title"))
    return fulltext.merge_hits(hits, "number", "link", "title", ["page_id"]).select("page_id")


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y%m%d') AS day FROM orders WHERE strftime(o_orderdate, '%Y%m%d') >= '19970300' AND strftime(o_orderdate, '%Y%m%d') <= '19989999'")
def date_range(spark, d):
    return table(spark, d, "orders").where(gateway.within(F.col("o_orderdate"), "199703", "1998")).select("o_orderkey", F.date_format("o_orderdate", "yyyyMMdd").alias("day"))


@query("SELECT c_custkey, c_name LIKE 'CUSTOMER#00000000%' OR upper(trim(c_name)) LIKE 'CUSTOMER#0000001%' AS named FROM customer")
def name_prefixes(spark, d):
    return table(spark, d, "customer").select("c_custkey", gateway.name_prefix(F.col("c_name"), ["customer#0000001"]).alias("named"))


_NUMBER = "['TWI', 'US', 'CN2', 'EP', 'USAU', 'TWM', 'US20', 'TW'][(p_partkey % 8 + 1)::INT] || lpad((p_partkey * 7919 % 100000000)::VARCHAR, 8, '0') || ['B2', 'A1', '', 'U'][(p_partkey % 4 + 1)::INT]"


@query(f"""WITH n AS (SELECT p_partkey, {_NUMBER} AS number FROM part), t AS (SELECT *, substr(number, 3) AS body, regexp_replace(substr(number, 3), '[A-Z]\\d?$', '') AS digits FROM n)
SELECT p_partkey, number, CASE WHEN number LIKE 'US%' THEN CASE WHEN regexp_matches(body, '^[A-Za-z]{{2}}.') THEN substr(body, 1, 2) || regexp_replace(substr(body, 3), '[A-Z]\\d?$', '')
 WHEN NOT regexp_matches(digits, '^\\d+$') THEN number WHEN length(digits) = 11 THEN 'US' || substr(digits, 1, 4) || substr(digits, 6) WHEN length(digits) = 10 AND digits LIKE '20%' THEN 'US' || digits ELSE 'US' || digits::BIGINT END
 WHEN number LIKE 'CN%' THEN 'CN' || digits || CASE WHEN length(digits) = 9 AND digits LIKE '2%' THEN 'U' ELSE '' END
 WHEN number LIKE 'TW%' THEN CASE WHEN regexp_matches(body, '^I\\d+$') THEN 'TW' || body || 'B' WHEN regexp_matches(body, '^M\\d+$') THEN 'TW' || body || 'U' ELSE 'TW' || digits END ELSE substr(number, 1, 2) || digits END AS epodoc,
 regexp_extract(number, '(20\\d{{2}}|19\\d{{2}})', 1) AS year FROM t""")
def epodoc_numbers(spark, d):
    k = F.col("p_partkey")
    pick = lambda options, n: F.element_at(F.array(*map(F.lit, options)), (k % n + 1).cast("int"))
    number = F.concat(pick(["TWI", "US", "CN2", "EP", "USAU", "TWM", "US20", "TW"], 8), F.lpad((k * 7919 % 100000000).cast("string"), 8, "0"), pick(["B2", "A1", "", "U"], 4))
    rows = table(spark, d, "part").select("p_partkey", number.alias("number"))
    return rows.select("p_partkey", "number", patent_text.epodoc(F.col("number")).alias("epodoc"), F.coalesce(patent_text.year(F.lit(None).cast("string"), F.col("number")), F.lit("")).alias("year"))


@query("""SELECT 'US' || (1000000 + doc_id) AS pubno, lang || '; ' || source AS ipc, trim(coalesce(text, '')) AS title, CASE WHEN doc_id % 2 = 0 THEN source ELSE lang || '; ' || source END AS assignee FROM documents""")
def biblio_records(spark, d):
    docs = table(spark, d, "documents")
    names = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.trim(F.coalesce("text", F.lit(""))).alias("title"), F.col("source").alias("applicants"), F.array("lang", "source").alias("ipc"))))
    names = names.otherwise(F.to_json(F.struct(F.trim(F.coalesce("text", F.lit(""))).alias("title"), F.array("lang", "source").alias("applicants"), F.array("lang", "source").alias("ipc"))))
    rows = docs.select(F.concat(F.lit("US"), (1000000 + F.col("doc_id")).cast("string")).alias("n"), names.alias("b"))
    return adapters.biblio_record(rows, "n", "b").select("pubno", "ipc", "title", "assignee")


@query("""WITH n AS (SELECT conv_id, turn, regexp_replace(text, '([0-9])[.、]', '\\1;', 'g') AS text FROM conversations), t AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'What is claimed is:' WHEN 1 THEN 'x 1. ' || text || ' 2. rest' WHEN 2 THEN '' ELSE text END AS t FROM n)
SELECT conv_id, turn, turn % 4 IN (0, 2) OR regexp_matches(t, '^\\s*$') AS empty, CASE turn % 4 WHEN 0 THEN t WHEN 1 THEN trim(regexp_replace(trim(text_), '\\s+', ' ', 'g')) WHEN 2 THEN 'Claim 1 not found.' ELSE trim(t) END AS claim FROM t JOIN (SELECT conv_id, turn, text AS text_ FROM n) USING (conv_id, turn)""")
def claim_texts(spark, d):
    # numbers that end in a stop would be claims themselves
    k, text = F.col("turn") % 4, F.regexp_replace("text", "([0-9])[.、]", "$1;")
    t = F.when(k == 0, "What is claimed is:").when(k == 1, F.concat(F.lit("x 1. "), text, F.lit(" 2. rest"))).when(k == 2, "").otherwise(text)
    rows = table(spark, d, "conversations").select("conv_id", "turn", t.alias("t"))
    return rows.select("conv_id", "turn", patent_text.claim1_empty(F.col("t")).alias("empty"), patent_text.claim1(F.col("t")).alias("claim"))
