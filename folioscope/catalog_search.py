"""Registered queries for field-qualified search, phased backfill, absorbing, the usage ledger and life cycles."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import pubno
from folioscope.operators import backfill, lifecycle
from folioscope.plans import field_query
from folioscope.registry import query
from folioscope.sources.tables import table
from folioscope.streaming import ledger

_TOKENS = r"' ' || array_to_string(list_transform(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}%]+'), lambda t: t || ' '), '')"
_FIELDS = '(the [1,3] of or "qu* est" or (und or les)[-2,4](der or des))@TX and not (thr*)@TX,SO or SO=web* and LA=de'


@query(rf"""WITH t AS (SELECT doc_id, lang, source, {_TOKENS.format("coalesce(text, '')")} AS tx, {_TOKENS.format("coalesce(source, '')")} AS so FROM documents),
w AS (SELECT doc_id, unnest(string_split(trim(tx), ' ')) AS word, generate_subscripts(string_split(trim(tx), ' '), 1) AS pos FROM t),
n AS (SELECT DISTINCT a.doc_id FROM w a JOIN w b ON a.doc_id = b.doc_id AND ((a.word = 'the' AND b.word = 'of' AND b.pos - a.pos BETWEEN 1 AND 3) OR (a.word IN ('und', 'les') AND b.word IN ('der', 'des') AND b.pos - a.pos BETWEEN -2 AND 4)) WHERE a.word IN ('the', 'und', 'les') AND b.word IN ('of', 'der', 'des'))
SELECT doc_id FROM t WHERE ((doc_id IN (SELECT doc_id FROM n) OR regexp_matches(tx, ' qu[^ ]* est ')) AND NOT (regexp_matches(tx, ' thr[^ ]* ') OR regexp_matches(so, ' thr[^ ]* '))) OR (coalesce(starts_with(source, 'web'), false) AND coalesce(lang = 'de', false))""")
def field_search(spark, d):
    fields = {"TX": F.col("text"), "SO": F.col("source"), "LA": F.col("lang")}
    return table(spark, d, "documents").where(field_query.compile(_FIELDS, fields, ["TX"])).select("doc_id")


@query("""WITH p AS (SELECT *, '2024' || lpad((p_size % 12 + 1)::VARCHAR, 2, '0') || lpad((p_partkey % 28 + 1)::VARCHAR, 2, '0') AS day FROM part)
SELECT p_partkey FROM p WHERE ((regexp_matches(lower(p_name), '\\b(ring|bolt)\\b') AND day >= '202403' AND day <= '20240799') OR p_partkey IN (3, 5, 8, 9999999)) AND NOT regexp_matches(lower(p_name), '^hot\\b') AND p_brand <> 'Brand#1'""".replace("\\\\", "\\"))
def field_conditions(spark, d):
    day = F.concat(F.lit("2024"), F.lpad((F.col("p_size") % 12 + 1).cast("string"), 2, "0"), F.lpad((F.col("p_partkey") % 28 + 1).cast("string"), 2, "0"))
    fields = {"TI": F.col("p_name"), "PN": F.col("p_partkey").cast("string"), "ID": day, "BR": F.col("p_brand")}
    rows = [("AND", "TI", "ring or bolt"), ("AND", "ID", "202403:202407"), ("OR", "PN", "3 or 5 or 8 or 9999999"), ("NOT", "TI", "hot*")]
    return table(spark, d, "part").where(field_query.conditions(rows, fields) & ~field_query.compile('BR="Brand#1"', fields, ["TI"])).select("p_partkey")


# a pool of parts in batches of a hundred: abstracts and claims that three sources fill in turn
_POOL = """WITH p AS (SELECT p_partkey // 100 AS batch, p_partkey AS nth, CASE WHEN p_partkey % 10 = 7 THEN 'TW' ELSE 'US' END || lpad(p_partkey::VARCHAR, 7, '0') AS pubno,
CASE WHEN p_partkey % 5 = 0 THEN repeat(p_name || ' ', 4) END AS abstract, CASE WHEN p_partkey % 7 = 0 THEN 'short' END AS claim1, p_name, p_type, p_size, p_partkey FROM part),
a AS (SELECT *, CASE WHEN length(trim(coalesce(abstract, ''))) >= 25 THEN NULL WHEN batch % 6 = 5 AND p_partkey % 100 >= 40 THEN 'failed' WHEN p_size % 3 = 0 THEN 'missed' WHEN p_size % 3 = 1 AND p_size % 2 = 0 THEN 'rejected' ELSE 'filled' END AS o1 FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY batch, o1 ORDER BY nth) AS f1 FROM a),
c AS (SELECT *, min(CASE WHEN o1 = 'failed' AND f1 = 8 THEN nth END) OVER (PARTITION BY batch) AS cut FROM t),
d1 AS (SELECT *, o1 = 'filled' AND (cut IS NULL OR nth <= cut) AS took1 FROM c),
s2 AS (SELECT *, CASE WHEN took1 THEN repeat(p_type || ' one ', 5) ELSE abstract END AS ab FROM d1),
s3 AS (SELECT *, cut IS NULL AND length(trim(coalesce(ab, ''))) < 25 AND pubno LIKE 'US%' AND p_size % 4 > 0 AS took2 FROM s2)
"""


def _pool(spark, d):
    part, k = table(spark, d, "part"), F.col("p_partkey")
    number = F.concat(F.when(k % 10 == 7, "TW").otherwise("US"), F.lpad(k.cast("string"), 7, "0"))
    p = part.select(F.floor(k / 100).alias("batch"), k.alias("nth"), number.alias("pubno"), F.when(k % 5 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 4)).alias("abstract"), F.when(k % 7 == 0, "short").alias("claim1"), "p_name", "p_type", "p_size")
    size = F.col("p_size")
    down = (F.col("batch") % 6 == 5) & (F.col("nth") % 100 >= 40)
    text = lambda column, word: F.repeat(F.concat(F.col(column), F.lit(f" {word} ")), 5)
    ids = F.when((size % 3 == 1) & (size % 2 == 0), F.array(F.lit("EP999999999"))).when(size % 3 == 1, F.array(F.concat("pubno", F.lit("B2")).substr(3, 7), F.lit("US1"))).otherwise(F.array().cast("array<string>"))
    one = p.where((size % 3 != 0) | down).select("pubno", text("p_type", "one").alias("abstract"), F.when(down, "BACKEND_DOWN").alias("error"), ids.alias("ids"))
    two = p.where(size % 4 > 0).select("pubno", text("p_name", "two").alias("abstract"))
    three = p.select("pubno", text("p_name", "a claim").alias("claim1"))
    phases = [backfill.Phase("search", one, ["abstract"], "error", "ids"), backfill.Phase("biblio", two, ["abstract"], skip=F.startswith("pubno", F.lit("TW"))), backfill.Phase("claims", three, ["claim1"])]
    return backfill.backfill(p.drop("p_name", "p_type", "p_size"), "batch", "nth", "pubno", ["abstract", "claim1"], phases)


@query(_POOL + """SELECT batch, nth, pubno, CASE WHEN took1 THEN trim(repeat(p_type || ' one ', 5)) WHEN took2 THEN trim(repeat(p_name || ' two ', 5)) ELSE abstract END AS abstract,
CASE WHEN took1 THEN 'search' WHEN took2 THEN 'biblio' END AS abstract_source, CASE WHEN cut IS NULL THEN trim(repeat(p_name || ' a claim ', 5)) ELSE claim1 END AS claim1, CASE WHEN cut IS NULL THEN 'claims' END AS claim1_source FROM s3""")
def phased_backfill(spark, d):
    return _pool(spark, d)[0]


@query(_POOL + """, r AS (SELECT batch, 'search' AS phase, o1 IS NOT NULL AND (cut IS NULL OR nth <= cut) AS asked, o1 AS o, false AS skipped, cut, CASE WHEN cut IS NOT NULL THEN 'BACKEND_DOWN' END AS reason FROM s3
UNION ALL SELECT batch, 'biblio', cut IS NULL AND length(trim(coalesce(ab, ''))) < 25 AND pubno LIKE 'US%', CASE WHEN took2 THEN 'filled' ELSE 'missed' END, cut IS NULL AND length(trim(coalesce(ab, ''))) < 25 AND pubno NOT LIKE 'US%', NULL, NULL FROM s3
UNION ALL SELECT batch, 'claims', cut IS NULL, 'filled', false, NULL, NULL FROM s3)
SELECT batch, phase, count(*) FILTER (asked) AS asked, count(*) FILTER (asked AND o = 'filled') AS filled, count(*) FILTER (asked AND o = 'missed') AS missed, count(*) FILTER (asked AND o = 'rejected') AS rejected, count(*) FILTER (asked AND o = 'failed') AS failed,
count(*) FILTER (skipped) AS skipped, max(cut) AS cut, max(reason) AS reason FROM r GROUP BY batch, phase""")
def backfill_report(spark, d):
    return _pool(spark, d)[1]


_ABSORB = """WITH s AS (SELECT 'US' || (c_custkey + 1000000) AS pubno, CASE WHEN c_custkey % 3 > 0 THEN c_name END AS title, CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE c_mktsegment END AS abstract, 'old' AS updated_at FROM customer WHERE c_custkey % 5 > 0),
r AS (SELECT CASE WHEN o_custkey % 11 > 0 THEN 'US' || (o_custkey + 1000000) END AS pubno, arg_min('t' || o_orderkey, o_orderkey) AS title, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS abstract FROM orders GROUP BY 1),
j AS (SELECT coalesce(s.pubno, r.pubno) AS pubno, s.title AS t, s.abstract AS a, r.title AS rt, r.abstract AS ra, s.pubno IS NULL AS new, r.pubno IS NOT NULL AS got, s.updated_at FROM s FULL JOIN (SELECT * FROM r WHERE pubno IS NOT NULL) r ON s.pubno = r.pubno),
m AS (SELECT *, CASE WHEN trim(coalesce(t, '')) = '' THEN coalesce(rt, t) ELSE t END AS title, CASE WHEN trim(coalesce(a, '')) = '' THEN coalesce(ra, a) ELSE a END AS abstract,
new OR (trim(coalesce(t, '')) = '' AND rt IS NOT NULL) OR (trim(coalesce(a, '')) = '' AND ra IS NOT NULL) AS wrote FROM j)
"""


def _absorbed(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    key = lambda k: F.concat(F.lit("US"), (F.col(k) + 1000000).cast("string"))
    store = c.where("c_custkey % 5 > 0").select(key("c_custkey").alias("pubno"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("title"), F.when(F.col("c_custkey") % 4 == 0, " ").otherwise(F.col("c_mktsegment")).alias("abstract"), F.lit("old").alias("updated_at"))
    # numbers as others write them, and a score that is nobody's business
    records = o.select(F.when(F.col("o_custkey") % 11 > 0, F.concat(F.lit("us "), (F.col("o_custkey") + 1000000).cast("string"))).alias("number"), F.col("o_orderkey").alias("_order"), F.concat(F.lit("t"), "o_orderkey").alias("name"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("text"), F.lit(5).alias("score"))
    return backfill.absorb(store, records, "pubno", ["title", "abstract"], {"title": F.col("name"), "abstract": F.col("text")}, F.when(F.col("number").isNotNull(), pubno.key(F.col("number"))), F.lit("now"))


@query(_ABSORB + "SELECT pubno, title, abstract, CASE WHEN got AND wrote THEN 'now' ELSE updated_at END AS updated_at FROM m")
def absorb_records(spark, d):
    return _absorbed(spark, d)[0]


@query(_ABSORB + "SELECT count(*) FILTER (new) AS imported, count(*) FILTER (got AND wrote AND NOT new) AS updated, count(*) FILTER (got AND NOT wrote) AS unchanged, (SELECT count(*) FROM orders WHERE o_custkey % 11 = 0) AS skipped FROM m")
def absorb_counts(spark, d):
    return _absorbed(spark, d)[1]


@query("""WITH e AS (SELECT strftime(ts, '%Y-%m') AS month, ts, (value * 100)::BIGINT AS b, CASE WHEN event_type = 'purchase' THEN 'reconciled' ELSE 'local' END AS kind FROM events),
g AS (SELECT month, coalesce(sum(b) FILTER (kind = 'local' AND b > 0), 0)::BIGINT AS local_bytes, arg_max(b, (ts, b)) FILTER (kind = 'reconciled') AS reconciled_bytes, max(ts) FILTER (kind = 'reconciled') AS told, max(ts) AS seen FROM e GROUP BY month)
SELECT month, local_bytes, reconciled_bytes, strftime(told, '%Y-%m-%d %H:%M:%S') AS reconciled_at, greatest(local_bytes, coalesce(reconciled_bytes, 0)) AS usage, coalesce(epoch(seen) - epoch(told) >= 900, true) AS due FROM g""")
def usage_ledger(spark, d):
    kind = F.when(F.col("event_type") == "purchase", "reconciled").otherwise("local")
    rows = table(spark, d, "events").select("ts", F.round(F.col("value") * 100).cast("long").alias("b"), kind.alias("kind"))
    return ledger.ledger(rows, "ts", "b", "kind").withColumn("reconciled_at", F.date_format("reconciled_at", "yyyy-MM-dd HH:mm:ss")).drop("as_of")


_YEARS = "y AS (SELECT p_type, year(l_shipdate)::INT AS year, count(*) AS n, count(DISTINCT l_suppkey) AS applicants FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"


@query(f"WITH {_YEARS} SELECT p_type, year, n, applicants, sum(n) OVER (PARTITION BY p_type ORDER BY year)::BIGINT AS total FROM y")
def life_cycle(spark, d):
    return _years(spark, d)


def _years(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), "l_suppkey", F.year("l_shipdate").alias("year"))
    return lifecycle.yearly(rows.join(table(spark, d, "part").select("p_partkey", "p_type"), "p_partkey"), ["p_type"], "year", "l_suppkey")


_V = "(k / (1 + exp(-r * (q[1] - m))))"
_SLOPES = ["(1 / (1 + exp(-r * (q[1] - m))))", "(k * (q[1] - m) * exp(-r * (q[1] - m)) / (1 + exp(-r * (q[1] - m))) ** 2)", "(-k * r * exp(-r * (q[1] - m)) / (1 + exp(-r * (q[1] - m))) ** 2)", f"(q[2] - {_V})"]
_SUMS = ", ".join(f"list_sum(list_transform(p, lambda q: {_SLOPES[i]} * {_SLOPES[j]})){' * (1 + damp)' if i == j else ''} AS s{i}{j}" for i in range(3) for j in range(i, 4))
_D = "({0} * ({4} * {8} - {5} * {7}) - {1} * ({3} * {8} - {5} * {6}) + {2} * ({3} * {7} - {4} * {6}))"
_M = ["s00", "s01", "s02", "s01", "s11", "s12", "s02", "s12", "s22"]


def _with(c: int) -> str:
    return _D.format(*[f"s{i // 3}3" if i % 3 == c else x for i, x in enumerate(_M)])


_SQUARES = "list_sum(list_transform(p, lambda q: (q[2] - {k} / (1 + exp(-{r} * (q[1] - {m})))) ** 2))"


@query(f"""WITH RECURSIVE {_YEARS}, t AS (SELECT p_type, year, sum(n) OVER (PARTITION BY p_type ORDER BY year)::DOUBLE AS y FROM y),
g AS (SELECT p_type, list([year::DOUBLE, y] ORDER BY year) AS p FROM t GROUP BY p_type),
b AS (SELECT p_type, p, p[-1][2] * 1.2 AS k, 4 / greatest(p[-1][1] - p[1][1], 1.0) AS r, list_filter(p, lambda q: q[2] * 2 >= p[-1][2])[1][1] AS m FROM g),
f AS (SELECT 0 AS i, p_type, p, k, r, m, 0.01::DOUBLE AS damp, {_SQUARES.format(k='k', r='r', m='m')} AS sse FROM b UNION ALL
SELECT i + 1, p_type, p, CASE WHEN good THEN nk ELSE k END, CASE WHEN good THEN nr ELSE r END, CASE WHEN good THEN nm ELSE m END, CASE WHEN good THEN greatest(damp / 3, 1e-12) ELSE least(damp * 5, 1e12) END, CASE WHEN good THEN nsse ELSE sse END FROM (
SELECT *, coalesce(nsse < sse AND nk > 0, false) AS good FROM (SELECT *, {_SQUARES.format(k='nk', r='nr', m='nm')} AS nsse FROM (SELECT *, k + {_with(0)} / nullif({_D.format(*_M)}, 0) AS nk, r + {_with(1)} / nullif({_D.format(*_M)}, 0) AS nr, m + {_with(2)} / nullif({_D.format(*_M)}, 0) AS nm FROM (SELECT *, {_SUMS} FROM f WHERE i < 60)))))
SELECT p_type, len(p)::INT AS years, round(k, 4) AS top, round(r, 4) AS rate, round(m, 4) AS middle, CASE WHEN p[-1][2] / k < 0.1 THEN 'emergence' WHEN p[-1][2] / k < 0.5 THEN 'growth' WHEN p[-1][2] / k < 0.9 THEN 'maturity' ELSE 'saturation' END AS stage FROM f WHERE i = 60""")
def s_curve(spark, d):
    rounded = [F.round(c, 4).alias(c) for c in ("top", "rate", "middle")]
    return lifecycle.s_curve(_years(spark, d), ["p_type"]).select("p_type", "years", *rounded, "stage")


@query("""WITH n AS (SELECT c_mktsegment, n_regionkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
SELECT c_mktsegment, n_regionkey, n, round(n / sum(n) OVER w, 6) AS share, CASE WHEN n_regionkey <> 2 THEN round(n / sum(n) FILTER (n_regionkey <> 2) OVER w, 6) END AS share_without FROM n WINDOW w AS (PARTITION BY c_mktsegment)""")
def region_shares(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    return lifecycle.region_share(table(spark, d, "customer").join(n, "c_nationkey"), ["c_mktsegment"], "n_regionkey", [2])
