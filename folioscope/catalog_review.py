"""Registered queries for antecedent basis, figures, support and enablement."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope import catalog_filings
from folioscope.operators import antecedents, citations, figures, trigram_index
from folioscope.registry import query
from folioscope.sources.tables import scratch, table

# filings of ten claims made of parts: claim k goes back to k - 1, or to an earlier one
_BODIES = {
    0: "'A ' || n || ' comprising a ' || t || ' that moves and two ' || n || 's with the ' || n || ' to hold said ' || t || ' , wherein the ' || t || 's are new'",
    1: "'The ' || n || ' wherein said ' || n || ' is red and the ' || t || 's are new, at least one box for the boxes to fill'",
    2: "'One or more ' || t || 's configured to turn the ' || t || ' with said ' || t || ' that turns;\n a) a lid for the lid to shut\n b) the lid is shut and the cup is full'",
    3: "'A plurality of ' || n || 's for the ' || n || ' to meet. The  ' || upper(n) || ' is one ' || n || ' that the ' || t || ' , or said ' || n || ' was'",
    4: "'the thing is a thing , the ' || n || ' that ' || n || 's with a body for the bodies to move'",
}
_CLAIMS = f"""c AS (SELECT p_partkey // 10 AS filing, (p_partkey % 10 + 1)::INT AS claim, lower(p_type) AS t, p_name AS n,
CASE WHEN p_size % 4 > 0 AND p_partkey % 10 > 0 THEN (CASE WHEN p_size % 4 = 1 THEN p_size % 12 + 1 ELSE p_partkey % 10 END)::INT END AS depends_on,
CASE p_size % 5 {' '.join(f'WHEN {k} THEN {b}' for k, b in _BODIES.items())} END AS body FROM part)"""


def _claims(spark, d):
    part = table(spark, d, "part").withColumns({"k": F.col("p_partkey") % 10, "n": F.col("p_name"), "t": F.lower("p_type")})
    body = None
    for k, b in _BODIES.items():
        body = (F if body is None else body).when(F.col("p_size") % 5 == k, F.expr(b.replace("\n", "\\n")))
    up = F.when((F.col("p_size") % 4 > 0) & (F.col("k") > 0), F.when(F.col("p_size") % 4 == 1, F.col("p_size") % 12 + 1).otherwise(F.col("k")).cast("int"))
    return part.select(F.floor(F.col("p_partkey") / 10).alias("filing"), (F.col("k") + 1).cast("int").alias("claim"), up.alias("depends_on"), body.alias("body"))


_LINEAGE = "l AS (SELECT filing, claim, claim AS ancestor FROM c UNION SELECT l.filing, l.claim, p.claim FROM l JOIN c ON c.filing = l.filing AND c.claim = l.ancestor JOIN c p ON p.filing = c.filing AND p.claim = c.depends_on)"
_STOPS = r"configured|comprising|wherein|that|for|to|with"
_FIND = "regexp_extract_all(body, '(?is){}', {})"
_NAME = r"\s+([a-z][a-z\s-]+?)\s+(?:{})"
_NORMAL = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_INTRODUCED = _FIND.format(r"\b(?:a|an|at least one|one or more|more than one|two or more|plurality of|one|two|three|four|five|six|seven|eight|nine|ten)" + _NAME.format(_STOPS + r"|,|;|\."), 1)
_USED = r"""SELECT filing, claim, '{w}' AS w, unnest(list_zip(regexp_extract_all(body, '(?is)(.*?)\b{w}""" + _NAME.format(_STOPS + r"|is|are|was|were|,|;|\.") + r"""', 1), regexp_extract_all(body, '(?is)(.*?)\b{w}""" + _NAME.format(_STOPS + r"|is|are|was|were|,|;|\.") + r"""', 2),
list_transform(regexp_extract_all(body, '(?is)(.*?)\b{w}""" + _NAME.format(_STOPS + r"|is|are|was|were|,|;|\.") + r"""'), lambda m: length(m)))) AS u, generate_subscripts(regexp_extract_all(body, '(?is)(.*?)\b{w}""" + _NAME.format(_STOPS + r"|is|are|was|were|,|;|\.") + r"""', 1), 1) AS i FROM c"""


@query(f"""WITH RECURSIVE {_CLAIMS}, {_LINEAGE},
k AS (SELECT DISTINCT l.filing, l.claim, {_NORMAL.format('x')} AS name FROM l JOIN (SELECT filing, claim, unnest({_INTRODUCED}) AS x FROM c) i ON i.filing = l.filing AND i.claim = l.ancestor),
u AS ({_USED.format(w='the')} UNION ALL {_USED.format(w='said')}),
v AS (SELECT filing, claim, w, {_NORMAL.format('u[2]')} AS name, (coalesce(sum(u[3]) OVER (PARTITION BY filing, claim, w ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(u[1]))::INT AS pos FROM u),
f AS (SELECT *, CASE WHEN w = 'the' THEN [name, CASE WHEN name LIKE '%ies' THEN left(name, -3) || 'y' WHEN regexp_matches(name, '(ses|xes|zes|ches|shes)$') THEN left(name, -2) WHEN name LIKE '%s' AND name NOT LIKE '%ss' THEN left(name, -1) ELSE name END,
CASE WHEN regexp_matches(name, '[^aeiou]y$') THEN left(name, -1) || 'ies' WHEN regexp_matches(name, '(s|x|z|ch|sh)$') THEN name || 'es' ELSE name || 's' END] ELSE [name] END AS forms FROM v)
SELECT filing, claim, w || ' ' || name AS term, pos FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.filing = f.filing AND k.claim = f.claim AND list_contains(f.forms, k.name))""")
def antecedent_basis(spark, d):
    return antecedents.missing_basis(_claims(spark, d), "filing", "claim", "depends_on", "body").drop("location").withColumnRenamed("at", "pos")


@query(f"WITH RECURSIVE {_CLAIMS}, {_LINEAGE} SELECT filing, claim, ancestor FROM l")
def claim_lineage(spark, d):
    return antecedents.lineage(_claims(spark, d), "filing", "claim", "depends_on").drop("steps")


# specifications made of documents: some of their words become marks of figures and sections
_MARKS = {" of ": " FIG. 12 and ", " in ": " FIGS. 3-5, 7A and 9 show ", " is ": " Figure 7b(c) ", " to ": " element 42 ", " that ": " Detailed  Description ", " be ": " brief description of the drawings ", " la ": " FIG. 2 ", " de ": " in figure 2, ", " und ": " Fig.4 "}


def _spec(replace, text):
    for word, mark in _MARKS.items():
        text = replace(text, word, mark)
    return text


_SPEC = _spec(lambda t, w, m: f"replace({t}, '{w}', '{m}')", "text")
_SPECS = rf"""s AS (SELECT doc_id, {_SPEC} AS s FROM documents),
f AS (SELECT doc_id, s, list_sort(list_distinct(regexp_extract_all(s, '{figures.FIGURE}', 1))) AS figs, regexp_extract(s, '(?is)DETAILED\s+DESCRIPTION.*') AS detail FROM s)"""


def _specs(spark, d):
    text = _spec(lambda t, w, m: F.replace(t, F.lit(w), F.lit(m)), F.col("text"))
    return table(spark, d, "documents").select("doc_id", text.alias("s"))


@query(rf"""WITH {_SPECS},
m AS (SELECT doc_id, fig, detail, '(?i)FIG(?:URE)?\.?\s*' || regexp_replace(fig, '([^0-9A-Za-z])', '\\\1', 'g') || '\b' AS p FROM (SELECT doc_id, detail, unnest(figs) AS fig FROM f WHERE detail <> '')),
w AS (SELECT doc_id, fig, detail, regexp_extract_all(detail, p) AS found, string_split_regex(detail, p) AS gaps FROM m),
n AS (SELECT doc_id, fig, len(found) > 0 AS discussed, len(list_filter(range(1, len(found) + 1), lambda i: regexp_matches(substr(detail,
 (list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[:i - 1], lambda x: length(x))), 0))::BIGINT + 1, length(found[i]) + 500), '{figures.NUMERAL}'))) > 0 AS numerals FROM w)
SELECT doc_id, len(figs)::INT AS n_figures, regexp_matches(s, '{figures.BRIEF['us']}') OR len(figs) = 0 AS listed, detail <> '' AS detailed,
coalesce((SELECT string_agg(fig, ',' ORDER BY fig) FROM n WHERE n.doc_id = f.doc_id AND NOT discussed), '') AS undiscussed, coalesce((SELECT string_agg(fig, ',' ORDER BY fig) FROM n WHERE n.doc_id = f.doc_id AND discussed AND NOT numerals), '') AS without_numerals FROM f""")
def figure_coverage(spark, d):
    s = F.col("s")
    rows = _specs(spark, d).withColumns({"issues": figures.drawing_issues(s, F.lit(True)), "figs": figures.referenced(s), "detailed": s.rlike(figures.DETAIL)})
    of = lambda kind: F.array_join(F.transform(F.filter("issues", lambda x: x["problem"] == kind), lambda x: x["figure"]), ",")
    return rows.select("doc_id", F.size("figs").alias("n_figures"), (~F.exists("issues", lambda x: x["problem"] == "no_brief_description")).alias("listed"), "detailed", of("not_discussed").alias("undiscussed"), of("no_numerals").alias("without_numerals"))


@query(rf"""WITH {_SPECS} SELECT doc_id, array_to_string(list_filter([CASE WHEN len(figs) > 0 AND doc_id % 3 = 0 THEN 'no_drawings' END, CASE WHEN len(figs) > 0 AND NOT regexp_matches(s, '{figures.BRIEF['ep']}') THEN 'no_brief_description' END], lambda x: x IS NOT NULL), ',') AS ep_issues,
array_to_string(list_filter([{', '.join(f"CASE WHEN NOT regexp_matches(s, '{p}') THEN '{n}' END" for n, p in figures.SECTIONS.items())}], lambda x: x IS NOT NULL), ',') AS missing FROM f""")
def drawing_sections(spark, d):
    s = F.col("s")
    found = F.transform(figures.drawing_issues(s, F.col("doc_id") % 3 != 0, "ep"), lambda x: x["problem"])
    return _specs(spark, d).select("doc_id", F.array_join(found, ",").alias("ep_issues"), F.array_join(figures.missing_sections(s), ",").alias("missing"))


@query(catalog_filings._FTS)
def fts_index(spark, d):
    path = scratch(spark, "trigrams")
    trigram_index.build(table(spark, d, "documents"), "doc_id", ["text", "source"], ["doc_id", "lang"], path)
    return trigram_index.search(spark, path, ["ation", "the "], "doc_id", ["doc_id", "lang"]).withColumn("rank", F.round("rank", 6))


# a network of parts: each cites the one at a third of its number, small ones also one ten sizes before
_EDGES = """WITH RECURSIVE e AS (SELECT p_partkey AS a, p_partkey // 3 AS b FROM part WHERE p_partkey > 0 UNION SELECT p_partkey, p_partkey - 10 * p_size FROM part WHERE p_size <= 10 AND p_partkey >= 10 * p_size),
f AS (SELECT DISTINCT a AS v FROM e WHERE a NOT IN (SELECT b FROM e) UNION ALL SELECT b FROM f JOIN e ON e.a = f.v),
g AS (SELECT DISTINCT b AS v FROM e WHERE b NOT IN (SELECT a FROM e) UNION ALL SELECT a FROM g JOIN e ON e.b = g.v),
w AS (SELECT a, b, (x.n * y.n)::BIGINT AS weight FROM e JOIN (SELECT v, count(*) AS n FROM f GROUP BY v) x ON x.v = a JOIN (SELECT v, count(*) AS n FROM g GROUP BY v) y ON y.v = b)"""


def _network(spark, d):
    part = table(spark, d, "part")
    edges = part.where("p_partkey > 0").select(F.col("p_partkey").alias("a"), F.floor(F.col("p_partkey") / 3).alias("b"))
    far = part.where("p_size <= 10 AND p_partkey >= 10 * p_size").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") - 10 * F.col("p_size")).alias("b"))
    return citations.path_counts(edges.union(far), "a", "b")[0]


@query(_EDGES + " SELECT a, b, weight FROM w")
def citation_paths(spark, d):
    return _network(spark, d).select("a", "b", F.col("weight").cast("long").alias("weight"))


@query(_EDGES + """, h AS (SELECT a, b, weight FROM w QUALIFY row_number() OVER (PARTITION BY a ORDER BY weight DESC, b) = 1),
m AS (SELECT * FROM (SELECT 0 AS step, a, b, weight FROM h WHERE a NOT IN (SELECT b FROM e) ORDER BY weight DESC, a LIMIT 1) UNION ALL SELECT step + 1, h.a, h.b, h.weight FROM m JOIN h ON h.a = m.b) SELECT step, a, b, weight FROM m""")
def citation_main_path(spark, d):
    return citations.main_path(_network(spark, d), "a", "b").withColumn("weight", F.col("weight").cast("long"))
