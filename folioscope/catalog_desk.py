"""Registered queries of the search desk: chunks, reranking, rotation, heads, matrices, reads by number, formats and simple searches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import markup, office_lists, pubno
from folioscope.operators import desk, filings, pool
from folioscope.registry import query
from folioscope.sources import readers, sinks
from folioscope.sources.tables import scratch, table

# law made of documents: some words become references
_LAW = {" of ": " MPEP Section 12 ", " la ": " 35 U.S.C. Section 101 ", " und ": " 37 CFR Section 1 ", " the ": " Article 5 ", " der ": " PCT Rule 6 ", " in ": " Guidelines G "}


def _law(replace, text):
    for word, reference in _LAW.items():
        text = replace(text, word, reference)
    return text


_FLAGS = ", ".join(f"regexp_matches(c, '{p}') AS {n}" for n, p in desk.REFERENCES.items())


@query(f"""WITH t AS (SELECT doc_id, lang, {_law(lambda t, w, r: f"replace({t}, '{w}', '{r}')", 'text')} AS t FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, lang, pos, substr(t, pos + 1, 500) AS c FROM (SELECT *, unnest(range(0, greatest(length(t), 1)::BIGINT, 400)) AS pos FROM t) WHERE length(trim(substr(t, pos + 1, 500))) >= 50), f AS (SELECT doc_id, pos, md5('[' || lang || '] ' || c) AS text_md5, {_FLAGS} FROM c)
SELECT *, has_usc_ref OR has_epc_ref AS has_statute, has_cfr_ref OR has_pct_ref AS has_rule_ref FROM f""")
def law_chunks(spark, d):
    t = _law(lambda t, w, r: F.replace(t, F.lit(w), F.lit(r)), F.col("text"))
    docs = table(spark, d, "documents").select("doc_id", "lang", t.alias("t"))
    return desk.labelled_chunks(docs, "doc_id", "t", "lang").withColumn("text_md5", F.md5("text")).drop("text")


@query("""SELECT vec_id, round(1 / (1 + list_sum(list_transform(list_zip(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), lambda x: (x[1] - x[2]) * (x[1] - x[2])))), 6) AS score FROM embeddings""")
def vector_closeness(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    one = v.where("vec_id = 3").select(F.col("v").alias("q"))  # one row
    distance = F.aggregate(F.zip_with("v", "q", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    return v.join(F.broadcast(one)).select("vec_id", F.round(desk.closeness(distance), 6).alias("score"))


@query(r"""WITH c AS (SELECT doc_id, n_chars, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS t FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100),
s AS (SELECT doc_id, n_chars, ' ' || array_to_string(t, ' ') || ' ' AS line, t FROM c)
SELECT doc_id, round(len(list_filter(['the', 'of', 'and', 'that'], lambda w: list_contains(t, w))) / 4.0::DOUBLE + 0.1::DOUBLE * (contains(line, ' the of ')::INT + contains(line, ' of and ')::INT + contains(line, ' and that ')::INT), 9) AS rerank, n_chars FROM s ORDER BY rerank DESC, n_chars DESC, doc_id LIMIT 20""")
def reranked(spark, d):
    return desk.rerank(table(spark, d, "documents").select("doc_id", "n_chars", "text"), "doc_id", "n_chars", "text", "the of and THE that", 100, 20)


@query("SELECT doc_id, n_chars FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'qu') OR contains(translate(source, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'qu') ORDER BY n_chars DESC, doc_id LIMIT 40")
def newest_like(spark, d):
    return desk.newest_with(table(spark, d, "documents"), "Qu", ["text", "source"], "n_chars", "doc_id", 40).select("doc_id", "n_chars")


@query("""WITH a AS (SELECT user_id, event_id, CASE WHEN value < 60 THEN 'over_quantity' WHEN event_type = 'click' THEN 'no_record' ELSE 'ok' END AS o FROM events)
SELECT user_id, coalesce(min(event_id) FILTER (o <> 'over_quantity'), max(event_id)) AS event_id, coalesce(arg_min(o, event_id) FILTER (o <> 'over_quantity'), 'over_quantity') AS o, count(*) FILTER (o = 'over_quantity') AS spent FROM a GROUP BY user_id""")
def account_rotation(spark, d):
    o = F.when(F.col("value") < 60, "over_quantity").when(F.col("event_type") == "click", "no_record").otherwise("ok")
    return desk.rotate(table(spark, d, "events").select("user_id", "event_id", o.alias("o")), "user_id", "event_id", "o")


_HEADS = """WITH f AS (SELECT doc_id, CASE WHEN n_chars >= 50 THEN md5(text) END AS family FROM documents), r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(family, doc_id::VARCHAR) ORDER BY doc_id) AS k, count(*) OVER (PARTITION BY coalesce(family, doc_id::VARCHAR)) AS n,
array_to_string(list(doc_id) OVER (PARTITION BY coalesce(family, doc_id::VARCHAR) ORDER BY doc_id ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING), ',') AS members FROM f)"""


@query(_HEADS + "SELECT doc_id, n, coalesce(members, '') AS members, CASE WHEN n > 1 THEN family || ' (+' || (n - 1) || ')' ELSE coalesce(family, '') END AS cell FROM r WHERE k = 1")
def family_heads(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("n_chars") >= 50, F.md5("text")).alias("family"))
    out = desk.heads(docs, F.col("family"), "doc_id", "doc_id", 3)
    return out.select("doc_id", "n", F.array_join(F.col("members").cast("array<string>"), ",").alias("members"), desk.family_cell(F.col("family"), F.col("n")).alias("cell"))


@query("""WITH c AS (SELECT DISTINCT p_partkey, unnest(string_split(p_name, ' ')) AS tech, p_type FROM part), e AS (SELECT DISTINCT p_partkey, tech, unnest([p_type, CASE WHEN p_type LIKE 'S%' THEN 'S' END]) AS effect FROM c),
n AS (SELECT tech, effect, count(*) AS n, min(p_partkey) AS representative FROM e GROUP BY ALL), g AS (SELECT unnest(['red', 'hot', 'bolt', 'ring', 'none']) AS tech), h AS (SELECT unnest(['SMALL', 'PROMO', 'S', 'nothing']) AS effect)
SELECT g.tech, h.effect, coalesce(n, 0) AS n, representative, CASE WHEN n >= 40 THEN 'hot' WHEN n IS NULL THEN 'empty' ELSE 'some' END AS state FROM g CROSS JOIN h LEFT JOIN n ON n.tech = g.tech AND n.effect = h.effect""")
def effect_matrix(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("tech"), F.array_compact(F.array("p_type", F.when(F.startswith("p_type", F.lit("S")), "S"))).alias("effect"))
    return desk.matrix(rows, "tech", "effect", "p_partkey", (["red", "hot", "bolt", "ring", "none"], ["SMALL", "PROMO", "S", "nothing"]), 40)


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_partkey ORDER BY i)::INT AS num, text FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS text, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part WHERE p_type IN ('SMALL', 'LARGE'))")
def flattened_items(spark, d):
    return desk.flattened(desk.point_read(table(spark, d, "part"), "p_type", ["SMALL", "LARGE"]), "p_partkey", F.split("p_name", " "))


@query("SELECT l_partkey, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY l_partkey")
def first_places(spark, d):
    return desk.ordered_distinct(table(spark, d, "lineitem").withColumn("at", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "l_partkey", "at")


@query("""WITH c AS (SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN ' usb' WHEN 1 THEN 'CNA' WHEN 2 THEN 'twx' WHEN 3 THEN 'EP' WHEN 4 THEN 'jp ' WHEN 5 THEN '' WHEN 6 THEN NULL ELSE 'USA' END AS code FROM supplier)
SELECT s_suppkey, CASE s_suppkey % 8 WHEN 0 THEN 'US' WHEN 1 THEN 'CN' WHEN 2 THEN 'TW' WHEN 7 THEN 'US' END AS place, CASE s_suppkey % 8 WHEN 3 THEN 'EPA,EPB' WHEN 4 THEN 'JPA,JPB' ELSE '' END AS databases FROM c""")
def jurisdictions(spark, d):
    k = F.col("s_suppkey") % 8
    code = None
    for i, c in enumerate([" usb", "CNA", "twx", "EP", "jp ", "", None, "USA"]):
        code = (F if code is None else code).when(k == i, F.lit(c).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", desk.jurisdiction(code).alias("place"), F.array_join(desk.databases(code), ",").alias("databases"))


@query(r"""WITH t AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id)
SELECT conv_id, CASE WHEN conv_id % 4 = 3 THEN 0 ELSE n - (conv_id % 4 = 1 AND n > 1)::INT END::INT AS n_claims, conv_id % 4 = 3 AS none, conv_id % 4 = 1 AND n > 2 AS not_consecutive, CASE WHEN conv_id % 4 = 2 THEN 'as defined in section (b)(iv)' ELSE '' END AS internal FROM t""")
def claim_formats(spark, d):
    k = F.col("conv_id") % 4
    # a gap in every fourth, and numbers before the header that don't count
    number = F.when((k == 1) & (F.col("turn") > 0), F.when(F.col("turn") > 1, F.col("turn") + 1)).otherwise(F.col("turn") + 1)
    line = F.concat(F.lit("\n "), number.cast("string"), F.lit(". A thing"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).getField("x"), "").alias("t"))
    text = F.when(k == 3, "99. nothing follows\nclaims:\nnone").otherwise(F.concat(F.lit("1. field\n77. art\n  What is  claimed is: \n"), "t", F.when(k == 2, " As defined in section (b)(iv)").otherwise("")))
    f = desk.claims_format(text)
    return c.select("conv_id", F.size(f["numbers"]).alias("n_claims"), f["none"].alias("none"), f["not_consecutive"].alias("not_consecutive"), F.lower(F.array_join(desk.internal_references(text), ",")).alias("internal"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND contains(lower(o_orderpriority), 'high') AND year(o_orderdate) BETWEEN 1976 AND 1997 UNION ALL SELECT -o_orderkey FROM orders WHERE o_orderdate::DATE > DATE '1998-03-01' AND o_orderdate::DATE <= DATE '1998-03-31'")
def simple_searches(spark, d):
    o = table(spark, d, "orders")
    old = desk.simple_search(o, "o_orderpriority", "HIGH", "o_orderdate", 2026, end=1997, o_orderstatus="F")
    new = desk.simple_search(o, "o_orderpriority", "", "o_orderdate", 2026, recent=("1998-03-31", 30))
    return old.select("o_orderkey").unionByName(new.select((-F.col("o_orderkey")).alias("o_orderkey")))


@query("SELECT p_partkey, p_name, p_type, p_brand, coalesce(p_retailprice::VARCHAR, '') AS price, '' AS gist FROM part")
def marked_csv(spark, d):
    """Six fixed fields under a byte-order mark; one of them is always blank."""
    path = scratch(spark, "marked")
    part = table(spark, d, "part").select("p_partkey", "p_name", "p_type", "p_brand", F.col("p_retailprice").cast("string").alias("price"), F.lit(None).cast("string").alias("gist"))
    heads = {"p_partkey": "公開公告號", "p_name": "專利名稱", "p_type": "類", "p_brand": "人", "price": "價", "gist": "AI"}
    sinks.write_csv(part, path, heads, mark=True)
    back = readers.mapped_csv(spark, path, {h: n for n, h in heads.items()})
    return back.select(F.col("p_partkey").cast("long").alias("p_partkey"), *[F.coalesce(c, F.lit("")).alias(c) for c in back.columns if c != "p_partkey"])


_IND = """WITH c AS (SELECT p_partkey, p_size % 3 = 0 AS ind, CASE p_size % 4 WHEN 0 THEN 'A thing, characterised in that ' || p_name WHEN 1 THEN 'wherein the improvement comprises ' || p_name ELSE p_name END AS body FROM part)"""


@query(_IND + "SELECT p_partkey FROM c WHERE ind AND body NOT LIKE '%characterised in that%' AND body NOT LIKE '%wherein the improvement comprises%'")
def two_part_independent(spark, d):
    size, name = F.col("p_size"), F.col("p_name")
    body = F.when(size % 4 == 0, F.concat(F.lit("A thing, characterised in that "), name)).when(size % 4 == 1, F.concat(F.lit("wherein the improvement comprises "), name)).otherwise(name)
    return table(spark, d, "part").where(size % 3 == 0).where(~filings.two_part(body)).select("p_partkey")


_ABSTRACTS = "a AS (SELECT doc_id, replace(replace(text, '. ', '.' || chr(10)), ' the ', ' means ') AS t FROM documents)"


@query(rf"""WITH {_ABSTRACTS}, c AS (SELECT doc_id, t, len(regexp_extract_all(t, '[^ \t\n\r\f]+')) AS n, len(string_split(t, chr(10))) AS l, array_to_string(list_filter([{', '.join(rf"CASE WHEN regexp_matches(t, '(?i)\b{t}\b') THEN '{t}' END" for t in filings.CLAIM_TERMS)}], lambda x: x IS NOT NULL), ',') AS terms FROM a)
SELECT doc_id, unnest(list_filter([CASE WHEN n < 50 THEN 'WARNING:short:' || n WHEN n > 150 THEN 'WARNING:long:' || n END, CASE WHEN l > 15 THEN 'WARNING:lines:' || l END, CASE WHEN terms <> '' THEN 'INFO:terms:' || terms END, CASE WHEN contains(t, chr(10) || chr(10)) THEN 'INFO:paragraphs:' END], lambda x: x IS NOT NULL)) AS issue FROM c""")
def us_abstract_checks(spark, d):
    t = F.replace(F.replace("text", F.lit(". "), F.lit(".\n")), F.lit(" the "), F.lit(" means "))
    rows = table(spark, d, "documents").select("doc_id", F.inline(filings.us_abstract_issues(t)))
    return rows.select("doc_id", F.concat_ws(":", "severity", "problem", "detail").alias("issue"))


_PARTS_OF = {" of ": " Technical  field ", " la ": " prior art ", " und ": " object of the invention ", " the ": " best mode ", " der ": " description of figures ", " in ": " industrial applicability "}


@query("WITH s AS (SELECT doc_id, " + "".join("replace(" for _ in _PARTS_OF) + "text" + "".join(f", '{a}', '{b}')" for a, b in _PARTS_OF.items()) + " AS s FROM documents) SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN NOT regexp_matches(s, '(?i){'|'.join(f'(?:{p})' for p in ps)}') THEN '{'IMPORTANT' if n.startswith('Indus') else 'CRITICAL'}:{n}' END" for n, ps in filings.EP_DESCRIPTION.items()) + "], lambda x: x IS NOT NULL)) AS missing FROM s")
def ep_description(spark, d):
    s = F.col("text")
    for a, b in _PARTS_OF.items():
        s = F.replace(s, F.lit(a), F.lit(b))
    return table(spark, d, "documents").select("doc_id", F.inline(filings.ep_missing_parts(s))).select("doc_id", F.concat_ws(":", "severity", "part").alias("missing"))


# result lists of suppliers by nation, in three layouts; behind a link's number stands its title's first letter, which the number's kind takes
@query("""WITH s AS (SELECT s_nationkey AS nation, s_nationkey % 3 AS layout, s_name, 'CN' || (100000000 + s_suppkey) AS number, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth FROM supplier)
SELECT nation, 'Title of ' || s_name AS title, CASE layout WHEN 0 THEN number || 'A' WHEN 1 THEN number || 'B' ELSE number || 'T' END AS pub_number, CASE layout WHEN 1 THEN CASE WHEN nth % 2 = 0 THEN 'http://lists.example/patent/' || number || 'B' ELSE 'http://other.example/patent/' || number || 'B' END WHEN 0 THEN 'http://lists.example/x/' || number ELSE 'http://lists.example/patent/' || number END AS link, CASE WHEN layout = 1 AND nth % 3 > 0 THEN 'What it is about' END AS abstract FROM s""")
def office_hits(spark, d):
    s = table(spark, d, "supplier").withColumn("nth", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    number = F.concat(F.lit("CN"), (F.col("s_suppkey") + 100000000).cast("string"))
    join = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    title = join("Title of ", F.col("s_name"))
    row = join('<tr><td><a href="/x/', number, '" title="', title, '">', "go", "</a><td>", F.substring(number, 1, 2), " ", F.substr(number, F.lit(3)), "A </tr>")
    own = F.when(F.col("nth") % 2 == 0, join("<dl><dt>申请公布号：</dt><dd> ", number, "B </dd></dl>")).otherwise(join('<div title="http://other.example/patent/', number, 'B"></div>'))
    card = join('<div class="item"><h1 class="title"> ', title, " \n</h1>", own, F.when(F.col("nth") % 3 > 0, "<dl><dt>摘要：</dt><dd>What <b>it</b> is\n about</dd></dl>").otherwise("<dl><dt>摘要：</dt><dd>no</dd></dl>"))
    link = join('<a class=x href="/patent/', number, '">', title, '</a><a href="/patent/', number, '">again</a><a href="/about">no</a><a href="javascript:show()">no</a>')
    layout = F.col("s_nationkey") % 3
    piece = F.when(layout == 0, F.concat(row, row)).when(layout == 1, card).otherwise(link)
    pages = s.groupBy("s_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.struct("nth", piece.alias("h")))).getField("h"), "\n").alias("h"))
    html = F.concat(F.lit("<table><tr><td>indexQuery form of this page</tr><tr>short</tr></table>"), "h")
    return pages.select(F.col("s_nationkey").alias("nation"), F.inline(office_lists.hits(html, "http://lists.example/")))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, '2-H') ORDER BY o_orderkey LIMIT 25")
def section_lookup(spark, d):
    return desk.section(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "2-H", "o_orderkey", 25)


_CLAIM1 = "c AS (SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'What is claimed is:' WHEN 1 THEN ' 　 ' WHEN 2 THEN NULL WHEN 3 THEN 'We Claim' ELSE 'A thing. ' || text END AS c FROM conversations)"


def _claim1(spark, d):
    k = F.col("turn") % 5
    c = F.when(k == 0, "What is claimed is:").when(k == 1, "   ").when(k == 2, None).when(k == 3, "We Claim").otherwise(F.concat(F.lit("A thing. "), "text"))
    return desk.claim1_audit(table(spark, d, "conversations").select("conv_id", "turn", c.alias("c")), "conv_id", "turn", "c")


@query(f"WITH {_CLAIM1} SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 5 < 4) AS empty FROM c GROUP BY conv_id")
def claim1_counts(spark, d):
    return _claim1(spark, d)[0]


@query(f"WITH {_CLAIM1} SELECT conv_id, turn FROM c WHERE turn % 5 < 4")
def claim1_missing(spark, d):
    return _claim1(spark, d)[1]


@query("SELECT doc_id, CASE WHEN doc_id % 3 < 2 THEN array_to_string([lang, source], ',') END AS names, CASE WHEN doc_id % 3 < 2 THEN n_chars END AS size, sha256(coalesce(text, '')) AS content FROM documents")
def json_cells(spark, d):
    """Lists and structs written as JSON cells and read back; every third cell is damaged or blank."""
    docs = table(spark, d, "documents").select("doc_id", F.array("lang", "source").alias("names"), F.struct("n_chars").alias("size"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content"))
    cells = desk.as_json(docs, ["names", "size"])
    bad = F.col("doc_id") % 3 == 2
    cells = cells.withColumns({"names": F.when(bad, F.lit("[oops")).otherwise(F.col("names")), "size": F.when(bad, F.lit(" ")).otherwise(F.col("size"))})
    return cells.select("doc_id", F.array_join(desk.from_json_text(F.col("names"), "array<string>"), ",").alias("names"), desk.from_json_text(F.col("size"), "struct<n_chars:bigint>")["n_chars"].alias("size"), "content")


@query("""SELECT p_partkey // 20 AS page, p_partkey, CASE WHEN p_partkey % 4 < 3 THEN '/record?n=' || p_partkey END AS link FROM part""")
def page_links(spark, d):
    """The link of a number among those of its page, found by digits; every fourth number isn't there."""
    k = F.col("p_partkey")
    number = F.concat(F.lit("US"), F.lpad((k + 100000).cast("string"), 8, "0"), F.lit("B"))
    anchor = F.when(k % 4 < 3, F.concat(F.lit('<a class=x href="/record?n='), k.cast("string"), F.lit('">US <b>'), F.lpad((k + 100000).cast("string"), 8, "0"), F.lit("</b></a><a href=/other>none</a>"))).otherwise("<p>")
    rows = table(spark, d, "part").select(F.floor(k / 20).alias("page"), "p_partkey", number.alias("number"), anchor.alias("a"))
    pages = rows.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(F.struct("p_partkey", "a"))).getField("a"), "").alias("h"))
    return rows.join(pages, "page").select("page", "p_partkey", markup.link_of(F.col("h"), F.col("number")).alias("link"))


_META = """WITH p AS (SELECT s_suppkey, ['US', 'TW', 'EP', 'CN'][s_suppkey % 4 + 1] || lpad(s_suppkey::VARCHAR, 7, '0') AS pubno FROM supplier),
a AS (SELECT pubno, '' AS country, s_suppkey::VARCHAR AS title FROM p WHERE s_suppkey % 3 = 0), b AS (SELECT pubno, 'XX' AS country, '' AS title FROM p WHERE s_suppkey % 2 = 0),
m AS (SELECT p.pubno, CASE WHEN a.pubno IS NULL AND b.pubno IS NOT NULL THEN 'XX' ELSE left(p.pubno, 2) END AS country, coalesce(nullif(CASE WHEN a.pubno IS NOT NULL THEN a.title ELSE b.title END, ''), 'Unknown') AS title, CASE WHEN a.pubno IS NOT NULL THEN 0 WHEN b.pubno IS NOT NULL THEN 1 END AS level FROM p LEFT JOIN a ON a.pubno = p.pubno LEFT JOIN b ON b.pubno = p.pubno)
"""


def _metadata(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name", F.concat(F.element_at(F.array(*map(F.lit, ("US", "TW", "EP", "CN"))), (F.col("s_suppkey") % 4 + 1).cast("int")), F.lpad(F.col("s_suppkey").cast("string"), 7, "0")).alias("pubno"))
    first = s.where("s_suppkey % 3 = 0").select("pubno", F.lit("").alias("country"), F.col("s_suppkey").cast("string").alias("title"))
    second = s.where("s_suppkey % 2 = 0").select("pubno", F.lit("XX").alias("country"), F.lit("").alias("title"))
    return pool.metadata(s, "pubno", [(first, None), (second, None)], ["country", "title"], ["title"], {"country": pubno.country(F.col("pubno"))})


@query(_META + "SELECT pubno, country, title, level FROM m")
def metadata_defaults(spark, d):
    return _metadata(spark, d)


@query(_META + "SELECT pubno, CASE WHEN level IS NULL THEN 'no record' ELSE 'no fields' END AS reason FROM m WHERE level IS NULL OR title = 'Unknown'")
def metadata_gaps(spark, d):
    return pool.gaps(_metadata(spark, d), "pubno", ["title"])
