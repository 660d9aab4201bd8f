"""Registered queries for result pages and nested answers: pages and JSON made of tables, read back and compared with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import result_pages
from folioscope.registry import query
from folioscope.sources import exchange
from folioscope.sources.tables import table

# records of a result list, twenty parts a page
_RECORDS = """WITH k AS (SELECT p_partkey // 20 AS page, p_partkey AS k, p_name || ' of ' || p_type AS title, p_brand || ' is a brand' AS abstract, p_size FROM part),
r AS (SELECT page, k, CASE WHEN k % 4 = 3 THEN (k // 4)::VARCHAR ELSE (k + 1)::VARCHAR END AS family_group, (k + 1)::VARCHAR AS seq, 'US' || lpad(k::VARCHAR, 8, '0') || 'B2' AS pat_no,
CASE k % 3 WHEN 0 THEN 'CN20241' || lpad(k::VARCHAR, 7, '0') || '.8' WHEN 1 THEN 'US1' || lpad(k::VARCHAR, 7, '0') END AS apply_no, '2024/01/' || lpad((k % 28 + 1)::VARCHAR, 2, '0') AS apply_date, title, CASE WHEN k % 5 > 0 THEN abstract END AS abstract FROM k)
"""


def _records(spark, d):
    k = F.col("p_partkey")
    digits = lambda n: F.lpad(k.cast("string"), n, "0")
    return table(spark, d, "part").select(
        F.floor(k / 20).alias("page"), k.alias("k"), F.when(k % 4 == 3, F.concat(F.floor(k / 4).cast("string"), F.lit(".2"))).alias("member"), (k + 1).cast("string").alias("seq"),
        F.concat(F.lit("US"), digits(8), F.lit("B2")).alias("pat_no"), F.when(k % 3 == 0, F.concat(F.lit("CN20241"), digits(7), F.lit(".8"))).when(k % 3 == 1, F.concat(F.lit("US1"), digits(7))).alias("apply_no"),
        F.concat(F.lit("2024/01/"), F.lpad((k % 28 + 1).cast("string"), 2, "0")).alias("apply_date"), F.concat("p_name", F.lit(" of "), "p_type").alias("title"), F.when(k % 5 > 0, F.concat("p_brand", F.lit(" is a brand"))).alias("abstract"),
    )


def _pages(rows, html):
    """page, html: the rows' pieces in order."""
    listed = F.array_sort(F.collect_list(F.struct("k", html.alias("h"))))
    return rows.groupBy("page").agg(F.array_join(F.transform(listed, lambda x: x["h"]), "").alias("html"), F.count(F.lit(1)).alias("n"))


_FIELDS = ["seq", "family_group", "pat_no", "apply_no", "apply_date", "title", "abstract"]


@query(_RECORDS + "SELECT page, seq, family_group, pat_no, apply_no, apply_date, title, abstract FROM r")
def page_rows(spark, d):
    cell = lambda c: F.when(c.isNotNull(), F.concat(F.lit("<td class=x> "), c)).otherwise("<td>&")
    order = [cell(F.col(c)) for c in ("seq", "member", "apply_date", "apply_no", "pat_no", "title", "abstract")]
    # the columns of odd pages stand in another order; rows and cells are not closed, and a script leaks into a cell
    turned = [order[0], order[5], order[4], order[3], order[1], order[2], order[6]]
    row = lambda cells: F.concat(F.lit('<TR bad><tr class=a><td><input onclick="clickselect(this,1,2,3)"><script>function instback(){return "<td>US00000000A1"}</script>'), *cells)
    pages = _pages(_records(spark, d), F.when(F.col("page") % 2 == 0, row(order)).otherwise(row(turned)))
    html = F.concat(F.lit("<table><tr><td>US99999999B2 head"), "html", F.lit("<tr><td>foot</table>"))
    return pages.select("page", F.inline(result_pages.result_rows(html))).select("page", *_FIELDS)


@query(_RECORDS + "SELECT page, seq, seq AS family_group, pat_no, CASE WHEN k % 3 = 2 THEN '109' ELSE apply_no END AS apply_no, apply_date, title, abstract FROM r")
def labelled_records(spark, d):
    field = lambda label, c: F.concat(F.lit(f"<tr><td class=sumth1 nowrap> {label} </td>\n<td class=sumtd1_603><b>"), c, F.lit("</b> \n "))
    parts = [field(label, F.coalesce(F.col(c), F.lit(""))) for c, label in result_pages.LABELS.items() if c != "apply_no"]
    spaced = F.coalesce(F.concat(F.substring("apply_no", 1, 2), F.lit(" "), F.substr("apply_no", F.lit(3))), F.lit("109 Q"))
    head = F.concat(F.lit('<table class="sumtab"><tr><td><input onclick="clickselect(this,1,2,3)"><a class="link602" href=x> '), "seq", F.lit(" </a>"), field("申請號", F.lit("TW 1")), *parts, field("申請號", spaced), F.lit("</table>"))
    return _pages(_records(spark, d), head).select("page", F.inline(result_pages.result_rows(F.col("html")))).select("page", *_FIELDS)


@query("""SELECT page, CASE WHEN page % 4 = 0 THEN n + 100 WHEN page % 4 = 3 THEN 0 ELSE n END::INT AS count, page % 4 = 3 AS is_empty, CASE WHEN page % 4 = 3 THEN 0 ELSE n END::INT AS n_rows,
CASE WHEN page % 4 < 3 THEN least END AS first_seq, CASE WHEN page % 4 < 3 THEN 'US' || lpad((least - 1)::VARCHAR, 8, '0') || 'B2' END AS first_no, CASE WHEN page % 4 = 0 THEN n + 1100 ELSE 0 END AS total, CASE WHEN page % 4 = 0 THEN page ELSE 1 END AS page_no, CASE WHEN page % 4 = 0 THEN 77 END AS families
FROM (SELECT p_partkey // 20 AS page, count(*) AS n, min(p_partkey) + 1 AS least FROM part GROUP BY 1)""")
def mark_lists(spark, d):
    row = F.concat(F.lit("<tr><td>"), "seq", F.lit("</td><td> <i>"), "pat_no", F.lit("</i></td>\n<td>"), "apply_date", F.lit("</td></tr><tr><td>no number</td></tr>"))
    pages = _pages(_records(spark, d), row)
    mod, n = F.col("page") % 4, F.col("n").cast("string")
    count = F.concat(F.lit("檢索結果：共 "), (F.col("n") + 100).cast("string"), F.lit(" 筆"))
    number = lambda c: F.concat(F.lit('<font class="numfmt"> '), c, F.lit(" </font>"))
    totals = F.concat(F.lit("共"), number(F.concat(F.lit("1,"), F.lpad((F.col("n") + 100).cast("string"), 3, "0"))), F.lit("筆 第"), number(F.col("page").cast("string")), F.lit("/"), number(F.lit("999999")), F.lit("頁 專利家族數量 "), number(F.lit("77")))
    html = F.when(mod == 3, F.lit("<p>無標記資料</p>")).when(mod == 0, F.concat(count, totals, "html")).otherwise(F.concat(F.lit("<p>檢索結果</p>"), n, "html"))
    m, t = F.col("m"), F.col("t")
    first = F.get(m["rows"], F.lit(0))
    out = pages.select("page", result_pages.mark_list(html).alias("m"), result_pages.page_totals(html).alias("t"))
    return out.select("page", m["count"].alias("count"), m["is_empty"].alias("is_empty"), F.size(m["rows"]).alias("n_rows"), first["seq"].cast("long").alias("first_seq"), first["apply_no"].alias("first_no"), t["total"].alias("total"), t["page"].alias("page_no"), t["families"].alias("families"))


# families of suppliers by nation: an answer for each nation
def _answers(spark, d):
    s = table(spark, d, "supplier").withColumn("k", F.col("s_suppkey") % 9)
    number = F.lpad(F.col("s_suppkey").cast("string"), 6, "0")
    node = lambda kind, value: F.concat(F.lit(f'"{kind}":'), value)
    dollar = lambda c: F.concat(F.lit('{"$":"'), c, F.lit('"}'))
    # plain or object nodes, one id or a list of them, numbers that come again with another kind
    country, kind = F.when(F.col("k") < 5, F.lit("US")).otherwise("EP"), F.when(F.col("k") % 2 == 0, "A1").otherwise("B2")
    doc = F.concat(F.lit('{"@document-id-type":"docdb",'), node("country", dollar(country)), F.lit(","), node("doc-number", F.when(F.col("k") % 3 == 0, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(dollar(number))), F.lit(","), node("kind", dollar(kind)), F.lit("}"))
    again = F.replace(F.replace(doc, F.lit('"A1"'), F.lit('"C9"')), F.lit('"B2"'), F.lit('"C9"'))
    ids = F.when(F.col("k") % 4 == 1, doc).otherwise(F.concat(F.lit('[{"@document-id-type":"epodoc","doc-number":{"$":"x"}},'), doc, F.lit(","), again, F.lit("]")))
    member = F.concat(F.lit('{"@family-id":"'), F.col("s_nationkey").cast("string"), F.lit('","publication-reference":{"document-id":'), ids, F.lit("}}"))
    rows = s.select(F.col("s_nationkey").alias("page"), F.col("s_suppkey").alias("k"), country.alias("country"), number.alias("number"), member.alias("m"), "s_name")
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("k", F.col(c).alias("h")))), lambda x: x["h"])
    return rows.groupBy("page").agg(listed("m").alias("members"), listed("s_name").alias("names"), listed("number").alias("numbers"), listed("country").alias("countries"))


@query("""SELECT s_nationkey AS nation, CASE WHEN count(*) > 0 THEN s_nationkey::VARCHAR END AS family_id, count(*)::INT AS n,
string_agg(CASE WHEN s_suppkey % 9 < 5 THEN 'US' ELSE 'EP' END || lpad(s_suppkey::VARCHAR, 6, '0') || CASE WHEN s_suppkey % 9 % 2 = 0 THEN 'A1' ELSE 'B2' END, ',' ORDER BY s_suppkey) AS members FROM supplier GROUP BY 1""")
def family_members(spark, d):
    members = F.col("members")
    body = F.when(F.size(members) == 1, members[0]).otherwise(F.concat(F.lit("["), F.array_join(members, ","), F.lit("]")))
    answer = F.concat(F.lit('{"ops:world-patent-data":{"ops:patent-family":{"ops:family-member":'), body, F.lit("}}}"))
    found = _answers(spark, d).select("page", exchange.family(answer).alias("f"))
    return found.select(F.col("page").alias("nation"), "f.family_id", F.size("f.members").alias("n"), F.array_join("f.members", ",").alias("members"))


@query("""WITH s AS (SELECT s_nationkey AS nation, row_number() OVER w AS nth, count(*) OVER (PARTITION BY s_nationkey) AS n, s_name, lpad(s_suppkey::VARCHAR, 6, '0') AS number FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_suppkey))
SELECT nation, true AS found, CASE WHEN nation % 3 = 0 THEN 'en ' ELSE 'de ' END || max(s_name) FILTER (nth = 1) AS title, CASE WHEN nation % 3 = 0 THEN 'en one two' ELSE 'last' END AS abstract,
string_agg(s_name, ',' ORDER BY nth) AS applicants, string_agg('C' || number, ',' ORDER BY nth) FILTER (nth <= 8) AS ipc, CASE WHEN nation % 2 = 0 THEN 'EP' || max(number) FILTER (nth = 1) || 'A' ELSE max(number) FILTER (nth = n) END AS apply_no, CASE WHEN nation % 2 = 0 THEN '20240101' ELSE '' END AS apply_date FROM s GROUP BY nation""")
def biblio_parse(spark, d):
    a = _answers(spark, d).withColumnRenamed("page", "nation")
    names, numbers, third = F.col("names"), F.col("numbers"), F.col("nation") % 3 == 0
    quoted = lambda items, f: F.concat(F.lit("["), F.array_join(F.transform(items, f), ","), F.lit("]"))
    text = lambda lang, c: F.concat(F.lit(f'{{"@lang":"{lang}","$":"{lang} '), c, F.lit('"}'))
    title = F.when(third, F.concat(F.lit("["), text("de", names[0]), F.lit(","), text("en", names[0]), F.lit("]"))).otherwise(text("de", names[0]))
    abstract = F.when(third, '[{"@lang":"en","p":["en one",{"$":"two"}]},{"@lang":"fr","p":"non"}]').otherwise('[{"p":{"$":"first"}},{"@lang":"de","p":{"$":" last "}}]')
    party = quoted(names, lambda n: F.concat(F.lit('{"@data-format":"epodoc","applicant-name":{"name":{"$":"'), n, F.lit('"}}},{"@data-format":"original","applicant-name":{"name":{"$":"no"}}}')))
    codes = quoted(numbers, lambda n: F.concat(F.lit('{"text":{"$":"C'), n, F.lit('"}}')))
    plain = quoted(numbers, lambda n: F.concat(F.lit('{"@document-id-type":"epodoc","doc-number":{"$":"'), n, F.lit('"}}')))
    full = F.concat(F.lit('{"@document-id-type":"docdb","country":{"$":"EP"},"doc-number":{"$":"'), numbers[0], F.lit('"},"kind":"A","date":{"$":"20240101"}}'))
    bib = F.concat(F.lit('{"invention-title":'), title, F.lit(',"parties":{"applicants":{"applicant":'), party, F.lit('}},"classifications-ipcr":{"classification-ipcr":'), codes, F.lit('},"application-reference":{"document-id":'), F.when(F.col("nation") % 2 == 0, full).otherwise(plain), F.lit("}}"))
    answer = F.concat(F.lit('{"ops:world-patent-data":{"exchange-documents":{"exchange-document":[{"bibliographic-data":'), bib, F.lit(',"abstract":'), abstract, F.lit("}]}}}"))
    out = exchange.biblio(a.select("nation", answer.alias("answer")), "nation", "answer")
    return out.withColumns({"applicants": F.array_join("applicants", ","), "ipc": F.array_join("ipc", ",")})


@query("""WITH s AS (SELECT s_nationkey AS nation, s_suppkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS nth, CASE WHEN s_suppkey % 9 < 5 THEN 'US' ELSE 'EP' END AS country, lpad(s_suppkey::VARCHAR, 6, '0') AS number FROM supplier),
i AS (SELECT nation, nth, nth AS family, country || number AS id FROM s UNION ALL SELECT nation, nth, nth, number FROM s UNION ALL SELECT nation, nth, nth, 'SHARED' || nation FROM s)
SELECT nation, id, arg_max(family, nth)::VARCHAR AS family_id FROM i GROUP BY nation, id""")
def family_blocks(spark, d):
    a = _answers(spark, d).withColumnRenamed("page", "nation")
    block = lambda x, i: F.concat(F.lit('<exchange-document system="x" family-id="'), (i + 1).cast("string"), F.lit('" country="'), x["countries"], F.lit('" doc-number="'), x["numbers"], F.lit('"><doc-number>'), x["numbers"], F.lit("</doc-number><doc-number>SHARED"), F.col("nation").cast("string"), F.lit("</doc-number></exchange-document>"))
    xml = F.concat(F.lit('<x><exchange-document country="ZZ" doc-number="1"><doc-number>none</doc-number>'), F.array_join(F.transform(F.arrays_zip("countries", "numbers"), block), "\n"))
    return exchange.family_ids(a.select("nation", xml.alias("xml")), "nation", "xml")


@query("""SELECT conv_id, trim(regexp_replace(string_agg(CASE WHEN turn % 3 = 0 THEN 'first' || text || role ELSE text || role END, '' ORDER BY turn), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS text FROM conversations GROUP BY conv_id""".replace("\\\\", "\\"))
def nested_texts(spark, d):
    said = lambda c: F.regexp_replace(F.to_json(F.array(F.col(c))), r"^\[|\]$", "")  # noqa: E731 - as a JSON string
    turn = F.when(F.col("turn") % 3 == 0, F.concat(F.lit('{"@no":"attribute","z":['), said("text"), F.lit(',null,0,false,{"b":{"$":'), said("role"), F.lit('}}],"$":"first"}')))
    turn = turn.when(F.col("turn") % 3 == 1, F.concat(F.lit("["), said("text"), F.lit(",[["), said("role"), F.lit("]]]"))).otherwise(F.concat(F.lit('{"text":'), said("text"), F.lit(',"a":{"role":'), said("role"), F.lit("}}")))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", turn.alias("h")))), lambda x: x["h"]), ",").alias("h"))
    return exchange.nested_text(rows.select("conv_id", F.concat(F.lit("["), "h", F.lit("]")).alias("h")), "conv_id", "h")
