"""Vectors for filings, audits, adapters, gateway, full text and paging."""

import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions import envelopes, patent_text
from folioscope.operators import audit, filings, fulltext
from folioscope.plans import gateway as g
from folioscope.sources import adapters, paging


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_titles_and_abstracts(spark):
    said = lambda t: [tuple(x) for x in one(spark, filings.title_issues(F.lit(t)))[0]]
    assert said("Engine mount") == [] and said("An engine") == [("INFO", "article")]
    assert said("x" * 501) == [("CRITICAL", "length"), ("CRITICAL", "short")] and said("y z" * 40) == [("INFO", "length")]
    assert said("Engine™ mount") == [("WARNING", "trademark")]
    assert one(spark, filings.abstract_issues(F.lit("word " * 30 + "(12a)")))[0] == []
    assert one(spark, filings.abstract_issues(F.lit("few words\n\nmore"), F.lit(True)))[0] == ["too_short", "no_reference_sign", "paragraphs", "no_figure"]
    assert one(spark, filings.missing_parts(F.lit("Technical Field ... prior art ... summary of the invention ... best mode")))[0] == ["drawings"]


def test_claims(spark):
    kinds = [one(spark, filings.category(F.lit(t)))[0] for t in ("A method of", "use of x", "An apparatus", "A system with", "A widget", "Method for")]
    assert kinds == ["process", "use", "apparatus", "apparatus", "product", "process"]
    assert one(spark, filings.two_part(F.lit("x characterized  in that y")), filings.excluded(F.lit("a games table; a mental act"))) == (True, ["mental act"])
    claims = spark.createDataFrame([("a", 1, None), ("a", 2, 1), ("a", 3, 2), ("a", 4, 3), ("a", 5, 6), ("a", 6, 5), ("b", 2, None), ("a", 7, 9)], "f string, n int, up int")
    got = {(r["f"], r["n"]): (r["root"], r["depth"]) for r in filings.ancestors(claims, "f", "n", "up").collect()}
    assert got == {("a", 1): (1, 0), ("a", 2): (1, 1), ("a", 3): (1, 2), ("a", 4): (1, 3), ("a", 5): (None, None), ("a", 6): (None, None), ("b", 2): (2, 0), ("a", 7): (None, None)}
    spec = spark.createDataFrame([("s", "HEAD\n[0001] A pump pumps.\n[0002] Two\nlines."), ("t", "HEADER\n\nPlain line\nOther Line")], "k string, t string")
    assert sorted(map(tuple, filings.paragraphs(spec, "k", "t").collect())) == [("s", 1, "A pump pumps."), ("s", 2, "Two\nlines."), ("t", 1, "Plain line"), ("t", 2, "Other Line")]
    issues = spark.createDataFrame([("f", 2, "x", "t", "MINOR"), ("f", 9, "x", "t", "CRITICAL"), ("f", 1, "y", "t", "MINOR")], "k string, claim int, issue_type string, term string, severity string")
    assert [(r["claim"]) for r in filings.sorted_issues(issues, "k", "claim").orderBy("rank").collect()] == [9, 1, 2]
    assert sorted(map(tuple, filings.issue_counts(issues).collect())) == [("CRITICAL", "x", 1), ("MINOR", "x", 1), ("MINOR", "y", 1)]


def test_audit(spark):
    assert audit.overrides('<!-- audit: min_queries=20 min_class_anchors=1 min_concept_groups=x exclude_jurisdiction=tw reason="a=b" -->') == {"min_queries": 20, "exclude_jurisdiction": {"TW"}}
    assert audit.thresholds({"min_queries": 20})["min_queries"] == 20 and audit.thresholds({})["min_queries"] == 12
    of = lambda b, c, k: one(spark, audit.shapes(F.lit(b), F.array(*map(F.lit, c)).cast("array<string>"), F.array(*map(F.lit, k)).cast("array<string>")))[0]
    assert of("SINGLE", ["a"], ["b"]) == [] and of("AND", ["a"], []) == [] and of("and", ["a", "b"], ["c"]) == ["OR", "AND"] and of("AND+OR", [], []) == ["AND", "OR"]
    row = "db string, database string, class_codes array<string>, keywords array<string>, concept_group string, boolean string"
    log = [("c", d, ["H01M", f"B60L {i}"], ["x", "y"], "ABC"[i % 3], "AND") for i, d in enumerate(["TWA", "US", "CN", "CNB"] * 3)]
    out = audit.verdict(spark.createDataFrame(log, row), "db").first()
    assert (out["verdict"], out["missing"], out["boolean_shapes"]) == ("PASS", [], ["AND", "OR"])
    thin = spark.createDataFrame([r for r in log if not r[1].startswith("US")] + [("c", "US", ["H01M"], [], "A", "AND")] * 1, row)
    assert audit.verdict(thin, "db").first()["gaps"] == ["queries"]
    assert audit.verdict(thin.unionByName(spark.createDataFrame(log[:1] * 3, row)), "db").first()["verdict"] == "WARN"
    assert audit.verdict(thin, "db", {"exclude_jurisdiction": {"US"}}).first()["missing"] == []
    pages = spark.createDataFrame([("d", p, t) for p, t in ((1, "FIG. 1"), (2, "x 10 12 14 16 18"), (3, "20 22 24 26 28 30"), (4, "Fig 10"))] + [("e", 1, "a"), ("e", 3, "fig.1 b")], "k string, p int, t string")
    assert dict(map(tuple, audit.figure_page(pages, "k", "p", "t").collect())) == {"d": 3, "e": 3}


def test_texts(spark):
    first = lambda t, full=True: one(spark, patent_text.claim1(F.lit(t), full))[0]
    assert first("1. A pump\n with  a rod. 2. The pump") == "A pump with a rod." and first("") == "Claim 1 not found." and first("no number") == "no number"
    assert first("1、一種泵 2、如") == "一種泵" and first("1. " + "x" * 1200, False) == "x" * 1000 + "..."
    empty = [one(spark, patent_text.claim1_empty(F.lit(t)))[0] for t in ("", " What is claimed is: ", "Claims.", "A pump", None)]
    assert empty == [True, True, True, False, True]
    assert one(spark, patent_text.numbers(F.lit("see TWI123456B, US20160373797A1_001.png, XUS1234567")))[0] == ["TWI123456B", "US20160373797A1"]
    assert one(spark, patent_text.date_text(F.lit(20230102)), patent_text.date_text(F.lit(202301)), patent_text.date_text(F.lit(0)), patent_text.date_digits(F.lit("2023/01-02"))) == ("2023-01-02", "202301", None, "20230102")
    forms = {"USAU2020278020A1": "AU2020278020", "CN212345678U": "CN212345678U", "CN101234567A": "CN101234567", "US20201234567A1": "US2020234567", "US2020123456A1": "US2020123456", "US08123456B2": "US8123456", "TWI123456": "TWI123456B", "TWM123456": "TWM123456U", "EP1234567A1": "EP1234567", "x": None}
    assert {k: one(spark, patent_text.epodoc(F.lit(k)))[0] for k in forms} == forms
    assert one(spark, patent_text.counts_by_name(F.lit("<li>TW (1,234)</li> CN(5)")), patent_text.result_count(F.lit("共 <b>1,359</b> 筆")), patent_text.result_count(F.lit("none"))) == ({"TW": 1234, "CN": 5}, 1359, None)
    assert one(spark, patent_text.identity(F.array(F.lit("US123")), F.lit("123")), patent_text.identity(F.array(F.lit("US9")), F.lit("123")), patent_text.identity(F.array().cast("array<string>"), F.lit("1"))) == (True, False, None)
    assert one(spark, patent_text.plain_lines(F.lit("<p>a &amp;lt; b</p>\n c"))) == ("a &lt; b \n c",)
    md = patent_text.markdown(F.lit("US1"), F.lit("abs"), F.array(F.struct(F.lit(1).alias("num"), F.lit("x").alias("text"))), F.lit("d"))
    assert one(spark, md)[0] == "# US1\n\n## Abstract\nabs\n\n## Claims\n1. x\n\n## Description\nd\n"


def test_reasons(spark):
    of = lambda t: one(spark, envelopes.code_reason(F.lit(t)))[0]
    assert [of(t) for t in ("SCRAPING_REQUIRED", "BAD_X: text", "got 503 now", "lower case", "A" * 41)] == ["envelope:SCRAPING_REQUIRED", "envelope:BAD_X", "http_error:503", "envelope:lower case", "envelope:" + "A" * 41]
    assert one(spark, envelopes.reason(F.lit("x" * 300)), envelopes.reason(F.lit("")), envelopes.reason(F.lit("a 404"))) == ("x" * 200, "unknown", "http_error:404")


def test_gateway(spark):
    assert g.clean_number_axis("(US1 or US2)@PN") == ("US1 or US2", ["@PN", "outer_parens"]) and g.clean_number_axis("(a) or (b)") == ("(a) or (b)", [])
    q = g.normalise(keyword=" (US1 or US2) ", keyword_field="PN", num=0, skip=-3, date_from="2023-01-01", date_to="", databases=[" TW ", ""])
    assert (q["keyword"], q["num"], q["skip"], q["date_from"], q["date_to"], q["databases"]) == ("US1 or US2", 30, 0, "20230101", None, ["TW"])
    with pytest.raises(g.QueryError):
        g.normalise(keyword="(a b)@PN")
    assert [g.looks_like_numbers(x) for x in ("US1 or CN2", "solar cell", "x@AN", None)] == [True, False, True, False]
    assert [g.check_expression(x, {"TI", "AB"}) for x in ("(a)@TI,AB", "", "(a", "a)", "(a)@ZZ")] == [None, "empty", "unbalanced: left open", "unbalanced: closed too early", "unknown field @ZZ"]
    assert g.fold_dates(" a ", "2020", None) == "(a) and ID=2020:" and g.fold_dates("a", None, None) == "a"
    assert g.full_text_query(uspc="1/2", cpc="H01M", keyword="cell", applicant="X", date_from="20200101", date_to="20201231") == 'CCL/1/2 AND CPC/H01M AND "cell" AND "X".as. AND @pd>="20200101"<="20201231"'
    assert g.as_cql("solar cell") == 'ta="solar cell"' and g.as_cql('pa="x"') == 'pa="x"'
    assert g.match_plan('ab abc "x') == {"phrases": '"abc"', "terms": ["abc"], "short": ["ab", '"x'], "mode": "hybrid"} and g.match_plan("a:b c:d")["mode"] == "fts" and g.match_plan("ab")["mode"] == "like-scan"
    assert g.facets({"a": 1}, offset=-1, limit=500) == {"pagination": {"offset": 0, "limit": 100}, "filters": [{"name": "a", "value": [1]}]}
    assert json.loads(g.summarise({"token": "x", "q": "y" * 90, "l": [1, 2], "d": {"a": 1}})) == {"token": "***", "q": "y" * 80 + "…", "l": "<list len=2>", "d": "<dict keys=1>"} and len(g.summarise({str(i): "z" * 70 for i in range(9)})) == 301
    assert (g.fetch_size(5), g.fetch_size(20), g.fetch_size(5, 300)) == (20, 50, 100) and g.expand("q", ["a {query}", "b"], 2) == ["q", "a q"]
    assert g.dig({"a": {"b": 1}}, "a", "b") == 1 and g.dig({}, "a", "b") == "" and g.safe_int("1,2") == 12 and g.safe_int("x") is None and g.as_list(None) == []
    assert g.checked("abc", "q", str, 1, 5) == "abc"
    for bad in (("", str, 1, 5), (True, int, 0, 5), (9, int, 0, 5)):
        with pytest.raises(g.QueryError):
            g.checked(bad[0], "q", *bad[1:])


def test_adapters(spark):
    node = {"data": {"gpss-API": {"patent": {"patentcontent": {"publication-reference": {"doc-number": "TW1", "date": "20200101"}, "patent-title": {"chinese-title": "泵"}, "abstract": {"p": ["a", "b"]}, "claims": {"claim": [{"claim-text": ["A", "pump"]}, "x"]}, "parties": {"applicants": {"applicant": [{"english-name": "X", "name": "Y"}, {"name": "Z"}, "plain"]}}, "classifications-cpc": {"cpc": [{"keyValue": f"C{i}"} for i in range(8)]}, "classifications-ipc": {"ipc": "H01M"}, "priority-claims": {"priority-claim": {"date": "2019"}}}}}}}
    frame = lambda x: spark.createDataFrame([(json.dumps(x),)], "j string")
    r = adapters.office_records(frame(node), "j").first()
    assert (r["pubno"], r["title"], r["abstract"], r["claim1"], r["claim1_empty"], r["assignee"], r["cpc"], r["ipc"], r["prio_date"], r["pub_date"], r["inventor"]) == ("TW1", "泵", "a b", "A pump", False, "X; Z; plain", "C0; C1; C2; C3; C4; C5", "H01M", "2019", "20200101", "")
    r = adapters.web_records(frame([{"publication_number": "US1", "snippet": "a &amp; b"}, {}]), "j").collect()
    assert [(x["pubno"], x["abstract"], x["claim1"]) for x in r] == [("US1", "a & b", ""), ("", "", "")]
    r = adapters.full_text_records(frame({"docs": [{"guid": "G", "patentNumber": "", "inventorsShort": ["A", "B"], "abstractHtml": "<p>x\n y</p>", "ipcCodeFlattened": list("abcdefgh")}, "no"]}), "j").collect()
    assert [(x["pubno"], x["inventor"], x["abstract"], x["ipc"]) for x in r] == [("G", "A; B", "x y", "a; b; c; d; e; f")]
    hits = {"results": {"cluster": [{"result": [{"rank": 0, "patent": {"publication_number": "US1", "title": " t ", "thumbnail": "a.png", "figures": [1, 2]}}]}, {"result": []}]}}
    r = adapters.hit_rows(frame(hits), "j", "http://i/").collect()
    assert [(x["rank"], x["publication_number"], x["title"], x["figure_url"], x["pdf_url"], x["num_figures"]) for x in r] == [(0, "US1", "t", "http://i/a.png", None, 2)]
    assert adapters.office_records(frame({}), "j").count() == adapters.web_records(frame({}), "j").where("pubno != ''").count() == 0


def test_fulltext(spark, tmp_path):
    store = spark.createDataFrame([("1", "電池組 battery", "TW", 3), ("2", "solar battery battery", "US", 9), ("3", "other", "US", 5)], "k string, t string, c string, u int")
    ask = lambda **kw: [r["k"] for r in fulltext.store_query(store, "k", ["t"], ["k"], "u", "c", **kw)[0].collect()]
    assert ask(number="3") == ["3"] and ask(text="電池組") == ["1"] and ask(place="US") == ["2", "3"] and ask() == ["2", "3", "1"] and ask(text="batt") == ["2", "1"]
    assert fulltext.store_query(store, "k", ["t"], ["k"], "u", "c")[1] == 3
    plan = g.match_plan("battery so")
    assert [r["k"] for r in fulltext.planned(store, ["t"], ["k"], plan, updated="u").collect()] == ["2"] and [r["k"] for r in fulltext.planned(store, ["t"], ["k"], g.match_plan("er"), updated="u").collect()] == ["2", "3", "1"]
    edges = spark.createDataFrame([("1", "extracted_from", '{"source_weight": 3}'), ("1", "distilled_from", '{"source_weight": 5}'), ("1", "other", '{"source_weight": 7}'), ("2", "extracted_from", "bad")], "source_id string, edge_type string, metadata_json string")
    assert {r["k"]: r["source_weight"] for r in fulltext.graded(store, edges, "k", ["extracted_from", "distilled_from"]).collect()} == {"1": 5.0, "2": None, "3": None}
    a, b = (spark.createDataFrame(x, "k string, rank int") for x in ([("1", 1), ("2", 2)], [("2", 1)]))
    got = fulltext.fuse_weighted({"a": (a, 1.0), "b": (b, 0.5)}, "k", 9).collect()
    assert [r["k"] for r in got] == ["2", "1"] and got[1]["b_score"] == 0 and [r["k"] for r in fulltext.fuse_weighted({"a": (a, 1.0), "b": (b, 0.5)}, "k", 9, store.where("c = 'TW'")).collect()] == ["1"]
    fulltext.build_index(store, "k", "t", str(tmp_path / "i"))
    assert [r["k"] for r in fulltext.score_index(spark, str(tmp_path / "i"), ["battery"], "k", 5).collect()] == ["2", "1"]
    both = fulltext.fan_out({"x": a.withColumn("score", F.lit(2.0)), "y": b.withColumn("score", F.lit(3.0))}, "k", 2).collect()
    assert [(r["k"], r["source"]) for r in both] == [("2", "y"), ("1", "x")]


def test_paging():
    rows, waits = list(range(950)), []
    fetch = lambda skip, size: (rows[skip : skip + size], len(rows))
    out = paging.harvest(fetch)
    assert out["rows"] == rows and out["complete"] and not out["true_zero"] and out["resume"] is None
    assert paging.harvest(fetch, num=300)["resume"] == 300 and paging.harvest(lambda s, n: ([], 0))["true_zero"]

    def flaky(skip, size):
        if skip >= 400:
            raise OSError("down")
        return fetch(skip, size)

    out = paging.harvest(flaky, sleep=waits.append)
    assert (len(out["rows"]), out["complete"], out["error"], out["resume"], waits) == (400, False, "down", 400, [2, 4, 8])
    with pytest.raises(g.QueryError):
        paging.bulk_axis(lambda **kw: ([], 0), {"keyword": "x"})
    assert paging.bulk_axis(lambda skip, num, **kw: ([sorted(kw)], 1), {"keyword": "x", "cpc": "H01M"})["rows"] == [["cpc"]]
    pages = {1: [1, 2], 2: [3], 3: [3]}
    assert paging.walk(lambda k: pages.get(k, []), lambda r: r, 9) == {"rows": [1, 2, 3], "pages": 2, "state": "complete"} and paging.walk(lambda k: [k], lambda r: r, 2)["state"] == "truncated"
    ticks = iter(range(99))
    out = paging.batched([1, 2, 3, 4], lambda x: x, 3, clock=lambda: next(ticks))
    assert out == {"done": {1: 1, 2: 2}, "remaining": [3, 4]}
    got = paging.ladder({"a": lambda q: [1], "b": lambda q: [], "c": lambda q: [q]}, {"TW"}, {"a": {"US"}}, "x")
    assert got == {"source": "c", "hits": ["x"], "misses": {"a": "not_served", "b": "zero_hits"}}
