"""Antecedents, lineage of claims and figures: small cases."""

from pyspark.sql import functions as F

from folioscope.operators import antecedents, figures, filings


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_names(spark):
    forms = {"bodies": ("body", "bodieses"), "boxes": ("box", "boxeses"), "glass": ("glass", "glasses"), "lid": ("lid", "lids"), "key": ("key", "keys"), "body": ("body", "bodies"), "bus": ("bu", "buses"), "y": ("y", "ys"), "s": ("", "ses")}
    rows = spark.createDataFrame([(w,) for w in forms], "w string").select("w", antecedents.singular(F.col("w")).alias("s"), antecedents.plural(F.col("w")).alias("p")).collect()
    assert {r["w"]: (r["s"], r["p"]) for r in rows} == forms
    assert value(spark, antecedents.normal(F.lit("  Big \n Lid.;"))) == "big lid"


CLAIMS = [
    (1, 1, None, "A lid and a box for the lid to shut. The cap that turns, said lids that the box is"),
    (1, 2, 1, "The box that said lid to, wherein the boxes that\n a) a rod to push the rod that\n b) the pin is"),
    (1, 3, 9, "the box that"),  # no such parent
    (1, 4, 5, "a cup to and the rim that"),
    (1, 5, 4, "the cup that has a rim to"),  # a cycle
    (2, 2, 1, "the lid that"),
    (3, 1, 1, "the cup to hold a cup to"),
]


def test_missing_basis(spark):
    df = spark.createDataFrame(CLAIMS, "f int, n int, up int, body string")
    found = lambda ordered: sorted((r["f"], r["n"], r["term"], r["location"]) for r in antecedents.missing_basis(df, "f", "n", "up", "body", ordered).collect())
    plain = [(1, 1, "said lids", "preamble"), (1, 1, "the cap", "preamble"), (1, 2, "the pin", "limitation (b)"), (1, 3, "the box", "preamble"), (2, 2, "the lid", "preamble")]
    got = found(False)
    assert set(plain) - set(got) <= {(1, 1, "said lids", "preamble")} and (1, 4, "the rim", "preamble") not in got and (3, 1, "the cup", "preamble") not in got
    assert (3, 1, "the cup", "preamble") in found(True) and set(got) <= set(found(True))


def test_lineage(spark):
    n = 150
    chain = spark.createDataFrame([(7, k, k - 1 if k > 1 else None) for k in range(1, n + 1)], "f int, n int, up int")
    rows = filings.ancestors(chain, "f", "n", "up").collect()
    assert {r["n"]: (r["root"], r["depth"]) for r in rows} == {k: (1, k - 1) for k in range(1, n + 1)}
    pairs = {(r["n"], r["ancestor"]): r["steps"] for r in antecedents.lineage(chain, "f", "n", "up").collect()}
    assert pairs == {(k, j): k - j for k in range(1, n + 1) for j in range(1, k + 1)}
    odd = spark.createDataFrame([(a, b, c) for a, b, c, _ in CLAIMS], "f int, n int, up int")
    got = {(r["f"], r["n"], r["ancestor"]) for r in antecedents.lineage(odd, "f", "n", "up").collect()}
    assert got == {(a, b, b) for a, b, _, _ in CLAIMS} | {(1, 2, 1), (1, 4, 5), (1, 5, 4)}
    assert {(r["f"], r["n"]): r["root"] for r in filings.ancestors(odd, "f", "n", "up").collect()} == {(1, 1): 1, (1, 2): 1, (1, 3): None, (1, 4): None, (1, 5): None, (2, 2): None, (3, 1): None}
    assert antecedents.lineage(odd.limit(0), "f", "n", "up").count() == 0 and filings.ancestors(odd.limit(0), "f", "n", "up").count() == 0


def test_figures(spark):
    text = "Brief Description of the Drawings FIGS. 1-3 and 5A show. fig. 2(b), FIGURE 10 to 12; FIG 9 - 7 & 4. DETAILED DESCRIPTION: FIG. 1-3 has a module 12. Figure 10. " + "x" * 600 + " FIG. 5A and button 7"
    assert value(spark, figures.referenced(F.lit(text))) == ["1-3", "10", "2(b)", "5A", "9 - 7"]
    assert value(spark, figures.numbers(F.lit(text))) == sorted(["1", "2", "3", "5A", "2(b)", "10", "11", "12", "9", "7", "4"])
    assert value(spark, figures.numbers(F.lit("FIGS. 1A-3B, 4 through 6 and FIG. 1-99999 none"))) == sorted(["1A", "2", "3B", "4", "5", "6", "1", "99999"])
    seen = {r["figure"]: (r["discussed"], r["numerals"]) for r in value(spark, figures.coverage(F.lit(text)))}
    assert seen == {"1-3": (True, True), "10": (True, True), "2(b)": (False, False), "5A": (True, False), "9 - 7": (False, False)}
    issues = lambda t, have, office="us": [tuple(x) for x in value(spark, figures.drawing_issues(F.lit(t), F.lit(have), office))]
    assert issues(text, True) == [("WARNING", "not_discussed", "2(b)"), ("INFO", "no_numerals", "5A"), ("WARNING", "not_discussed", "9 - 7")]
    assert issues("see FIG. 1", False) == issues("see FIG. 1", False, "ep") == [("CRITICAL", "no_drawings", None), ("CRITICAL", "no_brief_description", None)]
    assert issues("description of figures FIG. 1", True, "ep") == [] and issues("", False) == [] and value(spark, figures.coverage(F.lit("FIG. 1"))) is None
    assert value(spark, figures.missing_sections(F.lit("Background of the invention. Summary."))) == ["BRIEF DESCRIPTION OF DRAWINGS", "DETAILED DESCRIPTION"]


def test_basis_is_not_broadcast(spark):
    """Tables that grow with the claims stay out of the driver, however small they look."""
    df = spark.createDataFrame([(1, 1, None, "A lid comprising a box that turns"), (1, 2, 1, "The lid with the box and the cup is red")], "f int, n int, up int, body string")
    for out in (antecedents.missing_basis(df, "f", "n", "up", "body"), antecedents.missing_basis(df, "f", "n", "up", "body", True), antecedents.lineage(df, "f", "n", "up")):
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and ("SortMergeJoin" in plan or "steps" in out.columns)
