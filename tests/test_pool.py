"""Pool operators on small tables: forms of numbers, elements and places of claims, empty inputs, ties."""

from pyspark.sql import functions as F

from folioscope.functions import markup
from folioscope.operators import claims, pool


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_elements(spark):
    body = "A system comprising a first  sensor, the memory, said First sensor and an output port connected to the housing wall; a method."
    assert one(spark, claims.elements(F.col("b")), b=body) == ["first sensor", "output port", "housing wall"]
    assert one(spark, claims.elements(F.col("b")), b="") == []


def test_location(spark):
    body = "A valve, comprising:\n a) a large seat\n b) a spring\nof steel"
    for phrase, where in (("SPRING", "limitation (b)"), ("steel", "limitation (b)"), ("seat", "limitation (a)"), ("valve", "preamble"), ("knob", "body")):
        assert one(spark, claims.location(F.col("b"), F.col("p")), b=body, p=phrase) == where
    assert one(spark, claims.location(F.col("b"), F.col("p")), b="A valve with a knob", p="knob") == "preamble"


def test_forms(spark):
    got = one(spark, pool.forms(F.col("n")), n="USRE12345E1")
    assert got[0] == one(spark, pool.pubno.key(F.col("n")), n="USRE12345E1") and "USRE12345E1" in got and "RE12345" in got
    assert len(got) == len(set(got))


def test_resolve_edges(spark):
    requests = spark.createDataFrame([(1, "EP007A"), (2, None), (3, "EP9")], "k int, want string")
    rows = spark.createDataFrame([(1, 2, "EP 7"), (1, 1, "EP8"), (1, 3, "EP7B"), (2, 1, None), (2, 2, "EP1")], "k int, pos int, number string")
    got = {r["k"]: (r["pos"], r["matched"]) for r in pool.resolve(requests, rows, "k", "want", "number", "pos").collect()}
    assert got == {1: (2, True), 2: (1, False), 3: (None, False)}
    got = {r["k"]: r["pos"] for r in pool.resolve(requests, rows, "k", "want", "number", "pos", strict=True).collect()}
    assert got == {1: 2, 2: None, 3: None}


def test_tags_and_gate(spark):
    rules = {"x": {"a": "aa", "b": "bb"}}
    df = spark.createDataFrame([(1, "AA bb"), (2, None), (3, "zz")], "id int, t string").select("id", *pool.tags(F.col("t"), rules))
    assert [r["x"] for r in df.orderBy("id").collect()] == ["a|b", "unlabeled", "unlabeled"]
    assert {(r["label"], r["n"], r["sparse"]) for r in pool.sparse(df, rules, 0.4).collect()} == {("a", 1, True), ("b", 1, True)}
    assert [r["share"] for r in pool.sparse(df.limit(0), rules, 0.4).collect()] == [0.0, 0.0]
    rows = spark.range(100).select("id", F.lit("q").alias("batch"), (F.col("id") % 2 == 0).alias("good"))
    got = pool.gate(rows, "batch", "id", "good").first()
    assert got["sampled"] == 30 and not got["passes"] and not got["whole"]


def test_page_without_sections(spark):
    got = spark.range(1).select(markup.claims(F.lit("<p>x</p>")).alias("c"), markup.description(F.lit("<p>x</p>")).alias("d"), markup.pdf_link(F.lit("<p>x</p>")).alias("u")).first()
    assert (got["c"], got["d"], got["u"]) == ([], "", None)
