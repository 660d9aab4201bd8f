"""Patterns on texts beyond ASCII: rows as in SQL."""

import duckdb
import pytest

from folioscope import catalog

TURNS = [
    (1, 0, "u", "in der bestü, übest"), (1, 1, "a", "éhigh 5 weakß hİgh low\u212a"), (1, 2, "u", "best_ xbest best"), (2, 0, "u", "\x0bgood\x0b"),
    (2, 1, "u", "w " * 499 + "\x0b w"), (2, 2, "u", "w\x0b" * 600), (3, 0, "u", "lİmİted to: İncluding but not limited to "), (3, 1, "u", None),
]


def same(spark, tmp_path, name, table, rows, schema):
    path = str(tmp_path / f"{table}.parquet")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}/*.parquet'")
    out = catalog.QUERIES[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(out.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    return got


@pytest.mark.parametrize("name", ["claim_rules", "claim_scores"])
def test_claims_beyond_ascii(spark, tmp_path, name):
    assert same(spark, tmp_path, name, "conversations", TURNS, "conv_id long, turn long, role string, text string")


# turns of spaces of several kinds before another one, and turns without a number, below the first, or twice
ODD = [
    (1, 0, "u", "\n"), (1, 1, "u", "good claim 1"), (1, 2, "u", "\t\r"), (1, 3, "u", "best\n7."), (1, 4, "u", "etc."), (2, 0, "u", "\xa0"), (2, 1, "u", " \u3000"), (2, 2, "u", "low"),
    (3, None, "u", "weak"), (3, -2, "u", "good"), (3, -9, "u", "high"), (3, 1, "u", "a"), (3, 1, "u", "such as"), (4, 0, "u", "\f"), (5, 0, "u", "\u2003"), (None, 0, "u", "small"), (6, 0, "u", ""),
]


@pytest.mark.parametrize("name", ["claim_parse", "claim_scores"])
def test_claims_of_odd_turns(spark, tmp_path, name):
    rows = [r for r in ODD if r[3] != "best\n7."]  # the SQL leaves that one out
    got = same(spark, tmp_path, name, "conversations", rows, "conv_id long, turn long, role string, text string")
    assert sum(r[1] for r in got) == 12 if name == "claim_scores" else len(got) == 12


def test_claims_after_a_bare_number(spark, tmp_path):
    """A number without text that ends a turn takes no claim of the next one."""
    spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r["conv_id"]: (r["n_claims"], r["n_issues"]) for r in catalog.QUERIES["claim_scores"](spark, str(tmp_path)).collect()}
    assert got[1] == (5, 3)


UNITS = [
    (1, "é5 ft 5 ftä 6 feet, ß7 in. 8 in.x", 7), (2, "5\x0bft 5\n inches_ 5 inches", 7), (3, "6 lbſ 7 mile\u017f 8 yard\u017f. 9 degree\u017f F 9 degreeS fahrenheit 9Fü", 7), (4, None, 7),
    (5, "x5 ft _6 ft 7ft8 ft 9 ° F 9° Fß 32 F\u212a", 7), (6, "１２ ft ٣ ft 3 gal.é 3 gal. 4 galé", 7), (7, "", 7),
]


def test_units_beyond_ascii(spark, tmp_path):
    got = same(spark, tmp_path, "unit_terms", "documents", UNITS, "doc_id long, text string, n_chars long")
    assert sum(sum(r[1:]) for r in got if r[0] != 4) > 15
