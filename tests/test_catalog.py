"""Every catalog query against its SQL in DuckDB, and the query language's own cases."""

import duckdb
import pytest

from folioscope import catalog
from folioscope.plans.boolean_query import QuerySyntaxError, parse, term_pattern

D = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted((tuple(r[i] for i in order) for r in data), key=str)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_same_as_sql(spark, duck, name):
    out = catalog.QUERIES[name](spark, D)
    want = duck.execute(catalog.ORACLE_SQL[name])
    want = rows([c[0] for c in want.description], want.fetchall())
    got = rows(out.columns, out.collect())
    assert got[0] == want[0] and len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_parse():
    assert parse('a b or not "c d"') == ("or", ("and", ("term", "a"), ("term", "b")), ("not", ("term", "c d")))
    assert parse("((a)) AND b") == ("and", ("term", "a"), ("term", "b"))
    assert term_pattern("a* b?") == r"\ba\w*\W+b\w\b"
    for bad in ("", "(a", "a)", "and", "a or", '"a'):
        with pytest.raises(QuerySyntaxError):
            parse(bad)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
