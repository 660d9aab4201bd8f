"""Where queries register themselves with the SQL they are checked against."""

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None):
    def register(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"two queries are called {f.__name__}")
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register
