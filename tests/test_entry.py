import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "documents embeddings pages benchmark labels conversations events".split()
OWN = sorted(q.__name__ for q in entry._QUERIES)
ORACLE = entry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, int) or value is None:
        return str(value)
    try:
        return f"{float(value) + 0.0:.4f}"
    except ValueError:
        return str(value)


def table(rows):
    return sorted(tuple(plain(v) for v in row) for row in rows)


def test_every_statement_has_a_query():
    assert set(ORACLE) <= set(entry.queries())
    assert set(OWN) <= set(ORACLE)


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert table(rows) == table([row[i] for i in order] for row in result.fetchall())
