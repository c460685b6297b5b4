"""Every query that SQL can express against DuckDB on the same tables."""

import datetime
import os

import duckdb
import pytest

from lexibridge.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(data):
    c = duckdb.connect()
    c.execute("SET enable_progress_bar = false")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return str(v)


def rows(names, tuples):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(plain(t[i]) for i in order) for t in tuples)


@pytest.mark.skipif(not os.path.isdir("/root/testdata"), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, db, data, name):
    got = catalogue.queries()[name](spark, data)
    want = db.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())
