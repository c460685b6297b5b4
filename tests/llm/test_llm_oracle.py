"""The training-data operators that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from lexibridge.llm import queries
from tests.test_oracle import TABLES, rows

SMALL = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_operator_equals_sql(spark, name):
    db = duckdb.connect()
    db.execute("SET enable_progress_bar = false")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    want = db.execute(queries.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = queries.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(names)
    found = rows(got.columns, [tuple(r) for r in got.collect()])
    assert found and found == rows(names, want.fetchall())
