"""Every query with SQL gives DuckDB's rows on the smallest test data."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from polyglossa.plans.queries import ORACLE_SQL, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("part", "orders", "lineitem", "events", "documents", "benchmark", "conversations", "customer", "supplier", "labels", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(ORACLE_SQL[name])
    names = sorted(want.columns)
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == names
    rows = sorted((tuple(r[c] for c in names) for r in got.collect()), key=repr)
    assert rows == sorted(want.project(", ".join(f'"{c}"' for c in names)).fetchall(), key=repr)
