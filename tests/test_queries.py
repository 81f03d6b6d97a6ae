"""Every registered query with SQL against that SQL in DuckDB."""

import glob
import math
import os

import pytest

from tickloom.plans.all_queries import QUERIES, SQL

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def close(a, b):
    if a is None or b is None:
        return a is b or (a is None and isinstance(b, float) and math.isnan(b)) or (b is None and isinstance(a, float) and math.isnan(a))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b or abs(a - b) <= 2e-5 * max(1.0, abs(a))
    return a == b


def key(row):
    return [(x is None, "" if x is None else (f"{float(x) + 0.0:020.3f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x))) for x in row]


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = duck.execute(SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    a = sorted(([float(r[i]) if type(r[i]).__name__ == "Decimal" else r[i] for i in at] for r in want.fetchall()), key=key)
    b = sorted(([r[c] for c in columns] for r in got.collect()), key=key)
    assert len(a) == len(b)
    assert sum(all(close(x, y) for x, y in zip(r, s)) for r, s in zip(a, b)) == len(a)

