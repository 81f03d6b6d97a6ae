"""Queries with SQL on ticks that lack prices, times or numbers, share times or lie before 1970."""

import pytest

from tickloom.plans.all_queries import QUERIES, SQL

#: What is odd: columns of the events in place of the plain ones.
ODD = {
    "missing times": {"ts": "CASE WHEN i % 23 = 3 THEN NULL ELSE ts END"},
    "missing prices": {"value": "CASE WHEN i % 23 = 3 THEN NULL ELSE value END"},
    "equal times": {"ts": "date_trunc('hour', ts) + to_minutes(minute(ts) // 30 * 30)"},
    "before 1970": {"ts": "ts - to_days(19731)"},
    "missing numbers": {"ts": "date_trunc('hour', ts)", "event_id": "CASE WHEN i % 23 = 3 THEN NULL ELSE i END"},
}
CASES = [
    ("bekker_parkinson", "missing times"),
    ("parkinson_vol", "missing times"),
    ("parkinson_vol", "before 1970"),
    ("garman_klass_vol", "missing prices"),
    ("yang_zhang_vol", "equal times"),
    ("trade_amihud", "before 1970"),
    ("trade_hasbrouck", "missing numbers"),
]


def text(x):
    return "null" if x is None else f"{x + 0.0:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name, odd", CASES)
def test_matches_sql_on_odd_ticks(spark, tmp_path, name, odd):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("""CREATE TABLE plain AS SELECT i, i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 420) AS ts, i AS user_id, CASE i % 2 WHEN 0 THEN 'a' ELSE 'b' END AS event_type,
round(20 + 10 * sin(i * i), 2)::DOUBLE AS value, '{"k": ' || (i * 37 % 90) || '}' AS props FROM range(4000) r(i)""")
    columns = ", ".join(f"{ODD[odd].get(c, c)} AS {c}" for c in ("event_id", "ts", "user_id", "event_type", "value", "props"))
    con.execute(f"COPY (SELECT {columns} FROM plain p ORDER BY p.i) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path))
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    assert len(found) > 5 and sorted(tuple(map(text, r)) for r in got.collect()) == sorted(tuple(map(text, r)) for r in found)
