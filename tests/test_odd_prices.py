"""Queries with SQL on ticks whose prices are 0 or negative: infinite values, NaN and null are told apart."""

import math

import pytest

from tickloom.plans.all_queries import QUERIES, SQL

NAMES = [
    "bar_impacts",
    "corwin_schultz",
    "bekker_parkinson",
    "range_volatility",
    "garman_klass_vol",
    "parkinson_vol",
    "yang_zhang_vol",
    "trade_lambdas",
    "trade_amihud",
    "trade_hasbrouck",
]


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Folder with a table of events and a connection that has it as a view."""
    duckdb = pytest.importorskip("duckdb")
    path = tmp_path_factory.mktemp("odd")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 420) AS ts, i AS user_id, CASE i % 2 WHEN 0 THEN 'a' ELSE 'b' END AS event_type,
CASE WHEN i % 211 IN (0, 2) THEN 0 WHEN i % 389 = 0 THEN -1.5 ELSE round(20 + 10 * sin(i * i), 2) END::DOUBLE AS value, '{{"k": ' || (i * 37 % 90) || '}}' AS props FROM range(4000) r(i)) TO '{path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/events.parquet'")
    return str(path), con


def text(x):
    """Sort key and identity of a value; floats to nine digits."""
    return "null" if x is None else f"{x + 0.0:.9g}" if isinstance(x, float) else str(x)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql_on_odd_prices(spark, odd, name):
    path, con = odd
    got = QUERIES[name](spark, path)
    found = con.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    rows = got.collect()
    assert any(isinstance(x, float) and not math.isfinite(x) for r in found for x in r)
    assert sorted(tuple(map(text, r)) for r in rows) == sorted(tuple(map(text, r)) for r in found)


def test_threshold_bars_add_tick_by_tick():
    """Bars of one batch and of many small ones are those of a plain loop, however near the threshold a sum comes and however much came before."""
    import numpy as np
    import pandas as pd

    from tickloom.operators.bars import _Threshold

    rng = np.random.default_rng(3)
    near = [2500.0] * 9000 + ([2500.0] * 19 + [2499.99, 0.01]) * 20  # late bars that are a cent short at their 20th tick
    missing = [1.0, 2.0, 4.0, 1.0, -np.inf, 9.0, 9.0]
    for values, threshold in ((near, 50000.0), ([0.1] * 500, 1.0), (rng.integers(0, 9, 3000) / 10, 1.0), (rng.integers(-5, 9, 3000) / 10, 3.0), ([5.0, 1.0], 0.0), (missing, 5.0)):
        want, total, bar = [], 0.0, 0
        for v in values:
            total += v
            want.append((bar, total >= threshold))
            if total >= threshold:
                total, bar = 0.0, bar + 1
        rows = pd.DataFrame({"i": range(len(values)), "m": values})
        for size in (len(rows), 7):
            kernel = _Threshold((), threshold, "m", ["i"])
            got = pd.concat([kernel.feed(rows[k : k + size]) for k in range(0, len(rows), size)])
            assert list(zip(got["bar"].tolist(), got["done"].tolist())) == want and got["i"].tolist() == rows["i"].tolist()


def test_dollar_bars_just_short_of_the_threshold(spark):
    from tickloom.operators import bars

    prices = [2500.0] * 9000 + [2500.0] * 19 + [2499.99, 0.5]
    ticks = spark.createDataFrame([("a", i, i, p, 1) for i, p in enumerate(prices)], "symbol string, us long, seq long, price double, volume long")
    got = bars.dollar_bars(ticks, ["symbol"], ["us", "seq"], 50000).orderBy("tick_num").collect()
    assert len(got) == 451 and (got[-1]["tick_num"], got[-1]["cum_ticks"], got[-1]["close"]) == (9021, 21, 0.5)


@pytest.mark.parametrize("name", ["encode_array", "encode_tick_rule"])
def test_messages_of_ticks_at_equal_times(spark, tmp_path, name):
    """Ticks of one time stand in the order of their numbers; some volumes are missing."""
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i // 6 * 900) AS ts, i AS user_id, CASE i % 2 WHEN 0 THEN 'a' ELSE 'b' END AS event_type, round(20 + 10 * sin(i * i), 2)::DOUBLE AS value,
CASE WHEN i % 50 = 7 THEN '{{}}' ELSE '{{"k": ' || (i * 37 % 90) || '}}' END AS props FROM range(1200) r(i)) TO '{tmp_path}/events.parquet'""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    got = QUERIES[name](spark, str(tmp_path)).select("symbol", "day", "message").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(f"SELECT symbol, day, message FROM ({SQL[name]})").fetchall())
