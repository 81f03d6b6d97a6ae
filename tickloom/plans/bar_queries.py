"""Queries over bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bars as ops
from ..sources import testdata as src
from .registry import query

KEY, ORDER = ["symbol"], ["us", "seq"]

_SIDE = """g AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY us, seq)), 0) AS g, row_number() OVER (PARTITION BY symbol ORDER BY us, seq) AS tick_num FROM t),
x AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING), 0)::INT AS side FROM g)"""
_ROW = """arg_min(price, tick_num) AS open, max(price) AS high, min(price) AS low, arg_max(price, tick_num) AS close, sum(volume)::BIGINT AS volume, sum(CASE WHEN side = 1 THEN volume ELSE 0 END)::BIGINT AS cum_buy_volume, count(*) AS cum_ticks, round(sum(price * volume), 4) AS cum_dollar_value"""


def _out(df, *more: str):
    return df.select("symbol", *more, "date_time", "tick_num", "open", "high", "low", "close", "volume", "cum_buy_volume", "cum_ticks", F.round("cum_dollar_value", 4).alias("cum_dollar_value"))


@query("tick_rule_global", _SIDE + " ||| SELECT seq, side FROM x", "t")
def tick_rule_global(spark, sf):
    return ops.with_side(src.ticks(spark, sf), KEY, ORDER).select("seq", "side")


@query("tick_rule", """g AS (SELECT *, us // 3600000000 AS bar FROM t), h AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol, bar ORDER BY us, seq)), 0) AS g FROM g) |||
SELECT seq, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY symbol, bar ORDER BY us, seq ROWS UNBOUNDED PRECEDING), 0)::INT AS side FROM h""", "t")
def tick_rule(spark, sf):
    return ops.side_in_bar(src.ticks(spark, sf).withColumn("bar", F.floor(F.col("us") / 3600000000)), KEY, ORDER, "bar").select("seq", "side")


@query("imbalance_net", _SIDE + " ||| SELECT symbol, sum(side)::BIGINT AS tick_imbalance, sum(side * volume)::BIGINT AS volume_imbalance, round(sum(side * volume * price), 4) AS dollar_imbalance FROM x GROUP BY ALL", "t")
def imbalance_net(spark, sf):
    return ops.imbalance_net(ops.with_side(src.ticks(spark, sf), KEY, ORDER), KEY).withColumn("dollar_imbalance", F.round("dollar_imbalance", 4))


@query("imbalance_runs", _SIDE + """, f AS (SELECT *, CASE WHEN side <> lag(side) OVER (PARTITION BY symbol ORDER BY us, seq) THEN 1 ELSE 0 END AS f FROM x), r AS (SELECT *, sum(f) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS run FROM f) |||
SELECT seq, count(*) OVER w AS run_length, (sum(volume) OVER w)::BIGINT AS run_volume, round(sum(volume * price) OVER w, 4) AS run_dollars FROM r WINDOW w AS (PARTITION BY symbol, run ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""", "t")
def imbalance_runs(spark, sf):
    return ops.imbalance_runs(ops.with_side(src.ticks(spark, sf), KEY, ORDER), KEY, ORDER).select("seq", "run_length", "run_volume", F.round("run_dollars", 4).alias("run_dollars"))


@query("tick_bars", _SIDE + f" ||| SELECT symbol, max(us) AS date_time, max(tick_num) AS tick_num, {_ROW} FROM x GROUP BY symbol, (tick_num - 1) // 50 HAVING count(*) = 50", "t")
def tick_bars(spark, sf):
    return _out(ops.tick_bars(src.ticks(spark, sf), KEY, ORDER, 50))


@query("time_bars", _SIDE + f", y AS (SELECT *, (us // 3600000000 + 1) * 3600 AS bar FROM x), z AS (SELECT symbol, bar AS date_time, max(tick_num) + 1 AS tick_num, {_ROW} FROM y GROUP BY symbol, bar) ||| SELECT * FROM z QUALIFY date_time < max(date_time) OVER (PARTITION BY symbol)", "t")
def time_bars(spark, sf):
    return _out(ops.time_bars(src.ticks(spark, sf), KEY, ORDER, 3600))


@query("time_bars_alt", "|||SELECT symbol, us // 900000000 AS slot, arg_min(price, us) AS open, arg_max(price, us) AS close, count(*) AS n, sum(volume)::BIGINT AS volume FROM t GROUP BY ALL", "t")
def time_bars_alt(spark, sf):
    return src.ticks(spark, sf).groupBy("symbol", F.floor(F.col("us") / 900000000).alias("slot")).agg(F.min_by("price", "us").alias("open"), F.max_by("price", "us").alias("close"), F.count(F.lit(1)).alias("n"), F.sum("volume").alias("volume"))


def _fold_sql(metric: str, threshold: float) -> str:
    return _SIDE + f""", r AS (SELECT symbol, tick_num, ({metric})::DOUBLE AS acc, 0 AS bar, ({metric}) >= {threshold} AS done FROM x WHERE tick_num = 1
UNION ALL SELECT x.symbol, x.tick_num, CASE WHEN r.done THEN 0 ELSE r.acc END + ({metric}), r.bar + CASE WHEN r.done THEN 1 ELSE 0 END, CASE WHEN r.done THEN 0 ELSE r.acc END + ({metric}) >= {threshold} FROM r JOIN x ON x.symbol = r.symbol AND x.tick_num = r.tick_num + 1),
y AS (SELECT x.*, r.bar, r.done FROM x JOIN r USING (symbol, tick_num)) ||| SELECT symbol, max(us) AS date_time, max(tick_num) AS tick_num, {_ROW} FROM y GROUP BY symbol, bar HAVING bool_or(done)"""


@query("volume_bars", _fold_sql("volume", 1000), "t", recursive=True)
def volume_bars(spark, sf):
    return _out(ops.volume_bars(src.ticks(spark, sf), KEY, ORDER, 1000))


@query("dollar_bars", _fold_sql("price * volume", 50000), "t", recursive=True)
def dollar_bars(spark, sf):
    return _out(ops.dollar_bars(src.ticks(spark, sf), KEY, ORDER, 50000))


@query("standard_bars", _fold_sql("volume * 2", 3000), "t", recursive=True)
def standard_bars(spark, sf):
    return _out(ops.metric_bars(src.ticks(spark, sf), KEY, ORDER, F.col("volume") * 2, 3000))


@query("bar_row", _SIDE + f", y AS (SELECT *, us // 86400000000 AS day FROM x) ||| SELECT symbol, day, max(us) AS date_time, max(tick_num) AS tick_num, {_ROW} FROM y GROUP BY symbol, day", "t")
def bar_row(spark, sf):
    rows = ops.numbered(ops.with_side(src.ticks(spark, sf), KEY, ORDER), KEY, ORDER).withColumn("day", F.floor(F.col("us") / 86400000000))
    return _out(ops.bar_rows(rows, KEY, "us", "day"), "day")


def _expected(kind: str, metric: str, prev: int | None):
    def run(spark, sf):
        bars = ops.expectation_bars(src.ticks(spark, sf), KEY, ORDER, kind, metric, window=100, exp_num_ticks=30, num_prev_bars=prev, constraints=(10, 200) if prev else None)
        return _out(bars.withColumns({c: F.col(c).cast("long") for c in ("volume", "cum_buy_volume")}))

    return run


def _mean_sql(values: str, window: str) -> str:
    """Last value of the bias-corrected exponential mean of a list's last ``window`` values."""
    last, keep = f"{values}[greatest(1, len({values}) - ({window}) + 1):]", f"(1 - 2.0::DOUBLE / (({window}) + 1))"
    return f"(list_sum(list_transform({last}, lambda v, i: v * pow({keep}, len({last}) - i))) / list_sum(list_transform({last}, lambda v, i: pow({keep}, len({last}) - i))))"


def _expected_sql(kind: str, metric: str, prev: int | None) -> str:
    """The same bars tick by tick, with the histories as lists of the last 100 values."""
    size = {"tick": "1.0::DOUBLE", "volume": "x.volume::DOUBLE", "dollar": "x.price * x.volume"}[metric]
    run = kind == "run"
    keep = "list_append({0}, {1})[greatest(1, len({0}) - 98):]"
    next_ticks = f"CASE WHEN done THEN least(greatest({_mean_sql('sizes', '3')}, 10), 200) ELSE et END" if prev else "et"
    shares = _mean_sql("shares", str(prev) if prev else "len(shares)")
    state = "a1, a2, up, h1, h2, e1, e2, share"
    start = "0.0::DOUBLE AS a1, 0.0::DOUBLE AS a2, 0 AS up, []::DOUBLE[] AS h1, []::DOUBLE[] AS h2, NULL::DOUBLE AS e1, NULL::DOUBLE AS e2, NULL::DOUBLE AS share"
    # One tick: sums and histories; first expectations; the test; what a closed bar leaves behind.
    if run:
        summed = f"a1 + greatest(sg, 0) AS a1, a2 + greatest(-sg, 0) AS a2, up + CASE WHEN side = 1 THEN 1 ELSE 0 END AS up, CASE WHEN sg > 0 THEN {keep.format('h1', 'sg')} ELSE h1 END AS h1, CASE WHEN sg < 0 THEN {keep.format('h2', '-sg')} ELSE h2 END AS h2"
        known = "e1 IS NULL AND len(h1) >= 30 AND len(h2) >= 30"
        first = f"CASE WHEN {known} THEN {_mean_sql('h1', '100')} ELSE e1 END AS e1, CASE WHEN {known} THEN {_mean_sql('h2', '100')} ELSE e2 END AS e2, CASE WHEN {known} THEN up::DOUBLE / n ELSE share END AS share"
        done = "CASE WHEN e1 IS NULL THEN false ELSE greatest(a1, a2) > et * greatest(e1 * share, e2 * (1 - share)) END"
        after = f"CASE WHEN done THEN {_mean_sql('h1', '100')} ELSE e1 END AS e1, CASE WHEN done THEN {_mean_sql('h2', '100')} ELSE e2 END AS e2, CASE WHEN done THEN {shares} ELSE share END AS share"
    else:
        summed = f"a1 + sg AS a1, a2, up, {keep.format('h1', 'sg')} AS h1, h2"
        first = f"CASE WHEN e1 IS NULL AND len(h1) >= 30 THEN {_mean_sql('h1', '100')} ELSE e1 END AS e1, e2, share"
        done = "CASE WHEN e1 IS NULL THEN false ELSE abs(a1) > et * abs(e1) END"
        after = f"CASE WHEN done THEN {_mean_sql('h1', '100')} ELSE e1 END AS e1, e2, share"
    base = "symbol, tick_num, us, price, volume, side, sg"
    return _SIDE + f""", r AS (SELECT symbol, 0::BIGINT AS tick_num, 0::BIGINT AS us, 0.0::DOUBLE AS price, 0::BIGINT AS volume, 0 AS side, 0.0::DOUBLE AS sg, 0::BIGINT AS n, 0 AS bar, 30.0::DOUBLE AS et, []::DOUBLE[] AS sizes, []::DOUBLE[] AS shares, {start}, false AS done FROM x WHERE tick_num = 1
UNION ALL SELECT {base}, n, bar, {next_ticks}, sizes, shares, a1, a2, up, h1, h2, {after}, done FROM (
SELECT * REPLACE (CASE WHEN done THEN list_append(sizes, n::DOUBLE) ELSE sizes END AS sizes, CASE WHEN done THEN list_append(shares, up::DOUBLE / n) ELSE shares END AS shares) FROM (
SELECT *, {done} AS done FROM (
SELECT {base}, n, bar, et, sizes, shares, a1, a2, up, h1, h2, {first} FROM (
SELECT {base}, n + 1 AS n, bar, et, sizes, shares, {summed}, e1, e2, share FROM (
SELECT x.symbol, x.tick_num, x.us, x.price, x.volume, x.side, x.side * ({size}) AS sg, CASE WHEN r.done THEN 0 ELSE r.n END AS n, r.bar + CASE WHEN r.done THEN 1 ELSE 0 END AS bar, r.et, r.sizes, r.shares,
 CASE WHEN r.done THEN 0 ELSE r.a1 END AS a1, CASE WHEN r.done THEN 0 ELSE r.a2 END AS a2, CASE WHEN r.done THEN 0 ELSE r.up END AS up, r.h1, r.h2, r.e1, r.e2, r.share FROM r JOIN x ON x.symbol = r.symbol AND x.tick_num = r.tick_num + 1)))))),
y AS (SELECT * FROM r WHERE tick_num > 0) ||| SELECT symbol, max(us) AS date_time, max(tick_num) AS tick_num, {_ROW} FROM y GROUP BY symbol, bar HAVING bool_or(done)"""


for _kind in ("imbalance", "run"):
    for _name, _prev in (("ema", 3), ("const", None)):
        for _metric in ("tick", "volume", "dollar"):
            query(f"{_name}_{_metric}_{_kind}_bars", _expected_sql(_kind, _metric, _prev), "t", recursive=True)(_expected(_kind, _metric, _prev))


@query("find_bar_params", "|||SELECT symbol, round(count(*) / 50.0, 6)::DOUBLE AS tick_threshold, round(sum(volume) / 50.0, 6)::DOUBLE AS volume_threshold, round(sum(price * volume) / 50, 4) AS dollar_threshold FROM t GROUP BY ALL", "t")
def find_bar_params(spark, sf):
    return ops.bar_params(src.ticks(spark, sf), KEY, 50).select("symbol", *[F.round(c, n).alias(c) for c, n in (("tick_threshold", 6), ("volume_threshold", 6), ("dollar_threshold", 4))])
