"""Queries over market filters, bet sizes and back-tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import backtest as bt
from ..operators import market as mk
from ..sources import testdata as src
from . import label_queries as lq
from .registry import normal_sql, query


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


def _q(name: str, keep: str, run):
    query(name, f"|||SELECT symbol, day, round(vwap, 6) AS vwap FROM d WHERE symbol IN ({keep})", "ds")(lambda spark, sf: run(spark, sf).select("symbol", "day", _r("vwap")))


_q("all_dates_filter", "SELECT symbol FROM d GROUP BY symbol QUALIFY count(vwap) = max(count(vwap)) OVER ()", lambda s, f: mk.all_dates(src.daily(s, f)))
_q("liquidity_filter", "SELECT symbol FROM d GROUP BY symbol HAVING avg(dollar_total) > 56000", lambda s, f: mk.liquidity(src.daily(s, f), 56000))
_q("range_value_filter", "SELECT symbol FROM d GROUP BY symbol HAVING quantile_cont((high - low) / vwap, 0.5) BETWEEN 0.0 AND 0.5", lambda s, f: mk.range_value(src.daily(s, f), 0.0, 0.5))
_q("min_value_filter", "SELECT symbol FROM d GROUP BY symbol HAVING quantile_cont(vwap, 0.5) > 1800", lambda s, f: mk.min_value(src.daily(s, f), 1800))
_q("symbol_details_filter", "SELECT symbol FROM s WHERE sector <> '' AND upper(sector) = 'ASIA'", lambda s, f: mk.with_details(src.daily(s, f), src.symbol_details(s, f), (F.col("sector") != "") & (F.upper("sector") == "ASIA")))
_q("filter_market", "SELECT symbol FROM d GROUP BY symbol HAVING avg(dollar_total) > 50000 AND quantile_cont((high - low) / vwap, 0.5) BETWEEN 0 AND 0.9 AND quantile_cont(vwap, 0.5) > 1 INTERSECT SELECT symbol FROM s WHERE sector <> ''",
   lambda s, f: mk.with_details(mk.min_value(mk.range_value(mk.liquidity(src.daily(s, f), 50000), 0.0, 0.9), 1.0), src.symbol_details(s, f), F.col("sector") != ""))


@query("merge_symbol_stats", "m AS (SELECT symbol, quantile_cont(vwap, 0.5) AS v, quantile_cont(volume, 0.5) AS q, count(*) AS days FROM d GROUP BY ALL) ||| SELECT s.symbol, name, industry, sector, round(v, 6) AS vwap_median, round(q, 6) AS volume_median, days FROM m RIGHT JOIN s USING (symbol)", "ds")
def merge_symbol_stats(spark, sf):
    return mk.median_stats(src.daily(spark, sf), src.symbol_details(spark, sf), ["vwap", "volume"]).select("symbol", "name", "industry", "sector", _r("vwap_median"), _r("volume_median"), "days")


@query("scan_feather_details", "|||SELECT symbol, name, industry, sector FROM s", "s")
def scan_feather_details(spark, sf):
    return src.symbol_details(spark, sf)


_TR = """x AS (SELECT symbol, t, ln(close) - ln(lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS x FROM b), y AS (SELECT *, count(*) OVER (PARTITION BY t) AS k FROM x WHERE x IS NOT NULL),
z AS (SELECT *, (x - avg(x) OVER w) / stddev_pop(x) OVER w AS z FROM y WHERE k = (SELECT count(DISTINCT symbol) FROM b) WINDOW w AS (PARTITION BY symbol))"""


@query("transform_prices", _TR + " ||| SELECT symbol, t, round(z, 5) AS z, round(greatest(least(z, 4), -4) + tanh(z - greatest(least(z, 4), -4)), 5) AS squeezed FROM z", "tb")
def transform_prices(spark, sf):
    return mk.transformed(src.bars(spark, sf), "t", "close").select("symbol", "t", _r("z", 5), _r("squeezed", 5))


_BETA = """r AS (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM b), m AS (SELECT t, avg(r) AS market FROM r WHERE r IS NOT NULL GROUP BY t),
j AS (SELECT r.symbol, r.t, r, market FROM r JOIN m USING (t) WHERE r IS NOT NULL),
c AS (SELECT symbol, regr_slope(r, market) AS beta, avg(r) AS my, avg(market) AS mx FROM j GROUP BY symbol)"""


def _beta(spark, sf):
    rets = lq._returns(spark, sf)
    return mk.beta_residuals(rets, rets.groupBy("t").agg(F.avg("ret").alias("market")), "t", "ret")


@query("beta_residuals", _BETA + " ||| SELECT symbol, t, round(beta, 5) AS beta, round(r - (my + beta * (market - mx)), 4) AS residual FROM j JOIN c USING (symbol)", "tb")
def beta_residuals(spark, sf):
    return _beta(spark, sf).select("symbol", "t", _r("beta", 5), _r("residual", 4))


@query("prepare_data", _BETA + ", q AS (SELECT symbol, t, r - (my + beta * (market - mx)) AS e FROM j JOIN c USING (symbol)), z AS (SELECT symbol, t, (e - avg(e) OVER w) / stddev_pop(e) OVER w AS z FROM q WINDOW w AS (PARTITION BY symbol)) ||| SELECT symbol, t, round(greatest(least(z, 4), -4) + tanh(z - greatest(least(z, 4), -4)), 4) AS squeezed FROM z", "tb")
def prepare_data(spark, sf):
    from pyspark.sql import Window

    from ..operators.ingest import squeeze

    per = Window.partitionBy("symbol")
    rows = _beta(spark, sf).withColumn("z", (F.col("residual") - F.avg("residual").over(per)) / F.stddev_pop("residual").over(per))
    return rows.select("symbol", "t", F.round(squeeze(F.col("z")), 4).alias("squeezed"))


@query("open_market_dates", "|||SELECT day FROM range(19000, 19366) r(day) WHERE (day + 3) % 7 < 5 AND day % 50 <> 0")
def open_market_dates(spark, sf):
    return mk.session_days(19000, 19365, spark.range(19000, 19366, 50).select(F.col("id").alias("day")), spark)


@query("remaining_dates", "|||SELECT day FROM range(8000, 11000) r(day) WHERE (day + 3) % 7 < 5 AND day <= 10500 AND day NOT IN (SELECT day FROM d)", "d")
def remaining_dates(spark, sf):
    return mk.remaining_days(mk.session_days(8000, 10999, None, spark), src.daily(spark, sf), 10500)


@query("gap_fill", """n AS (SELECT *, t // 86400 AS day, row_number() OVER (PARTITION BY symbol, t // 86400 ORDER BY t) AS k FROM b),
e AS (SELECT symbol, day, max(t) AS tl, arg_max(close, t) AS pl, min(CASE WHEN k = 2 THEN t END) AS t2, min(CASE WHEN k = 2 THEN close END) AS p2 FROM n GROUP BY ALL),
g AS (SELECT *, lead(t2) OVER (PARTITION BY symbol ORDER BY day) AS t1, lead(p2) OVER (PARTITION BY symbol ORDER BY day) AS p1 FROM e),
h AS (SELECT *, round_even(abs(p1 - pl) / 5, 0)::INT AS n FROM g WHERE t1 IS NOT NULL AND p1 IS NOT NULL), i AS (SELECT *, unnest(range(0, n + 2)) AS i FROM h WHERE n > 0) |||
SELECT symbol, day, i::INT AS i, round(tl + 3600 + (t1 - tl - 7200) * i / (n + 1)::DOUBLE, 4) AS t, round(CASE WHEN i >= n THEN p1 ELSE pl + (p1 - pl) * i / n END, 6) AS close FROM i""", "tb")
def gap_fill(spark, sf):
    return mk.gap_fill(src.bars(spark, sf), 10.0).select("symbol", "day", "i", _r("t", 4), _r("close"))


@query("stacked_stats", "x AS (SELECT symbol, us // 86400000000 AS day, us // 3600000000 AS hour, max(price) AS high, min(price) AS low, min(us) AS open_at, max(us) AS close_at FROM t GROUP BY ALL) ||| SELECT symbol, day, count(*) AS n, round(quantile_cont((close_at - open_at) / 60000000.0::DOUBLE, 0.5), 5) AS minutes_median, round(avg(high - low), 5) AS range_mean, min(open_at) AS open_at, max(close_at) AS close_at FROM x GROUP BY ALL", "t")
def stacked_stats(spark, sf):
    rows = src.ticks(spark, sf).groupBy("symbol", F.floor(F.col("us") / 86400000000).alias("day"), F.floor(F.col("us") / 3600000000).alias("hour")).agg(F.max("price").alias("high"), F.min("price").alias("low"), F.min("us").alias("open_at"), F.max("us").alias("close_at"))
    return mk.stacked_stats(rows.withColumn("minutes", (F.col("close_at") - F.col("open_at")) / 60000000.0)).select("symbol", "day", "n", _r("minutes_median", 5), _r("range_mean", 5), "open_at", "close_at")


_SIG = lq._EV + "," + lq._VB


@query("avg_active_signals", _SIG + ", k AS (SELECT symbol, t0 AS t FROM w UNION SELECT symbol, t1 FROM w) ||| SELECT k.symbol, k.t, round(coalesce(avg(trgt), 0), 6) AS signal FROM k LEFT JOIN w ON w.symbol = k.symbol AND w.t0 <= k.t AND k.t < w.t1 GROUP BY ALL", "tb")
def avg_active_signals(spark, sf):
    return bt.average_active(lq._spans(spark, sf).withColumn("signal", F.col("trgt")), ["symbol"]).withColumn("signal", F.round("signal", 6))


@query("discrete_signal", "|||SELECT seq, greatest(least(round_even((price - 50) / 25 / 0.25, 0) * 0.25, 1), -1)::DOUBLE AS signal FROM t", "t")
def discrete_signal(spark, sf):
    return src.ticks(spark, sf).select("seq", bt.discrete_signal((F.col("price") - 50) / 25, 0.25).alias("signal"))


@query("bet_size_probability", f"x AS (SELECT seq, (volume + 0.5::DOUBLE) / 100 AS p FROM t), y AS (SELECT *, (p - 0.5) / sqrt(p * (1 - p)) AS z FROM x) ||| SELECT seq, round((CASE WHEN seq % 2 = 0 THEN 1 ELSE -1 END) * (2 * {normal_sql('z')} - 1), 5) + 0 AS bet_size FROM y", "t")
def bet_size_probability(spark, sf):
    p = (F.col("volume") + 0.5) / 100
    return src.ticks(spark, sf).select("seq", (F.round(bt.bet_size_probability(p, F.when(F.col("seq") % 2 == 0, 1).otherwise(-1)), 5) + 0.0).alias("bet_size"))


@query("bet_size_budget", _SIG + ", c AS (SELECT DISTINCT a.symbol, a.t0 AS t, (SELECT count(*) FROM w x WHERE x.symbol = a.symbol AND x.side > 0 AND x.t0 <= a.t0 AND x.t1 > a.t0) AS longs, (SELECT count(*) FROM w x WHERE x.symbol = a.symbol AND x.side < 0 AND x.t0 <= a.t0 AND x.t1 > a.t0) AS shorts FROM w a) ||| SELECT symbol, t, longs, shorts, round(coalesce(longs::DOUBLE / nullif(max(longs) OVER (PARTITION BY symbol), 0), 0) - coalesce(shorts::DOUBLE / nullif(max(shorts) OVER (PARTITION BY symbol), 0), 0), 6) AS bet_size FROM c", "tb")
def bet_size_budget(spark, sf):
    return bt.bet_size_budget(lq._spans(spark, sf), ["symbol"]).select("symbol", "t", "longs", "shorts", _r("bet_size"))


@query("bet_size_dynamic", "x AS (SELECT seq, price, price + (volume - 50) / 10.0::DOUBLE AS f, volume % 7 - 3 AS pos FROM t), y AS (SELECT *, (f - price) / sqrt(5 + (f - price) * (f - price)) AS m FROM x), z AS (SELECT *, trunc(m * 20)::BIGINT AS target FROM y) ||| SELECT seq, round(m, 6) AS bet_size, target, round((SELECT avg(f - (j / 20.0::DOUBLE) * sqrt(5 / (1 - (j / 20.0::DOUBLE) * (j / 20.0::DOUBLE)))) FROM range(least(pos + 1, target)::BIGINT, (greatest(pos - 1, target) + 1)::BIGINT) r(j) WHERE (CASE WHEN target > pos THEN j > pos AND j <= target WHEN target < pos THEN j < pos AND j >= target ELSE false END) AND abs(j) < 20), 5) AS limit_price FROM z", "t")
def bet_size_dynamic(spark, sf):
    rows = src.ticks(spark, sf).withColumns({"forecast": F.col("price") + (F.col("volume") - 50) / 10.0, "position": F.col("volume") % 7 - 3})
    return bt.dynamic_position(rows, 5.0, 20).select("seq", _r("bet_size"), "target", _r("limit_price", 5))


_POS = "x AS (SELECT symbol, us, seq, volume % 5 - 2 AS pos FROM t), y AS (SELECT *, lag(pos) OVER o AS p, lead(us) OVER o AS nx FROM x WINDOW o AS (PARTITION BY symbol ORDER BY us))"


@query("flattening_flips", _POS + " ||| SELECT seq FROM y WHERE (pos = 0 AND p <> 0) OR pos * p < 0 OR nx IS NULL", "t")
def flattening_flips(spark, sf):
    return bt.flattening_flips(src.ticks(spark, sf).withColumn("pos", F.col("volume") % 5 - 2), ["symbol"], "us", "pos").select("seq")


@query("hhi", "x AS (SELECT symbol, t // 86400 AS day, close - open AS r FROM b) ||| SELECT symbol, day, round(CASE WHEN count(*) > 2 THEN (sum(r * r) / pow(sum(r), 2) - 1.0::DOUBLE / count(*)) / (1 - 1.0::DOUBLE / count(*)) END, 4) AS hhi FROM x WHERE r > 0 GROUP BY ALL", "tb")
def hhi(spark, sf):
    rows = src.bars(spark, sf).select("symbol", F.floor(F.col("t") / 86400).alias("day"), (F.col("close") - F.col("open")).alias("r")).where("r > 0")
    return bt.hhi(rows, ["symbol", "day"], "r").select("symbol", "day", _r("hhi", 4))


@query("drawdown_tuw", "x AS (SELECT symbol, t, close, max(close) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS h FROM b), m AS (SELECT symbol, h, min(close) AS low, min(t) AS start FROM x GROUP BY ALL), n AS (SELECT *, lead(start) OVER (PARTITION BY symbol ORDER BY start) AS nx FROM m) ||| SELECT symbol, start, round(1 - low / h, 6) AS drawdown, nx - start AS under_water FROM n WHERE h > low", "tb")
def drawdown_tuw(spark, sf):
    return bt.drawdowns(src.bars(spark, sf), ["symbol"], "t", "close").select("symbol", "start", _r("drawdown"), "under_water")


@query("sharpe_ir", lq._RET + " ||| SELECT symbol, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS sharpe FROM y GROUP BY ALL", "tb")
def sharpe_ir(spark, sf):
    return bt.sharpe(lq._returns(spark, sf), ["symbol"], "ret").select("symbol", _r("sharpe", 5))


@query("psr_dsr", lq._RET + f""", m AS (SELECT symbol, avg(r) / stddev_samp(r) AS sr, count(r) AS n, avg(r) AS mu, stddev_pop(r) AS sd FROM y GROUP BY ALL), k AS (SELECT y.symbol, avg(pow((r - mu) / sd, 3)) AS skew, avg(pow((r - mu) / sd, 4)) AS kurt FROM y JOIN m USING (symbol) GROUP BY ALL),
j AS (SELECT m.symbol, sr, (sr - 0.1) * sqrt(n - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS z, 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * pow(1.6448536::DOUBLE / sr, 2) AS least FROM m JOIN k USING (symbol)) ||| SELECT symbol, round({normal_sql('z')}, 5) AS psr, round(least, 3) AS min_length FROM j""", "tb")
def psr_dsr(spark, sf):
    stats = lq._returns(spark, sf).groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret")).alias("sr"), F.count("ret").alias("n"), F.skewness("ret").alias("skew"), (F.kurtosis("ret") + 3).alias("kurt"))
    return stats.select("symbol", F.round(bt.probabilistic_sharpe(F.col("sr"), F.lit(0.1), F.col("n"), F.col("skew"), F.col("kurt")), 5).alias("psr"), F.round(bt.minimum_track_record(F.col("sr"), F.lit(0.0), F.col("skew"), F.col("kurt"), 1.6448536), 3).alias("min_length"))


@query("train_times", _SIG + ", k AS (SELECT symbol, t0, t1 FROM w WHERE t0 // 86400 % 5 = 0) ||| SELECT symbol, t0, t1 FROM w WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.symbol = w.symbol AND w.t0 <= k.t1 AND w.t1 >= k.t0)", "tb")
def train_times(spark, sf):
    spans = lq._spans(spark, sf).select("symbol", "t0", "t1")
    return bt.train_times(spans, spans.where(F.floor(F.col("t0") / 86400) % 5 == 0), ["symbol"], 86400)


@query("purged_kfold", _SIG + """, r AS (SELECT symbol, t0, t1, row_number() OVER (PARTITION BY symbol ORDER BY t0) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM w),
f AS (SELECT *, (CASE WHEN k < (n % 4) * (n // 4 + 1) THEN k // (n // 4 + 1) ELSE n % 4 + (k - (n % 4) * (n // 4 + 1)) // (n // 4) END)::INT AS fold FROM r),
g AS (SELECT symbol, fold, arg_min(t1, k) AS s0, max(t1) AS s1, max(k) + floor(max(n) * 0.02)::BIGINT AS upto FROM f GROUP BY ALL),
h AS (SELECT g.symbol, g.fold, s0, greatest(s1, coalesce(f.t1, s1)) AS s1 FROM g LEFT JOIN f ON f.symbol = g.symbol AND f.k = g.upto) |||
SELECT symbol, fold, 'test' AS role, t0 FROM f UNION ALL SELECT f.symbol, h.fold, 'train', t0 FROM f JOIN h ON h.symbol = f.symbol AND h.fold <> f.fold AND NOT (t0 <= s1 AND t1 >= s0)""", "tb")
def purged_kfold(spark, sf):
    return bt.purged_folds(lq._spans(spark, sf).select("symbol", "t0", "t1"), ["symbol"], 4, 0.02)


@query("combinatorial_cv", "|||SELECT i || ',' || j AS folds FROM range(6) a(i), range(6) b(j) WHERE i < j")
def combinatorial_cv(spark, sf):
    return bt.combinations(spark, 6, 2).select(F.array_join("folds", ",").alias("folds"))
