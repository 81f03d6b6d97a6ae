"""Queries over labels and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import labels as ops
from ..sources import testdata as src
from .registry import query

KEY = ["symbol"]
CELL = 86400


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


#: Every bar is an event; their target grows with the hour, sides alternate by day.
_EV = "e AS (SELECT symbol, t AS t0, 0.5 + (t // 3600 % 10) / 20.0::DOUBLE AS trgt, CASE WHEN t // 86400 % 2 = 0 THEN 1 ELSE -1 END AS side FROM b)"
_VB = "v AS (SELECT e.*, (SELECT min(b.t) FROM b WHERE b.symbol = e.symbol AND b.t >= e.t0 + 21600) AS t1 FROM e), w AS (SELECT * FROM v WHERE t1 IS NOT NULL)"


def _events(spark, sf):
    hour = F.floor(F.col("t") / 3600)
    return src.bars(spark, sf).select("symbol", F.col("t").alias("t0"), (0.5 + (hour % 10) / 20.0).alias("trgt"), F.when(F.floor(F.col("t") / 86400) % 2 == 0, 1).otherwise(-1).alias("side"))


def _spans(spark, sf):
    return ops.vertical_barrier(_events(spark, sf), src.bars(spark, sf), KEY, 21600)


@query("cusum_filter", """n AS (SELECT symbol, t, close, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM b),
r AS (SELECT symbol, t, k, close, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, 0 AS side FROM n WHERE k = 1
UNION ALL SELECT symbol, t, k, close, CASE WHEN NOT d < -2 AND u > 2 THEN 0 ELSE u END, CASE WHEN d < -2 THEN 0 ELSE d END, CASE WHEN d < -2 THEN -1 WHEN u > 2 THEN 1 ELSE 0 END
FROM (SELECT n.symbol, n.t, n.k, n.close, greatest(0, r.up + ln(n.close / r.close)) AS u, least(0, r.down + ln(n.close / r.close)) AS d FROM r JOIN n ON n.symbol = r.symbol AND n.k = r.k + 1)) |||
SELECT symbol, t, side FROM r WHERE side <> 0""", "tb", recursive=True)
def cusum_filter(spark, sf):
    return ops.cusum_filter(src.bars(spark, sf), KEY, "t", "close", 2.0)


@query("z_score_filter", """x AS (SELECT symbol, t, close, CASE WHEN count(*) OVER w = 20 THEN avg(close) OVER w + stddev_samp(close) OVER w END AS l FROM b WINDOW w AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)) ||| SELECT symbol, t FROM x WHERE close >= l""", "tb")
def z_score_filter(spark, sf):
    return ops.z_score_filter(src.bars(spark, sf), KEY, "t", "close", 20, 20, 1.0).select("symbol", "t")


@query("vertical_barrier", _EV + "," + _VB + " ||| SELECT symbol, t0, t1 FROM w", "tb")
def vertical_barrier(spark, sf):
    return _spans(spark, sf).select("symbol", "t0", "t1")


_PATH = _EV + "," + _VB + """, p AS (SELECT w.symbol, w.t0, w.t1, w.trgt, w.side, b.t, (b.close / b0.close - 1) * w.side AS r FROM w JOIN b b0 ON b0.symbol = w.symbol AND b0.t = w.t0 JOIN b ON b.symbol = w.symbol AND b.t BETWEEN w.t0 AND w.t1),
h AS (SELECT symbol, t0, t1, trgt, side, min(CASE WHEN r > trgt THEN t END) AS pt, min(CASE WHEN r < -trgt THEN t END) AS sl FROM p GROUP BY ALL)"""


@query("apply_pt_sl", _PATH + " ||| SELECT symbol, t0, pt, sl FROM h", "tb")
def apply_pt_sl(spark, sf):
    return ops.apply_barriers(_spans(spark, sf), src.bars(spark, sf), KEY, 1.0, 1.0, CELL).select("symbol", "t0", "pt", "sl")


@query("get_events", _PATH + " ||| SELECT symbol, t0, least(t1, pt, sl) AS t1, round(trgt, 6) AS trgt FROM h WHERE trgt > 0.6", "tb")
def get_events(spark, sf):
    return ops.get_events(_spans(spark, sf), src.bars(spark, sf), KEY, 1.0, 1.0, 0.6, CELL).select("symbol", "t0", "t1", _r("trgt"))


_BINS = _PATH + """, q AS (SELECT symbol, t0, least(t1, pt, sl) AS t1, trgt, side FROM h WHERE trgt > 0.6),
z AS (SELECT q.*, ln(b1.close / b0.close) * side AS l FROM q JOIN b b0 ON b0.symbol = q.symbol AND b0.t = q.t0 JOIN b b1 ON b1.symbol = q.symbol AND b1.t = q.t1),
y AS (SELECT symbol, t0, round(exp(l) - 1, 6) AS ret, CASE WHEN l > ln(1 + trgt) THEN 1 WHEN l < -ln(1 + trgt) THEN -1 ELSE 0 END AS bin, l FROM z)"""


def _bins(spark, sf, meta=False):
    events = ops.get_events(_spans(spark, sf), src.bars(spark, sf), KEY, 1.0, 1.0, 0.6, CELL)
    return ops.get_bins(events, src.bars(spark, sf), KEY, meta)


@query("get_bins", _BINS + " ||| SELECT symbol, t0, ret, bin FROM y", "tb")
def get_bins(spark, sf):
    return _bins(spark, sf).select("symbol", "t0", _r("ret"), "bin")


@query("barrier_touched", _BINS + " ||| SELECT symbol, t0, CASE WHEN l <= 0 THEN 0 ELSE bin END AS bin FROM y", "tb")
def barrier_touched(spark, sf):
    return _bins(spark, sf, True).select("symbol", "t0", "bin")


@query("drop_labels", _BINS + ", c AS (SELECT bin, count(*) / sum(count(*)) OVER () AS share, row_number() OVER (ORDER BY count(*), bin) AS k, count(*) OVER () AS classes FROM y GROUP BY bin) ||| SELECT symbol, t0, bin FROM y WHERE bin NOT IN (SELECT bin FROM c WHERE k = 1 AND share <= 0.3 AND classes > 2)", "tb")
def drop_labels(spark, sf):
    return ops.drop_labels(_bins(spark, sf), 0.3).select("symbol", "t0", "bin")


@query("raw_return", "|||SELECT symbol, t, round(ln(lead(close) OVER (PARTITION BY symbol ORDER BY t) / close), 6) AS ret FROM b", "tb")
def raw_return(spark, sf):
    return ops.raw_return(src.bars(spark, sf), KEY, "t", "close", log=True).select("symbol", "t", _r("ret"))


@query("fixed_time_horizon", "x AS (SELECT symbol, t, lead(close) OVER (PARTITION BY symbol ORDER BY t) / close - 1 AS r FROM b) ||| SELECT symbol, t, CASE WHEN r > 0.5 THEN 1 WHEN r < -0.5 THEN -1 WHEN r IS NOT NULL THEN 0 END AS label FROM x", "tb")
def fixed_time_horizon(spark, sf):
    return ops.fixed_time_horizon(src.bars(spark, sf), KEY, "t", "close", 0.5).select("symbol", "t", "label")


_RET = "x AS (SELECT symbol, t, close / lag(close) OVER (PARTITION BY symbol ORDER BY t) - 1 AS r FROM b), y AS (SELECT * FROM x WHERE r IS NOT NULL)"


def _returns(spark, sf):
    return ops.raw_return(src.bars(spark, sf), KEY, "t", "close", lag=False).where("ret IS NOT NULL").select("symbol", "t", "ret")


@query("excess_over_mean", _RET + " ||| SELECT symbol, t, round(r - avg(r) OVER (PARTITION BY t), 5) AS excess FROM y", "tb")
def excess_over_mean(spark, sf):
    return ops.excess_return(_returns(spark, sf), "t").select("symbol", "t", _r("excess", 5))


@query("excess_over_median", _RET + " ||| SELECT symbol, t, round(r - quantile_cont(r, 0.5) OVER (PARTITION BY t), 5) AS excess FROM y", "tb")
def excess_over_median(spark, sf):
    return ops.excess_return(_returns(spark, sf), "t", "median").select("symbol", "t", _r("excess", 5))


@query("return_over_benchmark", _RET + ", m AS (SELECT t, avg(r) AS m FROM y WHERE symbol = (SELECT min(symbol) FROM y) GROUP BY t) ||| SELECT symbol, t, round(r - m, 5) AS excess FROM y JOIN m USING (t)", "tb")
def return_over_benchmark(spark, sf):
    rets = _returns(spark, sf)
    first = rets.agg(F.min("symbol")).first()[0]
    return rets.join(rets.where(F.col("symbol") == first).groupBy("t").agg(F.avg("ret").alias("m")), "t").select("symbol", "t", F.round(F.col("ret") - F.col("m"), 5).alias("excess"))


@query("tail_sets", _RET + ", z AS (SELECT *, greatest(1, ceil((row_number() OVER (PARTITION BY t ORDER BY r, symbol) - 1) * 3 / greatest(count(*) OVER (PARTITION BY t) - 1, 1)::DOUBLE)) AS q FROM y) ||| SELECT symbol, t, CASE WHEN q = 3 THEN 1 WHEN q = 1 THEN -1 ELSE 0 END AS label FROM z", "tb")
def tail_sets(spark, sf):
    return ops.tail_sets(_returns(spark, sf), "t", "symbol", 3).select("symbol", "t", "label")


@query("trend_scanning", """n AS (SELECT symbol, t, close AS y, (row_number() OVER (PARTITION BY symbol ORDER BY t) - 1)::DOUBLE AS x FROM b),
l AS (SELECT n.symbol, n.t, k, max(m.t) AS t1, regr_slope(m.y, m.x) AS s, regr_syy(m.y, m.x) AS yy, regr_sxx(m.y, m.x) AS xx, regr_sxy(m.y, m.x) AS xy FROM n, range(5, 9) r(k) JOIN n m ON m.symbol = n.symbol AND m.x BETWEEN n.x AND n.x + k - 1 GROUP BY n.symbol, n.t, k HAVING count(*) = k),
v AS (SELECT symbol, t, t1, k, s / sqrt(greatest(yy - s * xy, 0) / (k - 2) / xx) AS tv FROM l) |||
SELECT symbol, t, arg_max(t1, abs(tv)) AS t1, round(arg_max(tv, abs(tv)), 4) AS t_value, sign(arg_max(tv, abs(tv)))::DOUBLE AS bin FROM v GROUP BY symbol, t""", "tb")
def trend_scanning(spark, sf):
    return ops.trend_scanning(src.bars(spark, sf), KEY, "t", "close", 5, 8).select("symbol", "t", "t1", _r("t_value", 4), "bin")


_CON = _EV + "," + _VB + ", c AS (SELECT b.symbol, b.t, b.close, (SELECT count(*) FROM w WHERE w.symbol = b.symbol AND b.t BETWEEN w.t0 AND w.t1) AS concurrency FROM b)"


@query("concurrent_events", _CON + " ||| SELECT symbol, t, concurrency FROM c", "tb")
def concurrent_events(spark, sf):
    return ops.concurrent_events(src.bars(spark, sf), _spans(spark, sf), KEY)


@query("avg_uniqueness", _CON + " ||| SELECT w.symbol, t0, round(avg(1.0::DOUBLE / concurrency), 6) AS uniqueness FROM w JOIN c ON c.symbol = w.symbol AND c.t BETWEEN t0 AND t1 GROUP BY ALL", "tb")
def avg_uniqueness(spark, sf):
    return ops.average_uniqueness(src.bars(spark, sf), _spans(spark, sf), KEY, CELL).withColumn("uniqueness", F.round("uniqueness", 6))


@query("concurrent_stats", _CON + ", u AS (SELECT w.symbol, t0, avg(1.0::DOUBLE / concurrency) AS u FROM w JOIN c ON c.symbol = w.symbol AND c.t BETWEEN t0 AND t1 GROUP BY ALL) ||| SELECT symbol, count(*) AS n, round(avg(u), 6) AS mean_uniqueness FROM u GROUP BY ALL", "tb")
def concurrent_stats(spark, sf):
    return ops.average_uniqueness(src.bars(spark, sf), _spans(spark, sf), KEY, CELL).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("uniqueness"), 6).alias("mean_uniqueness"))


@query("ind_matrix", _CON + " ||| SELECT c.symbol, c.t, t0 FROM w JOIN c ON c.symbol = w.symbol AND c.t BETWEEN t0 AND t1", "tb")
def ind_matrix(spark, sf):
    return ops.span_bars(src.bars(spark, sf), _spans(spark, sf), KEY, CELL).select("symbol", "t", "t0")


@query("ind_avg_uniqueness", _CON + " ||| SELECT c.symbol, round(avg(1.0::DOUBLE / concurrency), 6) AS uniqueness FROM w JOIN c ON c.symbol = w.symbol AND c.t BETWEEN t0 AND t1 GROUP BY ALL", "tb")
def ind_avg_uniqueness(spark, sf):
    bars, spans = src.bars(spark, sf), _spans(spark, sf)
    return ops.span_bars(ops.concurrent_events(bars, spans, KEY), spans, KEY, CELL).groupBy("symbol").agg(F.round(F.avg(1.0 / F.col("concurrency")), 6).alias("uniqueness"))


@query("weights_by_return", _CON + ", g AS (SELECT *, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM c), a AS (SELECT w.symbol, t0, abs(sum(r / nullif(concurrency, 0))) AS a FROM w JOIN g ON g.symbol = w.symbol AND g.t BETWEEN t0 AND t1 GROUP BY ALL) ||| SELECT symbol, t0, round(a * count(*) OVER (PARTITION BY symbol) / sum(a) OVER (PARTITION BY symbol), 5) AS weight FROM a", "tb")
def weights_by_return(spark, sf):
    return ops.weights_by_return(src.bars(spark, sf), _spans(spark, sf), KEY, CELL).select("symbol", "t0", _r("weight", 5))


@query("weights_by_decay", _CON + ", u AS (SELECT w.symbol, t0, avg(1.0::DOUBLE / concurrency) AS u FROM w JOIN c ON c.symbol = w.symbol AND c.t BETWEEN t0 AND t1 GROUP BY ALL) ||| SELECT symbol, t0, round(greatest(0, 1 - 0.5::DOUBLE + 0.5::DOUBLE / sum(u) OVER (PARTITION BY symbol) * sum(u) OVER (PARTITION BY symbol ORDER BY t0 ROWS UNBOUNDED PRECEDING)), 5) AS weight FROM u", "tb")
def weights_by_decay(spark, sf):
    return ops.weights_by_decay(ops.average_uniqueness(src.bars(spark, sf), _spans(spark, sf), KEY, CELL), KEY, 0.5).select("symbol", "t0", _r("weight", 5))
