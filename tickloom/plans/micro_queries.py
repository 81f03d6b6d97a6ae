"""Queries over microstructure features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import micro
from ..sources.testdata import bars, ticks
from .registry import normal_sql, query

W = 20


def _r(*cols: str, n: int = 8):
    return [F.round(c, n).alias(c) for c in cols]


_FRAME = "PARTITION BY symbol ORDER BY t ROWS BETWEEN 19 PRECEDING AND CURRENT ROW"


@query("roll_measure", f"""x AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY t) AS dp FROM b), y AS (SELECT *, lag(dp) OVER (PARTITION BY symbol ORDER BY t) AS dl FROM x),
z AS (SELECT symbol, t, dollars, CASE WHEN count(dl) OVER w >= 20 THEN 2 * sqrt(abs(covar_samp(dp, dl) OVER w)) END AS r FROM y WINDOW w AS ({_FRAME})) |||
SELECT symbol, t, round(r, 6) AS roll, round(CASE WHEN dollars <> 0 THEN r / dollars END, 8) AS roll_impact FROM z""", "tb")
def roll_measure(spark, sf):
    return micro.roll_measure(bars(spark, sf), ["symbol"], "t").select("symbol", "t", *_r("roll", n=6), *_r("roll_impact"))


@query("corwin_schultz", f"""x AS (SELECT *, pow(ln(high / low), 2) AS r FROM b),
y AS (SELECT *, CASE WHEN count(*) OVER v = 2 THEN sum(r) OVER v END AS p, CASE WHEN count(*) OVER v = 2 THEN pow(ln(max(high) OVER v / min(low) OVER v), 2) END AS g FROM x WINDOW v AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 1 PRECEDING AND CURRENT ROW)),
z AS (SELECT *, CASE WHEN count(p) OVER w >= 20 THEN avg(p) OVER w END AS beta FROM y WINDOW w AS ({_FRAME})),
a AS (SELECT symbol, t, CASE WHEN beta IS NOT NULL AND g IS NOT NULL THEN greatest((sqrt(2) - 1) * sqrt(beta) / (3 - 2 * sqrt(2)) - sqrt(g / (3 - 2 * sqrt(2))), 0) END AS al,
 CASE WHEN beta IS NOT NULL AND g IS NOT NULL THEN greatest((1 / sqrt(2) - 1) * sqrt(beta) / (sqrt(8 / pi()) * (3 - 2 * sqrt(2))) + sqrt(g / (8 / pi() * (3 - 2 * sqrt(2)))), 0) END AS s FROM z) |||
SELECT symbol, t, round(2 * (exp(al) - 1) / (1 + exp(al)), 8) AS spread, round(s, 8) AS bp_sigma FROM a""", "tb")
def corwin_schultz(spark, sf):
    return micro.corwin_schultz(bars(spark, sf), ["symbol"], "t").select("symbol", "t", *_r("spread", "bp_sigma"))


@query("bar_lambdas", f"""x AS (SELECT *, close - lag(close) OVER o AS dp, ln(close / lag(close) OVER o) AS r FROM b WINDOW o AS (PARTITION BY symbol ORDER BY t)),
y AS (SELECT *, last_value(nullif(sign(dp), 0) IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT *, dp / nullif(volume * s, 0) AS k, abs(r) / nullif(dollars, 0) AS a, r / nullif(s * sqrt(dollars), 0) AS h FROM y) |||
SELECT symbol, t, round(CASE WHEN count(k) OVER w >= 20 THEN avg(k) OVER w END, 8) AS kyle, round(CASE WHEN count(a) OVER w >= 20 THEN avg(a) OVER w END, 8) AS amihud,
 round(CASE WHEN count(h) OVER w >= 20 THEN avg(h) OVER w END, 8) AS hasbrouck FROM z WINDOW w AS ({_FRAME})""", "tb")
def bar_lambdas(spark, sf):
    return micro.bar_lambdas(bars(spark, sf), ["symbol"], "t").select("symbol", "t", *_r("kyle", "amihud", "hasbrouck"))


@query("trade_lambdas", """x AS (SELECT *, us // 86400000000 AS bar FROM t),
y AS (SELECT *, coalesce(price - lag(price) OVER o, 0) AS d, abs(coalesce(ln(price / lag(price) OVER o), 0)) AS r, nullif(sign(price - lag(price) OVER o), 0) AS g FROM x WINDOW o AS (PARTITION BY symbol, bar ORDER BY us, seq)),
z AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY symbol, bar ORDER BY us, seq ROWS UNBOUNDED PRECEDING), 0) AS s, price * volume AS m FROM y),
a AS (SELECT symbol, bar, count(*) AS n, sum(s * volume * d) AS kxy, sum(s * volume * s * volume) AS kxx, sum(d * d) AS kyy, sum(m * r) AS axy, sum(m * m) AS axx, sum(r * r) AS ayy, sum(s * sqrt(m) * r) AS hxy, sum(s * sqrt(m) * s * sqrt(m)) AS hxx FROM z GROUP BY ALL) |||
SELECT symbol, bar, n, round(kxy / nullif(kxx, 0), 6) AS kyle_lambda, round(kxy / nullif(kxx, 0) / nullif(sqrt(greatest(kyy - kxy / nullif(kxx, 0) * kxy, 0) / nullif(n - 1, 0) / nullif(kxx, 0)), 0), 4) AS kyle_t,
 round(axy / nullif(axx, 0), 8) AS amihud_lambda, round(axy / nullif(axx, 0) / nullif(sqrt(greatest(ayy - axy / nullif(axx, 0) * axy, 0) / nullif(n - 1, 0) / nullif(axx, 0)), 0), 4) AS amihud_t,
 round(hxy / nullif(hxx, 0), 8) AS hasbrouck_lambda, round(hxy / nullif(hxx, 0) / nullif(sqrt(greatest(ayy - hxy / nullif(hxx, 0) * hxy, 0) / nullif(n - 1, 0) / nullif(hxx, 0)), 0), 4) AS hasbrouck_t FROM a WHERE n >= 5""", "t")
def trade_lambdas(spark, sf):
    rows = micro.trade_lambdas(ticks(spark, sf).withColumn("bar", F.expr("us div 86400000000")), ["symbol"], ["us", "seq"], "bar").where("n >= 5")
    return rows.select("symbol", "bar", "n", *_r("kyle_lambda", n=6), *_r("kyle_t", "amihud_t", "hasbrouck_t", n=4), *_r("amihud_lambda", "hasbrouck_lambda"))


@query("range_volatility", f"""x AS (SELECT *, pow(ln(high / low), 2) AS h2, pow(ln(close / open), 2) AS c2, ln(open / lag(close) OVER o) AS lo, ln(close / lag(open) OVER o) AS lc,
 ln(high / close) * ln(high / open) + ln(low / close) * ln(low / open) AS rs FROM b WINDOW o AS (PARTITION BY symbol ORDER BY t)),
y AS (SELECT symbol, t, count(*) OVER w AS n, avg(h2 / (4 * ln(2))) OVER w AS p, avg(0.5::DOUBLE * h2 - (2 * ln(2) - 1) * c2) OVER w AS g,
 CASE WHEN count(lo) OVER w >= 20 THEN (sum(lo * lo) OVER w - pow(sum(lo) OVER w, 2) / 20) / 19 + 0.34::DOUBLE / (1.34::DOUBLE + 21.0::DOUBLE / 19) * (sum(lc * lc) OVER w - pow(sum(lc) OVER w, 2) / 20) / 19
  + (1 - 0.34::DOUBLE / (1.34::DOUBLE + 21.0::DOUBLE / 19)) * (sum(rs) OVER w) / 19 END AS yz FROM x WINDOW w AS ({_FRAME})) |||
SELECT symbol, t, CASE WHEN n >= 20 THEN round(sqrt(p), 8) END AS parkinson, CASE WHEN n >= 20 THEN round(sqrt(greatest(g, 0)), 8) END AS garman_klass, round(CASE WHEN yz IS NOT NULL THEN sqrt(greatest(yz, 0)) END, 5) AS yang_zhang FROM y""", "tb")
def range_volatility(spark, sf):
    rows = micro.range_volatility(bars(spark, sf), ["symbol"], "t")
    return rows.select("symbol", "t", *_r("parkinson", "garman_klass"), F.when(F.col("yang_zhang").isNotNull(), F.round("yang_zhang", 5)).alias("yang_zhang"))


@query("vpin", f"""x AS (SELECT *, nullif(sign(price - lag(price) OVER (PARTITION BY symbol ORDER BY us, seq)), 0) AS g FROM t),
y AS (SELECT *, last_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING) AS s FROM x),
z AS (SELECT symbol, ((us // 3600000000) + 1) * 3600 AS t, sum(volume) AS volume, coalesce(sum(CASE WHEN s = 1 THEN volume END), 0) AS buy FROM y GROUP BY ALL) |||
SELECT symbol, t, round(CASE WHEN count(*) OVER w >= 20 THEN avg(abs(2 * buy - volume)) OVER w / nullif(volume, 0) END, 8) AS vpin FROM z WINDOW w AS ({_FRAME})""", "t")
def vpin(spark, sf):
    from ..functions.windows import carried, ordered, tick_side

    over = ordered(["symbol"], ["us", "seq"])
    sided = ticks(spark, sf).withColumn("_g", tick_side(F.col("price"), over)).withColumn("side", carried(F.col("_g"), over))
    rows = sided.groupBy("symbol", ((F.floor(F.col("us") / 3600000000) + 1) * 3600).alias("t")).agg(F.sum("volume").alias("volume"), F.coalesce(F.sum(F.when(F.col("side") == 1, F.col("volume"))), F.lit(0)).alias("buy_volume"))
    return micro.vpin(rows, ["symbol"], "t").select("symbol", "t", *_r("vpin"))


@query("bvc_buy_volume", f"""x AS (SELECT *, close - lag(close) OVER (PARTITION BY symbol ORDER BY t) AS dp FROM b), y AS (SELECT symbol, t, volume, dp / nullif(CASE WHEN count(dp) OVER w >= 20 THEN stddev_samp(dp) OVER w END, 0) AS z FROM x WINDOW w AS ({_FRAME})) |||
SELECT symbol, t, round(volume * {normal_sql("z")}, 2) AS buy_volume FROM y""", "tb")
def bvc_buy_volume(spark, sf):
    return micro.bvc_buy_volume(bars(spark, sf), ["symbol"], "t").select("symbol", "t", *_r("buy_volume", n=2))
