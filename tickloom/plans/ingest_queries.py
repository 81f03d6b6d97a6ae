"""Queries over ingest and tick cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import testdata as src
from .registry import query

#: Irregular condition codes as SQL.
_CODES = ", ".join(map(str, ingest.IRREGULAR))


def _r(c: str, n: int = 6):
    return F.round(c, n).alias(c)


@query("daily_normalize", """x AS (SELECT l_returnflag AS symbol, l_orderkey AS id, l_quantity AS open, l_quantity + l_discount AS high, l_quantity - l_tax AS low, l_quantity - l_tax / 2 AS close, l_quantity + l_discount * 2 - l_tax AS vwap, l_linenumber AS volume FROM lineitem),
y AS (SELECT symbol, id, (open + high + low + close) / 4 AS midprice, CASE WHEN vwap BETWEEN low AND high THEN vwap ELSE (open + high + low + close) / 4 END AS vwap, volume FROM x) |||
SELECT symbol, id, round(midprice, 6) AS midprice, round(vwap, 6) AS vwap, round(vwap * volume, 6) AS dollar_total FROM y""")
def daily_normalize(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    rows = src.table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("symbol"), F.col("l_orderkey").alias("id"), q.alias("open"), (q + d).alias("high"), (q - t).alias("low"), (q - t / 2).alias("close"), (q + d * 2 - t).alias("vwap"), F.col("l_linenumber").alias("volume"))
    return ingest.normalize_daily(rows).select("symbol", "id", _r("midprice"), _r("vwap"), _r("dollar_total"))


@query("ticks_normalize", """|||SELECT event_type AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS size, event_id AS trade_id, epoch_us(ts) * 1000 AS sip_ns FROM events""")
def ticks_normalize(spark, sf):
    raw = src.ticks(spark, sf).select("symbol", F.col("price").alias("p"), F.col("volume").alias("s"), F.col("seq").alias("i"), (F.col("us") * 1000).alias("t"))
    return ingest.normalize_ticks(raw).select("symbol", "price", "size", "trade_id", "sip_ns")


@query("condition_flag", "|||SELECT seq, volume IN (" + _CODES + ") OR volume + 1 IN (" + _CODES + ") AS irregular FROM t", "t")
def condition_flag(spark, sf):
    return src.ticks(spark, sf).select("seq", ingest.irregular(F.array(F.col("volume").cast("int"), (F.col("volume") + 1).cast("int"))).alias("irregular"))


@query("condition_filter_alt", "|||SELECT seq FROM t WHERE volume NOT IN (" + _CODES + ") AND volume <> 12", "t")
def condition_filter_alt(spark, sf):
    codes = F.array(F.col("volume").cast("int"))
    return src.ticks(spark, sf).where(~ingest.irregular(codes) & ~ingest.irregular(codes, [ingest.AFTER_HOURS])).select("seq")


@query("validate_nonempty", "|||SELECT count(*) AS n FROM t", "t")
def validate_nonempty(spark, sf):
    return ingest.validate_nonempty(src.ticks(spark, sf)).agg(F.count(F.lit(1)).alias("n"))


@query("tick_df_fix", "|||SELECT seq FROM t WHERE strftime(make_timestamp(us) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York', '%H:%M:%S') BETWEEN '09:00:00' AND '16:00:00'", "t")
def tick_df_fix(spark, sf):
    return ingest.regular_hours(src.ticks(spark, sf).withColumn("at", F.expr("timestamp_ntz'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, us / 1000000.0)")), "at").select("seq")


@query("clean_trades", "|||SELECT DISTINCT symbol, us, price, volume FROM t WHERE volume > 0 AND volume NOT IN (" + _CODES + ") AND volume * 20000 < 1000000", "t")
def clean_trades(spark, sf):
    rows = src.ticks(spark, sf).withColumn("irregular", ingest.irregular(F.array(F.col("volume").cast("int")))).withColumn("delta", F.col("volume") * 20000)
    return ingest.clean_trades(rows, "price", "volume", "delta", ["symbol"], ["us", "price", "volume"]).select("symbol", "us", "price", "volume")


@query("trunc_timestamp", "|||SELECT seq, us AS epoch_us, us // 1000 AS epoch_ms, us // 10000 AS epoch_cs, us // 100000 AS epoch_ds, us // 1000000 AS epoch_s, us // 60000000 AS epoch_minute, us // 3600000000 AS epoch_hour FROM t", "t")
def trunc_timestamp(spark, sf):
    return src.ticks(spark, sf).select("seq", *[c.alias(n) for n, c in ingest.truncated_epochs(F.col("us")).items()])


@query("ts_groupby", "|||SELECT symbol, us // 3600000000 AS epoch_hour, count(price) AS price_count, round(avg(price), 6) AS price_mean, sum(volume)::BIGINT AS volume_sum FROM t GROUP BY ALL", "t")
def ts_groupby(spark, sf):
    rows = src.ticks(spark, sf).withColumns(ingest.truncated_epochs(F.col("us")))
    return ingest.by_epoch(rows, "epoch_hour", ["symbol"]).select("symbol", "epoch_hour", "price_count", _r("price_mean"), "volume_sum")


@query("add_range", "|||SELECT symbol, day, round(high - low, 6) AS range, round((high - low) / vwap, 6) AS range_value_pct FROM d", "d")
def add_range(spark, sf):
    return ingest.add_range(src.daily(spark, sf)).select("symbol", "day", _r("range"), _r("range_value_pct"))


@query("outlier_squeeze", "|||SELECT seq, round(greatest(least(price / 20, 4), -4) + tanh(price / 20 - greatest(least(price / 20, 4), -4)), 6) AS squeezed FROM t", "t")
def outlier_squeeze(spark, sf):
    return src.ticks(spark, sf).select("seq", F.round(ingest.squeeze(F.col("price") / 20), 6).alias("squeezed"))


@query("outlier_unsqueeze", "x AS (SELECT seq, greatest(least(price / 20, 4), -4) + tanh(price / 20 - greatest(least(price / 20, 4), -4)) / 2 AS y FROM t) ||| SELECT seq, round(greatest(least(y, 4), -4) + atanh(y - greatest(least(y, 4), -4)), 6) AS back FROM x", "t")
def outlier_unsqueeze(spark, sf):
    x = F.col("price") / 20
    clipped = F.greatest(F.least(x, F.lit(4.0)), F.lit(-4.0))
    return src.ticks(spark, sf).select("seq", F.round(ingest.unsqueeze(clipped + F.tanh(x - clipped) / 2), 6).alias("back"))


@query("add_bands", "|||SELECT symbol, t, round(close + 2 * (high - low), 6) AS close_upper, round(close - 2 * (high - low), 6) AS close_lower FROM b", "tb")
def add_bands(spark, sf):
    return ingest.bands(src.bars(spark, sf).withColumn("vol", F.col("high") - F.col("low")), "close", "vol").select("symbol", "t", _r("close_upper"), _r("close_lower"))


@query("compound_interest", "|||SELECT seq, round(price * pow(1 + volume / 100.0::DOUBLE / 100, 5), 6) AS final FROM t", "t")
def compound_interest(spark, sf):
    return src.ticks(spark, sf).select("seq", F.round(ingest.compound_interest(F.col("price"), F.col("volume") / 100.0, F.lit(5)), 6).alias("final"))


@query("vwap", "|||SELECT symbol, round(sum(price * volume) / sum(volume), 6) AS vwap, round(avg(volume), 6) AS avg_tick_size FROM t GROUP BY ALL", "t")
def vwap(spark, sf):
    return ingest.trade_means(src.ticks(spark, sf), ["symbol"]).select("symbol", _r("vwap"), _r("avg_tick_size"))


@query("avg_tick_size", "|||SELECT symbol, us // 86400000000 AS day, round(avg(volume), 6) AS avg_tick_size FROM t GROUP BY ALL", "t")
def avg_tick_size(spark, sf):
    return ingest.trade_means(src.ticks(spark, sf).withColumn("day", F.floor(F.col("us") / 86400000000)), ["symbol", "day"]).select("symbol", "day", _r("avg_tick_size"))


@query("mad_filter_batch", """x AS (SELECT *, CASE WHEN count(*) OVER w = 11 THEN quantile_cont(price, 0.5) OVER w END AS m FROM t WINDOW w AS (PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN 10 PRECEDING AND CURRENT ROW)),
y AS (SELECT *, abs(price - m) AS a FROM x),
z AS (SELECT *, CASE WHEN count(a) OVER w >= 11 THEN least(greatest(quantile_cont(a, 0.5) OVER w, 0.005), 0.05) END AS dev FROM y WINDOW w AS (PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN 332 PRECEDING AND CURRENT ROW)) |||
SELECT seq, round(m, 6) AS median, round(dev, 6) AS deviation, abs(price - m) > 22 * dev AS mad_outlier FROM z WHERE m IS NOT NULL AND dev IS NOT NULL""", "t")
def mad_filter_batch(spark, sf):
    return ingest.mad_filter(src.ticks(spark, sf), ["symbol"], ["us", "seq"]).select("seq", _r("median"), _r("deviation"), "mad_outlier")


_STATUS = """x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY us, seq) AS k, price - quantile_cont(price, 0.5) OVER (PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS dd FROM t),
y AS (SELECT *, least(greatest(quantile_cont(dd, 0.5) OVER (PARTITION BY symbol ORDER BY us, seq ROWS BETWEEN 332 PRECEDING AND CURRENT ROW), 0.005), 0.05) AS dm FROM x),
z AS (SELECT *, CASE WHEN k < 11 THEN 'mad_warmup' WHEN abs(dd) > 400 * dm THEN 'mad_outlier' ELSE 'mad_clean' END AS mad_status FROM y)"""


@query("mad_filter_stream", _STATUS + " ||| SELECT seq, mad_status FROM z", "t")
def mad_filter_stream(spark, sf):
    return ingest.mad_stream_status(src.ticks(spark, sf), ["symbol"], ["us", "seq"], k=400.0).select("seq", "mad_status")


_TICK = _STATUS + """, f AS (SELECT seq, us // 86400000000 AS date, CASE WHEN volume < 1 THEN 'zero_volume' WHEN volume IN (""" + _CODES + """) THEN 'irregular_condition' WHEN volume % 50 / 20.0 > 2 THEN 'ts_delta'
 WHEN mad_status <> 'mad_clean' THEN 'mad_outlier' WHEN us // 3600000000 % 24 < 9 THEN 'clean_pre_market' WHEN us // 3600000000 % 24 >= 16 THEN 'clean_after_hours' ELSE 'clean_open_market' END AS status FROM z)"""


def _status(spark, sf):
    rows = ingest.mad_stream_status(src.ticks(spark, sf), ["symbol"], ["us", "seq"], k=400.0)
    flag = ingest.irregular(F.array(F.col("volume").cast("int")))
    return ingest.tick_status(rows, F.floor(F.col("us") / 3600000000) % 24, F.col("volume") % 50 / 20.0, flag).withColumn("date", F.floor(F.col("us") / 86400000000))


@query("filter_tick", _TICK + " ||| SELECT seq, status FROM f", "t")
def filter_tick(spark, sf):
    return _status(spark, sf).select("seq", "status")


@query("tick_status_stats", _TICK + " ||| SELECT date, status, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY date), 6) AS share FROM f GROUP BY date, status", "t")
def tick_status_stats(spark, sf):
    return ingest.status_shares(_status(spark, sf)).select("date", "status", "n", _r("share"))


@query("rolling_decay_vwap", """x AS (SELECT seq, """ + ", ".join(f"lag(price * volume, {k}) OVER o * {8 - k} AS p{k}, lag(volume, {k}) OVER o * {8 - k} AS v{k}" for k in range(1, 8)) + """ FROM t WINDOW o AS (PARTITION BY symbol ORDER BY us, seq)) |||
SELECT seq, round((""" + "+".join(f"p{k}" for k in range(1, 8)) + ") / nullif(" + "+".join(f"v{k}" for k in range(1, 8)) + ", 0), 6) AS decay_vwap FROM x", "t")
def rolling_decay_vwap(spark, sf):
    return ingest.decay_vwap(src.ticks(spark, sf), ["symbol"], ["us", "seq"], decay="linear").select("seq", _r("decay_vwap"))


@query("rolling_std_feature", "|||SELECT symbol, t, round(stddev_samp(close) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) AS close_std FROM b", "tb")
def rolling_std_feature(spark, sf):
    from ..functions.windows import ordered

    return src.bars(spark, sf).select("symbol", "t", F.round(F.stddev_samp("close").over(ordered(["symbol"], ["t"]).rowsBetween(-9, 0)), 6).alias("close_std"))
