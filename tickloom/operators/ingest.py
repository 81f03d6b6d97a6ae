"""Ingest normalisation and scalar filters: Catalyst expressions, and a fold for rolling medians."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import Kernel, ordered_fold
from ..functions.windows import clip

# Trade condition codes that mark irregular trades.
IRREGULAR = [2, 5, 7, 10, 13, 15, 16, 20, 21, 22, 29, 33, 38, 52, 53]
AFTER_HOURS = 12


def irregular(conditions: Column, codes: list[int] | None = None) -> Column:
    """True if any condition is irregular; false for none or null."""
    return F.coalesce(F.arrays_overlap(conditions, F.array(*[F.lit(c) for c in codes or IRREGULAR])), F.lit(False))


def normalize_daily(df: DataFrame) -> DataFrame:
    """Drops symbols outside ASCII, strips NULs, adds midprice and dollar_total, replaces a vwap outside [low, high]."""
    mid = (F.col("high") + F.col("low") + F.col("open") + F.col("close")) / 4
    df = df.where(~F.col("symbol").rlike(r"[^\x00-\x7F]")).withColumn("symbol", F.translate("symbol", "\0", "")).withColumn("midprice", mid)
    df = df.withColumn("vwap", F.when(F.col("vwap").between(F.col("low"), F.col("high")), F.col("vwap")).otherwise(F.col("midprice")))
    return df.withColumn("dollar_total", F.col("vwap") * F.col("volume"))


def normalize_ticks(df: DataFrame, kind: str = "trades") -> DataFrame:
    """Short vendor keys to canonical columns; nanosecond epochs stay as longs beside microsecond timestamps."""
    # The vendor's short keys.
    names = {"trades": {"p": "price", "s": "size", "x": "exchange_id", "i": "trade_id", "c": "conditions", "q": "sequence"}, "quotes": {"p": "bid_price", "s": "bid_size", "x": "bid_exchange_id", "P": "ask_price", "S": "ask_size", "X": "ask_exchange_id", "q": "sequence"}}[kind]
    out = [F.col(a).alias(b) for a, b in names.items() if a in df.columns]
    for a, b in (("t", "sip"), ("y", "exchange")):
        if a in df.columns:
            out += [F.timestamp_micros(F.floor(F.col(a) / 1000)).alias(f"{b}_dt"), F.col(a).cast("long").alias(f"{b}_ns")]
    extra = [irregular(F.col("c")).alias("irregular")] if kind == "trades" and "c" in df.columns else []
    keep = [F.col(k) for k in ("symbol", "date") if k in df.columns]
    return df.select(*keep, *out, *extra)


def validate_nonempty(df: DataFrame) -> DataFrame:
    """The frame itself; raises if it has no row or a column without any value."""
    counts = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first().asDict()
    if not counts["_n"]:
        raise ValueError("no rows")
    if empty := [c for c in df.columns if not counts[c]]:
        raise ValueError(f"columns without a value: {empty}")
    return df


def regular_hours(df: DataFrame, time: str, zone: str = "America/New_York", start: str = "09:00:00", end: str = "16:00:00") -> DataFrame:
    """Local ``date_time`` within [start, end]."""
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), zone)
    return df.withColumn("date_time", local).where(F.date_format("date_time", "HH:mm:ss").between(start, end))


def clean_trades(df: DataFrame, price: str, size: str, delta_us: str, keys: list[str], identity: list[str], max_delta_us: int = 1_000_000) -> DataFrame:
    """Regular trades with a positive size and a (signed) delay below the limit, each identity once."""
    df = df.where((F.col(delta_us) < max_delta_us) & (F.col(size) > 0))
    if "irregular" in df.columns:
        df = df.where(~F.col("irregular"))
    return df.dropDuplicates([*keys, *identity])


def truncated_epochs(us: Column) -> dict[str, Column]:
    """Integer epochs at finer and coarser units."""
    return {"epoch_us": us, "epoch_ms": F.floor(us / 1_000), "epoch_cs": F.floor(us / 10_000), "epoch_ds": F.floor(us / 100_000), "epoch_s": F.floor(us / 1_000_000), "epoch_minute": F.floor(us / 60_000_000), "epoch_hour": F.floor(us / 3_600_000_000)}


def by_epoch(df: DataFrame, epoch: str, keys: list[str]) -> DataFrame:
    """Price count and mean, volume sum per truncated epoch."""
    return df.groupBy(*keys, epoch).agg(F.count("price").alias("price_count"), F.avg("price").alias("price_mean"), F.sum("volume").alias("volume_sum"))


def add_range(df: DataFrame) -> DataFrame:
    return df.withColumn("range", F.col("high") - F.col("low")).withColumn("range_value_pct", F.try_divide("range", "vwap"))


def squeeze(x: Column, t: float = 4.0) -> Column:
    """Linear within [-t, t], beyond it by the hyperbolic tangent of the excess."""
    clipped = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(t)), F.lit(-t)))
    return clipped + F.tanh(x - clipped)


def unsqueeze(y: Column, t: float = 4.0) -> Column:
    clipped = F.when(y.isNotNull(), F.greatest(F.least(y, F.lit(t)), F.lit(-t)))
    return clipped + F.atanh(F.when(F.abs(y - clipped) < 1, y - clipped))


def bands(df: DataFrame, base: str, vol: str, multiplier: float = 2.0) -> DataFrame:
    return df.withColumn(f"{base}_upper", F.col(base) + multiplier * F.col(vol)).withColumn(f"{base}_lower", F.col(base) - multiplier * F.col(vol))


def compound_interest(principal: Column, rate: Column, periods: Column) -> Column:
    return principal * F.pow(1 + rate / 100, periods)


def trade_means(df: DataFrame, keys: list[str]) -> DataFrame:
    """vwap and mean trade size."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(F.col("price") * F.col("volume")), F.sum("volume")).alias("vwap"), F.avg("volume").alias("avg_tick_size"))


class RunningMedian:
    """Median of the last ``n`` pushed values, the missing ones left out; a push takes a binary search."""

    def __init__(self, n: int):
        self.n, self.queue, self.sorted = n, deque(), []

    def push(self, x: float | None) -> None:
        self.queue.append(x)
        if x is not None:
            insort(self.sorted, x)
        if len(self.queue) > self.n and (old := self.queue.popleft()) is not None:
            del self.sorted[bisect_left(self.sorted, old)]

    def value(self) -> float | None:
        n = len(self.sorted)
        return (self.sorted[(n - 1) // 2] + self.sorted[n // 2]) / 2 if n else None


class _Mad(Kernel):
    """Rolling medians of values and of their distances, which stay in memory for one window."""

    def __init__(self, value: str, window: int, deviation_window: int, signed: bool):
        self.value, self.window, self.signed = value, window, signed
        self.middle, self.spread, self.n = RunningMedian(window), RunningMedian(deviation_window), 0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        medians, deviations = [], []
        for x in rows[self.value].to_numpy(float).tolist():
            x = None if x != x else x
            self.middle.push(x)
            m = self.middle.value() if self.signed or len(self.middle.sorted) == self.window else None
            d = None if m is None or x is None else x - m if self.signed else abs(x - m)
            self.spread.push(d)
            medians.append(m)
            deviations.append(self.spread.value() if self.signed or len(self.spread.sorted) >= self.window else None)
        self.n += len(rows)
        return rows.assign(_m=np.array(medians, float), _dm=np.array(deviations, float), _n=np.arange(self.n - len(rows) + 1, self.n + 1))


def _mad(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, deviation_window: int, signed: bool) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", _m double, _dm double, _n long"
    out = ordered_fold(df, keys, order, lambda key: _Mad(value, window, deviation_window, signed), schema)
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("_m", "_dm")}).withColumn("_dm", clip(F.col("_dm"), 0.005, 0.05))


def mad_filter(df: DataFrame, keys: list[str], order: list[str], value: str = "price", window: int = 11, deviation_window: int = 333, k: float = 22.0) -> DataFrame:
    """Rolling median and median absolute deviation; ``mad_outlier`` where the distance exceeds ``k`` deviations."""
    df = _mad(df, keys, order, value, window, deviation_window, False).withColumnsRenamed({"_m": "median", "_dm": "deviation"}).drop("_n")
    df = df.where(F.col("median").isNotNull() & F.col("deviation").isNotNull())
    return df.withColumn("mad_outlier", F.abs(F.col(value) - F.col("median")) > k * F.col("deviation"))


def mad_stream_status(df: DataFrame, keys: list[str], order: list[str], value: str = "price", window: int = 11, deviation_window: int = 333, k: float = 22.0) -> DataFrame:
    """``mad_status``: warmup until ``window`` rows, then outlier or clean; deviations keep their sign."""
    df = _mad(df, keys, order, value, window, deviation_window, True)
    far = F.abs(F.col(value) - F.col("_m")) > k * F.col("_dm")
    return df.withColumn("mad_status", F.when(F.col("_n") < window, "mad_warmup").when(far, "mad_outlier").otherwise("mad_clean")).drop("_m", "_n", "_dm")


def tick_status(df: DataFrame, hour: Column, delta_s: Column, irregular_flag: Column) -> DataFrame:
    """First matching status of a tick that has ``mad_status`` and ``volume``."""
    status = (
        F.when(F.col("volume") < 1, "zero_volume").when(irregular_flag, "irregular_condition").when(F.abs(delta_s) > 2, "ts_delta").when(F.col("mad_status") != "mad_clean", "mad_outlier")
        .when(hour < 9, "clean_pre_market").when(hour >= 16, "clean_after_hours").otherwise("clean_open_market")
    )
    return df.withColumn("status", status)


def status_shares(df: DataFrame, date: str = "date") -> DataFrame:
    """Share of each status per date."""
    counts = df.groupBy(date, "status").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(date)))


def decay_vwap(df: DataFrame, keys: list[str], order: list[str], window: int = 7, decay: str = "none") -> DataFrame:
    """VWAP of the previous ``window`` rows (the row itself left out), weighed evenly, linearly or exponentially."""
    over = Window.partitionBy(*keys).orderBy(*order)
    weight = {"none": lambda k: 1.0, "linear": lambda k: float(window + 1 - k), "exp": lambda k: 2.0 ** -(k - 1)}[decay]
    top = sum((F.lag(F.col("price") * F.col("volume"), k).over(over) * weight(k) for k in range(1, window + 1)), F.lit(0.0))
    low = sum((F.lag(F.col("volume"), k).over(over) * weight(k) for k in range(1, window + 1)), F.lit(0.0))
    return df.withColumn("decay_vwap", F.try_divide(top, low))
