"""Labels, concurrency, sample weights and event filters.

Returns from a price of 0, and logarithms of prices of 0 or less, are null; a cumulative sum passes over them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import Kernel, ordered_fold
from ..functions.joins import asof, interval
from ..functions.stats import log_ratio
from ..functions.windows import ordered, rolling_mean, rolling_std

DAY = 86400


class _Cusum(Kernel):
    def __init__(self, key: tuple, keys: list[str], time: str, price: str, h: float):
        self.key, self.keys, self.time, self.price, self.h = key, keys, time, price, h
        self.last, self.up, self.down = None, 0.0, 0.0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, p in zip(rows[self.time], rows[self.price]):
            if self.last is not None:
                r = math.log(p / self.last) if p > 0 and self.last > 0 else 0.0
                self.up, self.down = max(0.0, self.up + r), min(0.0, self.down + r)
                if self.down < -self.h:
                    self.down = 0.0
                    out.append((*self.key, t, -1))
                elif self.up > self.h:
                    self.up = 0.0
                    out.append((*self.key, t, 1))
            self.last = p
        return pd.DataFrame(out, columns=[*self.keys, self.time, "side"])


def cusum_filter(df: DataFrame, keys: list[str], time: str, price: str, h: float) -> DataFrame:
    """Times at which a one-sided cumulative sum of log returns passes ``h``; the side that fired is reset."""
    types = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in [*keys, time]) + ", side int"
    return ordered_fold(df.select(*keys, time, price), keys, [time], lambda key: _Cusum(key, keys, time, price, h), schema)


def z_score_filter(df: DataFrame, keys: list[str], time: str, price: str, mean_window: int, std_window: int, z: float) -> DataFrame:
    """Rows at or above rolling mean plus ``z`` rolling deviations."""
    over = ordered(keys, [time])
    limit = rolling_mean(F.col(price), over, mean_window) + z * rolling_std(F.col(price), over, std_window)
    return df.withColumn("_l", limit).where(F.col(price) >= F.col("_l")).drop("_l")


def vertical_barrier(events: DataFrame, bars: DataFrame, keys: list[str], after: int) -> DataFrame:
    """``t1``: the first bar at or after ``t0 + after``; events past the last bar are dropped."""
    shifted = events.withColumn("_at", F.col("t0") + after)
    return asof(shifted, bars.select(*keys, F.col("t").alias("t1")), keys, "_at", "t1", ["t1"], forward=True).where(F.col("t1").isNotNull()).drop("_at")


def apply_barriers(events: DataFrame, bars: DataFrame, keys: list[str], pt: float, sl: float, cell: int) -> DataFrame:
    """``pt``, ``sl``: first times in [t0, t1] at which side times return passes target multiples (strictly); null where none.

    ``events(keys, t0, t1, trgt, side)``; a multiple of 0 disables its barrier; a null ``t1`` means the last bar.
    """
    price = bars.select(*keys, F.col("t").alias("_t"), F.col("close").alias("_p"))
    last = bars.groupBy(*keys).agg(F.max("t").alias("_last"))
    spans = asof(events, bars.select(*keys, "t", F.col("close").alias("_p0")), keys, "t0", "t", ["_p0"], forward=True)
    spans = spans.join(last, keys).withColumn("_end", F.coalesce("t1", "_last")).drop("_last")
    path = interval(price, spans, keys, "_t", "t0", "_end", cell)
    ret = (F.try_divide("_p", F.col("_p0")) - 1) * F.col("side")
    hit = {"pt": F.min(F.when(ret > pt * F.col("trgt"), F.col("_t"))) if pt > 0 else F.lit(None).cast("long"), "sl": F.min(F.when(ret < -sl * F.col("trgt"), F.col("_t"))) if sl > 0 else F.lit(None).cast("long")}
    found = path.groupBy(*keys, "t0").agg(*[c.alias(n) for n, c in hit.items()])
    return events.join(found, [*keys, "t0"], "left")


def get_events(events: DataFrame, bars: DataFrame, keys: list[str], pt: float, sl: float, min_ret: float, cell: int) -> DataFrame:
    """Triple-barrier events: target above ``min_ret``; ``t1`` is the earliest of the three barriers."""
    touched = apply_barriers(events.where(F.col("trgt") > min_ret), bars, keys, pt, sl, cell)
    return touched.withColumn("t1", F.least("t1", "pt", "sl"))


def get_bins(events: DataFrame, bars: DataFrame, keys: list[str], meta: bool = False, pt: float = 1.0, sl: float = 1.0) -> DataFrame:
    """``ret`` between the closes at t0 and t1 and ``bin``: 1, -1 or 0 by the barrier it passed; meta labels are 1 or 0."""
    closes = bars.select(*keys, "t", F.col("close").alias("p"))
    at = asof(events, closes.withColumnRenamed("p", "_p0"), keys, "t0", "t", ["_p0"], forward=True)
    at = asof(at.where(F.col("t1").isNotNull()), closes.withColumnRenamed("p", "_p1"), keys, "t1", "t", ["_p1"], forward=True)
    log = log_ratio(F.col("_p1"), F.col("_p0")) * F.col("side")
    bin_ = F.when(log > F.ln(1 + F.col("trgt")) * pt, 1).when(log < -F.ln(1 + F.col("trgt")) * sl, -1).otherwise(0)
    if meta:
        bin_ = F.when(log <= 0, 0).otherwise(bin_)
    return at.withColumn("ret", F.exp(log) - 1).withColumn("bin", bin_).drop("_p0", "_p1")


def drop_labels(bins: DataFrame, min_pct: float = 0.05) -> DataFrame:
    """Drops the rarest class while it holds at most ``min_pct`` and three or more remain."""
    counts = {r["bin"]: r["count"] for r in bins.groupBy("bin").count().collect()}  # one row a class
    while len(counts) > 2:
        rare = min(counts, key=lambda k: (counts[k], k))
        if counts[rare] / sum(counts.values()) > min_pct:
            break
        del counts[rare]
    return bins.where(F.col("bin").isin(list(counts)))


def raw_return(df: DataFrame, keys: list[str], time: str, price: str, log: bool = False, binary: bool = False, lag: bool = True) -> DataFrame:
    over = ordered(keys, [time])
    now, then = (F.lead(price).over(over), F.col(price)) if lag else (F.col(price), F.lag(price).over(over))
    ret = log_ratio(now, then) if log else F.try_divide(now, then) - 1
    return df.withColumn("ret", F.signum(ret) if binary else ret)


def fixed_time_horizon(df: DataFrame, keys: list[str], time: str, price: str, threshold: float, window: int | None = None) -> DataFrame:
    """-1, 0 or 1 by the next row's return (standardised over ``window`` rows where given); null stays null."""
    over = ordered(keys, [time])
    df = df.withColumn("_r", F.try_divide(F.lead(price).over(over), F.col(price)) - 1)
    if window:
        df = df.withColumn("_r", F.try_divide(F.col("_r") - rolling_mean(F.col("_r"), over, window), rolling_std(F.col("_r"), over, window)))
    return df.withColumn("label", F.when(F.col("_r") > threshold, 1).when(F.col("_r") < -threshold, -1).when(F.col("_r").isNotNull(), 0)).drop("_r")


def excess_return(df: DataFrame, time: str, over: str = "mean", binary: bool = False) -> DataFrame:
    """``ret`` less the cross-section's mean or median at each time."""
    across = Window.partitionBy(time)
    middle = F.avg("ret").over(across) if over == "mean" else F.percentile("ret", 0.5).over(across)
    value = F.col("ret") - middle
    return df.withColumn("excess", F.signum(value) if binary else value)


def tail_sets(df: DataFrame, time: str, symbol: str, bins: int) -> DataFrame:
    """Per time, +1 for the top and -1 for the bottom of ``bins`` equal parts of ``ret``, ties by symbol; lists of names beside."""
    n = F.count(F.lit(1)).over(Window.partitionBy(time))
    place = F.row_number().over(Window.partitionBy(time).orderBy("ret", symbol))
    part = F.ceil((place - 1) * bins / F.greatest(n - 1, F.lit(1)))
    ranked = df.where(F.col("ret").isNotNull()).withColumn("_q", F.greatest(part, F.lit(1)))
    return ranked.withColumn("label", F.when(F.col("_q") == bins, 1).when(F.col("_q") == 1, -1).otherwise(0)).drop("_q")


def trend_scanning(df: DataFrame, keys: list[str], time: str, value: str, least: int, most: int) -> DataFrame:
    """For each row the forward window (``least`` to ``most`` rows) with the largest |t| of its trend; t1, t_value, sign."""
    over = ordered(keys, [time])
    df = df.withColumn("_n", F.row_number().over(over) - 1).withColumn("_m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    spans = df
    choices = []
    for length in range(least, most + 1):
        frame = over.rowsBetween(0, length - 1)
        x, y = F.col("_n").cast("double"), F.col(value)
        sx = F.sum(x * 1.0).over(frame)
        sy, sxx, syy, sxy = (F.sum(c).over(frame) for c in (y, x * x, y * y, x * y))
        vx, vy, c = sxx - sx * sx / length, syy - sy * sy / length, sxy - sx * sy / length
        slope = F.try_divide(c, vx)
        error = F.sqrt(F.try_divide(F.greatest(vy - slope * c, F.lit(0.0)) / (length - 2), vx))
        t = F.when(F.col("_n") + length <= F.col("_m"), F.try_divide(slope, error))
        choices.append(F.struct(F.abs(t).alias("a"), F.lit(-length).alias("l"), t.alias("t"), F.lead(time, length - 1).over(over).alias("t1")))
    best = F.array_max(F.filter(F.array(*choices), lambda c: c["a"].isNotNull()))
    return spans.withColumn("_b", best).where(F.col("_b").isNotNull()).select(*keys, time, F.col("_b.t1").alias("t1"), F.col("_b.t").alias("t_value"), F.signum("_b.t").alias("bin"))


def concurrent_events(bars: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """``concurrency``: spans open at each bar, both ends closed; a sweep of +1 and -1, not a join."""
    last = bars.groupBy(*keys).agg(F.max("t").alias("_last"))
    closed = spans.join(last, keys).withColumn("t1", F.coalesce("t1", "_last"))
    up = closed.select(*keys, F.col("t0").alias("t"), F.lit(1).alias("d"), F.lit(0).alias("o"))
    down = closed.select(*keys, F.col("t1").alias("t"), F.lit(-1).alias("d"), F.lit(2).alias("o"))
    marks = bars.select(*keys, "t", F.lit(0).alias("d"), F.lit(1).alias("o"))
    open_ = F.sum("d").over(Window.partitionBy(*keys).orderBy("t", "o").rowsBetween(Window.unboundedPreceding, 0))
    return up.union(down).union(marks).withColumn("concurrency", open_).where("o = 1").select(*keys, "t", "concurrency")


def span_bars(bars: DataFrame, spans: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """The sparse indicator matrix: one row per (span, bar inside it)."""
    last = bars.groupBy(*keys).agg(F.max("t").alias("_last"))
    closed = spans.join(last, keys).withColumn("t1", F.coalesce("t1", "_last")).drop("_last")
    return interval(bars, closed, keys, "t", "t0", "t1", cell)


def average_uniqueness(bars: DataFrame, spans: DataFrame, keys: list[str], cell: int) -> DataFrame:
    counted = concurrent_events(bars, spans, keys)
    return span_bars(counted, spans, keys, cell).groupBy(*keys, "t0").agg(F.avg(F.try_divide(F.lit(1.0), F.col("concurrency"))).alias("uniqueness"))


def weights_by_return(bars: DataFrame, spans: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """|sum of log returns over concurrency| in each span, scaled to sum to the number of spans (per key)."""
    rets = bars.withColumn("_r", log_ratio(F.col("close"), F.lag("close").over(ordered(keys, ["t"]))))
    counted = rets.join(concurrent_events(bars, spans, keys), [*keys, "t"])
    sums = span_bars(counted, spans, keys, cell).groupBy(*keys, "t0").agg(F.abs(F.sum(F.try_divide("_r", "concurrency"))).alias("_w"))
    every = Window.partitionBy(*keys)
    return sums.withColumn("weight", F.try_divide(F.col("_w") * F.count(F.lit(1)).over(every), F.sum("_w").over(every))).drop("_w")


def weights_by_decay(unique: DataFrame, keys: list[str], decay: float) -> DataFrame:
    """Linear decay over cumulative uniqueness; the newest weighs 1; a negative ``decay`` zeroes the oldest share."""
    run = F.sum("uniqueness").over(ordered(keys, ["t0"]).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("uniqueness").over(Window.partitionBy(*keys))
    slope = F.try_divide(F.lit(1.0 - decay), total) if decay >= 0 else F.try_divide(F.lit(1.0), (decay + 1) * total)
    return unique.withColumn("weight", F.greatest(F.lit(0.0), 1 - slope * total + slope * run))


def seq_bootstrap(start: np.ndarray, end: np.ndarray, draws: int, rng: np.random.Generator) -> list[int]:
    """Sequential bootstrap of labels that span bars ``start`` to ``end`` (both in): chances follow average uniqueness given the draws so far.

    Uniqueness of every label comes from one running sum of 1 / (1 + labels taken) over the bars: a draw takes time linear in bars and labels.
    """
    taken = np.zeros(int(end.max()) + 1 if len(end) else 0)
    out = []
    for _ in range(draws):
        run = np.concatenate([[0.0], np.cumsum(1 / (taken + 1))])
        unique = (run[end + 1] - run[start]) / (end - start + 1)
        out.append(int(rng.choice(len(start), p=unique / unique.sum())))
        taken[start[out[-1]] : end[out[-1]] + 1] += 1
    return out
