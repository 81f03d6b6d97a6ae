"""Bar sampling: closed forms where the bar key is one, ordered folds where it is path-dependent."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import Kernel, ordered_fold
from ..functions.windows import carried, ordered, tick_side


def with_side(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``side``: sign of the last price change, carried across bars; 0 before the first."""
    over = ordered(keys, order)
    return ticks.withColumn("_g", tick_side(F.col("price"), over)).withColumn("side", F.coalesce(carried(F.col("_g"), over), F.lit(0.0)).cast("int")).drop("_g")


def side_in_bar(ticks: DataFrame, keys: list[str], order: list[str], bar: str) -> DataFrame:
    """``side`` that starts again in each bar."""
    return with_side(ticks, [*keys, bar], order)


def imbalance_runs(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Length, volume and dollars of the run of equal sides that a tick is in; needs ``side``."""
    over = ordered(keys, order)
    flips = ticks.withColumn("_f", F.when(F.col("side") != F.lag("side").over(over), 1).otherwise(0))
    flips = flips.withColumn("_run", F.sum("_f").over(over.rowsBetween(Window.unboundedPreceding, 0)))
    run = ordered([*keys, "_run"], order).rowsBetween(Window.unboundedPreceding, 0)
    return flips.withColumns({"run_length": F.count(F.lit(1)).over(run), "run_volume": F.sum("volume").over(run), "run_dollars": F.sum(F.col("volume") * F.col("price")).over(run)}).drop("_f", "_run")


def imbalance_net(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """Net signed ticks, volume and dollars; needs ``side``."""
    v, p, s = F.col("volume"), F.col("price"), F.col("side")
    return ticks.groupBy(*keys).agg(F.sum(s).alias("tick_imbalance"), F.sum(s * v).alias("volume_imbalance"), F.sum(s * v * p).alias("dollar_imbalance"))


def bar_rows(ticks: DataFrame, keys: list[str], order: str, bar: str, *more: Column) -> DataFrame:
    """One row a bar of ticks that have ``side`` and ``tick_num``, with ``more`` aggregates."""
    dollars = F.col("price") * F.col("volume")
    return ticks.groupBy(*keys, bar).agg(
        F.max(order).alias("date_time"), F.max("tick_num").alias("tick_num"), F.min_by("price", "tick_num").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "tick_num").alias("close"),
        F.sum("volume").alias("volume"), F.sum(F.when(F.col("side") == 1, F.col("volume")).otherwise(0)).alias("cum_buy_volume"), F.count(F.lit(1)).alias("cum_ticks"), F.sum(dollars).alias("cum_dollar_value"), *more,
    )


def numbered(ticks: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return ticks.withColumn("tick_num", F.row_number().over(ordered(keys, order)))


def tick_bars(ticks: DataFrame, keys: list[str], order: list[str], threshold: int) -> DataFrame:
    """Bars of ``threshold`` ticks; the open last one is dropped."""
    rows = numbered(with_side(ticks, keys, order), keys, order).withColumn("bar", F.floor((F.col("tick_num") - 1) / threshold))
    return bar_rows(rows, keys, order[0], "bar").where(F.col("cum_ticks") == threshold)


def time_bars(ticks: DataFrame, keys: list[str], order: list[str], seconds: int) -> DataFrame:
    """Bars by right edge in epoch seconds; the last open bucket of each key is dropped; tick_num is one past the bar's last."""
    rows = numbered(with_side(ticks, keys, order), keys, order).withColumn("bar", (F.floor(F.col(order[0]) / (1_000_000 * seconds)) + 1) * seconds)
    out = bar_rows(rows, keys, order[0], "bar").withColumn("_last", F.max("bar").over(Window.partitionBy(*keys)))
    return out.where("bar < _last").drop("_last").withColumn("tick_num", F.col("tick_num") + 1).withColumn("date_time", F.col("bar"))


class _Threshold(Kernel):
    """Bar numbers by a sum, taken tick by tick, that is reset where it reaches the threshold; ``done`` at the ticks that reach it."""

    def __init__(self, key: tuple, threshold: float, metric: str, columns: list[str]):
        self.threshold, self.metric, self.columns = threshold, metric, columns
        self.sum, self.bar, self.length = 0.0, 0, 1

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        values = rows[self.metric].to_numpy(float)
        bar, done = np.empty(len(values), np.int64), np.zeros(len(values), bool)
        at = 0
        while at < len(values):
            start, size = at, 2 * self.length  # about the bar before's length first, twice as much each time
            while at < len(values):
                # The sum so far goes before the values, so that rounding is that of adding one tick after another.
                total = np.cumsum(np.concatenate([[self.sum], values[at : at + size]]))[1:]
                reached = ~(total < self.threshold)  # NaN is past any threshold
                if reached.any():
                    at += int(reached.argmax()) + 1
                    done[at - 1] = True
                    break
                self.sum, at, size = float(total[-1]), at + len(total), 2 * size
            bar[start:at] = self.bar
            if done[at - 1]:
                self.sum, self.bar, self.length = 0.0, self.bar + 1, at - start
        return rows[self.columns].assign(bar=bar, done=done)


def metric_bars(ticks: DataFrame, keys: list[str], order: list[str], metric: Column, threshold: float) -> DataFrame:
    """Bars that close where the summed metric reaches the threshold; the excess is discarded, the open last bar dropped.

    After a missing metric the sum is missing too, and no bar closes.
    """
    rows = numbered(with_side(ticks, keys, order), keys, order).withColumn("_metric", F.coalesce(metric.cast("double"), F.lit(float("-inf"))))
    columns = [c for c in rows.columns if c != "_metric"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "_metric") + ", bar long, done boolean"
    folded = ordered_fold(rows, keys, order, lambda key: _Threshold(key, threshold, "_metric", columns), schema)
    closed = F.max(F.when(F.col("done"), F.col("tick_num"))).alias("_closed")
    return bar_rows(folded, keys, order[0], "bar", closed).where("_closed IS NOT NULL").drop("_closed")


def volume_bars(ticks: DataFrame, keys: list[str], order: list[str], threshold: float = 70_000_000) -> DataFrame:
    return metric_bars(ticks, keys, order, F.col("volume"), threshold)


def dollar_bars(ticks: DataFrame, keys: list[str], order: list[str], threshold: float = 70_000_000) -> DataFrame:
    return metric_bars(ticks, keys, order, F.col("price") * F.col("volume"), threshold)


class _Expectation(Kernel):
    """Imbalance or run bars: a bar closes where the signed sums outgrow what the past leads to expect."""

    def __init__(self, key: tuple, keys: list[str], runs: bool, metric: str, window: int, ticks: float, prev_bars: int | None, limits: tuple[float, float] | None):
        self.key, self.keys, self.runs, self.metric, self.window = key, keys, runs, metric, window
        self.init, self.expected_ticks, self.prev_bars, self.limits = ticks, ticks, prev_bars, limits
        self.price, self.side, self.theta, self.plus, self.minus = None, 0, 0.0, 0.0, 0.0
        self.history: list[float] = []
        self.buys: list[float] = []
        self.sells: list[float] = []
        self.sizes: list[float] = []
        self.shares: list[float] = []
        self.expected = self.expected_buy = self.expected_sell = self.share = float("nan")
        self.open_bar()

    def open_bar(self) -> None:
        self.theta = self.plus = self.minus = 0.0
        self.row: dict = {"n": 0, "volume": 0.0, "dollars": 0.0, "buy": 0.0, "high": -np.inf, "low": np.inf, "open": None, "up": 0}

    @staticmethod
    def ewma(values: list[float], window: int) -> float:
        """Last value of the bias-corrected exponential mean of the last ``window`` values."""
        x = np.array(values[-window:])
        w = (1 - 2 / (window + 1)) ** np.arange(len(x) - 1, -1, -1)
        return float((x * w).sum() / w.sum())

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        out = []
        for us, price, volume, number in zip(rows["us"], rows["price"], rows["volume"], rows["tick_num"]):
            if self.price is not None and price != self.price:
                self.side = 1 if price > self.price else -1
            self.price = price
            signed = self.side * {"tick": 1.0, "volume": float(volume), "dollar": float(price * volume)}[self.metric]
            r = self.row
            r["n"] += 1
            r["volume"] += volume
            r["dollars"] += price * volume
            r["buy"] += volume if self.side == 1 else 0
            r["up"] += self.side == 1
            r["open"] = price if r["open"] is None else r["open"]
            r["high"], r["low"] = max(r["high"], price), min(r["low"], price)
            if self.runs:
                if signed > 0:
                    self.plus += signed
                    self.buys.append(signed)
                elif signed < 0:
                    self.minus -= signed
                    self.sells.append(-signed)
                if np.isnan(self.expected_buy) and len(self.buys) >= self.init and len(self.sells) >= self.init:
                    self.expected_buy, self.expected_sell = self.ewma(self.buys, self.window), self.ewma(self.sells, self.window)
                    self.share = r["up"] / r["n"]
                limit = self.expected_ticks * max(self.expected_buy * self.share, self.expected_sell * (1 - self.share))
                done = max(self.plus, self.minus) > limit
            else:
                self.theta += signed
                self.history.append(signed)
                if np.isnan(self.expected) and len(self.history) >= self.init:
                    self.expected = self.ewma(self.history, self.window)
                done = abs(self.theta) > self.expected_ticks * abs(self.expected)
            if done:
                out.append((*self.key, us, number, r["open"], r["high"], r["low"], price, r["volume"], r["buy"], r["n"], r["dollars"]))
                self.sizes.append(r["n"])
                if self.prev_bars:
                    self.expected_ticks = self.ewma(self.sizes, self.prev_bars)
                    if self.limits:
                        self.expected_ticks = min(max(self.expected_ticks, self.limits[0]), self.limits[1])
                if self.runs:
                    self.shares.append(r["up"] / r["n"])
                    self.share = self.ewma(self.shares, self.prev_bars or len(self.shares))
                    self.expected_buy, self.expected_sell = self.ewma(self.buys, self.window), self.ewma(self.sells, self.window)
                else:
                    self.expected = self.ewma(self.history, self.window)
                self.open_bar()
        keep = 4 * max(self.window, int(self.init) + 1)
        for values in (self.history, self.buys, self.sells):
            if len(values) > keep:
                del values[: -max(self.window, int(self.init) + 1)]
        return pd.DataFrame(out, columns=[*self.keys, "date_time", "tick_num", "open", "high", "low", "close", "volume", "cum_buy_volume", "cum_ticks", "cum_dollar_value"]) if out else None


def expectation_bars(ticks: DataFrame, keys: list[str], order: list[str], kind: str, metric: str, window: int = 10_000, exp_num_ticks: float = 20_000, num_prev_bars: int | None = 3, constraints: tuple[float, float] | None = None) -> DataFrame:
    """``kind`` imbalance or run; ``metric`` tick, volume or dollar; ``num_prev_bars`` None keeps the expected ticks constant."""
    types = dict(ticks.dtypes)
    schema = ", ".join(f"`{k}` {types[k]}" for k in keys) + ", date_time long, tick_num long, open double, high double, low double, close double, volume double, cum_buy_volume double, cum_ticks long, cum_dollar_value double"
    rows = numbered(ticks, keys, order)
    return ordered_fold(rows, keys, order, lambda key: _Expectation(key, keys, kind == "run", metric, window, exp_num_ticks, num_prev_bars, constraints), schema)


def bar_params(ticks: DataFrame, keys: list[str], bars: int) -> DataFrame:
    """Thresholds that give about so many bars."""
    return ticks.groupBy(*keys).agg((F.count(F.lit(1)) / bars).alias("tick_threshold"), (F.sum("volume") / bars).alias("volume_threshold"), (F.sum(F.col("price") * F.col("volume")) / bars).alias("dollar_threshold"))
