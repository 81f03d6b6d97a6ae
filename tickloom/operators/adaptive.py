"""Recursive smoothers, adaptive price bars, their features and triple-barrier labels on ticks."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import Kernel, ordered_fold
from ..functions.joins import interval
from ..functions.windows import ordered
from ..session import reachable

Step = Callable[[float], float]


class jma_step:  # noqa: N801  (called like the other steps)
    """Three coupled recurrences that track level, slope and adjustment; a step takes a value and gives the smoothed one."""

    def __init__(self, first: float, window: int, power: float = 1.0, phase: float = 0.0):
        self.ratio = 0.5 if phase < -100 else 2.5 if phase > 100 else phase / 101.5
        self.beta = 0.45 * (window - 1) / (0.45 * (window - 1) + 2)
        self.alpha = self.beta**power
        self.state = [first, 0.0, 0.0, first]

    def __call__(self, x: float) -> float:
        level, slope, lift, out = self.state
        level = x + self.alpha * (level - x)
        slope = (x - level) * (1 - self.beta) + self.beta * slope
        lift = (level + self.ratio * slope - out) * (1 - self.alpha) ** 2 + self.alpha**2 * lift
        self.state = [level, slope, lift, out + lift]
        return out + lift


def rema_step(first: float, window: int = 14, lam: float = 0.5) -> Step:
    """Regularised exponential mean of second order."""
    alpha, one, two = 2 / (window + 1), first, first

    def step(x: float) -> float:
        nonlocal one, two
        new = (one + alpha * (x - one) + lam * (2 * one - two)) / (1 + lam)
        one, two = new, one
        return new

    return step


def supersmoother_step(first: float, window: int = 10) -> Step:
    """Two-pole low-pass filter; 0 for the first three rows."""
    a = math.exp(-1.414 * 3.14159 / window)
    c2 = math.cos(math.radians(1.414 * 180 / window))
    c3 = -a * a
    c1 = 1 - c2 - c3
    n, before, one, two = 0, first, 0.0, 0.0

    def step(x: float) -> float:
        nonlocal n, before, one, two
        new = c1 * (x + before) / 2 + c2 * one + c3 * two if n >= 3 else 0.0
        n, before, one, two = n + 1, x, new, one
        return new

    return step


def ewma_step(first: float, window: int) -> Step:
    """Bias-corrected exponential mean over all rows."""
    keep, total, weight = 1 - 2 / (window + 1), 0.0, 0.0

    def step(x: float) -> float:
        nonlocal total, weight
        total, weight = total * keep + x, weight * keep + 1
        return total / weight

    return step


class _Smooth(Kernel):
    def __init__(self, make: Callable[[float], Step], value: str, name: str, warm: int):
        self.make, self.value, self.name, self.warm, self.step, self.n = make, value, name, warm, None, 0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        x = rows[self.value].to_numpy(float)
        self.step = self.step or self.make(float(x[0]))
        out = np.array([self.step(v) for v in x])
        out[: max(0, self.warm - self.n)] = np.nan
        self.n += len(x)
        return rows.assign(**{self.name: out})


def smoothed(df: DataFrame, keys: list[str], order: list[str], value: str, make: Callable[[float], Step], name: str, warm: int = 0) -> DataFrame:
    """``df`` with ``name``: a recursive smoother of ``value`` per key, null for the first ``warm`` rows."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name) + f", `{name}` double"
    out = ordered_fold(df.drop(name), keys, order, lambda key: _Smooth(make, value, name, warm), schema)
    return out.withColumn(name, F.when(~F.isnan(name), F.col(name)))


class _Expanding(Kernel):
    """The smoother of ``window`` from its row on; before, row ``i`` has that of window ``i + 1`` over the rows so far."""

    def __init__(self, value: str, name: str, window: int, power: float, phase: float):
        self.value, self.name, self.window, self.power, self.phase, self.head, self.step = value, name, window, power, phase, [], None

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for x in rows[self.value].to_numpy(float):
            self.step = self.step or jma_step(float(x), self.window, self.power, self.phase)
            now = self.step(x)
            if len(self.head) < self.window - 1:
                self.head.append(x)
                short = jma_step(self.head[0], len(self.head), self.power, self.phase)
                now = [short(v) for v in self.head][-1]
            out.append(now)
        return rows.assign(**{self.name: out})


def jma_expanding(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 10, power: float = 1.0, phase: float = 0.0) -> DataFrame:
    """``df`` with ``{value}_jma`` in every row: growing windows lead up to the full one."""
    if window < 1:
        raise ValueError("window must be 1 or more")
    name = f"{value}_jma"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != name) + f", `{name}` double"
    return ordered_fold(df.drop(name), keys, order, lambda key: _Expanding(value, name, window, power, phase), schema)


def jma_df(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, power: float, phase: float = 0.0, expand: bool = False) -> DataFrame:
    return jma_expanding(df, keys, order, value, window, power, phase) if expand else jma(df, keys, order, value, window, power, phase)


def jma(df: DataFrame, keys: list[str], order: list[str], value: str, window: int = 10, power: float = 1.0, phase: float = 0.0, warm: bool = True) -> DataFrame:
    return smoothed(df, keys, order, value, lambda first: jma_step(first, window, power, phase), f"{value}_jma", window - 1 if warm else 0)


class _Adaptive(Kernel):
    """Smooths clean ticks and cuts open-market ticks into bars by return, imbalance and duration."""

    def __init__(self, limits: dict):
        self.limits, self.smooth, self.bar, self.last_return = limits, None, 0, 0.0
        self._open()

    def _open(self) -> None:
        self.n, self.start, self.first, self.first_jma, self.price, self.side, self.signed = 0, None, None, None, None, 0, 0.0

    def dump(self) -> dict:
        """The state as plain numbers, for a stream's checkpoint."""
        names = ("bar", "last_return", "n", "start", "first", "first_jma", "price", "side", "signed")
        plain = lambda v: v.item() if isinstance(v, np.generic) else v
        return {k: plain(getattr(self, k)) for k in names} | {"smooth": [float(v) for v in self.smooth.state] if self.smooth else None}

    def load(self, state: dict) -> "_Adaptive":
        for k, v in state.items():
            if k != "smooth":
                setattr(self, k, v)
        if state["smooth"]:
            self.smooth = jma_step(0.0, self.limits.get("jma_winlen", 10), self.limits.get("jma_power", 1))
            self.smooth.state = state["smooth"]
        return self

    def _trigger(self, us: int, price: float, value: float) -> str | None:
        limits, found = self.limits, None
        if size := limits.get("renko_size"):
            wide = size * limits.get("renko_reversal_multiple", 1.0)
            moved = value - self.first_jma if limits.get("renko_return", "price_return") == "jma_return" else price - self.first
            bull, bear = (size, -wide) if self.last_return >= 0 else (wide, -size)
            found = "renko_up" if moved >= bull else found
            found = "renko_down" if moved < bear else found
        if (most := limits.get("volume_imbalance")) is not None and abs(self.signed) >= most:
            found = "volume_imbalance"
        if (most := limits.get("max_seconds")) is not None and us - self.start > most * 1e6:
            found = "duration"
        if us - self.start < limits.get("min_seconds", 0) * 1e6 or self.n < limits.get("min_tick_count", 0):
            found = None
        return found

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        smooths, bars, triggers = [], [], []
        for us, price, volume, status in zip(rows["us"], rows["price"], rows["volume"], rows["status"]):
            if self.smooth is None:
                self.smooth = jma_step(float(price), self.limits.get("jma_winlen", 10), self.limits.get("jma_power", 1))
            value, bar, trigger = np.nan, None, None
            if status.startswith("clean"):
                value = self.smooth(float(price))
            if status == "clean_open_market":
                if self.n == 0:
                    self.start, self.first, self.first_jma = us, price, value
                elif price != self.price:
                    self.side = 1 if price > self.price else -1
                self.price = price
                self.n += 1
                self.signed += self.side * volume
                bar, trigger = self.bar, self._trigger(us, price, value)
                if trigger:
                    self.last_return = price - self.first
                    self.bar += 1
                    self._open()
            smooths.append(value)
            bars.append(bar)
            triggers.append(trigger)
        return rows.assign(jma=smooths, bar=pd.array(bars, dtype="Int64"), bar_trigger=triggers)


def adaptive_bars(ticks: DataFrame, keys: list[str], limits: dict) -> DataFrame:
    """Ticks that have ``status``, with ``jma``, ``bar`` (open-market ticks) and ``bar_trigger`` on a bar's last tick.

    ``keys`` should hold the session date: bars and smoothers start anew each day.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ticks.schema.fields) + ", jma double, bar long, bar_trigger string"
    out = ordered_fold(ticks, keys, ["us", "seq"], lambda key: _Adaptive(limits), schema)
    return out.withColumn("jma", F.when(~F.isnan("jma"), F.col("jma")))


def weighted_quantile(values: np.ndarray, weights: np.ndarray, q: float) -> float:
    """The lower step of the weighted distribution, the middle of two where the weight is met exactly."""
    order = np.argsort(values, kind="stable")
    run = np.cumsum(weights[order])
    level = q * run[-1]
    at = min(int(np.searchsorted(run, level, side="left")), len(order) - 1)
    above = min(int(np.searchsorted(run, level, side="right")), len(order) - 1)
    return float((values[order][at] + values[order][above]) / 2)


BAR_COLUMNS = {
    "bar": "long", "open_at": "long", "close_at": "long", "price_open": "double", "price_close": "double", "price_low": "double", "price_high": "double", "jma_open": "double", "jma_close": "double", "jma_low": "double", "jma_high": "double",
    "tick_count": "long", "volume": "long", "dollars": "double", "tick_imbalance": "long", "volume_imbalance": "long", "dollar_imbalance": "double", "price_range": "double", "price_return": "double", "price_wq10": "double", "price_wq50": "double",
    "price_wq90": "double", "price_wmean": "double", "price_wstd": "double", "jma_range": "double", "jma_return": "double", "jma_wq10": "double", "jma_wq50": "double", "jma_wq90": "double", "jma_wmean": "double", "jma_wstd": "double", "bar_trigger": "string",
}


def bar_row(bar: int, us: np.ndarray, price: np.ndarray, jma_: np.ndarray, volume: np.ndarray, trigger: str) -> dict:
    """Times, price and jma statistics, counts and imbalances of one bar's ticks in order; sides start anew in the bar."""
    change = np.sign(np.diff(price, prepend=price[0]))
    last = np.maximum.accumulate(np.where(change != 0, np.arange(len(price)), 0))
    side = change[last].astype(np.int64)
    out = {"bar": bar, "open_at": us[0], "close_at": us[-1], "tick_count": len(us), "volume": volume.sum(), "dollars": (volume * price).sum(), "tick_imbalance": side.sum(), "volume_imbalance": (side * volume).sum(), "dollar_imbalance": (side * volume * price).sum(), "bar_trigger": trigger}
    total = volume.sum()
    for name, x in (("price", price), ("jma", jma_)):
        out |= {f"{name}_open": x[0], f"{name}_close": x[-1], f"{name}_low": x.min(), f"{name}_high": x.max(), f"{name}_range": x.max() - x.min(), f"{name}_return": x[-1] - x[0]}
        mean = (volume * x).sum() / total if total else np.nan
        out |= {f"{name}_wq{round(100 * q)}": weighted_quantile(x, volume, q) for q in (0.1, 0.5, 0.9)}
        out |= {f"{name}_wmean": mean, f"{name}_wstd": math.sqrt(max((volume * x * x).sum() / total - mean * mean, 0.0)) if total else np.nan}
    return out


class _BarRows(Kernel):
    """One row a closed bar; holds the ticks of one open bar."""

    def __init__(self, key: tuple, keys: list[str]):
        self.key, self.keys, self.held = key, keys, []

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        rows = rows[rows["bar"].notna()]
        ends = np.nonzero(rows["bar_trigger"].notna().to_numpy())[0] + 1
        out, at = [], 0
        for end in ends:
            part = rows.iloc[at:end]
            ticks = pd.concat([*self.held, part]) if self.held else part
            self.held, at = [], end
            out.append(bar_row(int(ticks["bar"].iloc[0]), *(ticks[c].to_numpy() for c in ("us", "price", "jma", "volume")), part["bar_trigger"].iloc[-1]))
        if at < len(rows):
            self.held.append(rows.iloc[at:])
        if not out:
            return None
        found = pd.DataFrame(out)[list(BAR_COLUMNS)]
        for k, v in reversed(list(zip(self.keys, self.key, strict=True))):
            found.insert(0, k, v)
        return found


def _null_nans(df: DataFrame) -> DataFrame:
    return df.select(*[F.when(~F.isnan(f.name), F.col(f.name)).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


def _key_schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join(f"`{k}` {types[k]}" for k in keys)


def bar_features(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """One row a closed bar of ticks that :func:`adaptive_bars` cut: a fold in order, no joins."""
    schema = ", ".join([_key_schema(ticks, keys), *(f"{c} {t}" for c, t in BAR_COLUMNS.items())])
    rows = ticks.where("bar IS NOT NULL").select(*keys, "us", "seq", "price", "volume", "jma", "bar", "bar_trigger")
    return _null_nans(ordered_fold(rows, keys, ["us", "seq"], lambda key: _BarRows(key, keys), schema))


LABEL_COLUMNS = {"bar": "long", "label_start_at": "long", "label_end_at": "long", "label_side": "string", "label_outcome": "string", "label_rrr": "double", "label_outcome_at": "long"}
TREND_COLUMNS = {"label_trend_slope": "double", "label_trend_tvalue": "double", "label_trend_r2": "double"}
Outcome = tuple[str, str, float, int | None]


def outcomes(us: np.ndarray, jma_: np.ndarray, first: float, risk: float, rewards: list[float]) -> list[Outcome]:
    """(side, goal, reward to risk, time or None) of each stop and target of a window, measured from its first price on ``jma``."""
    out: list[Outcome] = []
    for side, sign in (("long", 1), ("short", -1)):
        move = (jma_ - first) * sign
        for goal, hit, rrr in [("stop", move < -risk, -1.0), *(("profit", move >= risk * r, float(r)) for r in rewards)]:
            at = int(hit.argmax()) if len(hit) and hit.any() else -1
            out.append((side, goal, rrr * sign, int(us[at]) if at >= 0 else None))
    return out


def side_label(found: list[Outcome], side: str, end_at: int) -> tuple[str, float, int]:
    """The largest reward reached before the stop (any, without one), then the stop, then neutral at the window's end."""
    stop = next(at for s, goal, _, at in found if s == side and goal == "stop")
    reached = [(abs(rrr), rrr, at) for s, goal, rrr, at in found if s == side and goal == "profit" and at is not None and (stop is None or at < stop)]
    if reached:
        _, rrr, at = max(reached, key=lambda x: x[0])
        return "profit", rrr, at
    return ("stop", -1.0 if side == "long" else 1.0, stop) if stop is not None else ("neutral", 0.0, end_at)


def final_label(long: tuple[str, float, int], short: tuple[str, float, int]) -> tuple[str | None, str, float | None, int | None]:
    """(side, outcome, reward to risk, time) of both sides' labels; unknown where they do not agree."""
    if long[0] == "profit" and short[0] == "stop":
        return "long", "profit", long[1], long[2]
    if short[0] == "profit" and long[0] == "stop":
        return "short", "profit", short[1], short[2]
    if long[0] != "profit" and short[0] != "profit":
        return "neutral", "neutral", 0.0, max(long[2], short[2])
    return None, "unknown", None, None


def trend(price: np.ndarray) -> tuple[float, float, float]:
    """Slope, t-value of the constant and R squared of price on its place."""
    n, x = len(price), np.arange(len(price))
    mx, my = x.mean(), price.mean()
    sxx, syy, sxy = ((x - mx) ** 2).sum(), ((price - my) ** 2).sum(), ((x - mx) * (price - my)).sum()
    if n < 3 or sxx == 0:
        return math.nan, math.nan, math.nan
    slope = sxy / sxx
    error = math.sqrt(max(syy - slope * sxy, 0.0) / (n - 2) * (1 / n + mx * mx / sxx))
    return slope, (my - slope * mx) / error if error else math.nan, sxy * sxy / (sxx * syy) if syy else 1.0


class LabelRules:
    """How bars are labelled: stops and targets in price, windows in microseconds, fewest ticks of a window."""

    def __init__(self, risk: float, horizon_us: int, rewards: list[float], delay_us: int = 3_000_000, least: int = 30, with_trend: bool = False):
        self.risk, self.horizon, self.rewards, self.delay, self.least, self.with_trend = risk, horizon_us, rewards, delay_us, least, with_trend
        self.columns = LABEL_COLUMNS | (TREND_COLUMNS if with_trend else {})

    def label(self, bars: np.ndarray, close_at: np.ndarray, us: np.ndarray, price: np.ndarray, jma_: np.ndarray) -> pd.DataFrame:
        """Labels of bars from the clean ticks in [close + delay, close + horizon); windows of too few ticks stay empty."""
        rows = []
        for bar, start in zip(bars, close_at):
            end = start + self.horizon
            lo, hi = np.searchsorted(us, [start + self.delay, end], side="left")
            if hi - lo < self.least:
                rows.append((bar, *[None] * (len(self.columns) - 1)))
                continue
            found = outcomes(us[lo:hi], jma_[lo:hi], price[lo], self.risk, self.rewards)
            row = (bar, start, end, *final_label(side_label(found, "long", end), side_label(found, "short", end)))
            rows.append(row + trend(price[lo:hi]) if self.with_trend else row)
        return pd.DataFrame(rows, columns=list(self.columns)).astype({c: "Int64" for c, t in self.columns.items() if t == "long"})


def label_ticks(bars: DataFrame, ticks: DataFrame, keys: list[str], horizon_us: int, delay_us: int = 3_000_000) -> DataFrame:
    """(keys, bar, us, seq, price, jma): the clean ticks of each bar's window, as an interval join."""
    spans = bars.select(*keys, "bar", (F.col("close_at") + delay_us).alias("_a"), (F.col("close_at") + horizon_us).alias("_b"))
    clean = ticks.where("status LIKE 'clean%'").select(*keys, "us", "seq", "price", "jma")
    return interval(clean, spans, keys, "us", "_a", "_b", horizon_us, closed=False).select(*keys, "bar", "us", "seq", "price", "jma")


def label_bars(bars: DataFrame, ticks: DataFrame, keys: list[str], risk: float, horizon_us: int, rewards: list[float], delay_us: int = 3_000_000, least: int = 30, trend: bool = False) -> DataFrame:
    """Triple-barrier labels of bars; bars with fewer than ``least`` ticks get null labels.

    Bars and clean ticks of one key (a symbol's day) meet in one task and are matched by binary search: no row is repeated
    for the windows it lies in.
    """
    rules = LabelRules(risk, horizon_us, rewards, delay_us, least, trend)

    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left, right = left.sort_values("bar"), right.sort_values(["us", "seq"])
        found = rules.label(left["bar"].to_numpy(), left["close_at"].to_numpy(), *(right[c].to_numpy() for c in ("us", "price", "jma")))
        for k, v in reversed(list(zip(keys, key, strict=True))):
            found.insert(0, k, v)
        return found

    reachable(bars.sparkSession)
    clean = ticks.where("status LIKE 'clean%'").select(*keys, "us", "seq", "price", "jma")
    schema = ", ".join([_key_schema(bars, keys), *(f"{c} {t}" for c, t in rules.columns.items())])
    return _null_nans(bars.select(*keys, "bar", "close_at").groupBy(*keys).cogroup(clean.groupBy(*keys)).applyInPandas(run, schema))


class _Day(Kernel):
    """Features and labels of all bars of a key: its clean ticks are held until it ends."""

    def __init__(self, key: tuple, keys: list[str], rules: LabelRules):
        self.key, self.keys, self.rules, self.rows, self.bars, self.ticks = key, keys, rules, _BarRows(key, keys), [], []

    def feed(self, rows: pd.DataFrame) -> None:
        if (found := self.rows.feed(rows)) is not None:
            self.bars.append(found)
        self.ticks.append(rows.loc[rows["status"].str.startswith("clean"), ["us", "price", "jma"]])

    def end(self) -> pd.DataFrame | None:
        if not self.bars:
            return None
        bars, ticks = pd.concat(self.bars, ignore_index=True), pd.concat(self.ticks)
        labels = self.rules.label(bars["bar"].to_numpy(), bars["close_at"].to_numpy(), *(ticks[c].to_numpy() for c in ("us", "price", "jma")))
        return pd.concat([bars, labels.drop(columns="bar")], axis=1)


def bar_workflow(ticks: DataFrame, keys: list[str], rules: LabelRules) -> DataFrame:
    """Features and labels of bars in one fold over cut ticks."""
    schema = ", ".join([_key_schema(ticks, keys), *(f"{c} {t}" for c, t in (BAR_COLUMNS | {k: v for k, v in rules.columns.items() if k != "bar"}).items())])
    rows = ticks.select(*keys, "us", "seq", "price", "volume", "status", "jma", "bar", "bar_trigger")
    return _null_nans(ordered_fold(rows, keys, ["us", "seq"], lambda key: _Day(key, keys, rules), schema))


def bar_date_stats(bars: DataFrame, keys: list[str], date: str, imbalance: float) -> DataFrame:
    """Per date: bars, a quantile of their volume imbalance, mean and median duration (minutes) and range, the quantile's smooth and its last value."""
    minutes = (F.col("close_at") - F.col("open_at")) / 60_000_000
    rows = bars.groupBy(*keys, date).agg(
        F.count(F.lit(1)).alias("bar_count"), F.percentile(F.col("volume_imbalance").cast("double"), imbalance).alias("imbalance_thresh"), F.avg(minutes).alias("duration_min_mean"), F.percentile(minutes, 0.5).alias("duration_min_median"),
        F.avg("price_range").alias("price_range_mean"), F.percentile("price_range", 0.5).alias("price_range_median"),
    )
    out = jma(rows, keys, [date], "imbalance_thresh", 5, 1)
    return out.withColumn("imbalance_thresh_jma_lag", F.lag("imbalance_thresh_jma").over(ordered(keys, [date]))).dropna()


def futures_roll(df: DataFrame, keys: list[str], time: str, contract: str, ratio: bool = False, backward: bool = True) -> DataFrame:
    """``gap``: the running opening gap over contract changes, anchored at the end if ``backward``."""
    over = ordered(keys, [time])
    rolled = F.col(contract) != F.lag(contract).over(over)
    step = F.try_divide("open", F.lag("close").over(over)) if ratio else F.col("open") - F.lag("close").over(over)
    step = F.when(F.coalesce(rolled, F.lit(False)), step).otherwise(1.0 if ratio else 0.0)
    df = df.withColumn("_s", F.ln(step) if ratio else step)
    run = F.sum("_s").over(over.rowsBetween(Window.unboundedPreceding, 0))
    if backward:
        run = run - F.sum("_s").over(Window.partitionBy(*keys))
    return df.withColumn("gap", F.exp(run) if ratio else run).drop("_s")


def daily_volatility(df: DataFrame, keys: list[str], time: str, price: str, lookback: int, span: int) -> DataFrame:
    """Exponential deviation of returns against the last price strictly before ``time - lookback``."""
    from ..functions.joins import asof

    at = df.withColumn("_at", F.col(time) - lookback)
    past = asof(at, df.select(*keys, F.col(time).alias("_pt"), F.col(price).alias("_pp")), keys, "_at", "_pt", ["_pp"], strict=True).where("_pp IS NOT NULL")
    past = past.withColumn("ret", F.try_divide(price, F.col("_pp")) - 1).drop("_at", "_pp")

    def deviation(first: float) -> Step:
        keep = 1 - 2 / (span + 1)
        w = w2 = mean = m2 = 0.0

        def step(x: float) -> float:
            nonlocal w, w2, mean, m2
            w, w2, m2 = w * keep + 1, w2 * keep * keep + 1, m2 * keep
            d = x - mean
            mean += d / w
            m2 += d * (x - mean)
            lost = w - w2 / w
            return math.sqrt(m2 / lost) if lost > 1e-12 else math.nan

        return step

    return smoothed(past, keys, [time], "ret", deviation, "daily_vol")


def etf_trick(df: DataFrame, time: str) -> DataFrame:
    """Value of one unit in a rolled basket: ``df(time, sec, open, close, weight, cost, rate)``; one row a time.

    Holdings change where weights do; value moves by the close since the last one, or since the opening after a change.
    """
    over = Window.partitionBy("sec").orderBy(time)
    df = df.withColumn("_next", F.lead("open").over(over)).withColumn("_dc", F.col("close") - F.lag("close").over(over)).withColumn("_do", F.col("close") - F.col("open")).withColumn("_wp", F.lag("weight").over(over))
    df = df.withColumn("_abs", F.sum(F.abs("weight")).over(Window.partitionBy(time))).withColumn("_chg", F.max(F.when(F.col("_wp").isNull() | (F.col("_wp") != F.col("weight")), 1).otherwise(0)).over(Window.partitionBy(time)))
    unit = F.try_divide("weight", F.col("_next") * F.col("rate") * F.col("_abs"))
    grouped = df.groupBy(time).agg(F.max("_chg").alias("chg"), F.sort_array(F.collect_list(F.struct("sec", unit.alias("u"), "_dc", "_do", "rate", "cost"))).alias("a"))

    class Basket(Kernel):
        def __init__(self):
            self.k, self.held, self.fresh, self.n = 1.0, None, False, 0

        def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
            out = []
            for t, changed, parts in zip(rows[time], rows["chg"], rows["a"]):
                if self.held is not None:
                    move = sum(h * ((p["_do"] if self.fresh else p["_dc"]) or 0.0) * p["rate"] for h, p in zip(self.held, parts)) + sum(h * (p["cost"] or 0.0) for h, p in zip(self.held, parts))
                    self.k += move
                    out.append((t, self.k))
                self.fresh = False
                if changed or self.held is None:
                    self.held, self.fresh = [(p["u"] or 0.0) * self.k for p in parts], True
            return pd.DataFrame(out, columns=[time, "value"])

    return ordered_fold(grouped.withColumn("_all", F.lit(1)), ["_all"], [time], lambda key: Basket(), f"`{time}` {dict(df.dtypes)[time]}, value double")


def holding_period(df: DataFrame, keys: list[str], time: str, position: str, unit: float) -> DataFrame:
    """Weighted mean holding time per key, from an average entry time that additions move."""

    class Holding(Kernel):
        def __init__(self, key: tuple):
            self.key, self.entry, self.before, self.t0, self.sum, self.weight = key, 0.0, 0.0, None, 0.0, 0.0

        def feed(self, rows: pd.DataFrame) -> None:
            for t, p in zip(rows[time], rows[position]):
                self.t0 = t if self.t0 is None else self.t0
                now, p = (t - self.t0) / unit, float(p)
                change, old = p - self.before, self.before
                if change * old >= 0:
                    if p != 0:
                        self.entry = (self.entry * old + now * change) / p
                elif p * old < 0:
                    self.sum, self.weight = self.sum + (now - self.entry) * abs(old), self.weight + abs(old)
                    self.entry = now
                else:
                    self.sum, self.weight = self.sum + (now - self.entry) * abs(change), self.weight + abs(change)
                self.before = p

        def end(self) -> pd.DataFrame:
            return pd.DataFrame([(*self.key, self.sum / self.weight if self.weight else None)], columns=[*keys, "holding"])

    types = dict(df.dtypes)
    return ordered_fold(df.select(*keys, time, position), keys, [time], Holding, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", holding double")


