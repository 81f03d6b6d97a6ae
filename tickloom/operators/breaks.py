"""Structural breaks, fractional differences and entropies."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.series import by_end_blocks
from ..functions.windows import ordered
from ..session import reachable


def chow_dfc(df: DataFrame, keys: list[str], time: str, value: str, least: int) -> DataFrame:
    """Dickey-Fuller-Chow statistic at each candidate break: the t-value of y(t-1) switched on after it.

    Suffix sums by window give every candidate's regression in one pass; ``least`` rows stay on each side.
    """
    over = ordered(keys, [time])
    df = df.withColumn("_x", F.lag(value).over(over)).withColumn("_d", F.col(value) - F.lag(value).over(over)).where("_x IS NOT NULL")
    # Sums of later rows: the order turned round, so that the frame grows row by row.
    after, every = Window.partitionBy(*keys).orderBy(F.col(time).desc()).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*keys)
    x, d = F.col("_x"), F.col("_d")
    df = df.withColumns({"_xy": F.sum(x * d).over(after), "_xx": F.sum(x * x).over(after), "_yy": F.sum(d * d).over(every), "_n": F.count(F.lit(1)).over(every), "_k": F.row_number().over(over)})
    b = F.try_divide("_xy", "_xx")
    variance = (F.col("_yy") - b * F.col("_xy")) / (F.col("_n") - 1)
    df = df.withColumn("dfc", F.try_divide(b, F.sqrt(F.try_divide(F.greatest(variance, F.lit(0.0)), F.col("_xx")))))
    return df.where((F.col("_k") >= least) & (F.col("_n") - F.col("_k") >= least)).select(*keys, time, "dfc")


def csw_stats(y: np.ndarray, lo: int, hi: int, two_sided: bool = True) -> dict[str, np.ndarray]:
    """Largest standardised departure of rows lo to hi from every earlier level, and its critical value."""
    best, critical = np.full(hi - lo, np.nan), np.full(hi - lo, np.nan)
    square = np.concatenate([[0.0], np.cumsum(np.diff(y[:hi]) ** 2)])
    for t in range(max(2, lo), hi):
        variance = square[t] / (t - 1)
        if variance <= 0:
            continue
        gap = y[t] - y[:t]
        s = (np.abs(gap) if two_sided else gap) / (variance * np.sqrt(t - np.arange(t)))
        k = int(np.argmax(s))
        best[t - lo], critical[t - lo] = s[k], math.sqrt(4.6 + math.log(t - k))
    return {"stat": best, "critical": critical}


def csw_cusum(df: DataFrame, keys: list[str], time: str, value: str, two_sided: bool = True) -> DataFrame:
    """Chu-Stinchcombe-White statistic and its critical value at each row of a key's whole series."""
    return by_end_blocks(df, keys, time, value, lambda y, lo, hi: csw_stats(y, lo, hi, two_sided), ["stat", "critical"])


def get_betas(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares coefficients and their covariance; NaN where the columns are dependent."""
    k = x.shape[1]
    xx = x.T @ x
    if len(y) <= k or np.linalg.matrix_rank(xx) < k:
        return np.full(k, np.nan), np.full((k, k), np.nan)
    inverse = np.linalg.inv(xx)
    b = inverse @ (x.T @ y)
    e = y - x @ b
    return b, inverse * (e @ e) / (len(y) - k)


def adf_regression(y: np.ndarray, model: str, lags: int = 0, constant: bool = True) -> tuple[np.ndarray, np.ndarray, int]:
    """Regressors (the tested one first), target, and rows of ``y`` before the first row of both.

    ``linear`` and ``quadratic`` regress the change on the last level, lagged changes, trend and its square; ``none`` leaves the trend out;
    the ``sm_`` models regress the level (or its logarithm) on functions of time.
    """
    change = np.diff(y)
    n = len(change) - lags
    if n < 1:
        return np.empty((0, 1)), np.empty(0), lags + 1
    trend, one = np.arange(n, dtype=float), np.ones(n)
    if model.startswith("sm_"):
        level = y[lags + 1 :]
        with np.errstate(divide="ignore", invalid="ignore"):
            columns = {"sm_poly_1": [trend**2, one, trend], "sm_poly_2": [trend**2, one, trend], "sm_exp": [trend, one], "sm_power": [np.log(trend), one]}[model]
            return np.column_stack(columns), level if model == "sm_poly_1" else np.log(level), lags + 1
    columns = [y[lags:-1], *(change[lags - k : len(change) - k] for k in range(1, lags + 1)), *([one] if constant else [])]
    columns += {"none": [], "linear": [trend], "quadratic": [trend, trend**2]}[model]
    return np.column_stack(columns), change[lags:], lags + 1


def adf_stats(y: np.ndarray, lo: int, hi: int, least: int, model: str = "linear", lags: int = 0, constant: bool = True, phi: float = 0.0) -> dict[str, np.ndarray]:
    """Sup-ADF at rows lo to hi: the largest t-value over all start points at least ``least`` rows before.

    Sums over windows run backwards from each end, so that no difference of long sums loses digits.
    """
    x, target, skipped = adf_regression(y[:hi], model, lags, constant)
    k = x.shape[1]
    out = np.full(hi - lo, np.nan)
    for t in range(lo, hi):
        rows = t - skipped + 1
        if rows < max(least, k + 1):
            continue
        own, want = x[:rows][::-1], target[:rows][::-1]
        fine = np.isfinite(own).all(1) & np.isfinite(want)
        if not fine.all():  # log of time 0 and the like: windows stop before it
            rows = int(np.argmin(fine))
            own, want = own[:rows], want[:rows]
            if rows < max(least, k + 1):
                continue
        scale = np.maximum(np.abs(own).max(0), 1e-300)
        own = own / scale
        first = max(least, k + 1) - 1
        xx = np.cumsum(own[:, :, None] * own[:, None, :], axis=0)[first:]
        xy, yy = np.cumsum(own * want[:, None], axis=0)[first:], np.cumsum(want**2)[first:]
        n = np.arange(first + 1, rows + 1)
        good = np.linalg.cond(xx) < 1e12
        if not good.any():
            continue
        xx, xy, yy, n = xx[good], xy[good], yy[good], n[good]
        inverse = np.linalg.inv(xx)
        b = (inverse @ xy[:, :, None])[:, :, 0]
        error = np.sqrt(np.maximum((yy - (b * xy).sum(1)) / (n - k) * inverse[:, 0, 0], 0))
        stat = b[:, 0] / np.where(error > 0, error, np.nan)
        if model.startswith("sm_"):
            stat = np.abs(stat) / n**phi
        if np.isfinite(stat).any():
            out[t - lo] = np.nanmax(stat)
    return {"sadf": out}


def sadf(df: DataFrame, keys: list[str], time: str, value: str, least: int = 20, model: str = "linear", lags: int = 0, constant: bool = True, phi: float = 0.0) -> DataFrame:
    """Supremum augmented Dickey-Fuller statistic at each row of a key's whole series."""
    return by_end_blocks(df, keys, time, value, lambda y, lo, hi: adf_stats(y, lo, hi, least, model, lags, constant, phi), ["sadf"], 64)


def ffd_weights(d: float, threshold: float, most: int) -> list[float]:
    """Weights of the fixed-width fractional difference, newest first."""
    out = [1.0]
    for k in range(1, most):
        w = -out[-1] * (d - k + 1) / k
        if abs(w) < threshold:
            break
        out.append(w)
    return out


def fracdiff_ffd(df: DataFrame, keys: list[str], time: str, value: str, d: float, threshold: float = 1e-3, most: int = 50) -> DataFrame:
    """Fixed-width fractional difference: a sum of weighted lags, null until the width is full."""
    over = ordered(keys, [time])
    total = sum((F.lag(value, k).over(over) * w for k, w in enumerate(ffd_weights(d, threshold, most))), F.lit(0.0))
    return df.withColumn("fracdiff", total)


def fracdiff(df: DataFrame, keys: list[str], time: str, value: str, d: float, threshold: float = 0.01) -> DataFrame:
    """Expanding fractional difference; rows whose weight share lost exceeds the threshold are skipped. Convolution per key."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        x = pdf[value].ffill().to_numpy(float)
        n = len(x)
        k = np.arange(1, n)
        w = np.concatenate([[1.0], np.cumprod((k - 1 - d) / k)])
        share = np.cumsum(np.abs(w[::-1]))  # weight of the oldest rows first
        skip = int((share / share[-1] > threshold).sum())
        size = 1 << max(1, (2 * n - 1).bit_length())
        out = np.fft.irfft(np.fft.rfft(w, size) * np.fft.rfft(x, size), size)[:n]
        return pdf[[*keys, time]].assign(fracdiff=out).iloc[skip:]

    reachable(df.sparkSession)
    return df.select(*keys, time, value).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in [*keys, time]) + ", fracdiff double")


def shannon(message: Column) -> Column:
    """Entropy in bits of the letters of a message; JVM only."""
    letters = F.filter(F.split(message, ""), lambda c: c != "")
    n = F.size(letters).cast("double")
    return F.aggregate(F.array_distinct(letters), F.lit(0.0), lambda a, c: a - F.size(F.filter(letters, lambda x: x == c)) / n * F.log2(F.size(F.filter(letters, lambda x: x == c)) / n))


def _lempel_ziv(s: str) -> float:
    if not s:
        return 0.0
    seen, at = set(), 0
    while at < len(s):
        end = at + 1
        while s[at:end] in seen and end < len(s):
            end += 1
        seen.add(s[at:end])
        at = end
    return len(seen) / len(s)


def _plug_in(s: str, w: int) -> float:
    words = [s[i - w : i] for i in range(w, len(s))]
    if not words:
        return 0.0
    counts = np.array(list(pd.Series(words).value_counts()), float) / len(words)
    return float(-(counts * np.log2(counts)).sum() / w)


def _kontoyiannis(s: str, window: int | None = None) -> float:
    total, n = 0.0, 0
    points = range(1, len(s) // 2 + 1) if window is None else range(window, len(s) - window + 1)
    for i in points:
        back = i if window is None else window
        longest = 0
        for length in range(1, back + 1):
            if s[i : i + length] in s[max(0, i - back) : i] and i + length <= len(s):
                longest = length
            else:
                break
        total += math.log2(back + 1) / (longest + 1)
        n += 1
    return total / n if n else 0.0


def lempel_ziv(message: Column) -> Column:
    """Share of distinct phrases in a left-to-right parse; Arrow."""

    @pandas_udf("double")
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda s: None if s is None else _lempel_ziv(s))

    return run(message)


def plug_in(message: Column, word: int = 2) -> Column:
    """Entropy of overlapping words per letter (the last word left out); Arrow."""

    @pandas_udf("double")
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda s: None if s is None else _plug_in(s, word))

    return run(message)


def kontoyiannis(message: Column, window: int | None = None) -> Column:
    """Longest-match entropy over an expanding or fixed window; Arrow."""

    @pandas_udf("double")
    def run(messages: pd.Series) -> pd.Series:
        return messages.map(lambda s: None if s is None else _kontoyiannis(s, window))

    return run(message)


def encode_sides(sides: Column) -> Column:
    """An array of tick sides as letters."""
    return F.array_join(F.transform(sides, lambda s: F.when(s == 1, "a").when(s == -1, "b").when(s == 0, "c").otherwise(F.raise_error(F.lit("unknown side")))), "")


def encode_nearest(values: Column, keys: list[float]) -> Column:
    """An array of numbers as the letters of their nearest keys, first on ties."""
    table = F.array(*[F.struct(F.lit(float(k)).alias("k"), F.lit(chr(97 + i)).alias("c")) for i, k in enumerate(keys)])
    nearest = lambda v: F.array_min(F.transform(table, lambda e, i: F.struct(F.abs(e["k"] - v).alias("d"), i.alias("i"), e["c"].alias("c"))))["c"]
    return F.array_join(F.transform(values, nearest), "")


def quantile_keys(df: DataFrame, value: str, n: int) -> list[float]:
    """``n`` quantiles from 1 % to the maximum; n numbers reach the driver."""
    return list(df.agg(F.percentile(value, [0.01 + (1 - 0.01) * k / (n - 1) for k in range(n)]).alias("q")).first()["q"])


def sigma_keys(low: float, high: float, step: float) -> list[float]:
    out = np.arange(low, high, step).tolist()
    if len(out) > 256:
        raise ValueError("more than 256 letters; choose a larger step")
    return out
