"""Chart templates, Fourier components and weighted densities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fold import Kernel, ordered_fold
from ..session import reachable

# Published 10 by 10 flag templates, highest decile first; the bear templates are these upside down.
LEIGH_BULL = [
    [0.5, 0, -1, -1, -1, -1, -1, -1, -1, 0],
    [1, 0.5, 0, -0.5, -1, -1, -1, -1, -0.5, 0],
    [1, 1, 0.5, 0, -0.5, -0.5, -0.5, -0.5, 0, 0.5],
    [0.5, 1, 1, 0.5, 0, -0.5, -0.5, -0.5, 0, 1],
    [0, 0.5, 1, 1, 0.5, 0, 0, 0, 0.5, 1],
    [0, 0, 0.5, 1, 1, 0.5, 0, 0, 1, 1],
    [-0.5, 0, 0, 0.5, 1, 1, 0.5, 0.5, 1, 1],
    [-0.5, -1, 0, 0, 0.5, 1, 1, 1, 1, 0],
    [-1, -1, -1, -0.5, 0, 0.5, 1, 1, 0, -2],
    [-1, -1, -1, -1, -1, 0, 0.5, 0.5, -2, -2.5],
]
CERVELLOROYO_BULL = [
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 0, -1, -1, -1, -1, -1, -1],
    [0, 0, 0, -1, -2, -2, -2, -2, -2, -2],
    [0, 0, -1, -3, -3, -3, -3, -3, -3, -3],
    [0, -1, -3, -5, -5, -5, -5, -5, -5, -5],
    [0, -1, -5, -5, -5, -5, -5, -5, -5, -5],
    [0, -1, -5, -5, -5, -5, -5, -5, -5, -5],
    [5, -1, -5, -5, -5, -5, -5, -5, -5, -5],
]
TEMPLATES = {"leigh_bull": LEIGH_BULL, "leigh_bear": LEIGH_BULL[::-1], "cervelloroyo_bull": CERVELLOROYO_BULL, "cervelloroyo_bear": CERVELLOROYO_BULL[::-1]}


def flag_scores(windows: np.ndarray, template: np.ndarray) -> np.ndarray:
    """Template weight of each window (rows): shares of its prices in ten deciles by ten stretches of time."""
    m, n = windows.shape
    edges = np.percentile(windows, np.linspace(10, 100, 10), axis=1)
    decile = (windows[None, :, :] > edges[:, :, None]).sum(0)
    size = np.full(10, n // 10)
    size[: n % 10] += 1
    stretch = np.repeat(np.arange(10), size)
    return (template[9 - np.minimum(decile, 9), stretch[None, :]] / size[stretch][None, :]).sum(1)


class _Flags(Kernel):
    def __init__(self, value: str, window: int, template: np.ndarray):
        self.value, self.window, self.template, self.tail = value, window, template, np.empty(0)

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.concatenate([self.tail, rows[self.value].to_numpy(float)])
        first = len(self.tail)
        out = np.full(len(rows), np.nan)
        if len(x) > self.window:
            starts = np.arange(max(self.window, first), len(x))
            for part in np.array_split(starts, max(1, len(starts) * self.window // 2_000_000)):
                out[part - first] = flag_scores(np.stack([x[k - self.window : k] for k in part]), self.template)
        self.tail = x[-self.window :]
        return rows.assign(flag=out)


def matrix_flags(df: DataFrame, keys: list[str], order: list[str], value: str, window: int, template: str | list[list[float]] = "leigh_bull", threshold: float | None = None) -> DataFrame:
    """``flag``: how well the ``window`` rows before a row follow a 10 by 10 template; with a threshold 1 or -1. Rows without a full window go."""
    weights = np.array(TEMPLATES[template] if isinstance(template, str) else template, float)
    if weights.shape != (10, 10) or np.isnan(weights).any() or window < 10:
        raise ValueError("a template is 10 by 10 numbers, a window 10 rows or more")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", flag double"
    out = ordered_fold(df, keys, order, lambda key: _Flags(value, window, weights), schema).where(F.col("flag").isNotNull() & ~F.isnan("flag"))
    return out if threshold is None else out.withColumn("flag", F.when(F.col("flag") >= threshold, 1.0).otherwise(-1.0))


def low_frequencies(x: np.ndarray, components: int) -> np.ndarray:
    """The series with all but its ``components`` lowest frequencies (from either end of the spectrum) removed; its real part."""
    spectrum = np.fft.fft(x)
    spectrum[components : len(x) - components] = 0
    return np.fft.ifft(spectrum).real


def fft_components(df: DataFrame, keys: list[str], order: str, value: str, components: tuple[int, ...] = (3, 6, 9, 100)) -> DataFrame:
    """keys, order and ``fft_n`` for each number of components; a key's series (8 bytes a row) is one task."""
    types = dict(df.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        x = pdf[value].to_numpy(float)
        return pdf[[*keys, order]].assign(**{f"fft_{n}": low_frequencies(x, n) for n in components})

    reachable(df.sparkSession)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in [*keys, order]), *(f"fft_{n} double" for n in components)])
    return df.select(*keys, order, value).groupBy(*keys).applyInPandas(run, schema)


def kernel_width(x: np.ndarray) -> float:
    """Silverman's width: 0.9 times the smaller of the deviation and the normal quartile range, by the fifth root of the count."""
    quartiles = (np.percentile(x, 75) - np.percentile(x, 25)) / 1.349
    spread = min(x.std(ddof=1), quartiles) if quartiles > 0 else x.std(ddof=1)
    return 0.9 * spread * len(x) ** -0.2


def density_quantiles(x: np.ndarray, weights: np.ndarray, quantiles: list[float]) -> list[float]:
    """Quantiles of a weighted Gaussian kernel density; NaN for fewer than two different values."""
    w, h = weights / weights.sum() if weights.sum() else weights, kernel_width(x) if len(x) > 1 else 0.0
    if not h > 0 or not w.sum():
        return [math.nan] * len(quantiles)
    erf = np.vectorize(math.erf)
    out = []
    for q in quantiles:
        low, high = x.min() - 10 * h, x.max() + 10 * h
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if (w * 0.5 * (1 + erf((mid - x) / h / math.sqrt(2)))).sum() < q else (low, mid)
        out.append((low + high) / 2)
    return out


def weighted_kde(df: DataFrame, keys: list[str], value: str = "price", weight: str = "volume") -> DataFrame:
    """``kd_10``, ``kd_50``, ``kd_90`` of each group (one bar's ticks)."""
    types = dict(df.dtypes)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(*key, *density_quantiles(pdf[value].to_numpy(float), pdf[weight].to_numpy(float), [0.1, 0.5, 0.9]))], columns=[*keys, "kd_10", "kd_50", "kd_90"])

    reachable(df.sparkSession)
    out = df.select(*keys, value, weight).groupBy(*keys).applyInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", kd_10 double, kd_50 double, kd_90 double")
    return out.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("kd_10", "kd_50", "kd_90")})
