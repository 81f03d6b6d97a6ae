"""Moment-matched mixtures, reserve bet sizes, bet dispatch and optimal stopping levels of mean reversion."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf
from .backtest import bet_size_budget

Mixture = tuple[float, float, float, float, float]


def raw_moments(p: Mixture) -> list[float]:
    """First five moments of a mixture (mu_1, mu_2, sigma_1, sigma_2, p_1) of two normal distributions."""
    out = []
    for k in range(1, 6):
        one = lambda m, s: sum(math.comb(k, j) * m ** (k - j) * s**j * (math.prod(range(j - 1, 0, -2)) if j else 1) for j in range(0, k + 1, 2))  # noqa: E731, B023
        out.append(p[4] * one(p[0], p[2]) + (1 - p[4]) * one(p[1], p[3]))
    return out


def central_moment(raw: list[float], order: int) -> float:
    """Central moment from raw ones (of order 1 up)."""
    full = [1.0, *raw]
    return sum(math.comb(order, j) * full[j] * (-raw[0]) ** (order - j) for j in range(order + 1))


def raw_from_central(central: list[float], mean: float) -> list[float]:
    """Raw moments of orders 1 up from central ones (of order 1 up, the first being 0)."""
    full = [1.0, *central]
    return [sum(math.comb(k, j) * full[j] * mean ** (k - j) for j in range(k + 1)) for k in range(1, len(full))]


def _match(mu2: float, p: float, m: list[float], fifth: bool) -> Mixture | None:
    """One turn: the parameters that the first moments give for ``mu2`` and ``p``, and a new ``p`` from the next."""
    try:
        mu1 = (m[0] - (1 - p) * mu2) / p
        s2 = (m[2] + 2 * p * mu1**3 + (p - 1) * mu2**3 - 3 * mu1 * (m[1] + mu2**2 * (p - 1))) / (3 * (1 - p) * (mu2 - mu1))
        s1 = (m[1] - s2 - mu2**2) / p + s2 + mu2**2 - mu1**2
        if s2 < 0 or s1 < 0:
            return None
        if fifth:
            rest = 6 * s2**2 + (m[3] - p * (3 * s1**2 + 6 * s1 * mu1**2 + mu1**4)) / (1 - p)
            square = math.sqrt(rest) - 3 * s2 if rest >= 0 else -1.0
            if square < 0:
                return None
            mu2 = math.sqrt(square)
            a, b = (15 * v**2 * u + 10 * v * u**3 + u**5 for u, v in ((mu1, s1), (mu2, s2)))
            p = (m[4] - b) / (a - b)
        else:
            a = 3 * (s1**2 - s2**2) + 6 * (s1 * mu1**2 - s2 * mu2**2) + mu1**4 - mu2**4
            p = (m[3] - 3 * s2**2 - 6 * s2 * mu2**2 - mu2**4) / a
    except (ZeroDivisionError, OverflowError):
        return None
    if not 0 <= p <= 1 or isinstance(p, complex):
        return None
    return mu1, mu2, math.sqrt(s1), math.sqrt(s2), p


def fit_mixture(moments: list[float], rng: np.random.Generator, epsilon: float = 1e-5, factor: float = 5.0, fifth: bool = True, turns: int = 10_000) -> tuple[Mixture, float] | None:
    """Best match over a grid of second means above the mean, each from a random probability, and its squared error over five moments."""
    spread = math.sqrt(max(central_moment(moments, 2), 0.0))
    best = None
    for i in range(1, int(1 / max(epsilon, 1e-3))):
        mu2 = moments[0] + i * max(epsilon, 1e-3) * factor * spread
        p = rng.uniform()
        for _ in range(turns):
            found = _match(mu2, p, moments, fifth)
            if found is None:
                break
            error = sum((a - b) ** 2 for a, b in zip(moments, raw_moments(found), strict=True))
            if best is None or error < best[1]:
                best = found, error
            if abs(found[4] - p) < epsilon:
                break
            p, mu2 = found[4], found[1] if fifth else mu2
    return best


def likeliest(runs: np.ndarray, grid: int = 10_000) -> np.ndarray:
    """Mode of each column by a Gaussian kernel density (Scott's width)."""
    out = []
    for x in runs.T:
        width = x.std(ddof=1) * len(x) ** (-0.2) if len(x) > 1 else 0.0
        if width == 0:
            out.append(x[0])
            continue
        at = np.linspace(x.min(), x.max(), grid)
        density = sum(np.exp(-0.5 * ((at - v) / width) ** 2) for v in x)
        out.append(at[int(np.argmax(density))])
    return np.array(out)


def mixture_cdf(x: Column, p: Mixture) -> Column:
    return p[4] * normal_cdf((x - p[0]) / p[2]) + (1 - p[4]) * normal_cdf((x - p[1]) / p[3])


def bet_size_reserve(spans: DataFrame, keys: list[str], p: Mixture) -> DataFrame:
    """``bet_size`` from net concurrent bets under a fitted mixture: how far the distribution function lies beyond its value at 0."""
    rows = bet_size_budget(spans, keys).withColumn("c_t", F.col("longs") - F.col("shorts"))
    at, zero = mixture_cdf(F.col("c_t").cast("double"), p), mixture_cdf(F.lit(0.0), p)
    return rows.withColumn("bet_size", F.when(F.col("c_t") >= 0, F.try_divide(at - zero, 1 - zero)).otherwise(F.try_divide(at - zero, zero)))


def concurrency_moments(spans: DataFrame, keys: list[str]) -> list[float]:
    """First five raw moments of the net concurrent bets, summed by Spark."""
    c = (F.col("longs") - F.col("shorts")).cast("double")
    row = bet_size_budget(spans, keys).agg(*[F.avg(F.pow(c, F.lit(float(k)))).alias(f"m{k}") for k in range(1, 6)]).first()
    return [float(x) for x in row]


def bet_size(divergence: Column, w: Column | float, func: str = "sigmoid") -> Column:
    """Size of a bet on a price divergence; ``func`` is sigmoid or power."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    if func == "sigmoid":
        return divergence / F.sqrt(w + divergence * divergence)
    if func == "power":
        return F.when(divergence == 0, 0.0).otherwise(F.signum(divergence) * F.pow(F.abs(divergence), w))
    raise ValueError(f"unknown function {func}")


def target_position(forecast: Column, market: Column, w: Column | float, most: int, func: str = "sigmoid") -> Column:
    """Position by bet size, cut towards 0."""
    return (bet_size(forecast - market, w, func) * most).cast("long")


def inverse_price(forecast: Column, size: Column, w: Column | float, func: str = "sigmoid") -> Column:
    """Price at which a bet has that size."""
    w = w if isinstance(w, Column) else F.lit(float(w))
    if func == "sigmoid":
        return forecast - size * F.sqrt(F.try_divide(w, 1 - size * size))
    if func == "power":
        return F.when(size == 0, forecast).otherwise(forecast - F.signum(size) * F.pow(F.abs(size), F.try_divide(F.lit(1.0), w)))
    raise ValueError(f"unknown function {func}")


def limit_price(target: Column, position: Column, forecast: Column, w: Column | float, most: int, func: str = "sigmoid") -> Column:
    """Mean price of the positions from the one after ``position`` to ``target``, full ones left out; null without a step."""
    sign = F.signum((target - position).cast("double")).cast("long")
    between = F.filter(F.sequence(position + sign, target, F.when(sign != 0, sign).otherwise(F.lit(1).cast("long"))), lambda j: F.abs(j) < most)
    total = F.aggregate(between, F.lit(0.0), lambda s, j: s + inverse_price(forecast, j.cast("double") / float(most), w, func))
    return F.when(sign != 0, F.try_divide(total, F.size(between)))


def calibrate(divergence: Column, size: Column, func: str = "sigmoid") -> Column:
    """The coefficient that gives a divergence that size."""
    if func == "sigmoid":
        return divergence * divergence * (F.try_divide(F.lit(1.0), size * size) - 1)
    if func == "power":
        return F.try_divide(F.ln(F.abs(size)), F.ln(F.abs(divergence)))
    raise ValueError(f"unknown function {func}")


class StoppingLevels:
    """Optimal levels to liquidate and enter a mean-reverting position of discount rate ``r`` and cost ``c``, with and without a stop loss.

    The two fundamental solutions are integrals over u > 0; u = w ** (mu / r) takes their singularity at 0 away.
    """

    def __init__(self, theta: float, mu: float, sigma_sq: float, r: float | tuple[float, float], c: float | tuple[float, float], stop: float | None = None):
        self.theta, self.mu, self.root, self.spread, self.stop = theta, mu, math.sqrt(2 * mu / sigma_sq), math.sqrt(sigma_sq), stop
        self.r, self.c = (r, r) if isinstance(r, (int, float)) else r, (c, c) if isinstance(c, (int, float)) else c
        nodes, weights = np.polynomial.legendre.leggauss(64)
        edges = np.linspace(0, 1, 41)
        self.nodes = np.concatenate([(a + b) / 2 + (b - a) / 2 * nodes for a, b in zip(edges, edges[1:])])
        self.weights = np.concatenate([(b - a) / 2 * weights for a, b in zip(edges, edges[1:])])

    def _integral(self, x: float, rate: float, sign: float, extra: int) -> float:
        tilt = sign * self.root * (x - self.theta)
        top = max(tilt, 0.0) + 12.0
        power = rate / self.mu
        w = self.nodes * top**power
        u = w ** (1 / power)
        peak = max(tilt, 0.0) ** 2 / 2
        return float((self.weights * top**power / power * u**extra * np.exp(tilt * u - u * u / 2 - peak)).sum() * math.exp(min(peak, 700)))

    def f(self, x: float, rate: float, slope: bool = False) -> float:
        return self._integral(x, rate, 1.0, int(slope)) * (self.root if slope else 1)

    def g(self, x: float, rate: float, slope: bool = False) -> float:
        return self._integral(x, rate, -1.0, int(slope)) * (-self.root if slope else 1)

    @staticmethod
    def _root(function, low: float, high: float) -> float:
        a, b = function(low), function(high)
        if a * b > 0:  # the bracket holds none at its ends: look inside it
            grid = np.linspace(low, high, 200)
            values = [function(x) for x in grid]
            pair = next(((x, y) for x, y, p, q in zip(grid, grid[1:], values, values[1:]) if p * q <= 0), None)
            if pair is None:
                raise ValueError("no level in the bracket")
            low, high = pair
            a = function(low)
        for _ in range(200):
            mid = (low + high) / 2
            m = function(mid)
            if a * m <= 0:
                high = mid
            else:
                low, a = mid, m
        return (low + high) / 2

    def _bracket(self) -> tuple[float, float]:
        return self.theta - 6 * self.spread, self.theta + 6 * self.spread

    def liquidation(self) -> float:
        r, c = self.r[0], self.c[0]
        return self._root(lambda x: self.f(x, r) - (x - c) * self.f(x, r, True), *self._bracket())

    def value(self, x: float, slope: bool = False) -> float:
        """Expected discounted value of liquidating from ``x``."""
        b, r, c = self.liquidation(), self.r[0], self.c[0]
        return (1.0 if slope else x - c) if x >= b else (b - c) * self.f(x, r, slope) / self.f(b, r)

    def entry(self) -> float:
        r, c = self.r[1], self.c[1]
        b = self.liquidation()
        top = (b - self.c[0]) / self.f(b, self.r[0])
        v = lambda x, slope: (1.0 if slope else x - self.c[0]) if x >= b else top * self.f(x, self.r[0], slope)
        return self._root(lambda x: self.g(x, r) * (v(x, True) - 1) - self.g(x, r, True) * (v(x, False) - x - c), *self._bracket())

    def liquidation_stop(self) -> float:
        stop, r, c = self.stop, self.r[0], self.c[0]
        f0, g0 = self.f(stop, r), self.g(stop, r)

        def equation(b: float) -> float:
            f, g = self.f(b, r), self.g(b, r)
            return ((stop - c) * g - (b - c) * g0) * self.f(b, r, True) + ((b - c) * f0 - (stop - c) * f) * self.g(b, r, True) - (g * f0 - g0 * f)

        return self._root(equation, stop + 1e-6 * self.spread, self.theta + 6 * self.spread)

    def value_stop(self, x: float, slope: bool = False, b: float | None = None) -> float:
        b = self.liquidation_stop() if b is None else b
        stop, r, c = self.stop, self.r[0], self.c[0]
        if not stop < x < b:
            return 1.0 if slope else x - c
        fb, gb, f0, g0 = self.f(b, r), self.g(b, r), self.f(stop, r), self.g(stop, r)
        scale = fb * g0 - f0 * gb
        return (((b - c) * g0 - (stop - c) * gb) * self.f(x, r, slope) + ((stop - c) * fb - (b - c) * f0) * self.g(x, r, slope)) / scale

    def entry_stop(self) -> tuple[float, float]:
        """Interval of prices at which to enter: where the gain over the cost is largest, discounted from below and from above."""
        r, c = self.r[1], self.c[1]
        b = self.liquidation_stop()
        v = lambda x, slope=False: self.value_stop(x, slope, b)
        high = self._root(lambda x: self.g(x, r) * (v(x, True) - 1) - self.g(x, r, True) * (v(x) - x - c), self.stop + 1e-4 * self.spread, b - 1e-6 * self.spread)
        low = self._root(lambda x: self.f(x, r) * (v(x, True) - 1) - self.f(x, r, True) * (v(x) - x - c), self.stop + 1e-6 * self.spread, high)
        return low, high
