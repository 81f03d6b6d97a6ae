"""Dependence, covariance and networks over long matrices, and k-by-k kernels in numpy.

Pair statistics are sums over a self join by time: one row per time and pair of columns, as
the result has a number for each pair. Kernels take the k-by-k result: its square must fit the
driver, so columns are instruments or features (thousands), never rows.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fold import Kernel, ordered_fold
from ..functions.windows import ordered


def pairs(df: DataFrame, time: str, name: str, value: str) -> DataFrame:
    """(i, j, x, y) for all i <= j at equal times."""
    left = df.select(time, F.col(name).alias("i"), F.col(value).alias("x"))
    right = df.select(time, F.col(name).alias("j"), F.col(value).alias("y"))
    return left.join(right, time).where("i <= j")


def correlations(df: DataFrame, time: str, name: str, value: str) -> DataFrame:
    return pairs(df, time, name, value).groupBy("i", "j").agg(F.corr("x", "y").alias("rho"))


def covariances(df: DataFrame, time: str, name: str, value: str) -> DataFrame:
    """Maximum-likelihood covariance (divided by n)."""
    return pairs(df, time, name, value).groupBy("i", "j").agg(F.covar_pop("x", "y").alias("cov"))


def semi_covariances(df: DataFrame, time: str, name: str, value: str, target: float = 0.0) -> DataFrame:
    """Products of shortfalls, over the number of all cells."""
    down = df.withColumn(value, F.least(F.col(value) - target, F.lit(0.0)))
    cells = df.agg(F.count(F.lit(1))).first()[0]
    return pairs(down, time, name, value).groupBy("i", "j").agg((F.sum(F.col("x") * F.col("y")) / cells).alias("cov"))


def exponential_covariances(df: DataFrame, time: str, name: str, value: str, span: int) -> DataFrame:
    """Last exponentially weighted mean of the demeaned products."""
    alpha = 2 / (span + 1)
    demeaned = df.withColumn(value, F.col(value) - F.avg(value).over(Window.partitionBy(name)))
    both = pairs(demeaned, time, name, value)
    age = F.row_number().over(Window.partitionBy("i", "j").orderBy(F.col(time).desc())) - 1
    w = F.pow(F.lit(1 - alpha), age)
    return both.withColumn("w", w).groupBy("i", "j").agg((F.sum(F.col("w") * F.col("x") * F.col("y")) / F.sum("w")).alias("cov"))


def to_correlations(cov: DataFrame) -> DataFrame:
    """Scaled by the diagonal, clipped to [-1, 1]."""
    d = cov.where("i = j").select(F.col("i").alias("k"), F.sqrt("cov").alias("s"))
    a, b = d.select(F.col("k").alias("i"), F.col("s").alias("si")), d.select(F.col("k").alias("j"), F.col("s").alias("sj"))
    rho = F.try_divide("cov", F.col("si") * F.col("sj"))
    return cov.join(a, "i").join(b, "j").select("i", "j", F.greatest(F.least(rho, F.lit(1.0)), F.lit(-1.0)).alias("rho"))


def distances(rho: Column, kind: str = "angular") -> Column:
    inner = {"angular": (1 - rho) / 2, "absolute_angular": 1 - F.abs(rho), "squared_angular": 1 - rho * rho}[kind]
    return F.round(F.sqrt(F.greatest(inner, F.lit(0.0))), 5)


def spearman(df: DataFrame, time: str, name: str, value: str) -> DataFrame:
    place = F.rank().over(Window.partitionBy(name).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(name, value)) - 1) / 2.0
    return correlations(df.withColumn("_rank", place), time, name, "_rank")


def optimal_bins(n: Column, rho: Column | None = None) -> Column:
    """Histogram bins for one variable, or for two of correlation ``rho``."""
    if rho is None:
        z = F.pow(8 + 324 * n + 12 * F.sqrt(36 * n + 729 * n * n), 1 / 3)
        return F.round(z / 6 + 2 / (3 * z) + 1 / 3).cast("int")
    return F.round(F.sqrt(F.lit(0.5)) * F.sqrt(1 + F.sqrt(1 + 24 * n / (1 - rho * rho)))).cast("int")


def _histogram(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    every = Window.partitionBy(F.lit(0))
    bounds = df.agg(F.min(x).alias("ax"), F.max(x).alias("bx"), F.min(y).alias("ay"), F.max(y).alias("by"))
    cell = lambda c, a, b: F.least(F.floor(F.try_divide((F.col(c) - F.col(a)) * bins, F.col(b) - F.col(a))), F.lit(bins - 1).cast("long"))
    counts = df.join(F.broadcast(bounds)).groupBy(cell(x, "ax", "bx").alias("u"), cell(y, "ay", "by").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumns({"p": F.col("n") / F.sum("n").over(every), "pu": F.sum("n").over(Window.partitionBy("u")) / F.sum("n").over(every), "pv": F.sum("n").over(Window.partitionBy("v")) / F.sum("n").over(every)})


def information(df: DataFrame, x: str, y: str, bins: int) -> DataFrame:
    """Histogram mutual information (plain and over the smaller entropy) and variation of information."""
    cells = _histogram(df, x, y, bins)
    out = cells.agg(F.sum(F.col("p") * F.ln(F.col("p") / (F.col("pu") * F.col("pv")))).alias("mutual"), F.sum(-F.col("p") * F.ln("pu")).alias("hx"), F.sum(-F.col("p") * F.ln("pv")).alias("hy"))
    return out.select("mutual", F.try_divide("mutual", F.least("hx", "hy")).alias("normalised"), (F.col("hx") + F.col("hy") - 2 * F.col("mutual")).alias("variation"))


def distance_correlation(x: np.ndarray, y: np.ndarray) -> float:
    a, b = np.abs(x[:, None] - x[None, :]), np.abs(y[:, None] - y[None, :])
    centre = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = centre(a), centre(b)
    return float(np.sqrt((a * b).mean() / np.sqrt((a * a).mean() * (b * b).mean())))


def dense(long: DataFrame, value: str) -> tuple[list, np.ndarray]:
    """Names and the symmetric matrix of a k-by-k long table (k squared numbers reach the driver)."""
    rows = long.select("i", "j", value).collect()
    names = sorted({r["i"] for r in rows} | {r["j"] for r in rows})
    at = {n: k for k, n in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in rows:
        m[at[r["i"]], at[r["j"]]] = m[at[r["j"]], at[r["i"]]] = r[value]
    return names, m


def shrink(cov: np.ndarray, kind: str = "basic", n: int = 0, alpha: float = 0.1) -> np.ndarray:
    """Towards the scaled identity, by a constant or the oracle-approximating share."""
    k, mu = len(cov), np.trace(cov) / len(cov)
    if kind == "oas":
        square, trace = (cov**2).mean(), mu**2
        alpha = min(1.0, (square + trace) / ((n + 1) * max(square - trace / k, 1e-300)))
    return (1 - alpha) * cov + alpha * mu * np.eye(k)


def denoise(corr: np.ndarray, ratio: float, kind: str = "constant") -> np.ndarray:
    """Eigenvalues below the Marcenko-Pastur edge (``ratio`` rows per column) become their mean, or 0 (spectral)."""
    values, vectors = np.linalg.eigh(corr)
    noise = values <= (1 + np.sqrt(1 / ratio)) ** 2 * max(1 - values[-1] / len(corr), 1e-9)
    if noise.any():
        values = np.where(noise, values[noise].mean() if kind == "constant" else 0.0, values)
    m = vectors @ np.diag(values) @ vectors.T
    s = np.sqrt(np.diag(m))
    return m / np.outer(s, s)


def detone(corr: np.ndarray, components: int = 1) -> np.ndarray:
    values, vectors = np.linalg.eigh(corr)
    m = corr - vectors[:, -components:] @ np.diag(values[-components:]) @ vectors[:, -components:].T
    s = np.sqrt(np.maximum(np.diag(m), 1e-12))
    return m / np.outer(s, s)


def linkage(dist: np.ndarray, method: str = "single") -> list[tuple[int, int, float, int]]:
    """Agglomerative merges (left, right, distance, size) by single, complete or average linkage."""
    n = len(dist)
    d = {(i, j): dist[i, j] for i in range(n) for j in range(i + 1, n)}
    size = dict.fromkeys(range(n), 1)
    out = []
    while len(size) > 1:
        (a, b), best = min(d.items(), key=lambda x: (x[1], x[0]))
        new = n + len(out)
        out.append((a, b, float(best), size[a] + size[b]))
        for c in size:
            if c in (a, b):
                continue
            x, y = d.pop((min(a, c), max(a, c))), d.pop((min(b, c), max(b, c)))
            d[(min(c, new), max(c, new))] = {"single": min(x, y), "complete": max(x, y), "average": (x * size[a] + y * size[b]) / (size[a] + size[b])}[method]
        del d[(a, b)]
        size[new] = size.pop(a) + size.pop(b)
    return out


def leaf_order(merges: list[tuple[int, int, float, int]], n: int) -> list[int]:
    def leaves(k: int) -> list[int]:
        return [k] if k < n else leaves(merges[k - n][0]) + leaves(merges[k - n][1])

    return leaves(n + len(merges) - 1) if merges else list(range(n))


def hrp_weights(cov: np.ndarray, method: str = "single") -> np.ndarray:
    """Hierarchical risk parity: leaf order, then bisection by inverse cluster variance."""
    s = np.sqrt(np.diag(cov))
    corr = np.clip(cov / np.outer(s, s), -1, 1)
    dist = np.sqrt((1 - corr) / 2)
    dist = np.sqrt(((dist[:, None, :] - dist[None, :, :]) ** 2).sum(-1))
    order = leaf_order(linkage(dist, method), len(cov))
    w = np.ones(len(cov))

    def variance(ids: list[int]) -> float:
        sub = cov[np.ix_(ids, ids)]
        inverse = 1 / np.diag(sub)
        inverse /= inverse.sum()
        return float(inverse @ sub @ inverse)

    todo = [order]
    while todo:
        part = todo.pop()
        if len(part) < 2:
            continue
        a, b = part[: len(part) // 2], part[len(part) // 2 :]
        va, vb = variance(a), variance(b)
        share = 1 - va / (va + vb)
        w[a] *= share
        w[b] *= 1 - share
        todo += [a, b]
    return w


def minimum_spanning_tree(dist: np.ndarray) -> list[tuple[int, int, float]]:
    """Kruskal's edges, ties by indexes."""
    n, parent = len(dist), list(range(len(dist)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for d, i, j in sorted((dist[i, j], i, j) for i in range(n) for j in range(i + 1, n)):
        a, b = find(i), find(j)
        if a != b:
            parent[a] = b
            out.append((i, j, float(d)))
    return out


def black_litterman(cov: np.ndarray, market: np.ndarray, views: np.ndarray, pick: np.ndarray, tau: float = 0.05, delta: float = 2.5) -> tuple[np.ndarray, np.ndarray]:
    """Posterior returns and weights of views (pick @ returns = views)."""
    prior = delta * cov @ market
    omega = np.diag(np.diag(tau * pick @ cov @ pick.T))
    a = np.linalg.inv(tau * cov)
    b = pick.T @ np.linalg.inv(omega)
    mean = np.linalg.inv(a + b @ pick) @ (a @ prior + b @ views)
    w = np.linalg.inv(delta * cov) @ mean
    return mean, w / w.sum()


def inverse_variance(cov: DataFrame) -> DataFrame:
    d = cov.where("i = j").select(F.col("i").alias("symbol"), F.try_divide(F.lit(1.0), F.col("cov")).alias("v"))
    return d.select("symbol", (F.col("v") / F.sum("v").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def minimum_variance(cov: np.ndarray, mean: np.ndarray | None = None, target: float | None = None, steps: int = 4000) -> np.ndarray:
    """Long-only weights of least variance (at ``target`` return or more): projected gradient on the simplex."""
    n = len(cov)
    w = np.full(n, 1 / n)
    rate = 1 / (2 * np.linalg.eigvalsh(cov)[-1] + 1e-12)
    penalty = 0.0 if target is None else 1e3 * np.trace(cov) / n / max(float(np.var(mean)), 1e-12)
    if penalty:
        rate = 1 / (2 * np.linalg.eigvalsh(cov)[-1] + 2 * penalty * float(mean @ mean))
    for _ in range(steps):
        g = 2 * cov @ w
        if penalty and mean @ w < target:
            g = g - 2 * penalty * (target - mean @ w) * mean
        w = simplex(w - rate * g)
    return w


def simplex(v: np.ndarray) -> np.ndarray:
    """Nearest point of the probability simplex."""
    u = np.sort(v)[::-1]
    total = np.cumsum(u) - 1
    k = int(np.nonzero(u - total / np.arange(1, len(v) + 1) > 0)[0][-1])
    return np.maximum(v - total[k] / (k + 1), 0)


def risk_metrics(df: DataFrame, keys: list[str], value: str, level: float = 0.05) -> DataFrame:
    """Variance, value at risk (the 'higher' quantile), expected shortfall strictly below it, conditional drawdown at risk."""
    per = Window.partitionBy(*keys)
    n = F.count(value).over(per)
    place = F.row_number().over(per.orderBy(value))
    df = df.withColumn("_var", F.max(F.when(place == F.ceil(level * (n - 1)) + 1, F.col(value))).over(per))
    return df.groupBy(*keys).agg(F.var_samp(value).alias("variance"), F.first("_var").alias("value_at_risk"), F.avg(F.when(F.col(value) < F.col("_var"), F.col(value))).alias("expected_shortfall"))


def relatives(df: DataFrame, keys: list[str], time: str, price: str) -> DataFrame:
    """Price relatives, 1 in the first row and after a price of 0."""
    return df.withColumn("relative", F.coalesce(F.try_divide(price, F.lag(price).over(ordered(keys, [time]))), F.lit(1.0)))


class OnlinePortfolio:
    """Sequential weight updates over rows of relatives: ``eg``, ``olmar``, ``pamr``, ``rmr``, ``ftl`` by name; keeps one window of rows."""

    def __init__(self, kind: str, n: int, **params: float):
        self.kind, self.w, self.params = kind, np.full(n, 1 / n), params
        self.recent: deque[np.ndarray] = deque(maxlen=int(params.get("window", 5)))
        self.total = np.zeros(n)

    def step(self, x: np.ndarray) -> np.ndarray:
        """Weights for the next row, after seeing the relatives ``x``."""
        w, p = self.w, self.params
        if self.kind == "eg":
            w = w * np.exp(p.get("eta", 0.05) * x / (w @ x))
            self.w = w / w.sum()
        elif self.kind == "pamr":
            loss, centred = max(0.0, float(w @ x) - p.get("eps", 0.5)), x - x.mean()
            self.w = simplex(w - loss / max(float(centred @ centred), 1e-12) * centred)
        elif self.kind in ("olmar", "rmr"):
            self.recent.append(x)
            prices = np.cumprod(np.array(self.recent), axis=0)
            if self.kind == "olmar":
                guess = prices.mean(0) / prices[-1]
            else:
                guess = np.median(prices, axis=0)
                for _ in range(50):  # Weiszfeld steps to the L1 median
                    d = np.maximum(np.linalg.norm(prices - guess, axis=1), 1e-9)
                    guess = (prices / d[:, None]).sum(0) / (1 / d).sum()
                guess = guess / prices[-1]
            centred = guess - guess.mean()
            lack = max(0.0, p.get("eps", 10.0) - float(w @ guess))
            self.w = simplex(w + lack / max(float(centred @ centred), 1e-12) * centred)
        elif self.kind == "ftl":
            with np.errstate(divide="ignore"):
                self.total = self.total + np.log(np.maximum(x, 0))
            self.w = np.eye(len(w))[int(np.argmax(self.total))]
        return self.w


class Wealth(Kernel):
    """Running wealth of a sequential portfolio over wide rows of relatives, a batch at a time; missing names stand still."""

    def __init__(self, own, time: str, names: list[str]):
        self.own, self.time, self.names, self.wealth = own, time, names, 1.0

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for t, x in zip(rows[self.time], rows[self.names].fillna(1.0).to_numpy(float)):
            self.wealth *= float(self.own.w @ x)
            out.append((t, self.wealth))
            self.own.step(x)
        return pd.DataFrame(out, columns=[self.time, "wealth"])


def wealth_path(rows: DataFrame, time: str, names: list[str], make) -> DataFrame:
    """(time, wealth): one order over all rows, so one task; it streams one narrow row a time and keeps one state."""
    return ordered_fold(rows.withColumn("_all", F.lit(1)), ["_all"], [time], lambda key: Wealth(make(), time, names), f"`{time}` {dict(rows.dtypes)[time]}, wealth double")


def ou_fit(df: DataFrame, keys: list[str], time: str, value: str, dt: float) -> DataFrame:
    """Maximum-likelihood mean reversion (theta, mu, sigma_sq) from sums of a series and its lag."""
    df = df.withColumn("_x", F.lag(value).over(ordered(keys, [time]))).where("_x IS NOT NULL").withColumn("_y", F.col(value))
    s = df.groupBy(*keys).agg(F.count("_y").alias("n"), F.sum("_x").alias("x"), F.sum("_y").alias("y"), F.sum(F.col("_x") * F.col("_x")).alias("xx"), F.sum(F.col("_x") * F.col("_y")).alias("xy"), F.sum(F.col("_y") * F.col("_y")).alias("yy"))
    n, x, y, xx, xy, yy = (F.col(c) for c in ("n", "x", "y", "xx", "xy", "yy"))
    theta = F.try_divide(y * xx - x * xy, n * (xx - xy) - (x * x - x * y))
    s = s.withColumn("theta", theta)
    t = F.col("theta")
    share = F.try_divide(xy - t * x - t * y + n * t * t, xx - 2 * t * x + n * t * t)
    s = s.withColumn("a", share)
    a = F.col("a")
    mu = F.when(a > 0, -F.ln(F.when(a > 0, a)) / dt)
    left = (yy - 2 * a * xy + a * a * xx - 2 * t * (1 - a) * (y - a * x) + n * t * t * (1 - a) * (1 - a)) / n
    return s.withColumn("mu", mu).withColumn("sigma_sq", left * F.try_divide(2 * F.col("mu"), 1 - a * a)).select(*keys, "theta", "mu", "sigma_sq", F.try_divide(F.lit(float(np.log(2))), F.col("mu")).alias("half_life"))
