"""Distances between two columns by rank, shape and transport."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gpr_distance(rank_corr: Column, mean_x: Column, dev_x: Column, mean_y: Column, dev_y: Column, theta: float) -> Column:
    """Blend of rank dependence and the distance of two normal distributions, from moments alone."""
    both = dev_x * dev_x + dev_y * dev_y
    overlap = F.sqrt(F.try_divide(2 * dev_x * dev_y, both)) * F.exp(F.try_divide(-(mean_x - mean_y) * (mean_x - mean_y), 4 * both))
    return F.sqrt(F.greatest(theta * (1 - rank_corr) / 2 + (1 - theta) * (1 - overlap), F.lit(0.0)))


def gpr_distances(pairs: DataFrame, ranks: DataFrame, theta: float) -> DataFrame:
    """(i, j, distance) from ``pairs(i, j, x, y)`` and ``ranks(i, j, rho)``."""
    moments = pairs.groupBy("i", "j").agg(F.avg("x").alias("mx"), F.stddev_pop("x").alias("sx"), F.avg("y").alias("my"), F.stddev_pop("y").alias("sy"))
    return moments.join(ranks, ["i", "j"]).select("i", "j", gpr_distance(F.col("rho"), F.col("mx"), F.col("sx"), F.col("my"), F.col("sy"), theta).alias("distance"))


def line_transport(a: np.ndarray, b: np.ndarray) -> float:
    """Least cost of moving mass ``a`` to ``b`` over equal steps of [0, 1], squared distances: on a line masses keep their order."""
    at = np.linspace(0, 1, len(a))
    ca, cb = np.cumsum(a) / a.sum(), np.cumsum(b) / b.sum()
    cuts = np.unique(np.concatenate([[0.0], ca, cb]))
    cuts = cuts[cuts <= 1 + 1e-12]
    middle = (cuts[1:] + cuts[:-1]) / 2
    i, j = np.searchsorted(ca, middle), np.searchsorted(cb, middle)
    return float((np.diff(cuts) * (at[np.minimum(i, len(a) - 1)] - at[np.minimum(j, len(a) - 1)]) ** 2).sum())


def gnpr_distance(x: np.ndarray, y: np.ndarray, theta: float, bins: int = 50) -> float:
    """Blend of squared gaps of the values and the transport between their sorted histograms (squared steps)."""
    n = len(x)
    gap = 3 / (n * (n * n - 1)) * float(((x - y) ** 2).sum())
    a, b = (np.sort(np.histogram(v, bins=bins)[0] / n) for v in (x, y))
    return math.sqrt(theta * gap + (1 - theta) * line_transport(a, b))


def assignment(cost: np.ndarray) -> np.ndarray:
    """Column of each row in the cheapest one-to-one matching, by shortest augmenting paths."""
    n = len(cost)
    u, v, row_of, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, int), np.zeros(n + 1, int)
    for i in range(1, n + 1):
        row_of[0], j0 = i, 0
        least, used = np.full(n + 1, np.inf), np.zeros(n + 1, bool)
        while True:
            used[j0] = True
            i0 = row_of[j0]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (now < least[1:])
            least[1:][better] = now[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(used[1:], np.inf, least[1:]))) + 1
            delta = least[j1]
            u[row_of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if row_of[j0] == 0:
                break
        while j0:
            row_of[j0] = row_of[way[j0]]
            j0 = way[j0]
    out = np.empty(n, int)
    out[row_of[1:] - 1] = np.arange(n)
    return out


def transport(a: np.ndarray, b: np.ndarray) -> float:
    """Least mean squared distance between two sets of as many points."""
    cost = ((a[:, None, :] - b[None, :, :]) ** 2).sum(-1)
    return float(cost[np.arange(len(a)), assignment(cost)].mean())


def ranked(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy() / len(x)


def target_copula(kind: str, n: int, rng: np.random.Generator, corr: float = 0.7, share: float = 0.2) -> np.ndarray:
    """``n`` points of a dependence: comonotonicity, countermonotonicity, gaussian, positive_negative, different_variations, small_variations, v-shape."""
    i = np.arange(n)
    odd = i % 2 == 1

    def normal(k: int) -> np.ndarray:
        z = rng.multivariate_normal([0, 0], [[1, corr], [corr, 1]], k)
        return np.column_stack([ranked(z[:, 0]), ranked(z[:, 1])])

    if kind == "comonotonicity":
        y = i
    elif kind == "countermonotonicity":
        y = n - i
    elif kind == "gaussian":
        return normal(n)
    elif kind == "positive_negative":
        y = np.where(odd, i, n - i)
    elif kind == "different_variations":
        y = np.abs(n - np.where(odd, 0, i)) - np.abs(n - np.where(odd, i, 0))
    elif kind == "v-shape":
        y = np.abs(n - 2 * i)
    elif kind == "small_variations":
        out = int(n * (1 - share) / 2)
        edge = np.concatenate([i[:out], i[n - out :]])
        # Heights outside the middle are scaled by the fixed 5000 of the operator's definition.
        high = np.where(edge % 2 == 1, rng.uniform(0, out, len(edge)), rng.uniform(n - out, n, len(edge))) / 5000
        middle = normal(n - 2 * out) * share + (1 - share) / 2
        return np.concatenate([np.column_stack([edge / n, high])[:out], middle, np.column_stack([edge / n, high])[out:]])
    else:
        raise ValueError(f"unknown dependence {kind}")
    return np.column_stack([i / n, y / n])


def transport_dependence(x: np.ndarray, y: np.ndarray, kind: str, rng: np.random.Generator, corr: float = 0.7, share: float = 0.2) -> float:
    """Nearness of the ranks to a target dependence, measured against independence: 1 at the target, 0 far from it. Cubic in the rows."""
    own = np.column_stack([ranked(x), ranked(y)])
    free = rng.uniform(size=(len(x), 2))
    to_target, to_free = transport(own, target_copula(kind, len(x), rng, corr, share)), transport(own, free)
    return 1 - to_target / (to_free + to_target)
