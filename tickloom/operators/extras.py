"""Resampling, cluster scores, multiple-testing haircuts, further sequential portfolios and generators."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .matrices import simplex


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from contingency counts."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    two = lambda c: c * (c - 1) / 2.0
    both = cells.agg(F.sum(two(F.col("n"))).alias("ab"), F.sum("n").alias("n"))
    left = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("a"))
    right = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(two(F.col("n"))).alias("b"))
    one = both.withColumn("k", F.lit(1)).join(left.withColumn("k", F.lit(1)), "k").join(right.withColumn("k", F.lit(1)), "k")  # single rows
    expected = F.col("a") * F.col("b") / two(F.col("n"))
    return one.select(F.try_divide(F.col("ab") - expected, (F.col("a") + F.col("b")) / 2 - expected).alias("ari"))


def cluster_stats(df: DataFrame, label: str, group: str, value: str) -> DataFrame:
    """Per cluster: size, share of its largest group (purity), that group (least name on ties), median value."""
    counts = df.groupBy(label, group).agg(F.count(F.lit(1)).alias("n"))
    largest = counts.groupBy(label).agg(F.sum("n").alias("size"), F.min(F.struct((-F.col("n")).alias("m"), F.col(group).alias("g"))).alias("top"))
    middle = df.groupBy(label).agg(F.percentile(value, 0.5).alias("median"))
    return largest.join(middle, label).select(label, "size", (-F.col("top.m") / F.col("size")).alias("purity"), F.col("top.g").alias("mode"), "median")


def strided_buckets(df: DataFrame, order: list[str], keys: list[str], size: int, stride: int) -> DataFrame:
    """Rows of each full sliding bucket of ``size`` rows every ``stride`` rows: one output row per (bucket, row)."""
    over = Window.partitionBy(*keys).orderBy(*order)
    rows = df.withColumn("_k", F.row_number().over(over) - 1).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    first = F.greatest(F.lit(0).cast("long"), F.ceil((F.col("_k") - size + 1) / stride))
    rows = rows.withColumn("bucket", F.explode(F.sequence(first, F.greatest(F.floor(F.col("_k") / stride), first))))
    return rows.where((F.col("bucket") * stride <= F.col("_k")) & (F.col("_k") < F.col("bucket") * stride + size) & (F.col("bucket") * stride + size <= F.col("_n"))).drop("_k", "_n")


def linear_parts(atoms: int, parts: int) -> list[int]:
    """Bounds of equal counts."""
    return [math.ceil(x) for x in np.linspace(0, atoms, min(parts, atoms) + 1)]


def triangular_parts(atoms: int, parts: int, upper: bool = False) -> list[int]:
    """Bounds of about equal work where the k-th atom costs k."""
    total, out = atoms * (atoms + 1) / 2, [0]
    for k in range(1, min(parts, atoms) + 1):
        out.append(min(atoms, round((-1 + math.sqrt(1 + 8 * total * k / min(parts, atoms))) / 2)))
    out[-1] = atoms
    return [atoms - x for x in out[::-1]] if upper else out


def adf(y: np.ndarray) -> float:
    """t-value of y(t-1) with a constant, one lag."""
    d = np.diff(y)
    x = np.column_stack([y[1:-1], d[:-1], np.ones(len(d) - 1)])
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ d[1:]
    e = d[1:] - x @ b
    return float(b[0] / math.sqrt(e @ e / max(1, len(e) - 3) * inverse[0, 0]))


def matrix_divergence(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """Kullback-Leibler divergence of two correlation matrices and the norm of their difference."""
    kl = 0.5 * (np.linalg.slogdet(b)[1] - np.linalg.slogdet(a)[1] + np.trace(np.linalg.solve(b, a)) - len(a))
    return float(kl), float(np.linalg.norm(b - a))


def haircuts(p: float, others: np.ndarray) -> dict[str, float]:
    """Adjusted p-values of a test among others: Bonferroni, Holm, Benjamini-Hochberg-Yekutieli."""
    every = np.sort(np.append(others, p))
    n = len(every)
    at = int(np.searchsorted(every, p))
    holm = min(1.0, max((n - k) * every[k] for k in range(at + 1)))
    c = (1 / np.arange(1, n + 1)).sum()
    bhy = min(1.0, min(every[k] * n * c / (k + 1) for k in range(at, n)))
    return {"bonferroni": float(min(1.0, p * n)), "holm": float(holm), "bhy": float(bhy)}


def adjusted_p(df: DataFrame, name: str, p: str) -> DataFrame:
    """``bonferroni``, ``holm`` and ``bhy``: p-values of many tests adjusted for their number; one narrow row a test."""
    every = Window.partitionBy(F.lit(0))
    over = every.orderBy(p, name)
    n = F.count(F.lit(1)).over(every)
    rows = df.withColumns({"_n": n, "_k": F.row_number().over(over) - 1}).withColumn("_c", F.aggregate(F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: 1.0 / i), F.lit(0.0), lambda a, x: a + x))
    back = every.orderBy(F.col(p).desc(), F.col(name).desc()).rowsBetween(Window.unboundedPreceding, 0)
    one = lambda c: F.least(F.lit(1.0), c)
    rows = rows.withColumn("bonferroni", one(F.col(p) * F.col("_n"))).withColumn("holm", one(F.max((F.col("_n") - F.col("_k")) * F.col(p)).over(over.rowsBetween(Window.unboundedPreceding, 0))))
    return rows.withColumn("bhy", one(F.min(F.col(p) * F.col("_n") * F.col("_c") / (F.col("_k") + 1)).over(back))).drop("_n", "_k", "_c")


def best_constant(x: np.ndarray, steps: int = 5000, tol: float = 1e-7) -> np.ndarray:
    """Constant weights of the largest final wealth in hindsight: each weight is multiplied by its mean share in the wealth's growth, which never lowers it."""
    w = np.full(x.shape[1], 1 / x.shape[1])
    for _ in range(steps):
        growth = (x / (x @ w)[:, None]).mean(0)
        w = w * growth
        w /= w.sum()
        if growth.max() < 1 + tol:
            break
    return w


class ConfidenceWeighted:
    """Confidence-weighted mean reversion (variance form): a mean and a k-by-k spread of the weights, moved when a row passes ``eps``."""

    def __init__(self, k: int, eps: float = 0.5, confidence: float = 1.96):
        self.w, self.cov, self.eps, self.confidence = np.full(k, 1 / k), np.eye(k) / k**2, eps, confidence

    def step(self, row: np.ndarray) -> None:
        k, one = len(row), np.ones(len(row))
        m, v = float(self.w @ row), float(row @ self.cov @ row)
        pull = float(one @ self.cov @ row)
        centre = pull / float(one @ self.cov @ one)
        a = 2 * self.confidence * v * (v - centre * pull)
        b = 2 * self.confidence * v * (self.eps - m) + v - centre * pull
        c = self.eps - m - self.confidence * v
        roots = [r.real for r in np.roots([a, b, c]) if abs(r.imag) < 1e-9] if abs(a) > 1e-15 else [-c / b if b else 0.0]
        lam = max(0.0, *roots) if roots else 0.0
        self.w = simplex(self.w - lam * self.cov @ (row - centre))
        cov = np.linalg.inv(np.linalg.inv(self.cov + 1e-12 * np.eye(k)) + 2 * lam * self.confidence * np.diag(row**2))
        self.cov = cov / (k * np.trace(cov))


def confidence_weighted(x: np.ndarray, eps: float = 0.5, confidence: float = 1.96) -> np.ndarray:
    """Its wealth, row by row."""
    own, wealth, out = ConfidenceWeighted(x.shape[1], eps, confidence), 1.0, []
    for row in x:
        wealth *= float(own.w @ row)
        out.append(wealth)
        own.step(row)
    return np.array(out)


def weighted_growth(x: np.ndarray, v: np.ndarray, steps: int = 200) -> np.ndarray:
    """Long-only weights of the largest ``sum v log(x @ w)``; negative ``v`` shun rows. Projected ascent with a step that halves until it gains."""
    w, rate = np.full(x.shape[1], 1 / x.shape[1]), 1.0
    gain = lambda u: float(v @ np.log(np.maximum(x @ u, 1e-12)))
    now = gain(w)
    for _ in range(steps):
        slope = (x * (v / np.maximum(x @ w, 1e-12))[:, None]).sum(0) / max(np.abs(v).sum(), 1e-12)
        while rate > 1e-9:
            new = simplex(w + rate * slope)
            if (then := gain(new)) >= now:
                break
            rate /= 2
        else:
            break
        if np.abs(new - w).max() < 1e-9:
            break
        w, now, rate = new, then, min(rate * 2, 1e6)
    return w


class PatternMatching:
    """Correlation-driven weights: the largest growth over past rows that followed windows like the last one.

    ``plain`` takes windows of a correlation of at least ``rho``; ``symmetric`` also shuns rows that followed windows of at most ``-rho``;
    ``functional`` weighs both by how far a sigmoid of steepness ``lam`` lifts their correlation beyond the threshold. Keeps all past rows.
    """

    def __init__(self, k: int, window: int = 5, rho: float = 0.1, kind: str = "plain", lam: float = 1.0):
        if kind not in ("plain", "symmetric", "functional"):
            raise ValueError(f"unknown kind {kind}")
        self.w, self.window, self.rho, self.kind, self.lam = np.full(k, 1 / k), window, rho, kind, lam
        self.rows: list[np.ndarray] = []
        self.past: list[np.ndarray] = []  # entry s: the standardised window before row s + window

    def step(self, row: np.ndarray) -> None:
        self.rows.append(row)
        t, k = len(self.rows), len(row)
        if t < self.window:
            return
        last = np.concatenate([self.rows[s] for s in range(t - self.window, t)])
        last = last - last.mean()
        size = math.sqrt(float(last @ last))
        last = last / size if size > 0 else np.full(len(last), np.nan)
        if self.past:
            alike = np.array(self.past) @ last
            after = np.array(self.rows[self.window : self.window + len(self.past)])
            near, far = alike >= self.rho, (alike <= -self.rho) & (self.kind != "plain")
            if self.kind == "plain":
                self.w = weighted_growth(after[near], np.ones(int(near.sum()))) if near.any() else np.full(k, 1 / k)
            elif (near | far).any():
                lift = (1 / (1 + np.exp(-self.lam * (np.abs(alike) - self.rho)))) if self.kind == "functional" else np.ones(len(alike))
                v = np.where(near, lift, 0.0) - np.where(far, lift, 0.0)
                self.w = weighted_growth(after[near | far], v[near | far])
            else:
                self.w = np.full(k, 1 / k)
        self.past.append(last)


def pattern_matching(x: np.ndarray, window: int = 5, rho: float = 0.1, kind: str = "plain", lam: float = 1.0) -> np.ndarray:
    """Its wealth, row by row."""
    own, wealth, out = PatternMatching(x.shape[1], window, rho, kind, lam), 1.0, []
    for row in x:
        wealth *= float(own.w @ row)
        out.append(wealth)
        own.step(row)
    return np.array(out)


def random_walk(spark, n: int, seed: int = 1, spike: float = 0.02, size: float = 10.0) -> DataFrame:
    """A walk of unit steps with seeded spikes."""
    rows = spark.range(n).withColumn("_s", F.when(F.rand(seed) < 0.5, -1).otherwise(1)).withColumn("_x", F.when(F.rand(seed + 1) < spike, size).otherwise(0.0))
    return rows.select("id", (100 + F.sum("_s").over(Window.orderBy("id").rowsBetween(Window.unboundedPreceding, 0)) + F.col("_x")).alias("price"))


def block_correlation(names: int, blocks: int, inside: float = 0.5, across: float = 0.1) -> np.ndarray:
    """Correlation matrix of equal blocks."""
    at = np.arange(names) * blocks // names
    m = np.where(at[:, None] == at[None, :], inside, across)
    np.fill_diagonal(m, 1.0)
    return m
