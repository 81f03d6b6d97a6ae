"""Matrix and portfolio kernels against other forms of their definitions."""

import itertools
import math

import numpy as np
import pytest

from tickloom.operators import extras, matrices, patterns
from tickloom.operators.breaks import adf_stats, get_betas


def covariance(n, seed=0):
    x = np.random.default_rng(seed).normal(size=(5 * n, n)) @ np.random.default_rng(seed + 1).normal(size=(n, n))
    return np.cov(x.T)


def correlation(n, seed=0):
    c = covariance(n, seed)
    s = np.sqrt(np.diag(c))
    return c / np.outer(s, s)


def test_shrinkage():
    c = covariance(4)
    target = np.trace(c) / 4 * np.eye(4)
    assert np.allclose(matrices.shrink(c), 0.9 * c + 0.1 * target)
    n, mu = 30, np.trace(c) / 4
    alpha = min(1, ((c**2).mean() + mu**2) / ((n + 1) * ((c**2).mean() - mu**2 / 4)))
    assert np.allclose(matrices.shrink(c, "oas", n), (1 - alpha) * c + alpha * target)


def test_denoise_and_detone():
    c = correlation(8)
    clean = matrices.denoise(c, 5.0)
    values = np.linalg.eigvalsh(c)
    edge = (1 + math.sqrt(1 / 5)) ** 2 * (1 - values[-1] / 8)
    assert np.allclose(np.diag(clean), 1) and (values <= edge).sum() >= 1
    flat = np.where(values <= edge, values[values <= edge].mean(), values)
    v = np.linalg.eigh(c)[1]
    m = (v * flat) @ v.T
    assert np.allclose(clean, m / np.sqrt(np.outer(np.diag(m), np.diag(m))))
    none = matrices.detone(c)
    rest = c - values[-1] * np.outer(v[:, -1], v[:, -1])
    assert np.allclose(none, rest / np.sqrt(np.outer(np.diag(rest), np.diag(rest))))
    assert abs(v[:, -1] @ rest @ v[:, -1]) < 1e-9  # nothing of the market is left


def test_black_litterman_in_its_other_form():
    c, market = covariance(4, 3), np.array([0.4, 0.3, 0.2, 0.1])
    pick, views = np.array([[1, -1, 0, 0], [0, 0, 1, 0]], float), np.array([0.02, 0.05])
    mean, w = matrices.black_litterman(c, market, views, pick)
    prior = 2.5 * c @ market
    tau = 0.05 * c
    omega = np.diag(np.diag(pick @ tau @ pick.T))
    want = prior + tau @ pick.T @ np.linalg.solve(pick @ tau @ pick.T + omega, views - pick @ prior)
    assert np.allclose(mean, want) and w.sum() == pytest.approx(1) and np.allclose(c @ w * (want @ np.linalg.solve(c, np.ones(4))), want)


def test_matrix_divergence():
    a, b = correlation(3, 1), correlation(3, 2)
    kl, norm = extras.matrix_divergence(a, b)
    want = 0.5 * (math.log(np.linalg.det(b) / np.linalg.det(a)) + np.trace(np.linalg.inv(b) @ a) - 3)
    assert kl == pytest.approx(want) and norm == pytest.approx(math.sqrt(((a - b) ** 2).sum())) and extras.matrix_divergence(a, a)[0] == pytest.approx(0, abs=1e-12)


def test_spanning_tree_is_the_lightest():
    d = np.random.default_rng(4).uniform(size=(5, 5))
    d = d + d.T
    pairs = list(itertools.combinations(range(5), 2))

    def joined(edges):
        seen, todo = {0}, [0]
        while todo:
            u = todo.pop()
            for a, b in edges:
                for p, q in ((a, b), (b, a)):
                    if p == u and q not in seen:
                        seen.add(q)
                        todo.append(q)
        return len(seen) == 5

    best = min(sum(d[a, b] for a, b in e) for e in itertools.combinations(pairs, 4) if joined(e))
    assert sum(x for _, _, x in matrices.minimum_spanning_tree(d)) == pytest.approx(best)


def test_risk_parity_of_two_and_four():
    assert np.allclose(matrices.hrp_weights(np.diag([1.0, 4.0])), [0.8, 0.2])
    c = np.diag([1.0, 2.0, 4.0, 8.0])
    w = matrices.hrp_weights(c)
    assert w.sum() == pytest.approx(1) and np.allclose(w, (1 / np.diag(c)) / (1 / np.diag(c)).sum())
    v = matrices.minimum_variance(c)
    assert np.allclose(v, w, atol=1e-3)


def project(v):
    """Nearest point of the simplex by bisection on the shift."""
    low, high = v.min() - 2, v.max()
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if np.maximum(v - mid, 0).sum() > 1 else (low, mid)
    return np.maximum(v - low, 0)


@pytest.mark.parametrize("kind", ["eg", "pamr", "olmar", "rmr", "ftl"])
def test_online_portfolios_step_by_step(kind):
    x = np.random.default_rng(6).uniform(0.8, 1.25, size=(12, 3))
    own, w = matrices.OnlinePortfolio(kind, 3), np.full(3, 1 / 3)
    for t, row in enumerate(x):
        assert np.allclose(own.w, w, atol=1e-6) and own.w.sum() == pytest.approx(1)
        own.step(row)
        seen = x[: t + 1]
        if kind == "eg":
            w = w * np.exp(0.05 * row / (w @ row))
            w = w / w.sum()
        elif kind == "pamr":
            gap = row - row.mean()
            w = project(w - max(0, w @ row - 0.5) / (gap @ gap) * gap)
        elif kind == "ftl":
            w = np.eye(3)[np.prod(seen, axis=0).argmax()]
        else:
            path = np.cumprod(seen[-5:], axis=0)
            if kind == "olmar":
                guess = path.mean(0) / path[-1]
            else:  # the point of least summed distance, by descent on a fine path
                guess = np.median(path, axis=0)
                for step in np.geomspace(0.1, 1e-7, 400):
                    away = guess - path
                    norm = np.maximum(np.linalg.norm(away, axis=1), 1e-9)
                    guess = guess - step * (away / norm[:, None]).sum(0) / len(path)
                if len(path) < 3:
                    guess = own.w  # any point of a segment is least: follow the operator
                    w = own.w
                    continue
                guess = guess / path[-1]
            gap = guess - guess.mean()
            w = project(w + max(0, 10 - w @ guess) / (gap @ gap) * gap) if gap @ gap > 1e-15 else w
            if kind == "rmr":
                assert np.allclose(own.w, w, atol=0.15)
                w = own.w


def test_best_constant_portfolio_beats_a_grid():
    x = np.random.default_rng(7).uniform(0.7, 1.4, size=(60, 3))
    gain = lambda w: np.log(x @ w).sum()
    best = max(gain(np.array([a, b, 20 - a - b]) / 20) for a in range(21) for b in range(21 - a))
    assert gain(extras.best_constant(x)) >= best - 1e-3


def test_wealth_of_sequential_portfolios():
    x = np.random.default_rng(8).uniform(0.9, 1.1, size=(30, 3))
    for path in (extras.confidence_weighted(x), extras.pattern_matching(x, 3, 0.1)):
        assert len(path) == 30 and path[0] == pytest.approx(x[0].mean())
        steps = path / np.concatenate([[1], path[:-1]])
        assert (steps <= x.max(1) + 1e-9).all() and (steps >= x.min(1) - 1e-9).all()  # weights lie on the simplex
    even = np.ones((10, 2)) * 1.01
    assert extras.pattern_matching(even, 3)[-1] == pytest.approx(1.01**10)


@pytest.mark.parametrize("kind", ["plain", "symmetric", "functional"])
def test_pattern_matching_row_by_row(kind):
    x = np.random.default_rng(14).uniform(0.85, 1.2, size=(25, 2))
    own, shares = extras.PatternMatching(2, 3, 0.2, kind, 2.0), np.linspace(0, 1, 2001)
    for t, row in enumerate(x):
        own.step(row)
        seen = x[: t + 1]
        v, after = [], []
        for s in range(3, t + 1):  # rows that a whole window precedes
            a, b = seen[s - 3 : s].ravel(), seen[-3:].ravel()
            c = np.corrcoef(a, b)[0, 1] if len(a) == 6 else 0
            lift = 1 / (1 + math.exp(-2 * (abs(c) - 0.2))) if kind == "functional" else 1.0
            if c >= 0.2 or (kind != "plain" and c <= -0.2):
                v.append(lift if c > 0 else -lift)
                after.append(seen[s])
        if not v:
            assert np.allclose(own.w, 0.5)
            continue
        gain = lambda w: float(np.array(v) @ np.log(np.array(after) @ w))  # noqa: E731, B023
        best = max(gain(np.array([p, 1 - p])) for p in shares)
        # Growth that shuns rows has several peaks: the start's own is found there.
        assert gain(own.w) >= (best - 1e-4 if kind == "plain" else gain(np.array([0.5, 0.5])) - 1e-9)
    with pytest.raises(ValueError):
        extras.PatternMatching(2, kind="odd")


def test_parts_of_ordered_rows(spark):
    from tickloom.operators import market

    df = spark.range(1000).withColumnRenamed("id", "k")
    count = lambda pdf: pdf.assign(n=len(pdf), first=pdf["k"].min())[["k", "n", "first"]]
    even = market.map_parts(df, ["k"], 4, count, "k long, n long, first long").collect()
    assert sorted(r["k"] for r in even) == list(range(1000)) and len({r["first"] for r in even}) == 4 and max(r["n"] for r in even) < 400
    slanted = market.map_parts(df, ["k"], 4, count, "k long, n long, first long", True).collect()
    work = {}
    for r in slanted:
        work[r["first"]] = work.get(r["first"], 0) + r["k"]
    assert sorted(r["k"] for r in slanted) == list(range(1000)) and len(work) == 4 and max(work.values()) < 2 * min(work.values())


def test_adf_of_a_window():
    y = np.cumsum(np.random.default_rng(9).normal(size=60))
    x, d = np.column_stack([y[:-1], np.ones(59), np.arange(59)]), np.diff(y)
    stats = []
    for start in range(59 - 20 + 1):
        b, cov = get_betas(x[start:], d[start:])
        stats.append(b[0] / math.sqrt(cov[0, 0]))
    assert adf_stats(y, 59, 60, 20, "linear")["sadf"][0] == pytest.approx(max(stats), rel=1e-6)
    lagged = np.column_stack([y[2:-1], d[1:-1], d[:-2], np.ones(57)])
    stats = []
    for start in range(57 - 20 + 1):
        b, cov = get_betas(lagged[start:], d[2:][start:])
        stats.append(b[0] / math.sqrt(cov[0, 0]))
    assert adf_stats(y, 59, 60, 20, "none", 2)["sadf"][0] == pytest.approx(max(stats), rel=1e-6)
    for model in ("quadratic", "sm_poly_1", "sm_poly_2", "sm_exp", "sm_power"):
        assert np.isfinite(adf_stats(np.abs(y) + 1, 50, 60, 20, model, phi=0.5)["sadf"]).all()
    assert np.isnan(get_betas(np.ones((5, 2)), np.arange(5.0))[0]).all()


def test_adf_with_a_constant():
    y = np.cumsum(np.random.default_rng(10).normal(size=80))
    d = np.diff(y)
    b, cov = get_betas(np.column_stack([y[1:-1], d[:-1], np.ones(78)]), d[1:])
    assert extras.adf(y) == pytest.approx(b[0] / math.sqrt(cov[0, 0]), rel=0.02)


def plain_flag(window, template):
    cut = np.percentile(window, np.linspace(10, 100, 10))
    total = 0.0
    for c, part in enumerate(np.array_split(window, 10)):
        for v in part:
            total += template[9 - int(np.searchsorted(cut, v, side="left"))][c] / len(part)
    return total


def test_flags(spark):
    x = np.random.default_rng(11).normal(size=70).cumsum()
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(x)] + [("b", 0, 1.0)], "k string, i int, v double")
    for name in ("leigh_bull", "cervelloroyo_bear"):
        got = {r["i"]: r["flag"] for r in patterns.matrix_flags(df, ["k"], ["i"], "v", 33, name).collect()}
        assert got == pytest.approx({i: plain_flag(x[i - 33 : i], patterns.TEMPLATES[name]) for i in range(33, 70)})
    cut = {r["i"]: r["flag"] for r in patterns.matrix_flags(df, ["k"], ["i"], "v", 33, "leigh_bull", 0.0).collect()}
    assert set(cut.values()) <= {1.0, -1.0}
    with pytest.raises(ValueError):
        patterns.matrix_flags(df, ["k"], ["i"], "v", 5)


def test_fourier_and_densities(spark):
    x = np.random.default_rng(12).normal(size=64)
    slow = patterns.low_frequencies(x, 5)
    f, at = np.fft.fft(x), np.arange(64)
    want = sum((f[k] * np.exp(2j * np.pi * k * at / 64)).real for k in (*range(5), *range(59, 64))) / 64
    assert np.allclose(slow, want)
    assert np.allclose(patterns.low_frequencies(x, 100), x)
    w = np.random.default_rng(13).uniform(size=64)
    q = patterns.density_quantiles(x, w, [0.1, 0.5, 0.9])
    h = patterns.kernel_width(x)
    at = np.linspace(-8, 8, 40_001)
    density = sum(wi * np.exp(-0.5 * ((at - v) / h) ** 2) for v, wi in zip(x, w)) / (h * math.sqrt(2 * math.pi) * w.sum())
    run = np.cumsum(density) * (at[1] - at[0])
    assert [at[np.searchsorted(run, p)] for p in (0.1, 0.5, 0.9)] == pytest.approx(q, abs=2e-3)
    assert all(math.isnan(v) for v in patterns.density_quantiles(np.array([1.0]), np.array([1.0]), [0.5]))
    df = spark.createDataFrame([("a", float(v), float(u)) for v, u in zip(x, w)] + [("b", 1.0, 2.0)], "k string, price double, volume double")
    got = {r["k"]: r["kd_50"] for r in patterns.weighted_kde(df, ["k"]).collect()}
    assert got["a"] == pytest.approx(q[1]) and got["b"] is None


def test_generators(spark):
    m = extras.block_correlation(6, 2)
    assert (np.diag(m) == 1).all() and m[0, 2] == 0.5 and m[0, 3] == 0.1 and np.allclose(m, m.T)
    rows = [r["price"] for r in extras.random_walk(spark, 400, spike=0.0).orderBy("id").collect()]
    assert set(np.abs(np.diff(rows))) == {1.0}
    spiky = [r["price"] for r in extras.random_walk(spark, 400, spike=0.1).orderBy("id").collect()]
    assert 10 <= sum(abs(a - b) > 5 for a, b in zip(rows, spiky)) <= 80


def test_zero_negative_and_missing_prices(spark):
    """No ratio fails under ANSI arithmetic, and rows around a bad price are null or unaffected."""
    from pyspark.sql import functions as F

    from tickloom.operators import adaptive, labels, micro

    prices = [10.0, 0.0, -1.0, None, 12.0, 13.0, 0.0, 11.0] * 6
    bars = spark.createDataFrame([("a", i * 3600, p, p, p, p, i % 3, (p or 0.0) * (i % 3), 1) for i, p in enumerate(prices)], "symbol string, t long, open double, high double, low double, close double, volume long, dollars double, n long")
    for df in (micro.corwin_schultz(bars, ["symbol"], "t", 2), micro.bar_lambdas(bars, ["symbol"], "t", 2), micro.range_volatility(bars, ["symbol"], "t", 3), micro.roll_measure(bars, ["symbol"], "t", "close", 3), labels.raw_return(bars, ["symbol"], "t", "close", log=True), labels.raw_return(bars, ["symbol"], "t", "close"), labels.fixed_time_horizon(bars, ["symbol"], "t", "close", 0.1, 3), labels.trend_scanning(bars, ["symbol"], "t", "close", 5, 6), matrices.relatives(bars, ["symbol"], "t", "close"), labels.cusum_filter(bars.where("close IS NOT NULL"), ["symbol"], "t", "close", 0.1), adaptive.daily_volatility(bars, ["symbol"], "t", "close", 7200, 5)):
        assert df.collect() is not None
    first = labels.raw_return(bars, ["symbol"], "t", "close", log=True).orderBy("t").collect()
    assert first[0]["ret"] is None and first[4]["ret"] == pytest.approx(math.log(13 / 12))
    ticks = bars.select("symbol", F.lit(0).alias("bar"), F.col("t").alias("us"), F.col("t").alias("seq"), F.col("close").alias("price"), "volume")
    assert micro.trade_lambdas(ticks, ["symbol"], ["us", "seq"], "bar").count() == 1
    spans = labels.vertical_barrier(bars.select("symbol", F.col("t").alias("t0"), F.lit(0.1).alias("trgt"), F.lit(1).alias("side")), bars, ["symbol"], 7200)
    events = labels.get_events(spans, bars, ["symbol"], 1.0, 1.0, 0.0, 86400)
    assert labels.get_bins(events, bars, ["symbol"]).count() == 46 and labels.weights_by_return(bars, spans, ["symbol"], 86400).count() > 0
