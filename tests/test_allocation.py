"""Portfolios, mixtures and stopping levels against brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import allocation, moments
from tickloom.operators.clusters import agglomerate
from tickloom.operators.matrices import simplex


def market(n, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(4 * n, n)) @ rng.normal(size=(n, n)) * 0.05
    return rng.uniform(0, 0.3, n), np.cov(x.T) + 0.001 * np.eye(n), x


def grid(n, step):
    for parts in itertools.product(range(step + 1), repeat=n - 1):
        if sum(parts) <= step:
            yield np.array([*parts, step - sum(parts)]) / step


@pytest.mark.parametrize("seed", range(6))
def test_critical_line_beats_every_grid_portfolio(seed):
    mean, cov, _ = market(4, seed)
    line = allocation.CriticalLine(mean, cov)
    for w in line.points:
        assert w.sum() == pytest.approx(1) and w.min() > -1e-9
    returns = [mean @ w for w in line.points]
    assert returns == sorted(returns, reverse=True) and returns[0] == pytest.approx(mean.max())
    best = min(w @ cov @ w for w in grid(4, 24))
    assert line.least_variance() @ cov @ line.least_variance() <= best + 1e-9
    sharpe = lambda w: mean @ w / math.sqrt(w @ cov @ w)
    assert sharpe(line.largest_sharpe()) >= max(map(sharpe, grid(4, 24))) - 1e-9
    for w in grid(4, 12):  # no portfolio of more return has less variance
        if mean @ w >= returns[-1]:
            at = line.at_return(mean @ w)
            assert at @ cov @ at <= w @ cov @ w + 1e-9
    assert len(line.frontier(7)) == 7


def test_critical_line_with_bounds():
    mean, cov, _ = market(5, 3)
    line = allocation.CriticalLine(mean, cov, 0.05, 0.4)
    for w in line.points:
        assert w.min() >= 0.05 - 1e-9 and w.max() <= 0.4 + 1e-9 and w.sum() == pytest.approx(1)
    best = min(w @ cov @ w for w in (0.05 + 0.75 * v for v in grid(5, 15)) if w.max() <= 0.4)
    assert line.least_variance() @ cov @ line.least_variance() <= best + 1e-9
    with pytest.raises(ValueError):
        allocation.CriticalLine(mean, cov, 0.0, 0.1)


def test_custom_objective_takes_functions():
    mean, cov, _ = market(4, 1)
    line = allocation.CriticalLine(mean, cov)
    w = allocation.custom_objective(lambda x: float(x @ cov @ x), 4)
    assert w @ cov @ w == pytest.approx(line.least_variance() @ cov @ line.least_variance(), rel=1e-3)
    target = float(np.sort(mean)[-2])
    w = allocation.custom_objective(lambda x: float(x @ cov @ x), 4, [lambda x: float(mean @ x) - target])
    at = line.at_return(target)
    assert mean @ w >= target - 1e-3 and w @ cov @ w == pytest.approx(at @ cov @ at, rel=0.05)


def test_closed_form_and_nested_clusters():
    mean, cov, _ = market(6, 2)
    w = allocation.closed_form(cov)
    assert w.sum() == pytest.approx(1) and np.allclose(cov @ w, (cov @ w)[0])  # equal marginal risks
    rng = np.random.default_rng(0)
    m, block = allocation.block_matrix(3, 4, 0.6, rng)
    nested = allocation.nested_clusters(block, np.random.default_rng(1))
    assert nested.sum() == pytest.approx(1)
    exact = allocation.closed_form(block)  # clusters are independent: nesting loses nothing
    assert np.allclose(nested, exact, atol=1e-6)
    a, b = allocation.simulated_weights(block, m, 60, 5)
    assert a.sum() == pytest.approx(1) and b.sum() == pytest.approx(1)
    errors = allocation.allocation_errors(np.array([exact, exact]), np.array([exact, exact + 0.1]), block)
    assert errors[0] == pytest.approx(0) and errors[1] == pytest.approx(0.1 / math.sqrt(2))


@pytest.mark.parametrize("measure", ["equal_weighting", "variance", "standard_deviation", "expected_shortfall", "conditional_drawdown_risk"])
def test_equal_risk_contribution_worked_by_hand(measure):
    _, cov, x = market(6, 4)
    w = allocation.equal_risk_contribution(cov, x, measure, "ward", 3)
    assert w.sum() == pytest.approx(1)
    corr = allocation.to_corr(cov)
    tree = agglomerate(np.sqrt(2 * (1 - np.round(corr, 5))), "ward")

    def leaves(k):
        return [int(k)] if k < 6 else leaves(tree[int(k) - 6, 0]) + leaves(tree[int(k) - 6, 1])

    nodes = [10]
    while len(nodes) < 3:  # undo the last merges
        top = max(nodes)
        nodes.remove(top)
        nodes += [int(tree[top - 6, 0]), int(tree[top - 6, 1])]
    groups = [leaves(k) for k in nodes]

    def asset(i):
        if measure == "equal_weighting":
            return 1.0
        if measure in ("variance", "standard_deviation"):
            return cov[i, i]
        return (allocation.shortfall if measure == "expected_shortfall" else allocation.drawdown_at_risk)(x[:, i])

    inside = {tuple(g): np.array([1 / asset(i) for i in g]) / sum(1 / asset(i) for i in g) for g in groups}

    def risk(g):
        v = inside[tuple(g)]
        if measure == "equal_weighting":
            return 1.0
        if measure in ("variance", "standard_deviation"):
            r = v @ cov[np.ix_(g, g)] @ v
            return r if measure == "variance" else math.sqrt(r)
        return (allocation.shortfall if measure == "expected_shortfall" else allocation.drawdown_at_risk)(x[:, g] @ v)

    share = {tuple(g): 1.0 for g in groups}
    for k in (10, 9):
        sides = [[g for g in groups if set(g) <= set(leaves(tree[k - 6, c]))] for c in (0, 1)]
        left, right = (sum(map(risk, s)) for s in sides)
        part = 0.5 if measure == "equal_weighting" else 1 - left / (left + right)
        for s, p in zip(sides, (part, 1 - part)):
            for g in s:
                share[tuple(g)] *= p
    want = np.empty(6)
    for g in groups:
        want[g] = inside[tuple(g)] * share[tuple(g)]
    assert np.allclose(w, want)


def test_shortfall_and_drawdown():
    r = np.array([0.1, -0.3, 0.2, -0.1, -0.4, 0.3, 0.05, -0.2, 0.1, 0.0])
    edge = sorted(r)[math.ceil(0.25 * 9)]
    assert allocation.shortfall(r, 0.25) == pytest.approx(np.mean([v for v in r if v < edge]))
    run, high, falls = 0.0, -math.inf, []
    for v in r:
        run += v
        high = max(high, run)
        falls.append(high - run)
    edge = sorted(falls)[math.ceil(0.75 * 9)]
    assert allocation.drawdown_at_risk(r, 0.25) == pytest.approx(np.mean([v for v in falls if v > edge]))


def test_entropy_pooling_meets_views_and_is_nearest():
    rng = np.random.default_rng(3)
    prior, x = np.full(40, 1 / 40), rng.normal(size=40)
    p = allocation.entropy_pooling(prior, (x[None, :], np.array([0.3])))
    assert p.sum() == pytest.approx(1) and x @ p == pytest.approx(0.3)
    tilt = np.polyfit(x, np.log(p / prior), 1)  # the nearest is an exponential tilt
    assert np.allclose(np.log(p / prior), np.polyval(tilt, x), atol=1e-6)
    q = allocation.entropy_pooling(prior, None, (-x[None, :], np.array([-0.3])))  # mean of at least 0.3
    assert np.allclose(p, q, atol=1e-6)
    assert np.allclose(allocation.entropy_pooling(prior, None, (x[None, :], np.array([5.0]))), prior)  # a view that holds
    assert np.allclose(allocation.entropy_pooling(prior, (x[None, :], np.array([0.3])), confidence=0.25), 0.25 * p + 0.75 * prior)


def test_robust_bayesian_pick():
    mean, cov, _ = market(4, 5)
    w = allocation.robust_bayesian(mean, cov, mean, cov, 60, most_volatility=10.0)
    assert w.sum() == pytest.approx(1) and w.min() >= -1e-9
    t = 120
    shy = math.sqrt(allocation.chi_square_quantile(0.1, 4) / t * t / (t - 2))
    best = max(allocation.CriticalLine(mean, cov).frontier(10), key=lambda r: r[0] if r[0] - shy * r[1] > -math.inf else 0)
    assert mean @ w <= best[0] + 1e-9
    with pytest.raises(ValueError):
        allocation.robust_bayesian(mean, cov, mean, cov, 60, most_volatility=1e-9)


def test_chi_square_quantiles():
    # Fixed values of the published table.
    for p, df, want in ((0.5, 1, 0.454936), (0.95, 1, 3.841459), (0.1, 10, 4.865182), (0.975, 30, 46.979242)):
        assert allocation.chi_square_quantile(p, df) == pytest.approx(want, rel=1e-6)


def test_tree_correlation_of_two_groups():
    corr = np.array([[1, 0.8, 0.1, 0.2], [0.8, 1, 0.3, 0.1], [0.1, 0.3, 1, 0.6], [0.2, 0.1, 0.6, 1]])
    out = allocation.tree_correlation(corr, [["a", "a", "b", "b"]])
    assert out[0, 1] == pytest.approx(0.8) and out[2, 3] == pytest.approx(0.6)
    d = np.sqrt((1 - corr) / 2)
    across = d[:2, 2:].mean()
    assert np.allclose(out[:2, 2:], 1 - 2 * across**2) and np.allclose(out, out.T)
    assert allocation.correlation_distance(corr, corr) == pytest.approx(0) and allocation.correlation_distance(corr, np.eye(4)) > 0


def test_robust_covariance_ignores_outliers():
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 400)
    x[:40] += 25
    assert np.allclose(allocation.minimum_covariance_determinant(x, rng), [[1, 0.5], [0.5, 1]], atol=0.35)


def test_expert_blends():
    wealth = np.array([[1.1, 0.9, 1.0], [1.2, 0.8, 1.3]])
    weights = np.array([[[1, 0], [1, 0]], [[0, 1], [0, 1]], [[0.5, 0.5], [0.5, 0.5]]], float)
    history = allocation.expert_blend(wealth, weights)
    assert np.allclose(history[0], weights[:, 0].mean(0)) and np.allclose(history[1], (1.1 * weights[0, 1] + 0.9 * weights[1, 1] + 1.0 * weights[2, 1]) / 3)
    assert np.allclose(allocation.expert_blend(wealth, weights, "top")[1], weights[0, 1])
    assert np.allclose(allocation.expert_blend(wealth, weights, "uniform")[1], weights[:, 1].mean(0))


def test_moments_of_a_mixture():
    p = (-1.0, 2.0, 0.5, 1.5, 0.3)
    x = np.linspace(-15, 18, 400_001)
    density = 0.3 * np.exp(-((x + 1) ** 2) / 0.5) / math.sqrt(2 * math.pi * 0.25) + 0.7 * np.exp(-((x - 2) ** 2) / 4.5) / math.sqrt(2 * math.pi * 2.25)
    want = [np.trapezoid(x**k * density, x) for k in range(1, 6)]
    assert moments.raw_moments(p) == pytest.approx(want, rel=1e-6)
    assert moments.central_moment(want, 3) == pytest.approx(np.trapezoid((x - want[0]) ** 3 * density, x), rel=1e-5)
    central = [moments.central_moment(want, k) for k in range(1, 6)]
    assert moments.raw_from_central(central, want[0]) == pytest.approx(want)


@pytest.mark.parametrize("fifth", [False, True])
def test_mixture_fit_matches_moments(fifth):
    true = (-2.1, 0.2, 1.0, 0.7, 0.3)
    want = moments.raw_moments(true)
    found, error = moments.fit_mixture(want, np.random.default_rng(1), 1e-4, 5, fifth)
    assert error < 1.0 and moments.raw_moments(found) == pytest.approx(want, abs=0.75)
    assert moments.likeliest(np.array([[1.0, 5.0]] * 3 + [[1.1, 5.0]])).tolist() == pytest.approx([1.0, 5.0], abs=0.2)


def test_bet_dispatch(spark):
    rows = spark.createDataFrame([(25.0, 24.0, 3), (20.0, 24.0, -2), (24.0, 24.0, 0)], "f double, p double, pos long")
    for func, w in (("sigmoid", 5.0), ("power", 2.0)):
        scaled = rows if func == "sigmoid" else rows.selectExpr("f / 10 AS f", "p / 10 AS p", "pos")
        gap = F.col("f") - F.col("p")
        size = moments.bet_size(gap, w, func)
        target = moments.target_position(F.col("f"), F.col("p"), w, 10, func)
        out = scaled.select("*", size.alias("size"), target.alias("target"), moments.inverse_price(F.col("f"), size, w, func).alias("back"), moments.limit_price(target, F.col("pos"), F.col("f"), w, 10, func).alias("limit"), F.when(gap != 0, moments.calibrate(gap, size, func)).alias("w")).collect()
        for r in out:
            x = r["f"] - r["p"]
            m = x / math.sqrt(w + x * x) if func == "sigmoid" else math.copysign(abs(x) ** w, x) if x else 0.0
            assert r["size"] == pytest.approx(m) and r["target"] == int(m * 10) and r["back"] == pytest.approx(r["p"])
            assert r["w"] is None or r["w"] == pytest.approx(w)
            sign = (r["target"] > r["pos"]) - (r["target"] < r["pos"])
            steps = [j for j in range(r["pos"] + sign, r["target"] + sign, sign)] if sign else []
            inv = lambda s: r["f"] - (s * math.sqrt(w / (1 - s * s)) if func == "sigmoid" else math.copysign(abs(s) ** (1 / w), s) if s else 0)
            assert r["limit"] is None if not sign else r["limit"] == pytest.approx(np.mean([inv(j / 10) for j in steps]))
    with pytest.raises(ValueError):
        moments.bet_size(F.lit(1.0), 1.0, "cube")


def test_reserve_bet_sizes(spark):
    rows = spark.createDataFrame([("a", 0, 10, 1), ("a", 2, 8, 1), ("a", 3, 5, -1), ("a", 6, 9, -1), ("a", 12, 15, -1)], "k string, t0 long, t1 long, side int")
    p = (-1.0, 1.5, 0.8, 1.2, 0.4)
    cdf = lambda x: p[4] * (1 + math.erf((x - p[0]) / p[2] / math.sqrt(2))) / 2 + (1 - p[4]) * (1 + math.erf((x - p[1]) / p[3] / math.sqrt(2))) / 2
    spans = rows.collect()
    for r in moments.bet_size_reserve(rows, ["k"], p).collect():
        c = sum(s["side"] for s in spans if s["t0"] <= r["t"] < s["t1"])
        assert r["c_t"] == c
        assert r["bet_size"] == pytest.approx((cdf(c) - cdf(0)) / (1 - cdf(0)) if c >= 0 else (cdf(c) - cdf(0)) / cdf(0), abs=1e-5)
    net = [sum(s["side"] for s in spans if s["t0"] <= t < s["t1"]) for t in sorted({s["t0"] for s in spans})]
    assert moments.concurrency_moments(rows, ["k"]) == pytest.approx([np.mean(np.array(net, float) ** k) for k in range(1, 6)])


def test_stopping_levels_maximise_value():
    s = moments.StoppingLevels(0.5, 9.0, 0.3, 0.05, 0.02, stop=0.1)
    x = 0.55
    u = np.linspace(1e-9, 40, 2_000_001)
    power = 0.05 / 9.0
    direct = np.trapezoid(np.exp(s.root * (x - 0.5) * u - u * u / 2) * u ** (power - 1) - u ** (power - 1) * (u < 1), u) + 1 / power
    assert s.f(x, 0.05) == pytest.approx(direct, rel=1e-3)
    b = s.liquidation()
    gain = lambda z: (z - 0.02) / s.f(z, 0.05)
    assert all(gain(b) >= gain(z) - 1e-9 for z in np.linspace(0.3, 1.5, 60))
    d = s.entry()
    buy = lambda z: (s.value(z) - z - 0.02) / s.g(z, 0.05)
    assert d < b and all(buy(d) >= buy(z) - 1e-9 for z in np.linspace(d - 0.5, b, 60))
    bl = s.liquidation_stop()
    assert s.stop < bl <= b + 1e-6
    lo, hi = s.entry_stop()
    assert s.stop < lo <= hi < bl
    assert s.value_stop(s.stop + 1e-9, b=bl) == pytest.approx(s.stop - 0.02, abs=1e-4)
    h = 1e-5  # smooth fit at the liquidation level
    assert (s.value_stop(bl - h, b=bl) - s.value_stop(bl - 2 * h, b=bl)) / h == pytest.approx(1.0, abs=1e-2)
    assert simplex(np.array([2.0, 0.0])).tolist() == [1.0, 0.0]
