"""Factors, generators and dependence against definitions, planted structure and brute force."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.operators import dependence, factors, generate


def test_gradient_of_the_objective():
    x, _ = factors.modular_data(8, 2, 300, 1)
    c = np.corrcoef(x.T)
    w = np.random.default_rng(2).normal(size=(3, 8)) * 0.1
    exact = factors.LinearFactors.gradient(w, factors.LinearFactors.moments(w, c)) @ c
    for j, i in itertools.product(range(3), range(8)):
        e = np.zeros_like(w)
        e[j, i] = 1e-6
        slope = (factors.LinearFactors.moments(w + e, c)["tc"] - factors.LinearFactors.moments(w - e, c)["tc"]) / 2e-6
        assert exact[j, i] == pytest.approx(slope, rel=1e-4, abs=1e-6)


def test_linear_factors_find_planted_groups():
    x, parent = factors.modular_data(18, 3, 2000, 4)
    c = np.corrcoef(x.T)
    model = factors.LinearFactors(c, 3, 1)
    groups = {frozenset(np.nonzero(model.clusters() == k)[0]) for k in range(3)}
    assert groups == {frozenset(np.nonzero(parent == k)[0]) for k in range(3)}
    total = -0.5 * np.linalg.slogdet(c)[1]
    assert 0.85 * total < model.found["tc"] <= total + 1e-6
    assert model.found["tcs"].tolist() == sorted(model.found["tcs"], reverse=True)
    assert np.abs(model.covariance() - c).max() < 0.2
    assert factors.pick_factors(c, 1, 5) in (3, 4)


def test_sieve_takes_one_factor_after_another():
    x, parent = factors.modular_data(10, 2, 2000, 7)
    layers = factors.sieve(np.corrcoef(x.T), 3)
    tops = [set(np.argsort(-np.abs(w))[:5]) for w, _, _ in layers[:2]]
    assert {frozenset(t) for t in tops} == {frozenset(np.nonzero(parent == k)[0]) for k in range(2)}
    assert layers[2][1] < 0.2 * layers[0][1]
    assert np.allclose(np.diag(layers[0][2]), 1)


def test_discrete_factors_find_states():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 2, 800), rng.integers(0, 2, 800)
    x = np.column_stack([a * 4 + rng.normal(size=800) for _ in range(4)] + [b * 4 + rng.normal(size=800) for _ in range(4)])
    x[::50, 1] = np.nan
    model = factors.DiscreteFactors(x, 2, 2, 1)
    assert {frozenset(np.nonzero(model.clusters() == k)[0]) for k in range(2)} == {frozenset(range(4)), frozenset(range(4, 8))}
    states = model.transform(x)
    for truth in (a, b):
        assert max(abs(np.corrcoef(states[:, k], truth)[0, 1]) for k in range(2)) > 0.95
    assert model.history[-1] > 1.5  # near 2 * (H(x_1..x_4) - ...) of two binary parents


def test_gaussianize(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=4000)
    y = 2 + 3 * z * np.exp(0.2 * z * z / 2)
    tau = factors.heavy_tail_fit(y)
    assert tau[0] == pytest.approx(2, abs=0.2) and tau[1] == pytest.approx(3, abs=0.25) and tau[2] == pytest.approx(0.2, abs=0.06)
    x = factors.gaussianized(y, "lambert")
    assert factors._kurtosis(x) == pytest.approx(3, abs=0.05) and np.allclose(factors.inverse_lambert(x, tau), y, rtol=1e-4)
    assert np.allclose(factors.lambert(np.array([0.0, 1.0, math.e])), [0, 0.5671432904, 1])
    assert factors.box_cox_fit(np.exp(z)) == pytest.approx(0, abs=0.05)
    r = factors.gaussianized(y, "rank")
    assert abs(r.std() - 1) < 0.01 and (np.argsort(r) == np.argsort(y)).all()
    assert factors.normal_quantile(np.array([0.5, 0.975])).tolist() == pytest.approx([0, 1.959964], abs=1e-5)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y[:300])] + [("b", 0, None), ("b", 1, 1.0)], "k string, i int, v double")
    out = {(r["k"], r["i"]): r["gaussian"] for r in factors.gaussianize(df, ["k"], "i", "v", "rank").collect()}
    assert len(out) == 301 and [out["a", i] for i in range(300)] == pytest.approx(factors.gaussianized(y[:300], "rank").tolist())


def test_price_changes(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (2, "a", 2.0), (3, "a", 1.0), (3, "b", 4.0)], "t int, s string, p double")
    rows = factors.price_changes(df, "t", "s", "p").orderBy("t").collect()
    assert [(r["t"], r["a"], r["b"]) for r in rows] == [(2, pytest.approx(math.log(2)), 0.0), (3, pytest.approx(-math.log(2)), pytest.approx(math.log(2)))]


def test_bootstraps():
    rng = np.random.default_rng(1)
    x = np.arange(60.0).reshape(10, 6)
    rows = generate.row_bootstrap(x, rng)
    assert rows.shape == x.shape and {tuple(r) for r in rows} <= {tuple(r) for r in x}
    part = generate.row_bootstrap(x, rng, (10, 3))
    assert part.shape == (10, 3) and all(tuple(r) in {tuple(q[k : k + 3]) for q in x for k in range(4)} for r in part)
    blocks = generate.block_bootstrap(x, rng, block=(4, 4))
    cut = {tuple(x[a : a + 4, b : b + 4].ravel()) for a in (0, 4, 6) for b in (0, 2)}
    assert blocks.shape == x.shape and tuple(blocks[:4, :4].ravel()) in cut
    z = rng.normal(size=(400, 2)) @ np.array([[1, 0.8], [0, 0.6]])
    pair = generate.pair_bootstrap(z, rng)
    assert pair[0, 1] == pair[1, 0] == pytest.approx(np.corrcoef(z.T)[0, 1], abs=0.08)


def test_correlated_walks():
    walks = generate.correlated_walks(8, 6000, np.random.default_rng(2), groups=2, main=0.1, shared=0.4)
    corr = np.corrcoef(np.diff(walks, axis=0).T)
    inside = np.mean([corr[i, j] for i, j in itertools.combinations(range(4), 2)])
    assert inside == pytest.approx(0.5, abs=0.06) and corr[0, 7] == pytest.approx(0.1, abs=0.06) and abs(walks[0].mean() - 100) < 3


@pytest.mark.parametrize("make", [lambda r: generate.vine(5, r, "d"), lambda r: generate.vine(5, r, "c"), lambda r: generate.onion(5, r), lambda r: generate.vine(5, r, "c", fixed=(2.0, 2.0))])
def test_random_correlations_are_valid(make):
    rng = np.random.default_rng(3)
    every = [make(rng) for _ in range(400)]
    assert all(np.linalg.eigvalsh(c)[0] > -1e-9 and np.allclose(np.diag(c), 1) and np.allclose(c, c.T) for c in every)


def test_vines_and_onions_are_uniform():
    """Uniform matrices of dimension d have entries 2 Beta(d/2, d/2) - 1, whatever the pair."""
    rng = np.random.default_rng(4)
    for make in (lambda: generate.vine(4, rng, "d"), lambda: generate.vine(4, rng, "c"), lambda: generate.onion(4, rng)):
        every = np.array([make() for _ in range(4000)])
        for i, j in itertools.combinations(range(4), 2):
            assert every[:, i, j].var() == pytest.approx(4 * (4 / 16) / 5, abs=0.02)


def test_facts_of_matrices():
    found = generate.facts([np.eye(4), np.eye(4)])
    assert [v for f, _, v in found if f == "eigenvalues"] == [1, 1, 1, 1]
    star = np.eye(4)
    star[0, 1:] = star[1:, 0] = 0.5
    assert generate.degree_counts(star).tolist() == [0, 1, 0, 1 / 3]
    assert generate.leading_vector(star)[0] == pytest.approx(math.sqrt(0.5))


def test_assignment_equals_all_permutations():
    rng = np.random.default_rng(6)
    for _ in range(30):
        cost = rng.uniform(size=(6, 6))
        best = min(sum(cost[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6)))
        match = dependence.assignment(cost)
        assert sorted(match) == list(range(6)) and cost[np.arange(6), match].sum() == pytest.approx(best)


def test_line_transport_equals_assignment():
    rng = np.random.default_rng(7)
    for _ in range(20):
        a, b = rng.multinomial(12, np.ones(6) / 6), rng.multinomial(12, np.ones(6) / 6)
        at = np.linspace(0, 1, 6)
        p, q = np.repeat(at, a), np.repeat(at, b)
        cost = (p[:, None] - q[None, :]) ** 2
        assert dependence.line_transport(a / 12, b / 12) == pytest.approx(cost[np.arange(12), dependence.assignment(cost)].mean())


def test_distances():
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=200), rng.normal(2, 1, 200)
    assert dependence.gnpr_distance(x, x, 0.5) == 0 and dependence.gnpr_distance(x, y, 0.5) > 0
    n = 200
    a, b = (np.sort(np.histogram(v, bins=20)[0] / n) for v in (x, y))
    want = math.sqrt(0.3 * 3 / (n * (n * n - 1)) * ((x - y) ** 2).sum() + 0.7 * dependence.line_transport(a, b))
    assert dependence.gnpr_distance(x, y, 0.3, 20) == pytest.approx(want)


@pytest.mark.parametrize("kind", ["comonotonicity", "countermonotonicity", "gaussian", "positive_negative", "different_variations", "small_variations", "v-shape"])
def test_transport_dependence(kind):
    rng = np.random.default_rng(9)
    own = dependence.target_copula(kind, 60, rng)
    assert own.shape == (60, 2)
    if kind == "comonotonicity":
        x = rng.normal(size=60)
        assert dependence.transport_dependence(x, np.exp(x), kind, rng) > 0.95 > 0.5 > dependence.transport_dependence(x, -x, kind, rng)
    if kind == "v-shape":
        x = rng.normal(size=60)
        assert dependence.transport_dependence(x, np.abs(np.argsort(np.argsort(x)) - 30.0), kind, rng) > 0.7
    with pytest.raises(ValueError):
        dependence.target_copula("none", 5, rng)


def test_gpr_distance(spark):
    rng = np.random.default_rng(10)
    x, y = rng.normal(size=50), rng.normal(1, 2, 50)
    pairs = spark.createDataFrame([("a", "b", float(p), float(q)) for p, q in zip(x, y)], "i string, j string, x double, y double")
    ranks = spark.createDataFrame([("a", "b", 0.2)], "i string, j string, rho double")
    got = dependence.gpr_distances(pairs, ranks, 0.4).first()["distance"]
    s = x.std() ** 2 + y.std() ** 2
    want = 0.4 * 0.8 / 2 + 0.6 * (1 - math.sqrt(2 * x.std() * y.std() / s) * math.exp(-((x.mean() - y.mean()) ** 2) / (4 * s)))
    assert got == pytest.approx(math.sqrt(want)) and F is not None
