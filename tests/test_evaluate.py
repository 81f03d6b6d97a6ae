"""Model evaluation against direct computation in numpy."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import evaluate as ev


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=240) > 0).astype(int)
    pdf = pd.DataFrame({"id": range(240), "a": x[:, 0], "b": x[:, 1], "c": x[:, 2], "y": y, "w": rng.uniform(0.5, 2, 240)})
    folds = pd.DataFrame([(i, f, "test" if i // 80 == f else "train") for i in range(240) for f in range(3) if i // 80 == f or abs(i - 80 * f) > 5], columns=["id", "fold", "role"])
    return spark.createDataFrame(pdf).repartition(3).cache(), spark.createDataFrame(folds).cache(), pdf, folds


def newton(x, y, w):
    x, b = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return b


def loss(x, y, w, b):
    p = 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    return float((w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / w.sum())


def split(pdf, folds, f, columns):
    train, test = (pdf[pdf["id"].isin(folds[(folds["fold"] == f) & (folds["role"] == r)]["id"])] for r in ("train", "test"))
    b = newton(train[columns].to_numpy(), train["y"].to_numpy(), train["w"].to_numpy())
    return test, b, loss(test[columns].to_numpy(), test["y"].to_numpy(), test["w"].to_numpy(), b)


def test_cv_score(data):
    df, folds, pdf, split_of = data
    got = {r["fold"]: r["score"] for r in ev.cv_score(df, folds, ["id"], ["a", "b", "c"], "y", "w").collect()}
    assert got == pytest.approx({f: split(pdf, split_of, f, ["a", "b", "c"])[2] for f in range(3)}, rel=1e-5)
    accuracy = {r["fold"]: r["score"] for r in ev.cv_score(df, folds, ["id"], ["a", "b"], "y", None, "accuracy").collect()}
    for f in range(3):
        train, test = (pdf[pdf["id"].isin(split_of[(split_of["fold"] == f) & (split_of["role"] == r)]["id"])] for r in ("train", "test"))
        b = newton(train[["a", "b"]].to_numpy(), train["y"].to_numpy(), np.ones(len(train)))
        assert accuracy[f] == pytest.approx((((b[0] + test[["a", "b"]] @ b[1:]) >= 0) == (test["y"] == 1)).mean())
    with pytest.raises(ValueError):
        ev.score_column("y", None, "area")


def test_single_feature_importance(data):
    df, folds, pdf, split_of = data
    got = {r["feature"]: (r["mean"], r["std"]) for r in ev.single_feature_importance(df, folds, ["id"], ["a", "b", "c"], "y", "w").collect()}
    for f in "abc":
        scores = [split(pdf, split_of, k, [f])[2] for k in range(3)]
        assert got[f] == pytest.approx((np.mean(scores), np.std(scores, ddof=1) / math.sqrt(3)), rel=1e-4)


def test_mean_decrease_accuracy(data, spark):
    df, folds, pdf, split_of = data
    names = ["a", "b", "c"]
    hashed = {f: {r["id"]: r["h"] for r in df.select("id", F.xxhash64(F.lit(f"42{f}"), "id").alias("h")).collect()} for f in names}

    def lost(group, k):
        test, b, full = split(pdf, split_of, k, names)
        test = test.sort_values("id")
        mixed = test.copy()
        for f in group:
            mixed[f] = test.loc[test["id"].map(hashed[f]).sort_values().index, f].to_numpy()
        part = loss(mixed[names].to_numpy(), mixed["y"].to_numpy(), mixed["w"].to_numpy(), b)
        return (full - part) / -part

    for clusters in (None, [["a", "c"], ["b"]]):
        got = {r["feature"]: (r["mean"], r["std"]) for r in ev.mean_decrease_accuracy(df, folds, ["id"], names, "y", "w", clusters=clusters).collect()}
        for group in clusters or [[f] for f in names]:
            values = [lost(group, k) for k in range(3)]
            for f in group:
                assert got[f] == pytest.approx((np.mean(values), np.std(values, ddof=1) / math.sqrt(3)), rel=1e-4)


def test_mean_decrease_impurity(data):
    trees = np.array([[0.5, 0.3, 0.2], [0.6, 0.0, 0.4], [0.2, 0.8, 0.0]])
    got = ev.mean_decrease_impurity(trees, ["a", "b", "c"])
    mean = np.array([np.mean([0.5, 0.6, 0.2]), np.mean([0.3, 0.8]), np.mean([0.2, 0.4])])
    assert [m for _, m, _ in got] == pytest.approx((mean / mean.sum()).tolist())
    assert got[1][2] == pytest.approx(np.std([0.3, 0.8], ddof=1) / math.sqrt(3) / mean.sum())
    shared = ev.mean_decrease_impurity(trees, ["a", "b", "c"], [["a", "b"], ["c"]])
    assert shared[0][1] == shared[1][1] > shared[2][1]
    real = ev.forest_importances(data[0], ["a", "b", "c"], "y", 6, 3)
    assert real.shape == (6, 3) and np.allclose(real.sum(1), 1)


def test_orthogonal_features(data):
    df, _, pdf, _ = data
    names = ["a", "b", "c"]
    out = ev.orthogonal_features(df, names, 1.0).orderBy("id").toPandas()
    z = (pdf[names] - pdf[names].mean()) / pdf[names].std()
    parts = out[["pc_1", "pc_2", "pc_3"]].to_numpy()
    gram = parts.T @ parts
    values = np.sort(np.linalg.eigvalsh(z.T @ z))[::-1]
    assert np.allclose(gram, np.diag(values), atol=1e-6)
    assert [c for c in ev.orthogonal_features(df, names, count=1).columns if c.startswith("pc")] == ["pc_1"]


def test_pca_importance(data):
    df, _, pdf, _ = data
    _, _, corr, n = ev.standard_moments(df, ["a", "b", "c"])
    assert np.allclose(corr, pdf[["a", "b", "c"]].corr())
    got = ev.pca_importance(corr, n, np.array([0.5, 0.3, 0.2]))
    assert all(-1 - 1e-9 <= v <= 1 + 1e-9 for v in got.values())
    x, y = np.array([1.0, 2, 3, 3]), np.array([2.0, 1, 4, 4])
    pairs = list(itertools.combinations(range(4), 2))
    sign = lambda v: int(v > 0) - int(v < 0)
    top = sum(sign(x[i] - x[j]) * sign(y[i] - y[j]) for i, j in pairs)
    assert ev.kendall(x, y) == pytest.approx(top / 5)
    assert ev.weighted_kendall(np.array([3.0, 2, 1]), np.array([3.0, 2, 1])) == pytest.approx(1) and ev.weighted_kendall(np.array([3.0, 2, 1]), np.array([1.0, 2, 3])) == pytest.approx(-1)


def test_fingerprint(data):
    df, _, pdf, _ = data
    got = {(r["effect"], r["feature"]): (r["raw"], r["norm"]) for r in ev.fingerprint(df, ["a", "b"], lambda c: 2 * c["a"] + c["b"] * c["b"] + c["a"] * c["b"], 8, [("a", "b")]).collect()}
    model = lambda a, b: 2 * a + b * b + a * b
    grid = {f: np.quantile(pdf[f], np.linspace(0, 1, 8)) for f in "ab"}
    mean = {"a": np.array([model(v, pdf["b"]).mean() for v in grid["a"]]), "b": np.array([model(pdf["a"], v).mean() for v in grid["b"]])}
    raw = {}
    for f in "ab":
        line = np.polyval(np.polyfit(grid[f], mean[f], 1), grid[f])
        raw["linear", f], raw["non_linear", f] = np.abs(line - mean[f].mean()).mean(), np.abs(line - mean[f]).mean()
    both = np.array([[model(p, q) for q in grid["b"]] for p in grid["a"]])
    raw["pairwise", "a,b"] = np.abs(both - both.mean() - (mean["a"] - mean["a"].mean())[:, None] - (mean["b"] - mean["b"].mean())[None, :]).mean()
    assert {k: v[0] for k, v in got.items()} == pytest.approx(raw, abs=1e-9)
    assert got["linear", "a"][1] == pytest.approx(raw["linear", "a"] / (raw["linear", "a"] + raw["linear", "b"]))


def test_bagging_by_sequential_bootstrap(spark, data):
    df, _, pdf, _ = data
    spans = df.select("id", F.col("id").alias("first"), (F.col("id") + 3).alias("last"))
    weights = ev.bootstrap_weights(spans, "id", 4).cache()
    sums = {r["estimator"]: (r["n"], r["m"]) for r in weights.groupBy("estimator").agg(F.sum("times").alias("n"), F.count("id").alias("m")).collect()}
    assert sums == {e: (240, 240) for e in range(4)}
    models, score = ev.bagging(df, weights, "id", ["a", "b", "c"], "y", 2 / 3)
    assert 0.6 < score <= 1 and all((np.abs(b[1:]) < 1e-12).sum() == 1 for b in models.values())
    times = weights.where("estimator = 2").toPandas().set_index("id")["times"].reindex(range(240)).to_numpy()
    used = [k for k in range(3) if abs(models[(2,)][k + 1]) > 1e-12]
    b = newton(pdf[["a", "b", "c"]].to_numpy()[:, used], pdf["y"].to_numpy(), times.astype(float))
    assert models[(2,)][[0, *(k + 1 for k in used)]] == pytest.approx(b, rel=1e-4)


def test_classification_data(spark):
    df = ev.classification_data(spark, 2, 1, 2, 400, sigma=0.0)
    assert df.columns == ["id", "I_0", "I_1", "N_0", "N_1", "R_0", "label"]
    pdf = df.toPandas()
    assert (pdf["R_0"] == pdf["I_0"]).all() and 0.3 < pdf["label"].mean() < 0.7
    assert ((pdf["I_0"] + pdf["I_1"] > 0) == (pdf["label"] == 1)).mean() > 0.9


def test_sequential_bootstrap_chances():
    """First draw uniform over disjoint labels; after a draw, labels that overlap it fall behind."""
    from tickloom.operators.labels import seq_bootstrap

    start, end = np.array([0, 0, 10]), np.array([4, 4, 14])
    seconds = [seq_bootstrap(start, end, 2, np.random.default_rng(k)) for k in range(3000)]
    first = np.bincount([s[0] for s in seconds], minlength=3) / 3000
    assert first == pytest.approx([1 / 3] * 3, abs=0.04)
    after = np.bincount([s[1] for s in seconds if s[0] == 0], minlength=3)
    assert after / after.sum() == pytest.approx([0.25, 0.25, 0.5], abs=0.05)


def test_robust_covariance_in_passes(spark):
    rng = np.random.default_rng(8)
    x = rng.multivariate_normal([0, 0], [[1, 0.5], [0.5, 1]], 600)
    x[:60] += 25
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b"]))
    got = ev.robust_covariance(df, ["a", "b"])
    assert np.allclose(got, [[1, 0.5], [0.5, 1]], atol=0.3) and np.abs(np.cov(x.T)[0, 0]) > 20
    from tickloom.operators.allocation import minimum_covariance_determinant

    assert np.allclose(got, minimum_covariance_determinant(x, rng), atol=0.1)
