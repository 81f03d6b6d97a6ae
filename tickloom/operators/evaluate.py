"""Model evaluation: cross-validated scores, feature importances, orthogonal features, model fingerprints, bagging by sequential bootstrap.

Models of one kind but many training sets (folds, features, estimators) are fitted together: each step sums every set's
normal equations in one aggregation, and the driver solves small systems. Rows never leave the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import reachable
from .labels import seq_bootstrap

Key = tuple


def _margin(features: list[str]) -> Column:
    return sum((F.element_at("_b", k + 2) * F.col(f) for k, f in enumerate(features)), F.element_at("_b", 1))


def _with_models(df: DataFrame, by: list[str], models: dict[Key, np.ndarray]) -> DataFrame:
    """Each row beside its model's coefficients; one small row a model."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in by), "_b array<double>"])
    table = df.sparkSession.createDataFrame([(*k, [float(x) for x in b]) for k, b in models.items()], schema)
    return df.join(F.broadcast(table), by)  # folds times features, with a coefficient a feature


def fit_logistic(df: DataFrame, by: list[str], features: list[str], label: str, weight: str | None = None, ridge: float = 1e-6, steps: int = 12) -> dict[Key, np.ndarray]:
    """Coefficients (constant first) of a weighted logistic regression for each value of ``by``, by Newton steps over summed equations."""
    weight_of = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.where(F.col(label).isNotNull()).select(*by, *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y"), weight_of.alias("_w")).dropna(subset=features)
    keys = [tuple(r) for r in rows.select(*by).distinct().collect()]
    k = len(features) + 1
    models = {key: np.zeros(k) for key in keys}
    x = [F.lit(1.0), *[F.col(f) for f in features]]
    for _ in range(steps):
        p = 1 / (1 + F.exp(-F.greatest(F.least(_margin(features), F.lit(30.0)), F.lit(-30.0))))
        stepped = _with_models(rows, by, models).withColumn("_p", p).withColumn("_v", F.col("_w") * F.col("_p") * (1 - F.col("_p"))).withColumn("_e", F.col("_w") * (F.col("_y") - F.col("_p")))
        sums = [F.sum(F.col("_v") * x[i] * x[j]).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(F.col("_e") * x[i]).alias(f"g{i}") for i in range(k)]
        most = 0.0
        for r in stepped.groupBy(*by).agg(*sums).collect():
            key = tuple(r[c] for c in by)
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
            step = np.linalg.lstsq(h + ridge * np.eye(k), np.array([r[f"g{i}"] for i in range(k)]) - ridge * models[key], rcond=None)[0]
            models[key] = models[key] + step
            most = max(most, float(np.abs(step).max()))
        if most < 1e-9:
            break
    return models


def with_probability(df: DataFrame, by: list[str], models: dict[Key, np.ndarray], features: list[str]) -> DataFrame:
    """``df`` with ``p``, the chance of label 1 under each row's model."""
    return _with_models(df, by, models).withColumn("p", 1 / (1 + F.exp(-F.greatest(F.least(_margin(features), F.lit(30.0)), F.lit(-30.0))))).drop("_b")


def score_column(label: str, weight: str | None, scoring: str) -> Column:
    """Aggregate of ``p`` against the label: ``log_loss`` (negated, higher is better) or ``accuracy``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    p, y = F.greatest(F.least(F.col("p"), F.lit(1 - 1e-15)), F.lit(1e-15)), F.col(label).cast("double")
    if scoring == "log_loss":
        return F.try_divide(F.sum(w * (y * F.ln(p) + (1 - y) * F.ln(1 - p))), F.sum(w))
    if scoring == "accuracy":
        return F.try_divide(F.sum(w * F.when((p >= 0.5) == (y == 1), 1.0).otherwise(0.0)), F.sum(w))
    raise ValueError(f"unknown score {scoring}")


def cv_score(data: DataFrame, folds: DataFrame, keys: list[str], features: list[str], label: str, weight: str | None = None, scoring: str = "log_loss") -> DataFrame:
    """(fold, score): a model fitted on each fold's training rows scores its test rows. ``folds(keys, fold, role)``."""
    rows = data.join(folds, keys)
    models = fit_logistic(rows.where("role = 'train'"), ["fold"], features, label, weight)
    return with_probability(rows.where("role = 'test'"), ["fold"], models, features).groupBy("fold").agg(score_column(label, weight, scoring).alias("score"))


def _summary(scores: DataFrame, by: str) -> DataFrame:
    """Mean and standard error over folds; what is not finite counts as 0."""
    n = F.count("score")
    fine = lambda c: F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)
    return scores.groupBy(by).agg(fine(F.avg("score")).alias("mean"), fine(F.try_divide(F.stddev_samp("score"), F.sqrt(n))).alias("std"))


def single_feature_importance(data: DataFrame, folds: DataFrame, keys: list[str], features: list[str], label: str, weight: str | None = None, scoring: str = "log_loss") -> DataFrame:
    """(feature, mean, std) of the cross-validated score of each feature alone; all models are fitted together."""
    long = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]))
    rows = data.join(folds, keys).withColumn("_f", long).select("fold", "role", "_f.feature", "_f.x", label, *([weight] if weight else []))
    models = fit_logistic(rows.where("role = 'train'"), ["fold", "feature"], ["x"], label, weight)
    scored = with_probability(rows.where("role = 'test'"), ["fold", "feature"], models, ["x"])
    return _summary(scored.groupBy("fold", "feature").agg(score_column(label, weight, scoring).alias("score")), "feature")


def mean_decrease_accuracy(data: DataFrame, folds: DataFrame, keys: list[str], features: list[str], label: str, weight: str | None = None, scoring: str = "log_loss", clusters: list[list[str]] | None = None, seed: int = 42) -> DataFrame:
    """(feature, mean, std): the share of a fold's score lost when a feature (or all of its cluster) is shuffled among the test rows.

    A shuffle takes each row's value from the row of the same place in the order of a seeded hash.
    """
    rows = data.join(folds, keys)
    models = fit_logistic(rows.where("role = 'train'"), ["fold"], features, label, weight)
    test = rows.where("role = 'test'").withColumn("_at", F.row_number().over(Window.partitionBy("fold").orderBy(*keys)))
    score = lambda df, by: with_probability(df, ["fold"], models, features).groupBy(*by).agg(score_column(label, weight, scoring).alias("score"))
    whole = score(test, ["fold"]).withColumnRenamed("score", "full")
    parts = None
    for group in clusters or [[f] for f in features]:
        shuffled = test
        for f in group:
            taken = test.select("fold", F.row_number().over(Window.partitionBy("fold").orderBy(F.xxhash64(F.lit(f"{seed}{f}"), *keys), *keys)).alias("_at"), F.col(f).alias("_x"))
            shuffled = shuffled.join(taken, ["fold", "_at"]).drop(f).withColumnRenamed("_x", f)
        one = shuffled.select("fold", *features, label, *([weight] if weight else []), F.explode(F.array(*[F.lit(f) for f in group])).alias("feature"))
        parts = one if parts is None else parts.unionByName(one)
    lost = score(parts, ["fold", "feature"]).join(whole, "fold")
    base = -F.col("score") if scoring == "log_loss" else F.when(F.col("score") != 1.0, 1.0 - F.col("score"))
    return _summary(lost.withColumn("score", F.try_divide(F.col("full") - F.col("score"), base)), "feature")


def mean_decrease_impurity(trees: np.ndarray, names: list[str], clusters: list[list[str]] | None = None) -> list[tuple[str, float, float]]:
    """(feature, mean, std) from importances by tree (rows): zeros count as missing, means add up to 1; a cluster's features share its sum."""
    table = pd.DataFrame(trees, columns=names).replace(0.0, np.nan)
    root = len(table) ** -0.5
    if clusters:
        parts = {f: table[g].sum(axis=1) for g in clusters for f in g}
        mean, std = pd.Series({f: parts[f].mean() for f in names}), pd.Series({f: parts[f].std() * root for f in names})
    else:
        mean, std = table.mean(), table.std() * root
    total = mean.sum()
    return [(f, float(np.nan_to_num(mean[f] / total)), float(np.nan_to_num(std[f] / total))) for f in names]


def forest_importances(data: DataFrame, features: list[str], label: str, trees: int = 20, depth: int = 4, seed: int = 1) -> np.ndarray:
    """Impurity importances of each tree of a random forest that the cluster grows, one random feature at a split."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=features, outputCol="_v").transform(data.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).dropna())
    model = RandomForestClassifier(featuresCol="_v", labelCol="_y", numTrees=trees, maxDepth=depth, featureSubsetStrategy="1", seed=seed).fit(rows)
    return np.array([t.featureImportances.toArray() for t in model.trees])


def standard_moments(df: DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Means, sample deviations, correlations and the number of rows, in one pass."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i + 1, len(features))]
    row = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)], *[F.stddev_samp(f).alias(f"s{i}") for i, f in enumerate(features)], *[F.corr(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    corr = np.eye(len(features))
    for i, j in pairs:
        corr[i, j] = corr[j, i] = row[f"c{i}_{j}"]
    return np.array([row[f"m{i}"] for i in range(len(features))]), np.array([row[f"s{i}"] for i in range(len(features))]), corr, row["n"]


def robust_covariance(df: DataFrame, columns: list[str], share: float | None = None, steps: int = 30) -> np.ndarray:
    """Minimum covariance determinant over all rows: steps that keep the nearest ``share`` of rows (about half), then a reweighting.

    Starts from medians and median deviations. Each step is one pass for the distances' quantile and one for the moments of the
    rows within it; k-by-k sums reach the driver.
    """
    from .allocation import chi_square_quantile

    k, n = len(columns), df.count()
    share = share or (n + k + 1) / (2 * max(n, 1))
    if n <= k + 1:
        return np.full((k, k), np.nan)
    middle = np.array(list(df.agg(*[F.percentile(c, 0.5) for c in columns]).first()), float)
    spread = np.array(list(df.agg(*[F.percentile(F.abs(F.col(c) - F.lit(float(m))), 0.5) for c, m in zip(columns, middle, strict=True)]).first()), float) * 1.4826
    cov = np.diag(np.maximum(spread, 1e-12) ** 2)

    def distance() -> Column:
        inverse = np.linalg.pinv(cov)
        gap = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, middle, strict=True)]
        return sum((F.lit(float(inverse[i, j])) * gap[i] * gap[j] for i in range(k) for j in range(k)), F.lit(0.0))

    def within(limit: float) -> tuple[np.ndarray, np.ndarray]:
        rows = df.where(distance() <= limit)
        sums = rows.agg(*[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)], *[F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        return np.array([sums[f"m{i}"] for i in range(k)], float), np.array([[sums[f"c{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)], float)

    last = math.inf
    for _ in range(steps):
        limit = df.agg(F.percentile(distance(), share)).first()[0]
        middle, cov = within(limit)
        size = np.linalg.slogdet(cov)[1]
        if not size < last - 1e-9:
            break
        last = size
    cov = cov * df.agg(F.percentile(distance(), 0.5)).first()[0] / chi_square_quantile(0.5, k)
    return within(chi_square_quantile(0.975, k))[1]


def leading_vectors(corr: np.ndarray, n: int, share: float = 0.95, count: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues of Z'Z that hold ``share`` of the variance (or ``count``), and their vectors (largest component positive)."""
    values, vectors = np.linalg.eigh(corr * (n - 1))
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(0), np.arange(len(values))])
    dim = count or int(np.searchsorted(np.cumsum(values) / values.sum(), share)) + 1
    return values[:dim], vectors[:, :dim]


def orthogonal_features(df: DataFrame, features: list[str], share: float = 0.95, count: int | None = None) -> DataFrame:
    """``df`` with ``pc_1``..: standardised features along the leading vectors."""
    mean, dev, corr, n = standard_moments(df, features)
    _, vectors = leading_vectors(corr, n, share, count)
    z = [(F.col(f) - F.lit(float(m))) / F.lit(float(s)) for f, m, s in zip(features, mean, dev, strict=True)]
    return df.withColumns({f"pc_{k + 1}": sum((c * F.lit(float(v)) for c, v in zip(z, vectors[:, k], strict=True)), F.lit(0.0)) for k in range(vectors.shape[1])})


def _ranks(x: np.ndarray) -> np.ndarray:
    return pd.Series(x).rank().to_numpy()


def kendall(x: np.ndarray, y: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Tau-b; with ``weights`` each pair counts by the sum of its rows' weights."""
    a, b = np.sign(x[:, None] - x[None, :]), np.sign(y[:, None] - y[None, :])
    w = np.ones_like(a) if weights is None else weights[:, None] + weights[None, :]
    return float((w * a * b).sum() / math.sqrt((w * a * a).sum() * (w * b * b).sum()))


def weighted_kendall(x: np.ndarray, y: np.ndarray) -> float:
    """Mean of the taus weighted by falling ranks of either (1 / (1 + rank), ties by the other)."""
    total = 0.0
    for p, q in ((x, y), (y, x)):
        rank = np.empty(len(x))
        rank[np.lexsort((-q, -p))] = np.arange(len(x))
        total += kendall(x, y, 1 / (1 + rank))
    return total / 2


def pca_importance(corr: np.ndarray, n: int, importance: np.ndarray, share: float = 0.95) -> dict[str, float]:
    """How an importance agrees with the features' parts in the leading vectors: Pearson, Spearman, Kendall and weighted Kendall of ranks."""
    values, vectors = leading_vectors(corr, n, share)
    parts = np.abs(vectors * values)
    x, y = np.tile(importance, parts.shape[1]), parts.T.ravel()
    place = _ranks(-parts.sum(1))
    return {"pearson": float(np.corrcoef(x, y)[0, 1]), "spearman": float(np.corrcoef(_ranks(x), _ranks(y))[0, 1]), "kendall": kendall(x, y), "weighted_kendall": weighted_kendall(np.asarray(importance, float), 1 / place)}


def fingerprint(df: DataFrame, features: list[str], predict: Callable[[dict[str, Column]], Column], values: int = 50, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """(effect, feature, raw, norm) of a model given as a column of its inputs: linear, non-linear and pairwise parts of partial dependence.

    The grid is each feature's quantiles; one pass averages the predictions at all grid values, one more for each pair.
    """
    asked = [float(q) for q in np.linspace(0, 1, values)]
    found = df.agg(*[F.percentile(f, asked).alias(f) for f in features]).first()
    grid = {f: np.array(found[f], float) for f in features}
    own = {f: F.col(f).cast("double") for f in features}

    def averages(group: tuple[str, ...]) -> np.ndarray:
        """Mean predictions with the group's features held at every combination of grid values."""
        held = [F.array(*[F.lit(float(v)) for v in grid[f]]) for f in group]
        rows = df
        for k, a in enumerate(held):
            rows = rows.select("*", F.posexplode(a).alias(f"_i{k}", f"_v{k}"))
        at = predict(own | {f: F.col(f"_v{k}") for k, f in enumerate(group)})
        out = np.empty([values] * len(group))
        for r in rows.groupBy(*[f"_i{k}" for k in range(len(group))]).agg(F.avg(at).alias("y")).collect():
            out[tuple(r[f"_i{k}"] for k in range(len(group)))] = r["y"]
        return out

    mean = {f: averages((f,)) for f in features}
    effects: dict[str, dict[str, float]] = {"linear": {}, "non_linear": {}, "pairwise": {}}
    for f in features:
        line = np.polyval(np.polyfit(grid[f], mean[f], 1), grid[f]) if np.ptp(grid[f]) > 0 else np.full(values, mean[f].mean())
        effects["linear"][f] = float(np.abs(line - mean[f].mean()).mean())
        effects["non_linear"][f] = float(np.abs(line - mean[f]).mean())
    for a, b in pairs or []:
        both = averages((a, b))
        parts = (mean[a] - mean[a].mean())[:, None] + (mean[b] - mean[b].mean())[None, :]
        effects["pairwise"][f"{a},{b}"] = float(np.abs(both - both.mean() - parts).mean())
    rows = [(kind, f, v, v / total if (total := sum(part.values())) else 0.0) for kind, part in effects.items() for f, v in part.items()]
    return df.sparkSession.createDataFrame(rows, "effect string, feature string, raw double, norm double")


def bootstrap_weights(spans: DataFrame, key: str, estimators: int, draws: int | None = None, seed: int = 0) -> DataFrame:
    """(estimator, key, times): how often each estimator's sequential bootstrap drew a label. ``spans(key, first, last)`` are bar numbers.

    Each estimator is one task over narrow rows.
    """
    types = dict(spans.dtypes)

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        taken = seq_bootstrap(pdf["first"].to_numpy(int), pdf["last"].to_numpy(int), draws or len(pdf), np.random.default_rng([seed, int(pdf["estimator"].iloc[0])]))
        return pd.DataFrame({"estimator": pdf["estimator"], key: pdf[key], "times": np.bincount(taken, minlength=len(pdf))})

    reachable(spans.sparkSession)
    rows = spans.select(key, "first", "last").withColumn("estimator", F.explode(F.sequence(F.lit(0), F.lit(estimators - 1))))
    return rows.groupBy("estimator").applyInPandas(draw, f"estimator int, `{key}` {types[key]}, times long")


def bagging(data: DataFrame, weights: DataFrame, key: str, features: list[str], label: str, most_features: float = 1.0, seed: int = 0) -> tuple[dict[Key, np.ndarray], float]:
    """Models of all estimators, fitted together on their drawn rows and random features, and the out-of-bag accuracy of their mean.

    A feature that an estimator does not use has coefficient 0.
    """
    rows = data.join(weights, key)
    estimators = [r[0] for r in weights.select("estimator").distinct().collect()]
    k = max(1, round(most_features * len(features)))
    used = {e: sorted(np.random.default_rng([seed, 1, e]).choice(len(features), size=k, replace=False).tolist()) for e in estimators}
    mask = rows.sparkSession.createDataFrame([(e, used[e]) for e in estimators], "estimator int, _u array<int>")
    rows = rows.join(F.broadcast(mask), "estimator")
    rows = rows.withColumns({f: F.when(F.array_contains("_u", i), F.col(f).cast("double")).otherwise(0.0) for i, f in enumerate(features)})
    models = fit_logistic(rows.where("times > 0"), ["estimator"], features, label, "times")
    out = with_probability(rows.where("times = 0"), ["estimator"], models, features).groupBy(key).agg(F.avg("p").alias("p"), F.first(label).alias(label))
    return models, float(out.agg(score_column(label, None, "accuracy").alias("a")).first()["a"] or 0.0)


def classification_data(spark, informative: int, redundant: int, noise: int, rows: int, seed: int = 0, sigma: float = 0.0) -> DataFrame:
    """id, ``I_`` features that make the label, ``R_`` copies of them with ``sigma`` noise, ``N_`` noise, and ``label`` 0 or 1."""
    df = spark.range(rows).withColumns({f"I_{k}": F.randn(seed + k) for k in range(informative)})
    df = df.withColumns({f"N_{k}": F.randn(seed + 1000 + k) for k in range(noise)}) if noise else df
    df = df.withColumns({f"R_{k}": F.col(f"I_{k % informative}") + sigma * F.randn(seed + 2000 + k) for k in range(redundant)}) if redundant else df
    return df.withColumn("label", F.when(sum((F.col(f"I_{k}") for k in range(informative)), F.lit(0.0)) + 0.1 * F.randn(seed + 3000) > 0, 1).otherwise(0))
