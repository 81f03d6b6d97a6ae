"""Queries over clusters, networks, portfolios, mixtures, model evaluation, factors, generators and chart patterns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.stats import round_scaled
from ..functions.windows import ordered
from ..operators import allocation as al
from ..operators import backtest as bt
from ..operators import bars as ba
from ..operators import clusters as cl
from ..operators import dependence as dp
from ..operators import evaluate as ev
from ..operators import extras as ex
from ..operators import factors as fa
from ..operators import generate as ge
from ..operators import market as mk
from ..operators import matrices as mx
from ..operators import micro
from ..operators import moments as mo
from ..operators import networks as nw
from ..operators import patterns as pt
from ..sources import testdata as src
from . import label_queries as lq
from .registry import normal_sql, query

KEY = ["symbol"]
SEED = 7


def _r(c: str, n: int = 6):
    return (F.round(c, n) + 0.0).alias(c)


#: Mean price by day and hour: 24 columns whose correlations make the matrices below.
_HOURS = "hp AS (SELECT us // 86400000000 AS day, us // 3600000000 % 24 AS hour, avg(price) AS x FROM t GROUP BY ALL)"


def hours(spark, sf):
    us = F.col("us")
    return src.ticks(spark, sf).groupBy(F.floor(us / 86400000000).alias("day"), (F.floor(us / 3600000000) % 24).alias("hour")).agg(F.avg("price").alias("x"))


def hour_matrix(spark, sf) -> tuple[list, np.ndarray]:
    """Correlations of the hours; 24 squared numbers reach the driver."""
    names, m = mx.dense(mx.correlations(hours(spark, sf), "day", "hour", "x"), "rho")
    m = np.nan_to_num(m)
    np.fill_diagonal(m, 1.0)
    return names, m


def _distance(m: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((1 - m) / 2, 0))


def _rows(spark, rows, schema: str):
    return spark.createDataFrame([tuple(v.item() if isinstance(v, np.generic) else v for v in r) for r in rows], schema)


def _labels(name: str, kernel):
    @query(name)
    def run(spark, sf):
        names, m = hour_matrix(spark, sf)
        return _rows(spark, zip(names, kernel(m)), "hour long, cluster long")


_vectors = lambda m: cl.rows_distance(_distance(m))
_labels("kmeans_clusters", lambda m: cl.kmeans(_distance(m), 4, np.random.default_rng(SEED)))
_labels("hierarchical_clusters", lambda m: cl.cut(cl.agglomerate(_vectors(m), "ward"), 4))
_labels("dbscan_clusters", lambda m: cl.dbscan(_distance(m), 0.6, 3))
_labels("spectral_clusters", lambda m: cl.spectral(np.maximum(m, 0), 4, np.random.default_rng(SEED)))
_labels("mean_shift_clusters", lambda m: cl.mean_shift(_distance(m), 0.8))
_labels("affinity_clusters", lambda m: cl.affinity_propagation(-_vectors(m) ** 2))
_labels("constrained_clusters", lambda m: cl.constrained_kmeans(_distance(m), 4, 3, 9, np.random.default_rng(SEED)))


@query("optics_order")
def optics_order(spark, sf):
    names, m = hour_matrix(spark, sf)
    order, reach = cl.optics(_distance(m), 3)
    return _rows(spark, [(names[i], k, None if np.isinf(reach[i]) else float(reach[i])) for k, i in enumerate(order)], "hour long, place long, reach double")


@query("onc")
def onc(spark, sf):
    names, m = hour_matrix(spark, sf)
    groups, s = cl.optimal_clusters(m, np.random.default_rng(SEED), 5)
    return _rows(spark, [(names[i], k, float(s[i])) for k, g in enumerate(groups) for i in g], "hour long, cluster long, silhouette double")


@query("hier_order")
def hier_order(spark, sf):
    names, m = hour_matrix(spark, sf)
    return _rows(spark, [(k, names[i]) for k, i in enumerate(cl.hierarchical_order(m)[0])], "place long, hour long")


@query("feature_clusters")
def feature_clusters(spark, sf):
    names, m = hour_matrix(spark, sf)
    return _rows(spark, [(names[i], k) for k, g in enumerate(cl.feature_clusters(m, 5, np.random.default_rng(SEED), "average")) for i in g], "hour long, cluster long")


def _edges(name: str, kernel):
    @query(name)
    def run(spark, sf):
        names, m = hour_matrix(spark, sf)
        return _rows(spark, [(names[i], names[j], float(d)) for i, j, d in kernel(_distance(m))], "i long, j long, distance double")


_edges("almst", nw.average_linkage_tree)
_edges("pmfg", nw.planar_graph)


@query("centrality_rank")
def centrality_rank(spark, sf):
    names, m = hour_matrix(spark, sf)
    found = nw.centrality(len(names), nw.planar_graph(_distance(m)))
    return _rows(spark, [(n, *(float(v[k]) for v in found.values())) for k, n in enumerate(names)], "hour long, " + ", ".join(f"{c} double" for c in found))


@query("graph_matrix", _HOURS + ", p AS (SELECT a.hour AS i, z.hour AS j, corr(a.x, z.x) AS rho FROM hp a JOIN hp z USING (day) WHERE a.hour < z.hour GROUP BY ALL) ||| SELECT i, j, round(sqrt(greatest((1 - rho) / 2, 0)), 5) AS angular, round(sqrt(greatest(1 - abs(rho), 0)), 5) AS absolute_angular, round(sqrt(greatest(1 - rho * rho, 0)), 5) AS squared_angular FROM p", "t")
def graph_matrix(spark, sf):
    rho = mx.correlations(hours(spark, sf), "day", "hour", "x").where("i < j")
    return rho.select("i", "j", *[mx.distances(F.col("rho"), k).alias(k) for k in ("angular", "absolute_angular", "squared_angular")])


def _long(name: str, kernel):
    @query(name)
    def run(spark, sf):
        names, m = hour_matrix(spark, sf)
        out = kernel(m)
        return _rows(spark, [(names[i], names[j], float(out[i, j])) for i in range(len(names)) for j in range(len(names))], "i long, j long, value double")


_long("filter_corr_hier", lambda m: cl.filter_hierarchical(m, "average"))
_long("market_cov", lambda m: al.clean_covariance(m, 30 / len(m), "constant")[1])
_long("tic", lambda m: al.tree_correlation(m, [[h // 6 for h in range(len(m))], [h // 12 for h in range(len(m))]]))


@query("cov_mcd")
def cov_mcd(spark, sf):
    rows = lq._returns(spark, sf).groupBy("t").pivot("symbol").agg(F.first("ret")).dropna()
    names = [c for c in rows.columns if c != "t"]
    m = ev.robust_covariance(rows, names)
    return _rows(spark, [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names)], "i string, j string, cov double")


def _moments(spark, sf) -> tuple[list[str], np.ndarray, np.ndarray]:
    names, cov = mx.dense(mx.covariances(lq._returns(spark, sf), "t", "symbol", "ret"), "cov")
    mean = {r["symbol"]: r["m"] for r in lq._returns(spark, sf).groupBy("symbol").agg(F.avg("ret").alias("m")).collect()}
    return names, np.array([mean[n] for n in names]), cov


@query("cla")
def cla(spark, sf):
    names, mean, cov = _moments(spark, sf)
    line = al.CriticalLine(mean, cov)
    rows = [("turning_point", k, n, float(w[i])) for k, w in enumerate(line.points) for i, n in enumerate(names)]
    rows += [(kind, 0, n, float(w[i])) for kind, w in (("max_sharpe", line.largest_sharpe()), ("min_volatility", line.least_variance())) for i, n in enumerate(names)]
    return _rows(spark, rows, "solution string, point long, symbol string, weight double")


@query("mv_frontier")
def mv_frontier(spark, sf):
    _, mean, cov = _moments(spark, sf)
    return _rows(spark, [(k, r, d) for k, (r, d, _) in enumerate(al.CriticalLine(mean, cov).frontier(100))], "point long, ret double, deviation double")


def _portfolio(name: str, kernel):
    @query(name)
    def run(spark, sf):
        names, mean, cov = _moments(spark, sf)
        return _rows(spark, zip(names, kernel(mean, cov)), "symbol string, weight double")


_portfolio("mv_custom", lambda m, c: al.custom_objective(lambda w: float(w @ c @ w), len(m), [lambda w: 0.5 - float(w.max())], 500))
_portfolio("nco", lambda m, c: al.nested_clusters(c, np.random.default_rng(SEED)))
_portfolio("herc", lambda m, c: al.equal_risk_contribution(c, None, "variance", "ward", 3))
_portfolio("robust_bayesian", lambda m, c: al.robust_bayesian(np.full(len(m), m.mean()), np.diag(np.diag(c)), m, c, 600, most_volatility=100.0 * float(np.trace(c))))


@query("mcos")
def mcos(spark, sf):
    """Trials of closed-form and nested weights, one task each."""
    import pandas as pd

    names, mean, cov = _moments(spark, sf)

    def trial(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for k in pdf["id"]:
            closed, nested = al.simulated_weights(cov, mean, 200, int(k))
            out += [(int(k), n, float(a), float(b)) for n, a, b in zip(names, closed, nested)]
        return pd.DataFrame(out, columns=["trial", "symbol", "closed", "nested"])

    from ..session import reachable

    reachable(spark)
    return spark.range(8).groupBy("id").applyInPandas(trial, "trial long, symbol string, closed double, nested double")


@query("entropy_pooling")
def entropy_pooling(spark, sf):
    """Posterior weights of histogram cells of returns under a view on their mean: cells, not rows, reach the driver."""
    cells = lq._returns(spark, sf).groupBy(F.least(F.floor(F.col("ret") * 4), F.lit(200).cast("long")).alias("cell")).agg(F.count(F.lit(1)).alias("n"), F.avg("ret").alias("m")).orderBy("cell").collect()
    prior = np.array([r["n"] for r in cells], float) / sum(r["n"] for r in cells)
    mean = np.array([r["m"] for r in cells])
    post = al.entropy_pooling(prior, (mean[None, :], np.array([0.9 * float(prior @ mean)])), confidence=0.75)
    return _rows(spark, [(r["cell"], p, q) for r, p, q in zip(cells, prior, post)], "cell long, prior double, posterior double")


@query("olps_experts")
def olps_experts(spark, sf):
    """Wealth of ensembles over pattern-matching experts of several windows: each expert is a task over rows of relatives."""
    import pandas as pd

    from ..session import reachable

    rows = mx.relatives(src.bars(spark, sf), KEY, "t", "close").groupBy("t").pivot("symbol").agg(F.first("relative"))
    names = [c for c in rows.columns if c != "t"]

    def expert(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t").fillna(1.0)
        x = pdf[names].to_numpy(float)
        own = mx.OnlinePortfolio("olmar", len(names), window=int(pdf["window"].iloc[0]))
        out, wealth = [], 1.0
        for t, row in zip(pdf["t"], x):
            w = own.w.copy()
            wealth *= float(w @ row)
            out.append((int(pdf["window"].iloc[0]), t, wealth, w.tolist(), row.tolist()))
            own.step(row)
        return pd.DataFrame(out, columns=["window", "t", "wealth", "w", "x"])

    reachable(spark)
    paths = rows.withColumn("window", F.explode(F.array(*[F.lit(k) for k in (3, 5, 8)]))).groupBy("window").applyInPandas(expert, "window int, t long, wealth double, w array<double>, x array<double>")
    before = F.coalesce(F.lag("wealth").over(ordered(["window"], ["t"])), F.lit(1.0))
    paths = paths.withColumn("before", before)
    place = F.row_number().over(ordered(["t"], [F.col("before").desc(), "window"]))
    gain = F.aggregate(F.zip_with("w", "x", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    paths = paths.withColumn("gain", gain).withColumn("place", place)
    step = paths.groupBy("t").agg(F.try_divide(F.sum(F.col("before") * F.col("gain")), F.sum("before")).alias("history"), F.avg("gain").alias("uniform"), F.avg(F.when(F.col("place") <= 1, F.col("gain"))).alias("top"))
    from pyspark.sql import Window

    run = Window.partitionBy(F.lit(0)).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # one narrow row a time
    return step.select("t", *[F.sum(F.ln(c)).over(run).alias(f"log_{c}") for c in ("history", "uniform", "top")])


@query("ou_levels")
def ou_levels(spark, sf):
    fitted = mx.ou_fit(src.bars(spark, sf).where("close > 0").withColumn("y", F.ln("close")), KEY, "t", "y", 0.1).where("mu > 0 AND sigma_sq > 0").collect()  # one row a symbol
    rows = []
    for r in sorted(fitted, key=lambda r: r["symbol"]):
        s = mo.StoppingLevels(r["theta"], r["mu"], r["sigma_sq"], 0.05, 0.01)
        rows.append((r["symbol"], s.liquidation(), s.entry()))
    return _rows(spark, rows, "symbol string, liquidation double, entry double")


@query("ef3m")
def ef3m(spark, sf):
    import pandas as pd

    from ..session import reachable

    moments = mo.concurrency_moments(lq._spans(spark, sf), KEY)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [mo.fit_mixture(moments, np.random.default_rng(int(k)), 1e-2, turns=500) for k in pdf["id"]]
        return pd.DataFrame([(*f[0], f[1]) for f in found if f], columns=["mu_1", "mu_2", "sigma_1", "sigma_2", "p_1", "error"])

    reachable(spark)
    return spark.range(8).groupBy("id").applyInPandas(run, "mu_1 double, mu_2 double, sigma_1 double, sigma_2 double, p_1 double, error double")


_MIX = (-0.5, 1.5, 1.0, 2.0, 0.4)


def _mix_sql(x: str) -> str:
    return f"({_MIX[4]} * {normal_sql(f'(({x} - ({_MIX[0]})) / {_MIX[2]}::DOUBLE)')} + {1 - _MIX[4]} * {normal_sql(f'(({x} - ({_MIX[1]})) / {_MIX[3]}::DOUBLE)')})"


@query("bet_size_reserve", lq._EV + "," + lq._VB + f""", c AS (SELECT DISTINCT a.symbol, a.t0 AS t, (SELECT sum(x.side) FROM w x WHERE x.symbol = a.symbol AND x.t0 <= a.t0 AND x.t1 > a.t0)::DOUBLE AS c FROM w a), d AS (SELECT symbol, t, c::BIGINT AS c_t, {_mix_sql('c')} AS f, {_mix_sql('0.0')} AS z FROM c) |||
SELECT symbol, t, c_t, round(CASE WHEN c_t >= 0 THEN (f - z) / (1 - z) ELSE (f - z) / z END, 5) + 0 AS bet_size FROM d""", "tb")
def bet_size_reserve(spark, sf):
    return mo.bet_size_reserve(lq._spans(spark, sf), KEY, _MIX).select("symbol", "t", F.col("c_t").cast("long").alias("c_t"), _r("bet_size", 5))


@query("bet_dispatch", """x AS (SELECT seq, price, price + (volume - 50) / 50.0::DOUBLE AS f FROM t), y AS (SELECT *, f - price AS d FROM x) |||
SELECT seq, round(d / sqrt(5 + d * d), 6) + 0 AS sigmoid, round(CASE WHEN d = 0 THEN 0 ELSE sign(d) * pow(abs(d), 2) END, 6) + 0 AS power, trunc(d / sqrt(5 + d * d) * 20)::BIGINT AS target, round(f - 0.5::DOUBLE * sqrt(5 / 0.75::DOUBLE), 5) AS at_half FROM y""", "t")
def bet_dispatch(spark, sf):
    rows = src.ticks(spark, sf).withColumn("f", F.col("price") + (F.col("volume") - 50) / 50.0)
    d = F.col("f") - F.col("price")
    return rows.select("seq", mo.bet_size(d, 5.0).alias("sigmoid"), mo.bet_size(d, 2.0, "power").alias("power"), mo.target_position(F.col("f"), F.col("price"), 5.0, 20).alias("target"), mo.inverse_price(F.col("f"), F.lit(0.5), 5.0).alias("at_half")).select("seq", _r("sigmoid"), _r("power"), "target", _r("at_half", 5))


FEATURES = ["momentum", "volatility", "imbalance"]


def samples(spark, sf):
    """Labelled bars: three features at each event and whether the price rose by the end of its span."""
    over = ordered(KEY, ["t"])
    bars = src.bars(spark, sf)
    rows = bars.select("symbol", F.col("t").alias("t0"), F.log1p(F.try_divide("close", F.lag("close", 3).over(over))).alias("momentum"), F.log1p(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("volatility"), F.try_divide(F.col("close") - F.col("open"), F.col("high")).alias("imbalance"))
    spans = lq._spans(spark, sf).select("symbol", "t0", "t1")
    price = bars.select("symbol", F.col("t").alias("t1"), F.col("close").alias("p1"))
    label = spans.join(price, ["symbol", "t1"]).join(bars.select("symbol", F.col("t").alias("t0"), F.col("close").alias("p0")), ["symbol", "t0"])
    return rows.join(label.select("symbol", "t0", F.when(F.col("p1") > F.col("p0"), 1).otherwise(0).alias("label")), ["symbol", "t0"]).dropna()


def _folds(spark, sf):
    return bt.purged_folds(lq._spans(spark, sf).select("symbol", "t0", "t1"), KEY, 3, 0.01)


@query("cv_score")
def cv_score(spark, sf):
    return ev.cv_score(samples(spark, sf), _folds(spark, sf), ["symbol", "t0"], FEATURES, "label")


@query("mdi")
def mdi(spark, sf):
    return _rows(spark, ev.mean_decrease_impurity(ev.forest_importances(samples(spark, sf), FEATURES, "label"), FEATURES), "feature string, mean double, std double")


@query("mda")
def mda(spark, sf):
    return ev.mean_decrease_accuracy(samples(spark, sf), _folds(spark, sf), ["symbol", "t0"], FEATURES, "label")


@query("sfi")
def sfi(spark, sf):
    return ev.single_feature_importance(samples(spark, sf), _folds(spark, sf), ["symbol", "t0"], FEATURES, "label")


@query("orthogonal_features")
def orthogonal_features(spark, sf):
    return ev.orthogonal_features(samples(spark, sf), FEATURES, 1.0).select("symbol", "t0", *[f"pc_{k}" for k in (1, 2, 3)])


@query("pca_importance")
def pca_importance(spark, sf):
    _, _, corr, n = ev.standard_moments(samples(spark, sf), FEATURES)
    return _rows(spark, ev.pca_importance(corr, n, np.array([0.5, 0.3, 0.2])).items(), "measure string, value double")


@query("fingerprint")
def fingerprint(spark, sf):
    rows = samples(spark, sf).withColumn("all", F.lit(1))
    b = next(iter(ev.fit_logistic(rows, ["all"], FEATURES, "label").values()))
    predict = lambda c: 1 / (1 + F.exp(-(F.lit(float(b[0])) + sum((F.lit(float(v)) * c[f] for v, f in zip(b[1:], FEATURES)), F.lit(0.0)))))
    return ev.fingerprint(rows, FEATURES, predict, 20, [("momentum", "volatility")])


@query("sb_bagging")
def sb_bagging(spark, sf):
    bars, spans = src.bars(spark, sf), lq._spans(spark, sf)
    from ..operators import labels as lb

    placed = lb.span_bars(bars.withColumn("k", F.row_number().over(ordered(KEY, ["t"])) - 1), spans, KEY, lq.CELL).groupBy("symbol", "t0").agg(F.min("k").alias("first"), F.max("k").alias("last"))
    first = placed.agg(F.min("symbol")).first()[0]
    rows = samples(spark, sf).where(F.col("symbol") == first)  # the operator's sample: one instrument's labels
    weights = ev.bootstrap_weights(placed.where(F.col("symbol") == first), "t0", 6, seed=SEED)
    models, score = ev.bagging(rows, weights, "t0", FEATURES, "label", 2 / 3, SEED)
    return _rows(spark, [(k[0], f, float(v), score) for k, b in sorted(models.items()) for f, v in zip(["constant", *FEATURES], b)], "estimator int, feature string, coefficient double, oob_accuracy double")


@query("classification_data")
def classification_data(spark, sf):
    return ev.classification_data(spark, 3, 2, 2, 2000, SEED, 0.1)


@query("bar_microstructure")
def bar_microstructure(spark, sf):
    ticks = src.ticks(spark, sf)
    ends = ba.tick_bars(ticks, KEY, ["us", "seq"], 50).select("symbol", "tick_num")
    return micro.bar_microstructure(ticks, ends, KEY, ["us", "seq"], [10, 20, 50, 70], [-1.0, -0.2, 0.0, 0.2, 1.0])


_SIDES = """g AS (SELECT *, nullif(sign(price - lag(price) OVER o), 0) AS g, price - lag(price) OVER o AS d, ln(price / lag(price) OVER o) AS r, row_number() OVER o AS k, count(*) OVER (PARTITION BY symbol) AS n FROM t WINDOW o AS (PARTITION BY symbol ORDER BY us, seq)),
x AS (SELECT *, coalesce(last_value(g IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING), 0) AS s FROM g), y AS (SELECT symbol, us, k, price, volume, price * volume AS m, s, coalesce(d, 0) AS d, abs(coalesce(r, 0)) AS r, ((k - 1) // 50 + 1) * 50 AS tick_num FROM x WHERE (k - 1) // 50 < n // 50)"""


@query("bar_impacts", _SIDES + """, a AS (SELECT symbol, tick_num, max(us) AS date_time, count(*) AS n, avg(volume) AS size, sum(s)::BIGINT AS side, sum(m) / nullif(sum(volume), 0) AS vwap, sum(s * volume * d) AS kxy, sum(s * volume * s * volume) AS kxx, sum(d * d) AS kyy, sum(m * r) AS axy, sum(m * m) AS axx, sum(r * r) AS ryy, sum(s * sqrt(m) * r) AS hxy, sum(s * sqrt(m) * s * sqrt(m)) AS hxx FROM y GROUP BY ALL) |||
SELECT symbol, tick_num, date_time, round(size, 6) AS avg_tick_size, side AS tick_rule_sum, round(vwap, 5) AS vwap, round(kxy / kxx, 5) AS kyle_lambda, round(kxy / kxx / sqrt((kyy - kxy / kxx * kxy) / (n - 1) / kxx), 3) AS kyle_t, round(axy / axx, 7) AS amihud_lambda, round(axy / axx / sqrt((ryy - axy / axx * axy) / (n - 1) / axx), 3) AS amihud_t,
 round(hxy / hxx, 7) AS hasbrouck_lambda, round(hxy / hxx / sqrt((ryy - hxy / hxx * hxy) / (n - 1) / hxx), 3) AS hasbrouck_t FROM a""", "t")
def bar_impacts(spark, sf):
    ticks = src.ticks(spark, sf)
    ends = ba.tick_bars(ticks, KEY, ["us", "seq"], 50).select("symbol", "tick_num")
    rows = micro.bar_microstructure(ticks, ends, KEY, ["us", "seq"])
    r = lambda c, n: round_scaled(F.col(c), n).alias(c)
    return rows.select("symbol", "tick_num", "date_time", r("avg_tick_size", 6), "tick_rule_sum", r("vwap", 5), r("kyle_lambda", 5), r("kyle_t", 3), r("amihud_lambda", 7), r("amihud_t", 3), r("hasbrouck_lambda", 7), r("hasbrouck_t", 3))


@query("matrix_flags")
def matrix_flags(spark, sf):
    return pt.matrix_flags(src.bars(spark, sf).select("symbol", "t", "close"), KEY, ["t"], "close", 30).select("symbol", "t", _r("flag"))


@query("fft_components")
def fft_components(spark, sf):
    return pt.fft_components(src.bars(spark, sf), KEY, "t", "close")


@query("weighted_kde")
def weighted_kde(spark, sf):
    rows = src.ticks(spark, sf).withColumn("bar", F.floor(F.col("us") / 86400000000))
    return pt.weighted_kde(rows, ["symbol", "bar"])


def _pair_returns(spark, sf):
    return mx.pairs(lq._returns(spark, sf), "t", "symbol", "ret").where("i < j")


@query("gpr_distance", lq._RET + """, k AS (SELECT symbol, t, rank() OVER (PARTITION BY symbol ORDER BY r) + (count(*) OVER (PARTITION BY symbol, r) - 1) / 2.0::DOUBLE AS q FROM y),
h AS (SELECT a.symbol AS i, z.symbol AS j, corr(a.q, z.q) AS rho FROM k a JOIN k z USING (t) WHERE a.symbol < z.symbol GROUP BY ALL), p AS (SELECT a.symbol AS i, z.symbol AS j, avg(a.r) AS mx, stddev_pop(a.r) AS sx, avg(z.r) AS my, stddev_pop(z.r) AS sy FROM y a JOIN y z USING (t) WHERE a.symbol < z.symbol GROUP BY ALL) |||
SELECT i, j, round(sqrt(0.5::DOUBLE * (1 - rho) / 2 + 0.5::DOUBLE * (1 - sqrt(2 * sx * sy / (sx * sx + sy * sy)) * exp(-(mx - my) * (mx - my) / (4 * (sx * sx + sy * sy))))), 5) AS distance FROM p JOIN h USING (i, j)""", "tb")
def gpr_distance(spark, sf):
    return dp.gpr_distances(_pair_returns(spark, sf), mx.spearman(lq._returns(spark, sf), "t", "symbol", "ret").where("i < j"), 0.5).select("i", "j", _r("distance", 5))


def _per_pair(name: str, kernel, daily: bool = False):
    """One value a pair of symbols, or a pair and day where the kernel is cubic in the rows."""
    by = ["i", "j", "day"] if daily else ["i", "j"]

    @query(name)
    def run(spark, sf):
        import pandas as pd

        from ..session import reachable

        def one(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t")
            return pd.DataFrame([(*key, kernel(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)))], columns=[*by, "value"])

        reachable(spark)
        rows = _pair_returns(spark, sf).withColumn("day", F.floor(F.col("t") / 86400))
        return rows.groupBy(*by).applyInPandas(one, "i string, j string, " + ("day long, " if daily else "") + "value double")


_per_pair("gnpr_distance", lambda x, y: dp.gnpr_distance(x, y, 0.5))
_per_pair("ot_dependence", lambda x, y: dp.transport_dependence(x, y, "comonotonicity", np.random.default_rng(SEED)) if len(x) > 2 else None, daily=True)


@query("corex_linear")
def corex_linear(spark, sf):
    names, m = hour_matrix(spark, sf)
    model = fa.LinearFactors(m, 4, SEED)
    return _rows(spark, [(n, int(c), float(model.weights[c, k]), float(model.found["tcs"][c])) for k, (n, c) in enumerate(zip(names, model.clusters()))], "hour long, factor long, weight double, total_correlation double")


@query("corex_sieve")
def corex_sieve(spark, sf):
    names, m = hour_matrix(spark, sf)
    return _rows(spark, [(k, n, float(w[i]), tc) for k, (w, tc, _) in enumerate(fa.sieve(m, 3, SEED)) for i, n in enumerate(names)], "layer long, hour long, weight double, total_correlation double")


@query("corex_bio")
def corex_bio(spark, sf):
    rows = hours(spark, sf).groupBy("day").pivot("hour", list(range(24))).agg(F.first("x")).orderBy(F.xxhash64("day")).limit(10_000).orderBy("day").collect()  # the model's bounded sample
    x = np.array([[np.nan if r[str(h)] is None else r[str(h)] for h in range(24)] for r in rows])
    model = fa.DiscreteFactors(x, 3, 2, SEED)
    return _rows(spark, [(h, int(c), float(model.gains[c, h])) for h, c in enumerate(model.clusters())], "hour long, factor long, information double")


@query("gaussianize")
def gaussianize(spark, sf):
    return fa.gaussianize(lq._returns(spark, sf), KEY, "t", "ret", "lambert")


@query("corex_data", "h AS (SELECT symbol, t, close FROM b), g AS (SELECT DISTINCT t FROM h), s AS (SELECT DISTINCT symbol FROM h), f AS (SELECT s.symbol, g.t, last_value(h.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY g.t ROWS UNBOUNDED PRECEDING) AS p FROM g CROSS JOIN s LEFT JOIN h ON h.symbol = s.symbol AND h.t = g.t), c AS (SELECT symbol, t, ln(p / lag(p) OVER (PARTITION BY symbol ORDER BY t)) AS r, count(ln(p / lag(p) OVER (PARTITION BY symbol ORDER BY t))) OVER (PARTITION BY t) AS n FROM f) ||| SELECT symbol, t, round(r, 6) + 0 AS change FROM (SELECT symbol, t, r, count(r) OVER (PARTITION BY t) AS n FROM (SELECT symbol, t, ln(p / lag(p) OVER (PARTITION BY symbol ORDER BY t)) AS r FROM f)) WHERE n = (SELECT count(*) FROM s)", "tb")
def corex_data(spark, sf):
    wide = fa.price_changes(src.bars(spark, sf), "t", "symbol", "close")
    return wide.unpivot(["t"], [c for c in wide.columns if c != "t"], "symbol", "change").select("symbol", "t", _r("change"))


def _matrices(name: str, make):
    @query(name)
    def run(spark, sf):
        m = make(np.random.default_rng(SEED), spark, sf)
        return _rows(spark, [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])], "i long, j long, value double")


_matrices("row_bootstrap", lambda r, spark, sf: ge.row_bootstrap(hour_matrix(spark, sf)[1], r))
_matrices("block_bootstrap", lambda r, spark, sf: ge.block_bootstrap(hour_matrix(spark, sf)[1], r))
_matrices("vine_d", lambda r, spark, sf: ge.vine(10, r, "d"))
_matrices("vine_c", lambda r, spark, sf: ge.vine(10, r, "c", 2.0))
_matrices("onion", lambda r, spark, sf: ge.onion(10, r, 2.0))
_matrices("corr_random_walks", lambda r, spark, sf: ge.correlated_walks(6, 200, r, 2))


@query("stylized_facts")
def stylized_facts(spark, sf):
    return _rows(spark, ge.facts([hour_matrix(spark, sf)[1]]), "fact string, at double, value double")


@query("datasets", "|||SELECT day, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}" for s in ("click", "purchase")) + " FROM (SELECT t // 86400 AS day, symbol, arg_max(close, t) AS close FROM b GROUP BY ALL) GROUP BY day", "tb")
def datasets(spark, sf):
    return src.stock_prices(spark, sf).select("day", "click", "purchase")


@query("viz", "|||SELECT t, " + ", ".join(f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}" for s in ("click", "purchase")) + " FROM b WHERE symbol IN ('click', 'purchase') GROUP BY t", "tb")
def viz(spark, sf):
    return mk.symbols_wide(src.bars(spark, sf), "t", ["click", "purchase"])


@query("mp_pandas_obj", "k AS (SELECT symbol, t, close, row_number() OVER (ORDER BY symbol, t) - 1 AS k, count(*) OVER () AS n FROM b) ||| SELECT symbol, t, round(close * 2, 6) AS doubled FROM k", "tb")
def mp_pandas_obj(spark, sf):
    rows = src.bars(spark, sf).select("symbol", "t", "close")
    return mk.map_parts(rows, ["symbol", "t"], 6, lambda pdf: pdf[["symbol", "t"]].assign(doubled=(pdf["close"] * 2).round(6)), "symbol string, t long, doubled double")


@query("triangular_parts", "p AS (SELECT unnest(range(1, 8)) AS k) ||| SELECT k, least(100, round((-1 + sqrt(1 + 8 * 5050.0::DOUBLE * k / 7)) / 2))::BIGINT AS bound FROM p")
def triangular_parts(spark, sf):
    return spark.createDataFrame(list(enumerate(ex.triangular_parts(100, 7)))[1:], "k long, bound long")
