"""Operators that are one column, one member or one union of a wider query, under names of their own."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from ..functions.windows import ordered
from ..operators import matrices as mx
from ..operators.breaks import get_betas as fit
from ..sources import testdata as src
from . import adaptive_queries, bar_queries, extra_queries, label_queries, matrix_queries, micro_queries, model_queries  # noqa: F401
from .registry import QUERIES, SQL, query


def _part(name: str, of: str, columns: list[str], where: str = "true") -> None:
    """``columns`` of another query and of its SQL, where it has some."""

    def run(spark, sf):
        return QUERIES[of](spark, sf).where(where).select(*columns)

    QUERIES[name] = run
    if of in SQL:
        SQL[name] = f"SELECT {', '.join(columns)} FROM ({SQL[of]}) WHERE {where}"


def _union(name: str, members: dict[str, str], column: str) -> None:
    """The rows of several queries with the member's name beside them."""

    def run(spark, sf):
        return reduce(lambda a, b: a.unionByName(b), [QUERIES[of](spark, sf).withColumn(column, F.lit(k)) for k, of in members.items()])

    QUERIES[name] = run
    if all(of in SQL for of in members.values()):
        SQL[name] = " UNION ALL BY NAME ".join(f"SELECT *, '{k}' AS {column} FROM ({SQL[of]})" for k, of in members.items())


for _name, _of, _column in (
    ("roll_impact", "roll_measure", "roll_impact"), ("bekker_parkinson", "corwin_schultz", "bp_sigma"), ("bar_kyle", "bar_lambdas", "kyle"), ("bar_amihud", "bar_lambdas", "amihud"), ("bar_hasbrouck", "bar_lambdas", "hasbrouck"),
    ("parkinson_vol", "range_volatility", "parkinson"), ("garman_klass_vol", "range_volatility", "garman_klass"), ("yang_zhang_vol", "range_volatility", "yang_zhang"), ("renko_size", "symbol_vol_filter", "renko_size"), ("jma_df", "jma", "close_jma"),
):
    _part(_name, _of, ["symbol", "t", _column])
for _kind in ("kyle", "amihud", "hasbrouck"):
    _part(f"trade_{_kind}", "trade_lambdas", ["symbol", "bar", f"{_kind}_lambda", f"{_kind}_t"])
_part("bar_thresholds", "build_bars", ["seq", "bar", "bar_trigger"], "bar_trigger IS NOT NULL")
_part("bar_update", "build_bars", ["seq", "bar"], "bar IS NOT NULL")
_part("bar_state", "bar_features", ["symbol", "date", "bar", "price_low", "price_high", "price_range", "price_return", "jma_range", "jma_return", "tick_count", "volume", "tick_imbalance", "volume_imbalance"])
_part("bar_workflow", "bar_dates_workflow", ["date", "bar", "price_return", "tick_count", "bar_trigger", "label_side", "label_outcome", "label_rrr"], "symbol = 'click'")  # the operator's symbol
for _kind in ("imbalance", "run"):
    for _name in ("ema", "const"):
        _union(f"{_name}_{_kind}_bars", {m: f"{_name}_{m}_{_kind}_bars" for m in ("tick", "volume", "dollar")}, "metric")
_union("clusterers", {k: f"{k}_clusters" for k in ("kmeans", "hierarchical", "dbscan", "spectral", "mean_shift", "affinity", "constrained")}, "method")
_union("vines", {"d": "vine_d", "c": "vine_c", "onion": "onion"}, "method")


@query("olps_base", matrix_queries._REL + " ||| SELECT symbol, t, round(x, 6) AS relative FROM x", "tb")
def olps_base(spark, sf):
    return mx.relatives(src.bars(spark, sf), ["symbol"], "t", "close").select("symbol", "t", F.round("relative", 6).alias("relative"))


@query("norm_distance", matrix_queries._P + ", c AS (SELECT corr(x, y) AS rho FROM p WHERE i < j GROUP BY i, j) ||| SELECT round(sqrt(2 * sum(rho * rho)), 5) AS norm FROM c", "tb")
def norm_distance(spark, sf):
    norm = extra_queries.ex.matrix_divergence(c := extra_queries._corr(spark, sf), np.eye(len(c)))[1]
    return spark.createDataFrame([(norm,)], "norm double").select(F.round("norm", 5).alias("norm"))


@query("get_betas", "x AS (SELECT symbol, t // 86400 AS day, close - lag(close) OVER (PARTITION BY symbol, t // 86400 ORDER BY t) AS d, lag(close) OVER (PARTITION BY symbol, t // 86400 ORDER BY t) AS x FROM b), r AS (SELECT symbol, day, count(d) AS n, regr_slope(d, x) AS b, regr_sxx(d, x) AS xx, regr_syy(d, x) AS yy, regr_sxy(d, x) AS xy FROM x WHERE x IS NOT NULL GROUP BY ALL) ||| SELECT symbol, day, round(b, 5) AS beta, round((yy - b * xy) / (n - 2) / xx, 6) AS variance FROM r WHERE n >= 4", "tb")
def get_betas(spark, sf):
    """Change on the last level and a constant, by symbol and day."""
    import pandas as pd

    from ..session import reachable

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf["x"].to_numpy(float)
        b, cov = fit(np.column_stack([x, np.ones(len(x))]), pdf["d"].to_numpy(float))
        return pd.DataFrame([(*key, b[0], cov[0, 0])], columns=["symbol", "day", "beta", "variance"])

    day = F.floor(F.col("t") / 86400)
    over = ordered(["symbol", "day"], ["t"])
    rows = src.bars(spark, sf).withColumn("day", day).withColumn("x", F.lag("close").over(over)).where("x IS NOT NULL").withColumn("d", F.col("close") - F.col("x"))
    reachable(spark)
    out = rows.select("symbol", "day", "x", "d").groupBy("symbol", "day").applyInPandas(lambda key, pdf: run(key, pdf) if len(pdf) >= 4 else pd.DataFrame(columns=["symbol", "day", "beta", "variance"]), "symbol string, day long, beta double, variance double")
    return out.select("symbol", "day", F.round("beta", 5).alias("beta"), F.round("variance", 6).alias("variance"))


@query("bootstrap_mats")
def bootstrap_mats(spark, sf):
    """Row, pair and block bootstraps of the hours' matrix and of the hours themselves."""
    from ..operators import generate as ge

    names, m = model_queries.hour_matrix(spark, sf)
    wide = model_queries.hours(spark, sf).groupBy("day").pivot("hour", list(range(24))).agg(F.first("x")).orderBy("day").drop("day").fillna(0.0)
    x = np.array([list(r) for r in wide.collect()])  # one row a day
    rng = np.random.default_rng(model_queries.SEED)
    found = {"row": ge.row_bootstrap(m, rng), "block": ge.block_bootstrap(m, rng), "pair": ge.pair_bootstrap(x[:, :6], rng)}
    return model_queries._rows(spark, [(kind, i, j, float(v[i, j])) for kind, v in found.items() for i in range(v.shape[0]) for j in range(v.shape[1])], "kind string, i long, j long, value double")
