"""Queries over resampling, cluster scores and further portfolios."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.windows import ordered
from ..operators import extras as ex
from ..operators import labels as lb
from ..operators import matrices as mx
from ..sources import testdata as src
from . import label_queries as lq
from .registry import normal_sql, query


@query("cluster_eval", "c AS (SELECT n_regionkey AS a, s_suppkey % 4 AS z, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL), x AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS ab, sum(n) AS n FROM c), l AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY a)), r AS (SELECT sum(n * (n - 1) / 2.0::DOUBLE) AS v FROM (SELECT sum(n) AS n FROM c GROUP BY z)) ||| SELECT round((ab - l.v * r.v / (n * (n - 1) / 2.0::DOUBLE)) / ((l.v + r.v) / 2 - l.v * r.v / (n * (n - 1) / 2.0::DOUBLE)), 6) AS ari FROM x, l, r")
def cluster_eval(spark, sf):
    rows = src.table(spark, sf, "supplier").join(src.table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return ex.adjusted_rand(rows.withColumn("z", F.col("s_suppkey") % 4), "n_regionkey", "z").select(F.round("ari", 6).alias("ari"))


@query("cluster_metrics", "x AS (SELECT s.symbol % 7 AS label, sector, s.symbol FROM s), c AS (SELECT label, sector, count(*) AS n FROM x GROUP BY ALL) ||| SELECT label, sum(n)::BIGINT AS size, round(max(n) / sum(n)::DOUBLE, 6) AS purity, arg_min(sector, (-n, sector)) AS mode, (SELECT quantile_cont(symbol, 0.5) FROM x WHERE x.label = c.label)::DOUBLE AS median FROM c GROUP BY label", "s")
def cluster_metrics(spark, sf):
    rows = src.symbol_details(spark, sf).withColumn("label", F.col("symbol") % 7)
    return ex.cluster_stats(rows, "label", "sector", "symbol").withColumn("purity", F.round("purity", 6))


@query("corex_buckets", "n AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM b) ||| SELECT symbol, r.j AS bucket, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM n JOIN range(1000) r(j) ON k >= r.j * 30 AND k < r.j * 30 + 100 AND r.j * 30 + 100 <= n GROUP BY symbol, r.j", "tb")
def corex_buckets(spark, sf):
    return ex.strided_buckets(src.bars(spark, sf), ["t"], ["symbol"], 100, 30).groupBy("symbol", "bucket").agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count(F.lit(1)).alias("n"))


@query("lin_parts", "|||SELECT i, ceil(100 * i / 7.0::DOUBLE)::BIGINT AS bound FROM range(8) r(i)")
def lin_parts(spark, sf):
    return spark.createDataFrame(list(enumerate(ex.linear_parts(100, 7))), "i long, bound long")


@query("graph_api", "p AS (SELECT a.symbol AS i, z.symbol AS j FROM s a JOIN s z ON a.symbol < z.symbol AND a.sector = z.sector), q AS (SELECT a.symbol AS i, z.symbol AS j FROM s a JOIN s z ON a.symbol < z.symbol AND a.industry = z.industry) ||| SELECT i, j FROM (SELECT * FROM p EXCEPT SELECT * FROM q) UNION ALL SELECT i, j FROM (SELECT * FROM q EXCEPT SELECT * FROM p)", "s")
def graph_api(spark, sf):
    d = src.symbol_details(spark, sf)

    def edges(by):
        return d.select(F.col("symbol").alias("i"), by).join(d.select(F.col("symbol").alias("j"), by), by).where("i < j").select("i", "j")

    a, b = edges("sector"), edges("industry")
    return a.exceptAll(b).union(b.exceptAll(a))


@query("distance_correlation", lq._RET + """, z AS (SELECT symbol, t // 86400 AS day, t, r, lag(r) OVER (PARTITION BY symbol ORDER BY t) AS g FROM y), u AS (SELECT * FROM z WHERE g IS NOT NULL),
p AS (SELECT a.symbol, a.day, a.t AS i, c.t AS j, abs(a.r - c.r) AS a, abs(a.g - c.g) AS b FROM u a JOIN u c USING (symbol, day)),
q AS (SELECT symbol, day, a - avg(a) OVER i - avg(a) OVER j + avg(a) OVER w AS a, b - avg(b) OVER i - avg(b) OVER j + avg(b) OVER w AS b FROM p WINDOW i AS (PARTITION BY symbol, day, i), j AS (PARTITION BY symbol, day, j), w AS (PARTITION BY symbol, day)) |||
SELECT symbol, day, round(CASE WHEN count(*) > 4 THEN sqrt(greatest(avg(a * b), 0) / sqrt(avg(a * a) * avg(b * b))) END, 4) AS value FROM q GROUP BY ALL""", "tb")
def distance_correlation(spark, sf):
    # One symbol-day is a bounded group of rows.
    import pandas as pd

    rows = lq._returns(spark, sf).withColumn("day", F.floor(F.col("t") / 86400)).withColumn("lag", F.lag("ret").over(ordered(["symbol"], ["t"]))).where("lag IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        value = mx.distance_correlation(pdf["ret"].to_numpy(float), pdf["lag"].to_numpy(float)) if len(pdf) > 2 else None
        return pdf[["symbol", "day"]].head(1).assign(value=value)

    out = rows.groupBy("symbol", "day").applyInPandas(run, "symbol string, day long, value double")
    return out.select("symbol", "day", F.when(~F.isnan("value"), F.round("value", 4)).alias("value"))


@query("seq_bootstrap")
def seq_bootstrap(spark, sf):
    bars, spans = src.bars(spark, sf), lq._spans(spark, sf)
    import pandas as pd

    # One narrow row a label: the bars it spans, by number.
    placed = lb.span_bars(bars.withColumn("k", F.row_number().over(ordered(["symbol"], ["t"])) - 1), spans, ["symbol"], lq.CELL).groupBy("symbol", "t0").agg(F.min("k").alias("first"), F.max("k").alias("last"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t0")
        drawn = lb.seq_bootstrap(pdf["first"].to_numpy(int), pdf["last"].to_numpy(int), len(pdf), np.random.default_rng(1))
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "draw": range(len(drawn)), "t0": pdf["t0"].to_numpy()[drawn]})

    return placed.groupBy("symbol").applyInPandas(run, "symbol string, draw long, t0 long")


@query("min_ffd")
def min_ffd(spark, sf):
    from ..operators.breaks import fracdiff_ffd

    import pandas as pd

    rows = src.bars(spark, sf).withColumn("y", F.ln("close"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        return pdf[["symbol", "d"]].head(1).assign(adf=ex.adf(pdf["fracdiff"].to_numpy(float)), corr=float(np.corrcoef(pdf["fracdiff"], pdf["y"])[0, 1]))

    for k in range(11):  # all orders over one window
        rows = fracdiff_ffd(rows, ["symbol"], "t", "y", k / 10, 1e-2, 20).withColumnRenamed("fracdiff", f"f{k}")
    long = rows.select("symbol", "t", "y", F.explode(F.array(*[F.struct(F.lit(k / 10).alias("d"), F.col(f"f{k}").alias("fracdiff")) for k in range(11)])).alias("_x")).select("symbol", "t", "y", "_x.*")
    return long.where("fracdiff IS NOT NULL").groupBy("symbol", "d").applyInPandas(run, "symbol string, d double, adf double, corr double")


def _corr(spark, sf):
    return mx.dense(mx.correlations(lq._returns(spark, sf), "t", "symbol", "ret"), "rho")[1]


@query("kl_distance")
def kl_distance(spark, sf):
    c = _corr(spark, sf)
    kl, norm = ex.matrix_divergence(c, np.eye(len(c)))
    return spark.createDataFrame([(kl, norm)], "kl double, norm double")


@query("haircut_sharpe", lq._RET + f""", s AS (SELECT symbol, abs(avg(r) / stddev_samp(r) * sqrt(count(*))) AS z FROM y GROUP BY ALL), p AS (SELECT symbol, 2 * (1 - {normal_sql('z')}) AS p FROM s),
k AS (SELECT *, row_number() OVER (ORDER BY p, symbol) - 1 AS k, count(*) OVER () AS n FROM p), c AS (SELECT sum(1.0::DOUBLE / i) AS c FROM (SELECT unnest(range(1, max(n) + 1)) AS i FROM k)) |||
SELECT symbol, round(p, 5) AS p, round(least(1, p * n), 4) AS bonferroni, round(least(1, max((n - k) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING)), 4) AS holm, round(least(1, min(p * n * c / (k + 1)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 4) AS bhy FROM k, c""", "tb")
def haircut_sharpe(spark, sf):
    from ..functions.stats import normal_cdf

    stats = lq._returns(spark, sf).groupBy("symbol").agg((F.avg("ret") / F.stddev_samp("ret") * F.sqrt(F.count("ret").cast("double"))).alias("z"))
    rows = ex.adjusted_p(stats.select("symbol", (2 * (1 - normal_cdf(F.abs("z")))).alias("p")), "symbol", "p")
    return rows.select("symbol", F.round("p", 5).alias("p"), *[F.round(c, 4).alias(c) for c in ("bonferroni", "holm", "bhy")])


@query("random_walk")
def random_walk(spark, sf):
    return ex.random_walk(spark, 1000)


@query("hcbm")
def hcbm(spark, sf):
    m = ex.block_correlation(12, 3)
    return spark.createDataFrame([(i, j, float(m[i, j])) for i in range(12) for j in range(12)], "i long, j long, v double")


def _wealth(name: str, kernel):
    @query(name)
    def run(spark, sf):
        import pandas as pd

        rows = mx.relatives(src.bars(spark, sf), ["symbol"], "t", "close").groupBy("t").pivot("symbol").agg(F.first("relative"))
        names = [c for c in rows.columns if c != "t"]

        def fold(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("t").fillna(1.0)
            return pd.DataFrame({"t": pdf["t"], "wealth": kernel(pdf[names].to_numpy(float))})

        return rows.withColumn("all", F.lit(1)).groupBy("all").applyInPandas(fold, "t long, wealth double")


_wealth("olps_bcrp", lambda x: np.cumprod(x @ ex.best_constant(x)))


@query("olps_cwmr")
def olps_cwmr(spark, sf):
    rows = mx.relatives(src.bars(spark, sf), ["symbol"], "t", "close").groupBy("t").pivot("symbol").agg(F.first("relative"))
    names = [c for c in rows.columns if c != "t"]
    return mx.wealth_path(rows, "t", names, lambda: ex.ConfidenceWeighted(len(names)))


_wealth("olps_corn", ex.pattern_matching)
_wealth("olps_scorn", lambda x: ex.pattern_matching(x, kind="symmetric"))
_wealth("olps_fcorn", lambda x: ex.pattern_matching(x, kind="functional"))
