"""Bet sizes, back-test statistics and cross-validation splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf
from ..functions.windows import ordered


def bet_size_probability(prob: Column, side: Column, classes: int = 2) -> Column:
    z = F.try_divide(prob - 1.0 / classes, F.sqrt(prob * (1 - prob)))
    return side * (2 * normal_cdf(z) - 1)


def discrete_signal(signal: Column, step: float) -> Column:
    """Rounded (half to even) to the step and clamped to [-1, 1]."""
    return F.greatest(F.least(F.bround(signal / step) * step, F.lit(1.0)), F.lit(-1.0))


def average_active(signals: DataFrame, keys: list[str]) -> DataFrame:
    """At each start or end, the mean of the signals with t0 <= t < t1 (null t1: open); 0 where none is active."""
    starts = signals.select(*keys, F.col("t0").alias("t"), F.col("signal").alias("v"), F.lit(1).alias("d"))
    ends = signals.where("t1 IS NOT NULL").select(*keys, F.col("t1").alias("t"), (-F.col("signal")).alias("v"), F.lit(-1).alias("d"))
    steps = starts.union(ends).groupBy(*keys, "t").agg(F.sum("v").alias("v"), F.sum("d").alias("d"))
    run = ordered(keys, ["t"]).rowsBetween(Window.unboundedPreceding, 0)
    n = F.sum("d").over(run)
    return steps.select(*keys, "t", F.when(n > 0, F.sum("v").over(run) / n).otherwise(0.0).alias("signal"))


def bet_size_budget(spans: DataFrame, keys: list[str]) -> DataFrame:
    """At each start: active longs over their maximum less active shorts over theirs (start <= t < end)."""
    marks = spans.select(*keys, F.col("t0").alias("t"), F.when(F.col("side") > 0, 1).otherwise(0).alias("l"), F.when(F.col("side") < 0, 1).otherwise(0).alias("s"))
    ends = spans.select(*keys, F.col("t1").alias("t"), F.when(F.col("side") > 0, -1).otherwise(0).alias("l"), F.when(F.col("side") < 0, -1).otherwise(0).alias("s"))
    steps = marks.withColumn("start", F.lit(1)).union(ends.withColumn("start", F.lit(0))).groupBy(*keys, "t").agg(F.sum("l").alias("l"), F.sum("s").alias("s"), F.max("start").alias("start"))
    run, every = ordered(keys, ["t"]).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*keys)
    counted = steps.withColumn("l", F.sum("l").over(run)).withColumn("s", F.sum("s").over(run)).where("start = 1")
    share = lambda c: F.coalesce(F.try_divide(F.col(c).cast("double"), F.max(c).over(every)), F.lit(0.0))
    return counted.withColumn("bet_size", share("l") - share("s")).withColumnRenamed("l", "longs").withColumnRenamed("s", "shorts").drop("start")


def sigmoid_size(w: Column, divergence: Column) -> Column:
    return divergence / F.sqrt(w + divergence * divergence)


def power_size(w: Column, divergence: Column) -> Column:
    return F.signum(divergence) * F.pow(F.abs(divergence), w)


def dynamic_position(df: DataFrame, w: float, max_position: int) -> DataFrame:
    """``bet_size``, ``target`` (truncated) and ``limit_price`` from price, forecast and position by the sigmoid."""
    size = sigmoid_size(F.lit(w), F.col("forecast") - F.col("price"))
    df = df.withColumn("bet_size", size).withColumn("target", (size * max_position).cast("long"))
    inverse = lambda j: F.col("forecast") - (j / F.lit(max_position)) * F.sqrt(F.lit(w) / (1 - (j / F.lit(max_position)) * (j / F.lit(max_position))))
    sign = F.signum(F.col("target") - F.col("position")).cast("long")
    between = F.sequence(F.col("position") + sign, F.col("target"), F.when(sign != 0, sign).otherwise(F.lit(1).cast("long")))
    usable = F.filter(between, lambda j: F.abs(j) < max_position)
    total = F.aggregate(usable, F.lit(0.0), lambda a, j: a + inverse(j.cast("double")))
    return df.withColumn("limit_price", F.when(sign != 0, F.try_divide(total, F.size(usable))))


def flattening_flips(df: DataFrame, keys: list[str], time: str, position: str) -> DataFrame:
    """Rows where a position goes to 0 or changes its sign, and the last row."""
    over = ordered(keys, [time])
    before, after = F.lag(position).over(over), F.lead(time).over(over)
    flat = (F.col(position) == 0) & (before != 0)
    flip = F.col(position) * before < 0
    return df.withColumn("_f", F.coalesce(flat | flip, F.lit(False)) | after.isNull()).where("_f").drop("_f")


def hhi(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Normalised concentration; null for two bets or fewer."""
    out = df.groupBy(*keys).agg(F.count(value).alias("_n"), F.sum(F.col(value) * F.col(value)).alias("_s2"), F.sum(value).alias("_s"))
    raw = F.try_divide("_s2", F.col("_s") * F.col("_s"))
    return out.select(*keys, F.when(F.col("_n") > 2, (raw - 1 / F.col("_n")) / (1 - 1 / F.col("_n"))).alias("hhi"))


def drawdowns(df: DataFrame, keys: list[str], time: str, value: str, dollars: bool = False) -> DataFrame:
    """Per high-water mark that was undercut: its time, the drawdown and the time under water (to the next mark)."""
    over = ordered(keys, [time])
    df = df.withColumn("_h", F.max(value).over(over.rowsBetween(Window.unboundedPreceding, 0)))
    marks = df.groupBy(*keys, "_h").agg(F.min(value).alias("_low"), F.min(time).alias("start"))
    marks = marks.withColumn("_next", F.lead("start").over(Window.partitionBy(*keys).orderBy("start"))).where(F.col("_h") > F.col("_low"))
    drop = F.col("_h") - F.col("_low") if dollars else 1 - F.try_divide("_low", "_h")
    return marks.select(*keys, "start", drop.alias("drawdown"), (F.col("_next") - F.col("start")).alias("under_water"))


def sharpe(df: DataFrame, keys: list[str], value: str, periods: int = 252, rf: float = 0.0) -> DataFrame:
    return df.groupBy(*keys).agg((F.try_divide(F.avg(value) - rf, F.stddev_samp(value)) * F.sqrt(F.lit(float(periods)))).alias("sharpe"))


def probabilistic_sharpe(observed: Column, benchmark: Column, n: Column, skew: Column, kurtosis: Column) -> Column:
    return normal_cdf((observed - benchmark) * F.sqrt(n - 1) / F.sqrt(1 - skew * observed + (kurtosis - 1) / 4 * observed * observed))


def minimum_track_record(observed: Column, benchmark: Column, skew: Column, kurtosis: Column, z: float) -> Column:
    return 1 + (1 - skew * observed + (kurtosis - 1) / 4 * observed * observed) * F.pow(z / (observed - benchmark), 2)


def train_times(spans: DataFrame, tests: DataFrame, keys: list[str], cell: int) -> DataFrame:
    """Spans that no test span touches (all ends closed); overlap is an equi join over cells."""
    cells = lambda df, a, b: df.withColumn("_c", F.explode(F.sequence(F.floor(F.col(a) / cell), F.floor(F.col(b) / cell))))
    left = cells(spans, "t0", "t1")
    right = cells(tests.select(*keys, F.col("t0").alias("s0"), F.col("t1").alias("s1")), "s0", "s1")
    hit = left.join(right, [*keys, "_c"]).where("t0 <= s1 AND t1 >= s0").select(*keys, "t0", "t1").distinct()
    return spans.join(hit, [*keys, "t0", "t1"], "left_anti")


def purged_folds(spans: DataFrame, keys: list[str], folds: int, embargo: float = 0.0) -> DataFrame:
    """(fold, role, t0): contiguous test folds by position; training spans that overlap the test span or its embargo are purged.

    The test span starts at the label end of the fold's first row, ends at the fold's latest label end plus the embargo rows.
    """
    w = Window.partitionBy(*keys)
    rows = spans.withColumn("_k", F.row_number().over(w.orderBy("t0")) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    base, extra = F.floor(F.col("_n") / folds), F.col("_n") % folds
    big = extra * (base + 1)
    rows = rows.withColumn("fold", F.when(F.col("_k") < big, F.floor(F.col("_k") / (base + 1))).otherwise(extra + F.floor((F.col("_k") - big) / F.greatest(base, F.lit(1)))).cast("int"))
    bounds = rows.groupBy(*keys, "fold").agg(F.min("_k").alias("lo"), F.max("_k").alias("hi"), F.min_by("t1", "_k").alias("s0"), F.max("t1").alias("s1"), F.first("_n").alias("n"))
    bounds = bounds.withColumn("_upto", F.col("hi") + F.floor(F.col("n") * embargo))
    at = rows.select(*keys, F.col("_k").alias("_upto"), F.col("t1").alias("_e"))
    bounds = bounds.join(at, [*keys, "_upto"], "left").withColumn("s1", F.greatest("s1", F.coalesce("_e", "s1"))).select(*keys, F.col("fold").alias("f"), "s0", "s1")
    test = rows.select(*keys, "fold", F.lit("test").alias("role"), "t0")
    train = rows.join(bounds, keys).where("fold <> f AND NOT (t0 <= s1 AND t1 >= s0)").select(*keys, F.col("f").alias("fold"), F.lit("train").alias("role"), "t0")
    return test.unionByName(train)


def combinations(spark, folds: int, tests: int) -> DataFrame:
    """All choices of ``tests`` among ``folds`` test folds, as sorted arrays."""
    one = spark.range(folds).select(F.array("id").alias("folds"))
    for _ in range(tests - 1):
        last = F.element_at("folds", -1)
        one = one.withColumn("next", F.explode_outer(F.when(last + 1 < folds, F.sequence(last + 1, F.lit(folds - 1).cast("long"))))).where("next IS NOT NULL").select(F.concat("folds", F.array("next")).alias("folds"))
    return one
