"""Daily-market filters and transforms over a long (symbol, day) table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import ordered
from .ingest import squeeze


def all_dates(df: DataFrame) -> DataFrame:
    """Symbols with as many rows as the fullest symbol."""
    counts = df.groupBy("symbol").agg(F.count("vwap").alias("n"))
    most = counts.agg(F.max("n").alias("n"))
    return df.join(counts.join(F.broadcast(most), "n"), "symbol", "left_semi")  # one row is broadcast


def by_statistic(df: DataFrame, statistic: F.Column, low: float | None = None, high: float | None = None, strict: bool = False) -> DataFrame:
    """Rows of symbols whose aggregate lies in [low, high] (or above ``low`` if strict)."""
    per = df.groupBy("symbol").agg(statistic.alias("v"))
    if low is not None:
        per = per.where(F.col("v") > low if strict else F.col("v") >= low)
    if high is not None:
        per = per.where(F.col("v") <= high)
    return df.join(per, "symbol", "left_semi")


def liquidity(df: DataFrame, cut: float) -> DataFrame:
    return by_statistic(df, F.avg("dollar_total"), cut, strict=True)


def range_value(df: DataFrame, low: float, high: float) -> DataFrame:
    return by_statistic(df.withColumn("_p", F.try_divide(F.col("high") - F.col("low"), "vwap")), F.percentile("_p", 0.5), low, high).drop("_p")


def min_value(df: DataFrame, least: float) -> DataFrame:
    return by_statistic(df, F.percentile("vwap", 0.5), least, strict=True)


def with_details(df: DataFrame, details: DataFrame, where: F.Column) -> DataFrame:
    return df.join(details.where(where), "symbol", "left_semi")


def median_stats(df: DataFrame, details: DataFrame, columns: list[str]) -> DataFrame:
    """Details of every symbol with its median statistics (null where it has no rows)."""
    stats = df.groupBy("symbol").agg(*[F.percentile(c, 0.5).alias(f"{c}_median") for c in columns], F.count(F.lit(1)).alias("days"))
    return stats.join(details, "symbol", "right")


def transformed(df: DataFrame, time: str, value: str) -> DataFrame:
    """Standardised and squeezed log differences on dates that every symbol has; ``z`` and ``squeezed`` per symbol."""
    n = df.agg(F.count_distinct("symbol")).first()[0]
    over = ordered(["symbol"], [time])
    df = df.withColumn("_x", F.ln(F.col(value)) - F.ln(F.lag(value).over(over))).where("_x IS NOT NULL")
    df = df.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy(time))).where(F.col("_k") == n)
    per = Window.partitionBy("symbol")
    df = df.withColumn("z", F.try_divide(F.col("_x") - F.avg("_x").over(per), F.stddev_pop("_x").over(per)))
    return df.withColumn("squeezed", squeeze(F.col("z"))).drop("_k").withColumnRenamed("_x", "log_diff")


def beta_residuals(df: DataFrame, market: DataFrame, time: str, value: str) -> DataFrame:
    """Residuals of each symbol's line on the market series (time, market)."""
    both = df.join(market, time)
    per = Window.partitionBy("symbol")
    y, x = F.col(value), F.col("market")
    n, sx, sy = F.count(y).over(per), F.sum(x).over(per), F.sum(y).over(per)
    beta = F.try_divide(F.sum(x * y).over(per) - sx * sy / n, F.sum(x * x).over(per) - sx * sx / n)
    both = both.withColumn("beta", beta).withColumn("_mx", sx / n).withColumn("_my", sy / n)
    return both.withColumn("residual", y - (F.col("_my") + F.col("beta") * (x - F.col("_mx")))).drop("_mx", "_my")


def session_days(start: int, end: int, holidays: DataFrame | None, spark) -> DataFrame:
    """Weekdays from ``start`` to ``end`` (days since 1970), less ``holidays(day)``."""
    days = spark.range(start, end + 1).select(F.col("id").alias("day")).where(F.pmod(F.col("day") + 3, F.lit(7)) < 5)
    return days.join(holidays, "day", "left_anti") if holidays is not None else days


def remaining_days(wanted: DataFrame, there: DataFrame, today: int) -> DataFrame:
    return wanted.where(F.col("day") <= today).join(there.select("day").distinct(), "day", "left_anti")


def gap_fill(bars: DataFrame, size: float, hour: int = 3600) -> DataFrame:
    """Rows on the straight line between a day's last close and the next day's second close, evenly spaced between +1 h and -1 h."""
    day = F.floor(F.col("t") / 86400)
    numbered = bars.withColumn("day", day).withColumn("_k", F.row_number().over(Window.partitionBy("symbol", "day").orderBy("t")))
    ends = numbered.groupBy("symbol", "day").agg(F.max("t").alias("t_last"), F.max_by("close", "t").alias("p_last"), F.min(F.when(F.col("_k") == 2, F.col("t"))).alias("t_second"), F.min(F.when(F.col("_k") == 2, F.col("close"))).alias("p_second"))
    over = ordered(["symbol"], ["day"])
    gaps = ends.withColumns({"t1": F.lead("t_second").over(over), "p1": F.lead("p_second").over(over)}).where("t1 IS NOT NULL AND p1 IS NOT NULL")
    n = F.bround(F.abs(F.col("p1") - F.col("p_last")) / (size / 2)).cast("int")
    steps = gaps.withColumn("n", n).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") + 1)))
    price = F.when(F.col("i") >= F.col("n"), F.col("p1")).otherwise(F.col("p_last") + (F.col("p1") - F.col("p_last")) * F.col("i") / F.col("n"))
    at = F.col("t_last") + hour + (F.col("t1") - F.col("t_last") - 2 * hour) * F.col("i") / (F.col("n") + 1)
    return steps.select("symbol", "day", "i", at.alias("t"), price.alias("close"), F.lit("gap_filler").alias("bar_trigger"))


def stacked_stats(bars: DataFrame) -> DataFrame:
    """Per symbol and day: count, median minutes, mean range, first opening, last closing."""
    return bars.groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"), F.percentile("minutes", 0.5).alias("minutes_median"), F.avg(F.col("high") - F.col("low")).alias("range_mean"), F.min("open_at").alias("open_at"), F.max("close_at").alias("close_at"))


def symbols_wide(df: DataFrame, time: str, symbols: list, metric: str = "close") -> DataFrame:
    """One column a symbol of one metric over time: the table behind a chart of symbols."""
    return df.where(F.col("symbol").isin(symbols)).groupBy(time).pivot("symbol", symbols).agg(F.first(metric))


def map_parts(df: DataFrame, order: list[str], parts: int, kernel, schema: str, triangular: bool = False) -> DataFrame:
    """``kernel(rows)`` over about ``parts`` stretches of the ordered rows, of equal counts or (triangular) of equal work where row k costs k.

    Rows are dealt by ranges of ``order``, so a stretch is one task's rows and nothing is numbered in one place. Triangular stretches
    are runs of finer ranges that end where the square of their share reaches a whole part.
    """
    import math

    import pandas as pd

    from ..session import reachable

    reachable(df.sparkSession)
    if not triangular:

        def run(batches):
            rows = [b for b in batches if len(b)]
            if rows:
                yield kernel(pd.concat(rows, ignore_index=True))

        return df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInPandas(run, schema)
    fine = 8 * parts
    ends = [math.sqrt((k + 1) / parts) for k in range(parts)]
    share = (F.spark_partition_id() + 1) / fine
    part = sum((F.when(share > e + 1e-12, 1).otherwise(0) for e in ends[:-1]), F.lit(0))
    dealt = df.repartitionByRange(fine, *order).withColumn("_part", part)
    return dealt.groupBy("_part").applyInPandas(lambda pdf: kernel(pdf.drop(columns="_part").sort_values(order, ignore_index=True)), schema)
