"""Row frames that are null until full, as rolling statistics are."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: list[str], order: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(*order)


def ordered_nulls_last(keys: list[str], order: list[str]) -> WindowSpec:
    """As ``ordered``, but rows without a time or number come last, as in the SQL."""
    return ordered(keys, [F.col(c).asc_nulls_last() for c in order])


def full(value: Column, over: WindowSpec, n: int, counted: Column) -> Column:
    """``value`` over the last ``n`` rows, null until ``n`` non-null values of ``counted`` are there."""
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(counted).over(frame) >= n, value.over(frame))


def rolling_mean(c: Column, over: WindowSpec, n: int) -> Column:
    return full(F.avg(c), over, n, c)


def rolling_sum(c: Column, over: WindowSpec, n: int) -> Column:
    return full(F.sum(c), over, n, c)


def rolling_std(c: Column, over: WindowSpec, n: int) -> Column:
    return full(F.stddev_samp(c), over, n, c)


def rolling_max(c: Column, over: WindowSpec, n: int) -> Column:
    return full(F.max(c), over, n, c)


def rolling_min(c: Column, over: WindowSpec, n: int) -> Column:
    return full(F.min(c), over, n, c)


def rolling_median(c: Column, over: WindowSpec, n: int, least: int | None = None) -> Column:
    frame = over.rowsBetween(-(n - 1), 0)
    return F.when(F.count(c).over(frame) >= (n if least is None else least), F.percentile(c, 0.5).over(frame))


def carried(c: Column, over: WindowSpec) -> Column:
    """Last non-null value up to the row."""
    return F.last(c, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))


def tick_side(price: Column, over: WindowSpec) -> Column:
    """Sign of the last price change, carried over equal prices; 0 before the first change."""
    change = F.signum(price - F.lag(price).over(over))
    return F.when(change != 0, change)


def clip(c: Column, low: float, high: float) -> Column:
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))
