"""As-of, interval and overlap joins as equi joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], forward: bool = False, strict: bool = False) -> DataFrame:
    """``left`` with ``columns`` of the nearest ``right`` row at or before (or after) each time.

    Both sides are laid into one ordered stream per key and the last (next) right row is
    carried along: one shuffle on the keys and no product of rows. ``strict`` leaves out
    equal times.
    """
    right = right.select(*[F.col(k) for k in keys], F.col(right_time).alias("_asof_at"), F.struct(*columns).alias("_asof_row"))
    # Among equal times a right row comes first where it may match, last where it may not (mirrored going forward).
    before = (not strict) != forward
    stream = left.withColumn("_asof_at", F.col(left_time)).withColumn("_asof_left", F.lit(True)).unionByName(right.withColumn("_asof_left", F.lit(False)), allowMissingColumns=True)
    stream = stream.withColumn("_asof_order", F.when(F.col("_asof_left"), 1).otherwise(0 if before else 2))
    # Going forward the order is turned round, so that the frame grows row by row either way.
    order = [F.col(c).desc() if forward else F.col(c).asc() for c in ("_asof_at", "_asof_order")]
    over = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("_asof_row", ignorenulls=True).over(over)
    out = stream.withColumn("_asof_found", found).where("_asof_left")
    return out.select(*left.columns, *[F.col(f"_asof_found.{c}").alias(c) for c in columns])


def interval(points: DataFrame, spans: DataFrame, keys: list[str], at: str, start: str, end: str, cell: int, closed: bool = True) -> DataFrame:
    """Points inside spans: spans are laid over cells of ``cell`` units and joined by (keys, cell).

    ``cell`` should be near the usual span, so that a span covers few cells and a cell
    holds few points. Times are integers; ``closed`` counts the end in.
    """
    cells = spans.withColumn("_c", F.explode(F.sequence(F.floor(F.col(start) / cell), F.floor(F.col(end) / cell))))
    inside = (F.col(at) >= F.col(start)) & ((F.col(at) <= F.col(end)) if closed else (F.col(at) < F.col(end)))
    return points.withColumn("_c", F.floor(F.col(at) / cell)).join(cells, [*keys, "_c"]).where(inside).drop("_c")
