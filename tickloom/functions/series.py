"""Kernels in which every row of a series meets all rows before it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reachable

#: Ends of one task's block.
BLOCK = 256


def by_end_blocks(df: DataFrame, keys: list[str], time: str, value: str, kernel: Callable[[np.ndarray, int, int], dict[str, np.ndarray]], columns: list[str], block: int = BLOCK) -> DataFrame:
    """keys, time and ``columns`` of ``kernel(values, lo, hi)`` over the rows lo to hi of each key's ordered series; rows of NaN are dropped.

    A series is packed once into a row of two arrays, and each block of ends is a row of its own, so that the quadratic work of
    one long series spreads over tasks; a task holds one series (16 bytes a row) and one block's results.
    """
    types = dict(df.dtypes)
    rows = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")))).alias("a"))
    blocks = rows.withColumn("lo", F.explode(F.sequence(F.lit(0), F.size("a") - 1, F.lit(block)))).select(*keys, F.transform("a", lambda x: x["t"]).alias("ts"), F.transform("a", lambda x: x["v"]).alias("vs"), "lo")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                values = np.asarray(row["vs"], float)
                lo, hi = row["lo"], min(row["lo"] + block, len(values))
                found = pd.DataFrame(kernel(values, lo, hi))[columns]
                found.insert(0, time, list(row["ts"][lo:hi]))
                for k in reversed(keys):
                    found.insert(0, k, row[k])
                yield found.dropna(subset=columns)

    reachable(df.sparkSession)
    spread = blocks.repartition(F.xxhash64(*keys, "lo"))
    return spread.mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in [*keys, time]) + "".join(f", {c} double" for c in columns))
