"""The ordered fold: path-dependent kernels over keyed, ordered rows.

Rows are dealt out by key and sorted; each task streams its rows in Arrow batches and
keeps one kernel's state at a time, so a key's rows need not fit in memory. Equal keys
are contiguous after the sort. Choose keys that include the session date wherever the
operator restarts each day: a key's rows are one task's work.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame

from ..session import reachable


class Kernel:
    """State of one key. ``feed`` gets its next rows in order; both methods return output rows or None."""

    def feed(self, rows: pd.DataFrame) -> pd.DataFrame | None:
        raise NotImplementedError

    def end(self) -> pd.DataFrame | None:
        return None


def ordered_fold(df: DataFrame, keys: list[str], order: list[str], kernel: Callable[[tuple[Any, ...]], Kernel], schema: str) -> DataFrame:
    """Runs ``kernel(key)`` over each key's rows in ``order``; the kernel adds the key to its output itself."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for batch in batches:
            if batch.empty:
                continue
            for key, rows in batch.groupby(keys, sort=False, dropna=False):
                key = tuple(None if k is None or k != k else k for k in key)
                if state is None or key != now:
                    if state is not None and (out := state.end()) is not None and len(out):
                        yield out
                    now, state = key, kernel(key)
                if (out := state.feed(rows)) is not None and len(out):
                    yield out
        if state is not None and (out := state.end()) is not None and len(out):
            yield out

    reachable(df.sparkSession)
    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
