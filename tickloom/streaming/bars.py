"""Streaming bars, deduplication and tick state.

Streams carry ``symbol, ts (timestamp), seq, price, volume``. Windows functions do not
exist on streams, so running state lives in keyed state; rows later than the watermark
are dropped by Spark and counted in the query's progress. Where a kernel depends on order, each
micro-batch is put in order first and a tick older than the last of an earlier batch goes to the
side output (``late``) instead of changing what was already given out.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.adaptive import BAR_COLUMNS, _Adaptive, bar_row, jma_step
from ..operators.ingest import RunningMedian
from ..session import reachable

OUT = "symbol string, date_time timestamp, open double, high double, low double, close double, volume double, cum_buy_volume double, cum_ticks long, cum_dollar_value double"
STATE = "last double, side int, acc double, open double, high double, low double, close double, volume double, buy double, ticks long, dollars double, at timestamp"


def stream_time_bars(ticks: DataFrame, unit: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Tumbling bars labelled by their right edge; the open one waits for the watermark."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.window("ts", unit).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("cum_ticks"))
        .select("symbol", F.col("w.end").alias("date_time"), "open", "high", "low", "close", "volume", "cum_ticks")
    )


def stream_dedup(ticks: DataFrame, identity: list[str], late: str = "1 hour") -> DataFrame:
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(identity)


def stream_threshold_bars(ticks: DataFrame, metric: str, threshold: float) -> DataFrame:
    """Volume, dollar or tick bars by keyed state; each micro-batch is put in order first."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["ts", "seq"])
        last, side, acc, o, h, lo, c, v, b, n, d, at = state.get if state.exists else (None, 0, 0.0, None, None, None, None, 0.0, 0.0, 0, 0.0, None)
        out = []
        for ts, price, volume in zip(rows["ts"], rows["price"], rows["volume"]):
            if last is not None and price != last:
                side = 1 if price > last else -1
            last, at = float(price), ts.to_pydatetime()
            o = price if o is None else o
            h, lo, c = price if h is None else max(h, price), price if lo is None else min(lo, price), price
            v, b, n, d = v + volume, b + (volume if side == 1 else 0), n + 1, d + price * volume
            acc += {"tick": 1.0, "volume": float(volume), "dollar": float(price * volume)}[metric]
            if acc >= threshold:
                out.append((*key, ts, o, h, lo, c, v, b, n, d))
                acc, o, h, lo, c, v, b, n, d = 0.0, None, None, None, None, 0.0, 0.0, 0, 0.0
        flt = lambda x: None if x is None else float(x)
        state.update((flt(last), int(side), float(acc), flt(o), flt(h), flt(lo), flt(c), float(v), float(b), int(n), float(d), at))
        if out:
            yield pd.DataFrame(out, columns=[x.split(" ")[0] for x in OUT.split(", ")])

    return ticks.groupBy("symbol").applyInPandasWithState(fold, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_labels(bars: DataFrame, ticks: DataFrame, start: str = "3 seconds", horizon: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Ticks in [close + start, close + horizon) of each bar: an interval join of two streams."""
    b = bars.withWatermark("close_at", late).alias("b")
    t = ticks.withWatermark("ts", late).alias("t")
    inside = (F.col("b.symbol") == F.col("t.symbol")) & F.expr(f"t.ts >= b.close_at + interval {start}") & F.expr(f"t.ts < b.close_at + interval {horizon}")
    return b.join(t, inside).select("b.symbol", "b.close_at", F.col("t.ts").alias("at"), "t.price")


def stream_session(ticks: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a symbol: stretches without a pause of ``gap``; the open one waits for the watermark."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy("symbol", F.session_window("ts", gap).alias("w"))
        .agg(F.min_by("price", "ts").alias("open"), F.max_by("price", "ts").alias("close"), F.sum("volume").alias("volume"), F.count(F.lit(1)).alias("ticks"))
        .select("symbol", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "open", "close", "volume", "ticks")
    )


def _in_order(batches: Iterator[pd.DataFrame], last: float | None) -> tuple[pd.DataFrame, pd.DataFrame, int | None]:
    """Rows of a micro-batch in order, those older than ``last`` (microseconds), and the newest time."""
    rows = pd.concat(list(batches)).sort_values(["ts", "seq"]).reset_index(drop=True)
    us = rows["ts"].astype("datetime64[us]").astype("int64")
    rows = rows.assign(us=us)
    old = us < last if last is not None else pd.Series(False, index=rows.index)
    fresh = rows[~old]
    return fresh, rows[old], int(fresh["us"].iloc[-1]) if len(fresh) else last


def stream_mad_jma(ticks: DataFrame, window: int = 11, deviation_window: int = 333, k: float = 22.0, smooth: int = 7, power: float = 1.0) -> DataFrame:
    """symbol, seq, ts, price, mad_status and jma (of clean ticks) tick by tick; late ticks have the status ``late``."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"last": None, "n": 0, "values": [], "gaps": [], "jma": None}
        rows, old, kept["last"] = _in_order(batches, kept["last"])
        middle, spread = RunningMedian(window), RunningMedian(deviation_window)
        for m, values in ((middle, kept["values"]), (spread, kept["gaps"])):
            for v in values:
                m.push(v)
        step, statuses, smoothed = None, [], []
        for price in rows["price"].to_numpy(float).tolist():
            if step is None:
                step = jma_step(price, smooth, power)
                step.state = kept["jma"] or step.state
            middle.push(price)
            spread.push(price - middle.value())
            kept["n"] += 1
            limit = k * min(max(spread.value(), 0.005), 0.05)
            status = "mad_warmup" if kept["n"] < window else "mad_outlier" if abs(price - middle.value()) > limit else "mad_clean"
            statuses.append(status)
            smoothed.append(step(price) if status == "mad_clean" else np.nan)
        kept |= {"values": list(middle.queue), "gaps": list(spread.queue), "jma": step.state if step else kept["jma"]}
        state.update((json.dumps(kept),))
        out = pd.concat([rows.assign(mad_status=statuses, jma=smoothed), old.assign(mad_status="late", jma=np.nan)])
        yield out.assign(symbol=key[0])[["symbol", "seq", "ts", "price", "mad_status", "jma"]]

    reachable(ticks.sparkSession)
    return ticks.groupBy("symbol").applyInPandasWithState(fold, "symbol string, seq long, ts timestamp, price double, mad_status string, jma double", "kept string", "append", GroupStateTimeout.NoTimeout)


def stream_bars(ticks: DataFrame, limits: dict) -> DataFrame:
    """Adaptive bars of ticks with ``status``: one row at each trigger, as the batch operator gives; a late tick makes a row of its own with ``late`` set."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"last": None, "kernel": None, "held": []}
        rows, old, kept["last"] = _in_order(batches, kept["last"])
        kernel = _Adaptive(limits)
        if kept["kernel"]:
            kernel.load(kept["kernel"])
        out = []
        if len(rows):
            cut = kernel.feed(rows)
            held = kept["held"]
            for us, price, jma, volume, bar, trigger in zip(cut["us"].tolist(), cut["price"].tolist(), cut["jma"].tolist(), cut["volume"].tolist(), cut["bar"], cut["bar_trigger"]):
                if bar is None or bar is pd.NA:
                    continue
                held.append([us, price, jma, volume])
                if trigger:
                    out.append(bar_row(int(bar), *(np.array(c) for c in zip(*held)), trigger) | {"late": False})
                    held = []
            kept |= {"held": held, "kernel": kernel.dump()}
        state.update((json.dumps(kept),))
        found = pd.DataFrame(out, columns=[*BAR_COLUMNS, "late"])
        if len(old):
            side = pd.DataFrame({"open_at": old["us"], "close_at": old["us"], "price_open": old["price"], "price_close": old["price"], "volume": old["volume"], "late": True}).reindex(columns=[*BAR_COLUMNS, "late"])
            found = pd.concat([found, side]) if len(found) else side
        if len(found):
            found.insert(0, "symbol", key[0])
            yield found.astype({c: "Int64" for c, t in BAR_COLUMNS.items() if t == "long"})

    reachable(ticks.sparkSession)
    schema = "symbol string, " + ", ".join(f"{c} {t}" for c, t in BAR_COLUMNS.items()) + ", late boolean"
    return ticks.groupBy("symbol").applyInPandasWithState(fold, schema, "kept string", "append", GroupStateTimeout.NoTimeout)
