"""Queries over smoothers, adaptive bars and their labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import adaptive as ad
from ..operators import ingest
from ..sources import testdata as src
from .ingest_queries import _TICK, _status
from .registry import query

KEY = ["symbol"]
_N = "n AS (SELECT symbol, t, close AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM b)"


def _r(c: str, n: int = 5):
    return F.round(c, n).alias(c)


_B = 0.45 * 6 / (0.45 * 6 + 2)


def _jma_sql(select: str) -> str:
    a = f"{_B * _B!r}::DOUBLE"
    b = f"{_B!r}::DOUBLE"
    ratio = f"{10 / 101.5!r}::DOUBLE"
    step = f"""SELECT symbol, t, k, x, l, s, q, q + j AS j FROM (SELECT symbol, t, k, x, j, l, s, (l + {ratio} * s - j) * pow(1 - {a}, 2) + pow({a}, 2) * q AS q FROM
(SELECT *, (x - l) * (1 - {b}) + {b} * s0 AS s FROM (SELECT symbol, t, k, x, j, q, s0, (1 - {a}) * x + {a} * l0 AS l FROM (%s))))"""
    first = step % "SELECT symbol, t, k, x, x AS j, 0.0::DOUBLE AS q, 0.0::DOUBLE AS s0, x AS l0 FROM n WHERE k = 1"
    more = step % "SELECT n.symbol, n.t, n.k, n.x, r.j, r.q, r.s AS s0, r.l AS l0 FROM r JOIN n ON n.symbol = r.symbol AND n.k = r.k + 1"
    return f"{_N}, r AS ({first} UNION ALL {more}) ||| {select}"


@query("jma", _jma_sql("SELECT symbol, t, round(CASE WHEN k >= 7 THEN j END, 5) AS close_jma FROM r"), "tb", recursive=True)
def jma(spark, sf):
    return ad.jma(src.bars(spark, sf), KEY, ["t"], "close", 7, 2, 10.0).select("symbol", "t", _r("close_jma"))


@query("jma_rolling", _jma_sql("SELECT symbol, t, round(j, 5) AS close_jma FROM r WHERE k >= 7"), "tb", recursive=True)
def jma_rolling(spark, sf):
    return ad.jma_df(src.bars(spark, sf), KEY, ["t"], "close", 7, 2, 10.0).where("close_jma IS NOT NULL").select("symbol", "t", _r("close_jma"))


def _jma_list(w: int) -> str:
    """DuckDB: the smoother of window ``w`` over the first ``w`` closes, as nested steps."""
    b = 0.45 * (w - 1) / (0.45 * (w - 1) + 2)
    a, ratio = b * b, 10 / 101.5
    step = f"""struct_pack(l := x + {a!r}::DOUBLE * (z.l - x), s := (x - (x + {a!r}::DOUBLE * (z.l - x))) * (1 - {b!r}::DOUBLE) + {b!r}::DOUBLE * z.s, q := z.q, j := z.j)"""
    lift = f"(z.l + {ratio!r}::DOUBLE * z.s - z.j) * pow(1 - {a!r}::DOUBLE, 2) + {a * a!r}::DOUBLE * z.q"
    out = "struct_pack(l := xs[1], s := 0.0::DOUBLE, q := 0.0::DOUBLE, j := xs[1])"
    for k in range(1, w + 1):
        moved = f"(SELECT {step} FROM (SELECT {out} AS z, xs[{k}] AS x))"
        out = f"(SELECT struct_pack(l := z.l, s := z.s, q := {lift}, j := z.j + {lift}) FROM (SELECT {moved} AS z))"
    return f"({out}).j"


@query("jma_expanding", _jma_sql("SELECT * FROM r").rpartition("|||")[0] + ", h AS (SELECT symbol, list(x ORDER BY k) AS xs FROM n WHERE k < 7 GROUP BY symbol), e AS (" + " UNION ALL ".join(f"SELECT symbol, {w} AS k, {_jma_list(w)} AS j FROM h" for w in range(1, 7)) + ") ||| SELECT r.symbol, r.t, round(coalesce(e.j, r.j), 5) AS close_jma FROM r LEFT JOIN e ON e.symbol = r.symbol AND e.k = r.k", "tb", recursive=True)
def jma_expanding(spark, sf):
    return ad.jma_df(src.bars(spark, sf), KEY, ["t"], "close", 7, 2, 10.0, expand=True).select("symbol", "t", _r("close_jma"))


@query("filter_features", _jma_sql("SELECT symbol, t, round(j, 5) AS close_jma, round(j - lag(j) OVER o, 4) AS diff_1, round(j - lag(j, 3) OVER o, 4) AS diff_3, round(x - j, 4) AS residual FROM r WINDOW o AS (PARTITION BY symbol ORDER BY t)"), "tb", recursive=True)
def filter_features(spark, sf):
    from ..functions.windows import ordered

    rows, over, j = ad.jma(src.bars(spark, sf), KEY, ["t"], "close", 7, 2, 10.0, warm=False), ordered(KEY, ["t"]), F.col("close_jma")
    return rows.select("symbol", "t", _r("close_jma"), F.round(j - F.lag(j).over(over), 4).alias("diff_1"), F.round(j - F.lag(j, 3).over(over), 4).alias("diff_3"), F.round(F.col("close") - j, 4).alias("residual"))


def _fold_sql(first: str, step: str, out: str) -> str:
    return f"{_N}, r AS (SELECT symbol, t, k, x, {first} FROM n WHERE k = 1 UNION ALL SELECT n.symbol, n.t, n.k, n.x, {step} FROM r JOIN n ON n.symbol = r.symbol AND n.k = r.k + 1) ||| SELECT symbol, t, round({out}, 5) AS smooth FROM r"


def _smooth(make):
    return lambda spark, sf: ad.smoothed(src.bars(spark, sf), KEY, ["t"], "close", make, "smooth").select("symbol", "t", _r("smooth"))


_K = f"{1 - 2 / 11!r}::DOUBLE"
query("ewma", _fold_sql("x AS s, 1.0::DOUBLE AS w", f"r.s * {_K} + n.x, r.w * {_K} + 1", "s / w"), "tb", recursive=True)(_smooth(lambda x: ad.ewma_step(x, 10)))
_A = f"{2 / 15!r}::DOUBLE"
query("rema", _fold_sql("x AS a, x AS c", f"(r.a + {_A} * (n.x - r.a) + 0.5::DOUBLE * (2 * r.a - r.c)) / 1.5::DOUBLE, r.a", "a"), "tb", recursive=True)(_smooth(lambda x: ad.rema_step(x, 14, 0.5)))


def _super() -> str:
    import math

    a, c2 = math.exp(-1.414 * 3.14159 / 10), math.cos(math.radians(1.414 * 18))
    c3 = -a * a
    return _fold_sql("x AS p, 0.0::DOUBLE AS a, 0.0::DOUBLE AS c", f"n.x, CASE WHEN n.k > 3 THEN {1 - c2 - c3!r}::DOUBLE * (n.x + r.p) / 2 + {c2!r}::DOUBLE * r.a + {c3!r}::DOUBLE * r.c ELSE 0 END, r.a", "a")


query("supersmoother", _super(), "tb", recursive=True)(_smooth(lambda x: ad.supersmoother_step(x, 10)))

LIMITS = {"renko_size": 30.0, "renko_return": "price_return", "renko_reversal_multiple": 2.0, "volume_imbalance": 250, "max_seconds": 4 * 3600, "min_seconds": 60, "min_tick_count": 3, "jma_winlen": 7, "jma_power": 1}


def _ticks(spark, sf):
    return ad.adaptive_bars(_status(spark, sf).select("symbol", "date", "us", "seq", "price", "volume", "status"), ["symbol", "date"], LIMITS)


RULES = ad.LabelRules(5.0, 4 * 3600 * 1_000_000, [1.0, 2.0, 4.0], least=5, with_trend=True)


def _cut_sql() -> str:
    """Cut ticks ``c``: the smoother over clean ticks and the bar state over open-market ticks, one row after the other."""
    beta = 0.45 * 6 / (0.45 * 6 + 2)
    b, opened = f"{beta!r}::DOUBLE", "status = 'clean_open_market'"
    fresh = "(n0 = 0)"
    return (
        _TICK.replace("f AS (SELECT seq,", "f AS (SELECT symbol, us, price, volume, seq,")
        + f""", o AS (SELECT *, row_number() OVER (PARTITION BY symbol, date ORDER BY us, seq) AS k, first_value(price) OVER (PARTITION BY symbol, date ORDER BY us, seq) AS p1 FROM f),
r AS (SELECT symbol, date, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS us, 0.0::DOUBLE AS price, 0::BIGINT AS volume, '' AS status, p1 AS l, 0.0::DOUBLE AS s, 0.0::DOUBLE AS q, p1 AS j, NULL::DOUBLE AS jma, 0::BIGINT AS n, 0::BIGINT AS st, 0.0::DOUBLE AS fp, 0.0::DOUBLE AS pp, 0 AS side, 0.0::DOUBLE AS signed, 0.0::DOUBLE AS lr, 0::BIGINT AS bar, NULL::BIGINT AS own, NULL::VARCHAR AS trig FROM o WHERE k = 1
UNION ALL SELECT symbol, date, k, seq, us, price, volume, status, l, s, q, j, CASE WHEN status LIKE 'clean%' THEN j END,
 CASE WHEN done THEN 0 ELSE n END, st, fp, pp, CASE WHEN done THEN 0 ELSE side END, CASE WHEN done THEN 0 ELSE signed END, CASE WHEN done THEN price - fp ELSE lr END, bar + CASE WHEN done THEN 1 ELSE 0 END, CASE WHEN {opened} THEN bar END, CASE WHEN done THEN trig END
FROM (SELECT *, trig IS NOT NULL AND {opened} AND us - st >= 60000000 AND n >= 3 AS done FROM (
 SELECT *, CASE WHEN us - st > 14400000000 THEN 'duration' WHEN abs(signed) >= 250 THEN 'volume_imbalance' WHEN price - fp < CASE WHEN lr >= 0 THEN -60 ELSE -30 END THEN 'renko_down' WHEN price - fp >= CASE WHEN lr >= 0 THEN 30 ELSE 60 END THEN 'renko_up' END AS trig FROM (
 SELECT symbol, date, k, seq, us, price, volume, status, l, s, q, j, lr, bar, CASE WHEN {opened} THEN n0 + 1 ELSE n0 END AS n, CASE WHEN {opened} AND {fresh} THEN us ELSE st END AS st, CASE WHEN {opened} AND {fresh} THEN price ELSE fp END AS fp, CASE WHEN {opened} THEN price ELSE pp END AS pp,
  side1 AS side, signed + CASE WHEN {opened} THEN side1 * volume ELSE 0 END AS signed FROM (
 SELECT *, CASE WHEN {opened} AND NOT {fresh} AND price > pp THEN 1 WHEN {opened} AND NOT {fresh} AND price < pp THEN -1 ELSE side END AS side1 FROM (
 SELECT * REPLACE (CASE WHEN status LIKE 'clean%' THEN q1 ELSE q END AS q, CASE WHEN status LIKE 'clean%' THEN j + q1 ELSE j END AS j) FROM (
 SELECT *, (l + 0.5::DOUBLE * 0 * s - j) * pow(1 - {b}, 2) + pow({b}, 2) * q AS q1 FROM (
 SELECT * REPLACE (CASE WHEN status LIKE 'clean%' THEN (price - l1) * (1 - {b}) + {b} * s ELSE s END AS s, CASE WHEN status LIKE 'clean%' THEN l1 ELSE l END AS l) FROM (
 SELECT o.symbol, o.date, o.k, o.seq, o.us, o.price, o.volume, o.status, r.l, r.s, r.q, r.j, r.n AS n0, r.st, r.fp, r.pp, r.side, r.signed, r.lr, r.bar, o.price + {b} * (r.l - o.price) AS l1 FROM r JOIN o ON o.symbol = r.symbol AND o.date = r.date AND o.k = r.k + 1))))))))),
c AS (SELECT * FROM r WHERE k > 0)"""
    )


def _stats_sql() -> str:
    """Bars ``zb`` of the cut ticks, as ``bar_features`` makes them."""
    parts, joins = [], []
    for x in ("price", "jma"):
        joins.append(
            f"{x}_w AS (SELECT symbol, date, own, {x} AS x, volume, sum(volume) OVER (PARTITION BY symbol, date, own ORDER BY {x} RANGE UNBOUNDED PRECEDING) AS cw, sum(volume) OVER (PARTITION BY symbol, date, own) AS tw FROM g), "
            f"{x}_q AS (SELECT symbol, date, own, " + ", ".join(f"(min(CASE WHEN cw >= {q}::DOUBLE * tw THEN x END) + coalesce(min(CASE WHEN cw > {q}::DOUBLE * tw THEN x END), max(x))) / 2 AS {x}_wq{round(100 * q)}" for q in (0.1, 0.5, 0.9)) + f" FROM {x}_w GROUP BY ALL)"
        )
        parts += [f"arg_min({x}, (us, seq)) AS {x}_open", f"arg_max({x}, (us, seq)) AS {x}_close", f"min({x}) AS {x}_low", f"max({x}) AS {x}_high", f"max({x}) - min({x}) AS {x}_range", f"arg_max({x}, (us, seq)) - arg_min({x}, (us, seq)) AS {x}_return"]
        parts += [f"sum(volume * {x}) / sum(volume) AS {x}_wmean", f"sqrt(greatest(sum(volume * {x} * {x}) / sum(volume) - pow(sum(volume * {x}) / sum(volume), 2), 0)) AS {x}_wstd"]
    return f""", g0 AS (SELECT *, max(trig) OVER (PARTITION BY symbol, date, own) AS bar_trigger, sign(price - lag(price) OVER (PARTITION BY symbol, date, own ORDER BY us, seq)) AS ch FROM c WHERE own IS NOT NULL),
g AS (SELECT *, coalesce(last_value(nullif(ch, 0) IGNORE NULLS) OVER (PARTITION BY symbol, date, own ORDER BY us, seq ROWS UNBOUNDED PRECEDING), 0)::BIGINT AS sd FROM g0 WHERE bar_trigger IS NOT NULL), {", ".join(joins)},
zb AS (SELECT symbol, date, own AS bar, min(us) AS open_at, max(us) AS close_at, {", ".join(parts)}, count(*) AS tick_count, sum(volume)::BIGINT AS volume, sum(volume * price) AS dollars, sum(sd)::BIGINT AS tick_imbalance, sum(sd * volume)::BIGINT AS volume_imbalance, sum(sd * volume * price) AS dollar_imbalance, any_value(bar_trigger) AS bar_trigger FROM g GROUP BY symbol, date, own)"""


#: Two passes over the rows leave more doubtful last digits in a deviation than in a sum.
_LOOSE = {"price_wstd": 3, "jma_wstd": 3, "dollars": 3, "dollar_imbalance": 3}


def _bar_columns(rename: str = "") -> str:
    out = ["symbol", "date", "bar"] if not rename else []
    for c, t in ad.BAR_COLUMNS.items():
        if c != "bar":
            out.append(f"round({c}, {_LOOSE.get(c, 5)}) + 0 AS {c}" if t == "double" else c)
    return ", ".join(out)


def _rounded(df, extra: dict[str, int] | None = None):
    digits = _LOOSE | (extra or {})
    return df.select(*[(F.round(f.name, digits.get(f.name, 5)) + 0.0).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields])


_CUT = _cut_sql()


@query("build_bars", _CUT + " ||| SELECT seq, status, round(jma, 5) AS jma, own AS bar, trig AS bar_trigger FROM c", "t", recursive=True)
def build_bars(spark, sf):
    return _ticks(spark, sf).select("seq", "status", _r("jma"), "bar", "bar_trigger")


@query("bar_features", _CUT + _stats_sql() + f" ||| SELECT {_bar_columns()} FROM zb JOIN (SELECT symbol AS s1, date AS d1, own AS o1, * EXCLUDE (symbol, date, own) FROM price_q) ON s1 = symbol AND d1 = date AND o1 = bar JOIN (SELECT symbol AS s2, date AS d2, own AS o2, * EXCLUDE (symbol, date, own) FROM jma_q) ON s2 = symbol AND d2 = date AND o2 = bar", "t", recursive=True)
def bar_features(spark, sf):
    return _rounded(ad.bar_features(_ticks(spark, sf), ["symbol", "date"]))


_WINDOW = ", lt AS (SELECT zb.symbol, zb.date, zb.bar, zb.close_at AS label_start_at, zb.close_at + 14400000000 AS label_end_at, c.us, c.seq, c.price, c.jma, row_number() OVER w - 1 AS i, first_value(c.price) OVER w AS p1 FROM zb JOIN c ON c.symbol = zb.symbol AND c.date = zb.date AND c.status LIKE 'clean%' AND c.us >= zb.close_at + 3000000 AND c.us < zb.close_at + 14400000000 WINDOW w AS (PARTITION BY zb.symbol, zb.date, zb.bar ORDER BY c.us, c.seq))"
_OUTCOMES = (
    _WINDOW
    + ", tb AS (SELECT symbol, date, bar, label_start_at, label_end_at, count(*) AS n, "
    + ", ".join(f"min(CASE WHEN (jma - p1) * {sign} < -5 THEN us END) AS {side}_stop, " + ", ".join(f"min(CASE WHEN (jma - p1) * {sign} >= {5 * r} THEN us END) AS {side}_{r}" for r in (1, 2, 4)) for side, sign in (("long", 1), ("short", -1)))
    + " FROM lt GROUP BY ALL HAVING count(*) >= 5), oc AS ("
    + " UNION ALL ".join(f"SELECT symbol, date, bar, label_end_at, '{side}' AS side, '{goal}' AS goal, {rrr}.0::DOUBLE AS rrr, {side}_{name} AS hit_at FROM tb" for side, sign in (("long", 1), ("short", -1)) for goal, rrr, name in [("stop", -sign, "stop"), *(("profit", sign * r, str(r)) for r in (1, 2, 4))])
    + ")"
)
_SIDES = _OUTCOMES + """, so AS (SELECT symbol, date, bar, label_end_at, side, max(CASE WHEN goal = 'stop' THEN hit_at END) AS stop FROM oc GROUP BY ALL),
pr AS (SELECT oc.symbol, oc.date, oc.bar, oc.side, arg_max(oc.rrr, abs(oc.rrr)) AS rrr, arg_max(oc.hit_at, abs(oc.rrr)) AS hit_at FROM oc JOIN so ON so.symbol = oc.symbol AND so.date = oc.date AND so.bar = oc.bar AND so.side = oc.side WHERE oc.goal = 'profit' AND oc.hit_at IS NOT NULL AND (so.stop IS NULL OR oc.hit_at < so.stop) GROUP BY ALL),
sl AS (SELECT so.symbol, so.date, so.bar, so.side, CASE WHEN pr.hit_at IS NOT NULL THEN 'profit' WHEN stop IS NOT NULL THEN 'stop' ELSE 'neutral' END AS outcome, CASE WHEN pr.hit_at IS NOT NULL THEN pr.rrr WHEN stop IS NOT NULL THEN CASE side WHEN 'long' THEN -1.0 ELSE 1.0 END ELSE 0.0 END::DOUBLE AS rrr, coalesce(pr.hit_at, stop, label_end_at) AS hit_at FROM so LEFT JOIN pr USING (symbol, date, bar, side))"""
_LABEL = _SIDES + """, fl AS (SELECT l.symbol, l.date, l.bar, CASE WHEN l.outcome = 'profit' AND s.outcome = 'stop' THEN 'long' WHEN s.outcome = 'profit' AND l.outcome = 'stop' THEN 'short' WHEN l.outcome <> 'profit' AND s.outcome <> 'profit' THEN 'neutral' END AS label_side,
 CASE WHEN l.outcome = 'profit' AND s.outcome = 'stop' THEN l.rrr WHEN s.outcome = 'profit' AND l.outcome = 'stop' THEN s.rrr WHEN l.outcome <> 'profit' AND s.outcome <> 'profit' THEN 0.0 END AS label_rrr,
 CASE WHEN l.outcome = 'profit' AND s.outcome = 'stop' THEN l.hit_at WHEN s.outcome = 'profit' AND l.outcome = 'stop' THEN s.hit_at WHEN l.outcome <> 'profit' AND s.outcome <> 'profit' THEN greatest(l.hit_at, s.hit_at) END AS label_outcome_at,
 CASE WHEN (l.outcome = 'profit' AND s.outcome = 'stop') OR (s.outcome = 'profit' AND l.outcome = 'stop') THEN 'profit' WHEN l.outcome <> 'profit' AND s.outcome <> 'profit' THEN 'neutral' ELSE 'unknown' END AS label_outcome
 FROM sl l JOIN sl s ON l.symbol = s.symbol AND l.date = s.date AND l.bar = s.bar AND l.side = 'long' AND s.side = 'short')"""
_TREND = """, tr AS (SELECT symbol, date, bar, regr_slope(price, i) AS slope, regr_r2(price, i) AS r2, regr_intercept(price, i) AS b0, count(*) AS n, regr_sxx(price, i) AS xx, regr_syy(price, i) AS yy, regr_sxy(price, i) AS xy, avg(i) AS mx FROM lt GROUP BY ALL HAVING count(*) >= 5)"""
_BASE = _CUT + _stats_sql()
_DAY = ["symbol", "date"]


def _window_ticks(spark, sf):
    ticks = _ticks(spark, sf)
    return ad.label_ticks(ad.bar_features(ticks, _DAY), ticks, _DAY, RULES.horizon)


@query("label_ticks", _BASE + _WINDOW + " ||| SELECT symbol, date, bar, us, seq, price, round(jma, 5) AS jma FROM lt", "t", recursive=True)
def label_ticks(spark, sf):
    return _window_ticks(spark, sf).select(*_DAY, "bar", "us", "seq", "price", _r("jma"))


def _per_window(spark, sf, kernel, schema):
    """One call of ``kernel(key, window)`` for each bar's window of enough ticks; a window is bounded by its horizon."""
    import pandas as pd

    from ..session import reachable

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["us", "seq"])
        rows = kernel(pdf) if len(pdf) >= RULES.least else []
        return pd.DataFrame([(*key, *r) for r in rows], columns=["symbol", "date", "bar", *(c.split(" ")[0] for c in schema.split(", "))])

    ticks = _ticks(spark, sf)
    bars = ad.bar_features(ticks, _DAY)
    windows = ad.label_ticks(bars, ticks, _DAY, RULES.horizon).join(bars.select(*_DAY, "bar", (F.col("close_at") + RULES.horizon).alias("end_at")), [*_DAY, "bar"])
    reachable(spark)
    return windows.groupBy(*_DAY, "bar").applyInPandas(run, "symbol string, date long, bar long, " + schema)


def _found(pdf):
    return ad.outcomes(pdf["us"].to_numpy(), pdf["jma"].to_numpy(), pdf["price"].iloc[0], RULES.risk, RULES.rewards)


@query("tb_outcome", _BASE + _OUTCOMES + " ||| SELECT symbol, date, bar, side, goal, rrr, hit_at FROM oc", "t", recursive=True)
def tb_outcome(spark, sf):
    out = _per_window(spark, sf, lambda pdf: [(side, goal, rrr, None if at is None else float(at)) for side, goal, rrr, at in _found(pdf)], "side string, goal string, rrr double, hit_at double")
    return out.withColumn("hit_at", F.when(~F.isnan("hit_at"), F.col("hit_at").cast("long")))


@query("tb_label_side", _BASE + _SIDES + " ||| SELECT symbol, date, bar, side, outcome, rrr, hit_at FROM sl", "t", recursive=True)
def tb_label_side(spark, sf):
    return _per_window(spark, sf, lambda pdf: [(side, *ad.side_label(_found(pdf), side, int(pdf["end_at"].iloc[0]))) for side in ("long", "short")], "side string, outcome string, rrr double, hit_at long")


@query("tb_label", _BASE + _LABEL + " ||| SELECT symbol, date, bar, label_outcome, label_side FROM fl", "t", recursive=True)
def tb_label(spark, sf):
    def one(pdf):
        end = int(pdf["end_at"].iloc[0])
        found = _found(pdf)
        side, outcome, _, _ = ad.final_label(ad.side_label(found, "long", end), ad.side_label(found, "short", end))
        return [(outcome, side)]

    return _per_window(spark, sf, one, "label_outcome string, label_side string")


@query("trend_label", _BASE + _WINDOW + _TREND + " ||| SELECT symbol, date, bar, round(slope, 4) + 0 AS slope, round(b0 / sqrt((yy - slope * xy) / (n - 2) * (1.0::DOUBLE / n + mx * mx / xx)), 3) AS tvalue, round(r2, 4) AS r2 FROM tr", "t", recursive=True)
def trend_label(spark, sf):
    out = _per_window(spark, sf, lambda pdf: [ad.trend(pdf["price"].to_numpy(float))], "slope double, tvalue double, r2 double")
    return out.select(*_DAY, "bar", (F.round("slope", 4) + 0.0).alias("slope"), F.round("tvalue", 3).alias("tvalue"), F.round("r2", 4).alias("r2"))


_ALL_LABELS = "round(slope, 4) + 0 AS label_trend_slope, round(b0 / sqrt((yy - slope * xy) / (tr.n - 2) * (1.0::DOUBLE / tr.n + mx * mx / xx)), 3) AS label_trend_tvalue, round(r2, 4) AS label_trend_r2"
_SHARP = {"label_trend_slope": 4, "label_trend_tvalue": 3, "label_trend_r2": 4}


@query("label_bars", _BASE + _LABEL + _TREND + f" ||| SELECT zb.symbol, zb.date, zb.bar, CASE WHEN fl.bar IS NOT NULL THEN zb.close_at END AS label_start_at, CASE WHEN fl.bar IS NOT NULL THEN zb.close_at + 14400000000 END AS label_end_at, label_side, label_outcome, label_rrr, label_outcome_at, {_ALL_LABELS} FROM zb LEFT JOIN fl USING (symbol, date, bar) LEFT JOIN tr USING (symbol, date, bar)", "t", recursive=True)
def label_bars(spark, sf):
    ticks = _ticks(spark, sf)
    return _rounded(ad.label_bars(ad.bar_features(ticks, _DAY), ticks, _DAY, RULES.risk, RULES.horizon, RULES.rewards, least=RULES.least, trend=True), _SHARP)


@query("bar_dates_workflow", _BASE + _LABEL + f" ||| SELECT zb.symbol, zb.date, zb.bar, zb.close_at, round(price_open, 5) AS price_open, round(price_return, 5) + 0 AS price_return, zb.tick_count, zb.volume, bar_trigger, label_side, label_outcome, label_rrr, label_outcome_at FROM zb LEFT JOIN fl USING (symbol, date, bar)", "t", recursive=True)
def bar_dates_workflow(spark, sf):
    return _rounded(ad.bar_workflow(_ticks(spark, sf), _DAY, RULES)).select(*_DAY, "bar", "close_at", "price_open", "price_return", "tick_count", "volume", "bar_trigger", "label_side", "label_outcome", "label_rrr", "label_outcome_at")


@query("bar_date_stats")
def bar_date_stats(spark, sf):
    return _rounded(ad.bar_date_stats(ad.bar_features(_ticks(spark, sf), _DAY), ["symbol"], "date", 0.9))


@query("futures_roll", "x AS (SELECT symbol, t, CASE WHEN t // 86400 <> lag(t // 86400) OVER o THEN open - lag(close) OVER o ELSE 0 END AS s FROM b WINDOW o AS (PARTITION BY symbol ORDER BY t)) ||| SELECT symbol, t, round(sum(s) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) - sum(s) OVER (PARTITION BY symbol), 4) + 0 AS gap FROM x", "tb")
def futures_roll(spark, sf):
    return ad.futures_roll(src.bars(spark, sf).withColumn("contract", F.floor(F.col("t") / 86400)), KEY, "t", "contract").select("symbol", "t", (F.round("gap", 4) + 0.0).alias("gap"))


@query("daily_vol", """h AS (SELECT a.symbol, a.t, a.close, (SELECT arg_max(z.close, z.t) FROM b z WHERE z.symbol = a.symbol AND z.t < a.t - 86400) AS p FROM b a), r AS (SELECT symbol, t, close / p - 1 AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) AS k FROM h WHERE p IS NOT NULL),
w AS (SELECT a.symbol, a.t, a.x AS ret, pow(1 - 2.0::DOUBLE / 51, a.k - z.k) AS w, z.x FROM r a JOIN r z ON z.symbol = a.symbol AND z.k <= a.k), m AS (SELECT symbol, t, any_value(ret) AS ret, sum(w) AS s, sum(w * w) AS s2, sum(w * x) / sum(w) AS mean FROM w GROUP BY symbol, t),
v AS (SELECT w.symbol, w.t, sum(w * pow(x - mean, 2)) AS ss FROM w JOIN m USING (symbol, t) GROUP BY ALL) ||| SELECT symbol, t, round(ret, 5) + 0 AS ret, round(CASE WHEN s - s2 / s > 1e-9 THEN sqrt(ss / (s - s2 / s)) END, 4) AS daily_vol FROM m JOIN v USING (symbol, t)""", "tb")
def daily_vol(spark, sf):
    return ad.daily_volatility(src.bars(spark, sf), KEY, "t", "close", 86400, 50).select("symbol", "t", (F.round("ret", 5) + 0.0).alias("ret"), _r("daily_vol", 4))


@query("etf_trick", """d0 AS (SELECT t // 86400 AS day, symbol AS sec, arg_min(open, t) AS open, arg_max(close, t) AS close, CASE WHEN t // 86400 // 7 % 2 = 0 THEN 0.2 ELSE 0.1 END::DOUBLE AS weight FROM b GROUP BY ALL),
e AS (SELECT *, lead(open) OVER o AS nx, close - lag(close) OVER o AS dc, lag(weight) OVER o AS wp, sum(weight) OVER (PARTITION BY day) AS total FROM d0 WINDOW o AS (PARTITION BY sec ORDER BY day)),
a AS (SELECT day, row_number() OVER (ORDER BY day) AS k, bool_or(wp IS NULL OR wp <> weight) AS chg, list(coalesce(weight / (nx * total), 0) ORDER BY sec) AS u, list(coalesce(dc, 0) ORDER BY sec) AS dc, list(close - open ORDER BY sec) AS dn FROM e GROUP BY day),
r AS (SELECT day, k, 1.0::DOUBLE AS v, u AS held, true AS fresh FROM a WHERE k = 1
UNION ALL SELECT day, k, v, CASE WHEN chg THEN list_transform(u, lambda x: x * v) ELSE held END, chg FROM (SELECT a.day, a.k, a.chg, a.u, r.held, r.v + list_sum(list_transform(range(1, len(r.held) + 1), lambda i: r.held[i] * CASE WHEN r.fresh THEN a.dn[i] ELSE a.dc[i] END)) AS v FROM r JOIN a ON a.k = r.k + 1)) |||
SELECT day, round(v, 5) AS value FROM r WHERE k > 1""", "tb", recursive=True)
def etf_trick(spark, sf):
    rows = src.bars(spark, sf).withColumn("day", F.floor(F.col("t") / 86400)).groupBy("day", F.col("symbol").alias("sec")).agg(F.min_by("open", "t").alias("open"), F.max_by("close", "t").alias("close"))
    return ad.etf_trick(rows.withColumns({"weight": F.when(F.floor(F.col("day") / 7) % 2 == 0, 0.2).otherwise(0.1), "cost": F.lit(0.0), "rate": F.lit(1.0)}), "day").select("day", _r("value"))


@query("holding_period", """n AS (SELECT symbol, (us - min(us) OVER (PARTITION BY symbol)) / 86400000000.0::DOUBLE AS moment, (volume % 5 - 2)::DOUBLE AS pos, row_number() OVER (PARTITION BY symbol ORDER BY us) AS k FROM t),
r AS (SELECT symbol, 0::BIGINT AS k, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS s, 0.0::DOUBLE AS w FROM n WHERE k = 1
UNION ALL SELECT symbol, k, CASE WHEN ch * old >= 0 THEN CASE WHEN pos <> 0 THEN (entry * old + moment * ch) / pos ELSE entry END WHEN pos * old < 0 THEN moment ELSE entry END, pos,
 s + CASE WHEN ch * old >= 0 THEN 0 WHEN pos * old < 0 THEN (moment - entry) * abs(old) ELSE (moment - entry) * abs(ch) END, w + CASE WHEN ch * old >= 0 THEN 0 WHEN pos * old < 0 THEN abs(old) ELSE abs(ch) END
FROM (SELECT n.symbol, n.k, n.moment, n.pos, n.pos - r.pos AS ch, r.pos AS old, r.entry, r.s, r.w FROM r JOIN n ON n.symbol = r.symbol AND n.k = r.k + 1)) |||
SELECT symbol, round(arg_max(s, k) / nullif(arg_max(w, k), 0), 5) AS holding FROM r GROUP BY symbol""", "t", recursive=True)
def holding_period(spark, sf):
    return ad.holding_period(src.ticks(spark, sf).withColumn("pos", F.col("volume") % 5 - 2), KEY, "us", "pos", 86400e6).select("symbol", _r("holding"))


@query("ws_replay", "|||SELECT symbol, price, volume AS size, us // 1000 AS trade_ms, round((us * 1000 + 5000000) / 1000000.0::DOUBLE - us // 1000, 3) AS delay_ms FROM t WHERE seq % 2 = 0", "t")
def ws_replay(spark, sf):
    from ..sources.files import parse_capture

    event = F.struct(F.when(F.col("seq") % 2 == 0, "T").otherwise("Q").alias("ev"), F.col("symbol").alias("sym"), F.col("price").alias("p"), F.col("volume").alias("s"), F.floor(F.col("us") / 1000).alias("t"))
    lines = src.ticks(spark, sf).select(F.concat((F.col("us") * 1000 + 5000000).cast("string"), F.lit("||"), F.to_json(F.array(event))).alias("value"))
    return parse_capture(lines).select("symbol", "price", "size", "trade_ms", F.round("delay_ms", 3).alias("delay_ms"))


@query("scan_date_range", "|||SELECT seq, symbol, price FROM t WHERE us // 86400000000 BETWEEN 19730 AND 19740", "t")
def scan_date_range(spark, sf):
    return src.ticks(spark, sf).where(F.floor(F.col("us") / 86400000000).between(19730, 19740)).select("seq", "symbol", "price")


@query("list_symbols_dates", "|||SELECT DISTINCT symbol, us // 86400000000 AS date FROM t", "t")
def list_symbols_dates(spark, sf):
    from ..sources.files import partitions

    return partitions(src.ticks(spark, sf).withColumn("date", F.floor(F.col("us") / 86400000000)))


@query("symbol_vol_filter")
def symbol_vol_filter(spark, sf):
    rows = ingest.add_range(src.bars(spark, sf).withColumn("vwap", F.try_divide("dollars", "volume")).where("vwap IS NOT NULL"))
    rows = ad.jma(ad.jma(rows, KEY, ["t"], "range", 5, 1), KEY, ["t"], "vwap", 7, 1)
    from ..functions.windows import ordered

    over = ordered(KEY, ["t"])
    out = rows.select("symbol", "t", *[F.lag(c).over(over).alias(f"{c}_lag") for c in ("range_jma", "vwap_jma", "close")]).dropna()
    size = F.least(F.greatest(F.col("range_jma_lag") / 15, F.col("vwap_jma_lag") * 0.0005), F.col("vwap_jma_lag") * 0.005)
    return out.select("symbol", "t", _r("range_jma_lag"), _r("vwap_jma_lag"), F.round(size, 6).alias("renko_size"))
