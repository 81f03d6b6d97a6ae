"""Joins, folds and window helpers against plain Python."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.fold import Kernel, ordered_fold
from tickloom.functions.joins import asof, interval
from tickloom.functions.stats import normal_cdf
from tickloom.operators import backtest, bars, breaks, ingest, labels, matrices


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_asof(spark, forward, strict):
    random.seed(3)
    left = [(k, random.randint(0, 30)) for k in "ab" for _ in range(20)]
    right = [(k, t, float(t)) for k in "ab" for t in random.sample(range(31), 8)]
    got = asof(spark.createDataFrame(left, "k string, t long"), spark.createDataFrame(right, "k string, u long, v double"), ["k"], "t", "u", ["v"], forward, strict)

    def expect(k, t):
        if forward:
            found = [v for a, u, v in right if a == k and (u > t if strict else u >= t)]
            return min(found, default=None)
        found = [v for a, u, v in right if a == k and (u < t if strict else u <= t)]
        return max(found, default=None)

    assert rows(got) == sorted(((k, t, expect(k, t)) for k, t in left), key=str)


@pytest.mark.parametrize("cell", [1, 7, 1000])
def test_interval(spark, cell):
    random.seed(4)
    points = [(k, t) for k in "ab" for t in random.sample(range(60), 25)]
    spans = [(k, i, s, s + random.randint(0, 9)) for k in "ab" for i, s in enumerate(random.sample(range(60), 10))]
    got = interval(spark.createDataFrame(points, "k string, t long"), spark.createDataFrame(spans, "k string, i long, a long, b long"), ["k"], "t", "a", "b", cell)
    assert rows(got.select("k", "t", "i")) == sorted(((k, t, i) for k, t in points for q, i, a, b in spans if q == k and a <= t <= b), key=str)


def test_fold_carries_state_across_batches(spark):
    class Running(Kernel):
        def __init__(self, key):
            self.key, self.total = key, 0

        def feed(self, pdf):
            out = []
            for v in pdf["v"]:
                self.total += v
                out.append((*self.key, self.total))
            return pd.DataFrame(out, columns=["k", "s"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        data = [(k, i, i % 5) for k in ["a", "b", None] for i in range(40)]
        random.seed(5)
        random.shuffle(data)
        got = rows(ordered_fold(spark.createDataFrame(data, "k string, o long, v long"), ["k"], ["o"], Running, "k string, s long"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, total = [], 0
    for i in range(40):
        total += i % 5
        want += [(k, total) for k in ["a", "b", None]]
    assert got == sorted(want, key=str)


def test_normal_cdf(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-3.0, -1.0, 0.0, 1.96)], "x double").select(normal_cdf(F.col("x"))).collect()]
    assert got == pytest.approx([0.0013499, 0.1586553, 0.5, 0.9750021], abs=2e-7)


def test_threshold_bars_reset_the_excess(spark):
    ticks = spark.createDataFrame([("a", i, i, 1.0, v) for i, v in enumerate([3, 4, 9, 1, 1, 7, 2])], "symbol string, us long, seq long, price double, volume long")
    got = bars.volume_bars(ticks, ["symbol"], ["us", "seq"], 6).orderBy("tick_num").select("tick_num", "volume").collect()
    assert [tuple(r) for r in got] == [(2, 7), (3, 9), (6, 9)]


def test_bars_do_not_depend_on_input_order(spark):
    data = [("a", i, i, 10.0 + i % 3, i % 7) for i in range(200)]
    schema = "symbol string, us long, seq long, price double, volume long"
    one = rows(bars.dollar_bars(spark.createDataFrame(data, schema), ["symbol"], ["us", "seq"], 200))
    assert one == rows(bars.dollar_bars(spark.createDataFrame(data[::-1], schema).repartition(3), ["symbol"], ["us", "seq"], 200))


def test_concurrency_and_uniqueness(spark):
    # Eight labels of two hours on an hourly index.
    hours = spark.createDataFrame([("a", h, 1.0) for h in range(24)], "symbol string, t long, close double")
    spans = spark.createDataFrame([("a", s, s + 2) for s in (1, 2, 5, 7, 10, 11, 12, 20)], "symbol string, t0 long, t1 long")
    counts = {r["t"]: r["concurrency"] for r in labels.concurrent_events(hours, spans, ["symbol"]).collect()}
    brute = {h: sum(s <= h <= s + 2 for s in (1, 2, 5, 7, 10, 11, 12, 20)) for h in range(24)}
    assert counts == brute
    unique = {r["t0"]: r["uniqueness"] for r in labels.average_uniqueness(hours, spans, ["symbol"], 4).collect()}
    assert unique[20] == 1.0 and unique[1] == pytest.approx((1 + 0.5 + 0.5) / 3)


def test_condition_flag_of_null(spark):
    df = spark.createDataFrame([([2, 3],), ([1],), (None,)], "c array<int>")
    assert [r[0] for r in df.select(ingest.irregular(F.col("c"))).collect()] == [True, False, False]


def test_empty_frames(spark):
    ticks = spark.createDataFrame([], "symbol string, us long, seq long, price double, volume long")
    assert bars.dollar_bars(ticks, ["symbol"], ["us", "seq"], 10).count() == 0
    with pytest.raises(ValueError):
        ingest.validate_nonempty(ticks)


def test_discrete_signal(spark):
    got = spark.createDataFrame([(0.12,), (0.38,), (-1.7,)], "s double").select(backtest.discrete_signal(F.col("s"), 0.25)).collect()
    assert [r[0] for r in got] == pytest.approx([0.0, 0.5, -1.0])


def test_entropies():
    assert breaks._lempel_ziv("abab") == 3 / 4
    assert breaks._plug_in("aabb", 1) == pytest.approx(0.9182958)


def test_portfolios():
    import numpy as np

    cov = np.diag([1.0, 4.0])
    assert matrices.hrp_weights(cov) == pytest.approx([0.8, 0.2])
    assert matrices.minimum_variance(cov) == pytest.approx([0.8, 0.2], abs=1e-6)
    assert [e[:2] for e in matrices.minimum_spanning_tree(np.array([[0, 1, 3], [1, 0, 2], [3, 2, 0.0]]))] == [(0, 1), (1, 2)]
    assert matrices.simplex(np.array([0.5, 0.5, 2.0])) == pytest.approx([0, 0, 1])


def test_portfolios_step_at_every_bar(spark):
    import os

    from tickloom.plans.all_queries import QUERIES
    from tickloom.sources import testdata

    data = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rows = matrices.relatives(testdata.bars(spark, data), ["symbol"], "t", "close").select("t").distinct().count()
    for name in ("olps_bcrp", "olps_cwmr", "olps_corn"):
        assert QUERIES[name](spark, data).count() == rows


def test_pattern_matching_equals_pairwise_correlations():
    import numpy as np

    from tickloom.operators import extras

    x = np.random.default_rng(4).uniform(0.9, 1.1, (40, 3))
    w, wealth, want = np.full(3, 1 / 3), 1.0, []
    for t in range(40):
        wealth *= float(w @ x[t])
        want.append(wealth)
        if t + 1 > 5:
            alike = [s for s in range(5, t + 1) if np.corrcoef(x[t - 4 : t + 1].ravel(), x[s - 5 : s].ravel())[0, 1] >= 0.1]
            w = extras.best_constant(x[alike], 200_000, 1e-9) if alike else np.full(3, 1 / 3)
    assert np.allclose(extras.pattern_matching(x), want, atol=2e-3)  # two solvers of one optimum
