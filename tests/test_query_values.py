"""Queries without SQL against values worked out here: inputs come from DuckDB and pandas, kernels are tested on their own."""

import glob
import math
import os

import numpy as np
import pandas as pd
import pytest

from tickloom.operators import adaptive, allocation, clusters, dependence, evaluate, extras, factors, generate, labels, matrices, moments, networks, patterns
from tickloom.operators.breaks import ffd_weights
from tickloom.plans.all_queries import QUERIES, SQL
from tickloom.plans.model_queries import FEATURES, SEED
from tickloom.plans.registry import ROLES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


LARGER = DATA.replace("sf0.001", "sf0.01")


class Frames:
    def __init__(self, folder=DATA):
        import duckdb

        self.con = duckdb.connect()
        for path in glob.glob(f"{folder}/*.parquet"):
            self.con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
        self.ticks = self.con.execute(f"WITH {ROLES['t']} SELECT * FROM t ORDER BY symbol, us, seq").df()
        self.bars = self.con.execute(f"WITH {ROLES['t']}, {ROLES['b']} SELECT * FROM b ORDER BY symbol, t").df()
        self.names = sorted(self.bars["symbol"].unique())
        returns = self.bars.assign(ret=self.bars.groupby("symbol")["close"].pct_change()).dropna(subset=["ret"])
        self.returns = returns[["symbol", "t", "ret"]]
        self.wide = self.returns.pivot(index="t", columns="symbol", values="ret")
        pairs = lambda f: np.array([[f(self.wide[[a, b]].dropna().to_numpy() if a != b else np.repeat(self.wide[[a]].dropna().to_numpy(), 2, 1)) for b in self.names] for a in self.names])
        self.cov = pairs(lambda x: np.cov(x.T, bias=True)[0, 1])
        self.corr = pairs(lambda x: np.corrcoef(x.T)[0, 1])
        self.mean = self.wide.mean().to_numpy()
        hours = self.ticks.assign(day=self.ticks["us"] // 86400000000, hour=self.ticks["us"] // 3600000000 % 24).groupby(["day", "hour"])["price"].mean().unstack()
        self.hours = hours
        m = hours.corr(min_periods=2).to_numpy().copy()
        m[np.isnan(m)] = 0
        np.fill_diagonal(m, 1)
        self.hour = m
        relatives = self.bars.assign(x=self.bars.groupby("symbol")["close"].pct_change().add(1).fillna(1)).pivot(index="t", columns="symbol", values="x").fillna(1.0)
        self.relatives = relatives

    def distance(self):
        return np.sqrt(np.maximum((1 - self.hour) / 2, 0))


@pytest.fixture(scope="module")
def data():
    return Frames()


def rng():
    return np.random.default_rng(SEED)


def by_hour(values):
    return [(h, int(v)) for h, v in enumerate(values)]


def square(m):
    return [(i, j, m[i, j]) for i in range(len(m)) for j in range(m.shape[1])]


def named(m, names):
    return [(a, b, m[i, j]) for i, a in enumerate(names) for j, b in enumerate(names)]


def edges(found):
    return [(i, j, d) for i, j, d in found]


def per_name(w, names):
    return list(zip(names, w, strict=True))


def wealth(kind):
    def run(d):
        x = d.relatives.to_numpy()
        own, now, out = matrices.OnlinePortfolio(kind, x.shape[1]), 1.0, []
        for t, row in zip(d.relatives.index, x):
            now *= own.w @ row
            out.append((t, now))
            own.step(row)
        return out

    return run


def path(kernel):
    return lambda d: list(zip(d.relatives.index, kernel(d.relatives.to_numpy()), strict=True))


def samples(d):
    b = d.bars.copy()
    g = b.groupby("symbol")
    b["momentum"] = np.log1p(b["close"] / g["close"].shift(3))
    b["volatility"] = np.log1p((b["high"] - b["low"]) / b["close"])
    b["imbalance"] = (b["close"] - b["open"]) / b["high"]
    rows = []
    for _, part in b.groupby("symbol"):
        t, close = part["t"].to_numpy(), part["close"].to_numpy()
        at = np.searchsorted(t, t + 21600)
        for k, j in enumerate(at):
            if j < len(t):
                rows.append((part["symbol"].iloc[0], t[k], t[j], int(close[j] > close[k]), k, j))
    spans = pd.DataFrame(rows, columns=["symbol", "t0", "t1", "label", "first", "last"])
    return spans, spans.merge(b.rename(columns={"t": "t0"})[["symbol", "t0", *FEATURES]], on=["symbol", "t0"]).dropna()


def folds(spans):
    out = []
    for symbol, part in spans.groupby("symbol"):
        part = part.sort_values("t0").reset_index(drop=True)
        for f, place in enumerate(np.array_split(np.arange(len(part)), 3)):
            hi = place[-1] + int(len(part) * 0.01)
            s0, s1 = part["t1"].iloc[place[0]], max(part["t1"].iloc[place].max(), part["t1"].iloc[hi] if hi < len(part) else 0)
            out += [(symbol, part["t0"].iloc[i], f, "test") for i in place]
            out += [(symbol, part["t0"].iloc[i], f, "train") for i in range(len(part)) if i not in set(place) and not (part["t0"].iloc[i] <= s1 and part["t1"].iloc[i] >= s0)]
    return pd.DataFrame(out, columns=["symbol", "t0", "fold", "role"])


def newton(x, y, w=None):
    x, b, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1), np.ones(len(x)) if w is None else w
    for _ in range(40):
        p = 1 / (1 + np.exp(-x @ b))
        b += np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x, x.T @ (w * (y - p)))
    return b


def loss(x, y, b):
    p = np.clip(1 / (1 + np.exp(-(b[0] + x @ b[1:]))), 1e-15, 1 - 1e-15)
    return float((y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def fold_scores(d, columns):
    spans, rows = samples(d)
    parts = rows.merge(folds(spans), on=["symbol", "t0"])
    out = []
    for f in range(3):
        train, test = (parts[(parts["fold"] == f) & (parts["role"] == r)] for r in ("train", "test"))
        b = newton(train[columns].to_numpy(), train["label"].to_numpy())
        out.append(loss(test[columns].to_numpy(), test["label"].to_numpy(), b))
    return out


def importance_of_one(d):
    return [(f, np.mean(s), np.std(s, ddof=1) / math.sqrt(3)) for f in FEATURES for s in [fold_scores(d, [f])]]


def pooled(d):
    return samples(d)[1]


def agglomerated(d):
    return clusters.cut(clusters.agglomerate(clusters.rows_distance(d.distance()), "ward"), 4)


def turning_points(d):
    line = allocation.CriticalLine(d.mean, d.cov)
    rows = [("turning_point", k, n, w[i]) for k, w in enumerate(line.points) for i, n in enumerate(d.names)]
    return rows + [(kind, 0, n, w[i]) for kind, w in (("max_sharpe", line.largest_sharpe()), ("min_volatility", line.least_variance())) for i, n in enumerate(d.names)]


def pooled_views(d):
    cell = np.minimum(np.floor(d.returns["ret"] * 4), 200).astype(int)
    g = d.returns["ret"].groupby(cell.to_numpy())
    n, m = g.size().to_numpy(float), g.mean().to_numpy()
    p = n / n.sum()
    q = allocation.entropy_pooling(p, (m[None, :], np.array([0.9 * p @ m])), confidence=0.75)
    return list(zip(sorted(set(cell)), p, q))


def expert_paths(d):
    x, out = d.relatives.to_numpy(), {}
    for window in (3, 5, 8):
        own, w, s, now = matrices.OnlinePortfolio("olmar", x.shape[1], window=window), [], [], 1.0
        for row in x:
            w.append(own.w.copy())
            now *= own.w @ row
            s.append(now)
            own.step(row)
        out[window] = np.array(w), np.array(s)
    weights, riches = np.array([w for w, _ in out.values()]), np.array([s for _, s in out.values()]).T
    logs = [np.cumsum(np.log((allocation.expert_blend(riches, weights, how) * x).sum(1))) for how in ("history", "uniform", "top")]
    return list(zip(d.relatives.index, *logs))


def stopping(d):
    out = []
    for symbol, part in d.bars.groupby("symbol"):
        y = np.log(part["close"].to_numpy())
        x, z = y[:-1], y[1:]
        slope = np.cov(x, z, bias=True)[0, 1] / x.var()
        theta = (z.mean() - slope * x.mean()) / (1 - slope)
        if slope <= 0:
            continue
        n = len(x)
        theta = (z.sum() * (x * x).sum() - x.sum() * (x * z).sum()) / (n * ((x * x).sum() - (x * z).sum()) - (x.sum() ** 2 - x.sum() * z.sum()))
        share = ((x - theta) * (z - theta)).sum() / ((x - theta) ** 2).sum()
        if share <= 0:
            continue
        mu = -math.log(share) / 0.1
        sigma = (((z - theta) - share * (x - theta)) ** 2).mean() * 2 * mu / (1 - share**2)
        s = moments.StoppingLevels(theta, mu, sigma, 0.05, 0.01)
        out.append((symbol, s.liquidation(), s.entry()))
    return out


def spans_of(d):
    return samples(d)[0]


def net_moments(d):
    c = []
    for _, part in spans_of(d).groupby("symbol"):
        side = np.where(part["t0"] // 86400 % 2 == 0, 1, -1)
        c += [side[(part["t0"] <= t) & (part["t1"] > t)].sum() for t in part["t0"]]
    return [np.mean(np.array(c, float) ** k) for k in range(1, 6)]


def mixtures(d):
    m = net_moments(d)
    found = [moments.fit_mixture(m, np.random.default_rng(k), 1e-2, turns=500) for k in range(8)]
    return [(*f[0], f[1]) for f in found if f]


def draws(d):
    out = []
    for symbol, part in spans_of(d).groupby("symbol"):
        part = part.sort_values("t0")
        taken = labels.seq_bootstrap(part["first"].to_numpy(), part["last"].to_numpy(), len(part), np.random.default_rng(1))
        out += [(symbol, k, part["t0"].iloc[i]) for k, i in enumerate(taken)]
    return out


def orders_of_difference(d):
    out = []
    for symbol, part in d.bars.groupby("symbol"):
        y = np.log(part["close"].to_numpy())
        for k in range(11):
            w = ffd_weights(k / 10, 1e-2, 20)
            f = np.array([sum(v * y[i - j] for j, v in enumerate(w)) for i in range(len(w) - 1, len(y))])
            out.append((symbol, k / 10, extras.adf(f), np.corrcoef(f, y[len(w) - 1 :])[0, 1]))
    return out


def smooth(x, window, power=1.0, phase=0.0):
    step = adaptive.jma_step(x[0], window, power, phase)
    return np.array([step(v) for v in x])


def renko(d):
    out = []
    for symbol, part in d.bars[d.bars["volume"] != 0].groupby("symbol"):
        r, v = smooth((part["high"] - part["low"]).to_numpy(), 5), smooth((part["dollars"] / part["volume"]).to_numpy(), 7)
        for k in range(1, len(part)):
            if k - 1 >= 6:
                out.append((symbol, part["t"].iloc[k], r[k - 1], v[k - 1], min(max(r[k - 1] / 15, v[k - 1] * 0.0005), v[k - 1] * 0.005)))
    return out


def day_stats(d):
    columns = ["symbol", "date", "bar", "open_at", "close_at", "volume_imbalance", "price_range"]
    bars = d.con.execute(SQL["bar_features"]).df()[columns]
    out = []
    for symbol, part in bars.groupby("symbol"):
        g = part.assign(minutes=(part["close_at"] - part["open_at"]) / 6e7).groupby("date")
        s = pd.DataFrame({"n": g.size(), "q": g["volume_imbalance"].quantile(0.9), "m": g["minutes"].mean(), "md": g["minutes"].median(), "r": g["price_range"].mean(), "rd": g["price_range"].median()})
        j = smooth(s["q"].to_numpy(float), 5)
        for k in range(5, len(s)):
            row = s.iloc[k]
            out.append((symbol, s.index[k], row["n"], row["q"], row["m"], row["md"], row["r"], row["rd"], j[k], j[k - 1]))
    return out


def impacts(d):
    """Entropies of bars of 50 ticks; impacts and sizes are checked by their SQL."""
    out = []
    for symbol, part in d.ticks.groupby("symbol"):
        p = part["price"].to_numpy()
        change = np.sign(np.diff(p, prepend=p[0]))
        side, last = [], 0
        for c in change:
            last = int(c) or last
            side.append(last)
        for end in range(50, len(p) + 1, 50):
            text = "".join({1: "a", -1: "b", 0: "c"}[s] for s in side[end - 50 : end])
            share = np.array([text.count(c) for c in set(text)]) / 50
            rest = [text[i - 1] for i in range(1, 50)]
            plug = np.array([rest.count(c) for c in set(rest)]) / 49
            seen, i = set(), 0
            while i < 50:
                j = i + 1
                while text[i:j] in seen and j < 50:
                    j += 1
                seen.add(text[i:j])
                i = j
            konto = 0.0
            for i in range(1, 26):
                n = 0
                while n < i and i + n < 50 and text[i : i + n + 1] in text[:i]:
                    n += 1
                konto += math.log2(i + 1) / (n + 1)
            out.append((symbol, end, -(share * np.log2(share)).sum(), -(plug * np.log2(plug)).sum(), len(seen) / 50, konto / 25))
    return out


EXPECTED = {
    "kmeans_clusters": lambda d: by_hour(clusters.kmeans(d.distance(), 4, rng())),
    "hierarchical_clusters": lambda d: by_hour(agglomerated(d)),
    "dbscan_clusters": lambda d: by_hour(clusters.dbscan(d.distance(), 0.6, 3)),
    "spectral_clusters": lambda d: by_hour(clusters.spectral(np.maximum(d.hour, 0), 4, rng())),
    "mean_shift_clusters": lambda d: by_hour(clusters.mean_shift(d.distance(), 0.8)),
    "affinity_clusters": lambda d: by_hour(clusters.affinity_propagation(-(clusters.rows_distance(d.distance()) ** 2))),
    "constrained_clusters": lambda d: by_hour(clusters.constrained_kmeans(d.distance(), 4, 3, 9, rng())),
    "optics_order": lambda d: [(i, k, None if np.isinf(r[i]) else r[i]) for o, r in [clusters.optics(d.distance(), 3)] for k, i in enumerate(o)],
    "onc": lambda d: [(i, k, s[i]) for groups, s in [clusters.optimal_clusters(d.hour, rng(), 5)] for k, g in enumerate(groups) for i in g],
    "hier_order": lambda d: list(enumerate(clusters.hierarchical_order(d.hour)[0])),
    "feature_clusters": lambda d: [(i, k) for k, g in enumerate(clusters.feature_clusters(d.hour, 5, rng(), "average")) for i in g],
    "almst": lambda d: edges(networks.average_linkage_tree(d.distance())),
    "pmfg": lambda d: edges(networks.planar_graph(d.distance())),
    "centrality_rank": lambda d: [(h, *(v[h] for v in found.values())) for found in [networks.centrality(24, networks.planar_graph(d.distance()))] for h in range(24)],
    "filter_corr_hier": lambda d: square(clusters.filter_hierarchical(d.hour, "average")),
    "market_cov": lambda d: square(allocation.clean_covariance(d.hour, 30 / 24)[1]),
    "tic": lambda d: square(allocation.tree_correlation(d.hour, [[h // 6 for h in range(24)], [h // 12 for h in range(24)]])),
    "row_bootstrap": lambda d: square(generate.row_bootstrap(d.hour, rng())),
    "block_bootstrap": lambda d: square(generate.block_bootstrap(d.hour, rng())),
    "vine_d": lambda d: square(generate.vine(10, rng(), "d")),
    "vine_c": lambda d: square(generate.vine(10, rng(), "c", 2.0)),
    "onion": lambda d: square(generate.onion(10, rng(), 2.0)),
    "corr_random_walks": lambda d: square(generate.correlated_walks(6, 200, rng(), 2)),
    "stylized_facts": lambda d: generate.facts([d.hour]),
    "corex_sieve": lambda d: [(k, h, w[h], tc) for k, (w, tc, _) in enumerate(factors.sieve(d.hour, 3, SEED)) for h in range(24)],
    "corex_bio": lambda d: [(h, c, m.gains[c, h]) for m in [factors.DiscreteFactors(d.hours.to_numpy(), 3, 2, SEED)] for h, c in enumerate(m.clusters())],
    "gaussianize": lambda d: [(s, t, v) for s, p in d.returns.groupby("symbol") for t, v in zip(p["t"], factors.gaussianized(p["ret"].to_numpy(), "lambert"))],
    "cla": turning_points,
    "mv_frontier": lambda d: [(k, r, v) for k, (r, v, _) in enumerate(allocation.CriticalLine(d.mean, d.cov).frontier(100))],
    "mv_custom": lambda d: per_name(allocation.custom_objective(lambda w: float(w @ d.cov @ w), 5, [lambda w: 0.5 - float(w.max())], 500), d.names),
    "nco": lambda d: per_name(allocation.nested_clusters(d.cov, rng()), d.names),
    "herc": lambda d: per_name(allocation.equal_risk_contribution(d.cov, None, "variance", "ward", 3), d.names),
    "robust_bayesian": lambda d: per_name(allocation.robust_bayesian(np.full(5, d.mean.mean()), np.diag(np.diag(d.cov)), d.mean, d.cov, 600, most_volatility=100 * np.trace(d.cov)), d.names),
    "mcos": lambda d: [(k, n, a, b) for k in range(8) for v in [allocation.simulated_weights(d.cov, d.mean, 200, k)] for n, a, b in zip(d.names, *v)],
    "entropy_pooling": pooled_views,
    "olps_experts": expert_paths,
    "ou_levels": stopping,
    "ef3m": mixtures,
    "hrp": lambda d: per_name(matrices.hrp_weights(d.cov), d.names),
    "cov_shrink": lambda d: per_name(0.9 * np.diag(d.cov) + 0.1 * np.trace(d.cov) / 5, d.names),
    "min_volatility": lambda d: per_name(allocation.CriticalLine(d.mean, d.cov).least_variance(), d.names),
    "black_litterman": lambda d: per_name(matrices.black_litterman(d.cov, np.full(5, 0.2), np.array([0.01]), np.array([[1.0, -1, 0, 0, 0]]))[1], d.names),
    "mst": lambda d: [(d.names[i], d.names[j], x) for i, j, x in matrices.minimum_spanning_tree(np.sqrt((1 - d.corr) / 2))],
    "denoise": lambda d: named(matrices.denoise(d.corr, 100.0), d.names),
    "detone": lambda d: named(matrices.detone(d.corr), d.names),
    "kl_distance": lambda d: [(0.5 * (-np.linalg.slogdet(d.corr)[1] + 5 - 5), np.linalg.norm(d.corr - np.eye(5)))],
    **{f"olps_{k}": wealth(k) for k in ("eg", "pamr", "olmar", "rmr", "ftl")},
    "olps_bcrp": path(lambda x: np.cumprod(x @ extras.best_constant(x))),
    "olps_cwmr": path(extras.confidence_weighted),
    "olps_corn": path(extras.pattern_matching),
    "olps_scorn": path(lambda x: extras.pattern_matching(x, kind="symmetric")),
    "olps_fcorn": path(lambda x: extras.pattern_matching(x, kind="functional")),
    "cv_score": lambda d: list(enumerate(fold_scores(d, FEATURES))),
    "sfi": importance_of_one,
    "pca_importance": lambda d: list(evaluate.pca_importance(pooled(d)[FEATURES].corr().to_numpy(), len(pooled(d)), np.array([0.5, 0.3, 0.2])).items()),
    "seq_bootstrap": draws,
    "min_ffd": orders_of_difference,
    "symbol_vol_filter": renko,
    "matrix_flags": lambda d: [(s, t, v) for s, p in d.bars.groupby("symbol") for x in [p["close"].to_numpy()] for t, v in zip(p["t"].to_numpy()[30:], patterns.flag_scores(np.stack([x[k - 30 : k] for k in range(30, len(x))]), np.array(patterns.LEIGH_BULL)))],
    "fft_components": lambda d: [(s, *r) for s, p in d.bars.groupby("symbol") for r in zip(p["t"], *(patterns.low_frequencies(p["close"].to_numpy(), n) for n in (3, 6, 9, 100)))],
    "weighted_kde": lambda d: [(s, b, *(None if math.isnan(v) else v for v in patterns.density_quantiles(p["price"].to_numpy(), p["volume"].to_numpy(float), [0.1, 0.5, 0.9]))) for (s, b), p in d.ticks.assign(bar=d.ticks["us"] // 86400000000).groupby(["symbol", "bar"])],
    "gnpr_distance": lambda d: [(a, b, dependence.gnpr_distance(x[:, 0], x[:, 1], 0.5)) for i, a in enumerate(d.names) for b in d.names[i + 1 :] for x in [d.wide[[a, b]].dropna().to_numpy()]],
    "ot_dependence": lambda d: [(a, b, day, dependence.transport_dependence(p[a].to_numpy(), p[b].to_numpy(), "comonotonicity", rng()) if len(p) > 2 else None) for i, a in enumerate(d.names) for b in d.names[i + 1 :] for day, p in d.wide[[a, b]].dropna().groupby(lambda t: t // 86400)],
    "hcbm": lambda d: square(extras.block_correlation(12, 3)),
}

#: Columns that the expectation above holds, where it is not all of them.
SOME = {"bar_microstructure": (impacts, ["symbol", "tick_num", "tick_rule_entropy_shannon", "tick_rule_entropy_plug_in", "tick_rule_entropy_lempel_ziv", "tick_rule_entropy_konto"])}


def close(a, b):
    if a is None or b is None or isinstance(a, str):
        return a == b or (a is None and isinstance(b, float) and math.isnan(b)) or (b is None and isinstance(a, float) and math.isnan(a))
    return (math.isnan(a) and math.isnan(b)) or abs(float(a) - float(b)) <= 2e-3 * max(1.0, abs(float(a)))


def order(row):
    return [(x is None, "" if x is None else f"{float(x):020.2f}" if isinstance(x, (int, float, np.number)) else str(x)) for x in row]


@pytest.mark.parametrize("name", [*EXPECTED, *SOME])
def test_values(spark, data, name):
    kernel, columns = SOME.get(name, (EXPECTED.get(name), None))
    got = QUERIES[name](spark, DATA)
    got = sorted((tuple(r) for r in got.select(*columns or got.columns).collect()), key=order)
    want = sorted((tuple(r) for r in kernel(data)), key=order)
    assert len(got) == len(want) > 0
    wrong = [(a, b) for a, b in zip(got, want) if not all(close(x, y) for x, y in zip(a, b, strict=True))]
    assert not wrong, wrong[:3]


@pytest.fixture(scope="module")
def larger():
    return Frames(LARGER)


def test_date_stats(spark, larger):
    got = sorted((tuple(r) for r in QUERIES["bar_date_stats"](spark, LARGER).collect()), key=order)
    want = sorted(((s, t, *r) for s, t, *r in day_stats(larger)), key=order)
    names = QUERIES["bar_date_stats"](spark, LARGER).columns
    assert names[:2] == ["symbol", "date"] and len(got) == len(want) > 0
    assert all(close(x, y) for a, b in zip(got, want) for x, y in zip(a, b, strict=True))


def test_linear_factors_query(spark, data):
    """The hours' matrix is nearly singular, so the ascent's last digits differ: totals agree, and each column has its largest weight."""
    got = QUERIES["corex_linear"](spark, DATA).toPandas()
    m = factors.LinearFactors(data.hour, 4, SEED)
    assert len(got) == 24 and sorted(set(got["total_correlation"]), reverse=True)[0] == pytest.approx(m.found["tcs"][0], rel=0.1)
    assert np.mean(got["factor"].to_numpy() == m.clusters()) >= 0.75


def test_robust_covariance_query(spark, larger):
    data, x = larger, larger.wide.dropna()
    m = {(r["i"], r["j"]): r["cov"] for r in QUERIES["cov_mcd"](spark, LARGER).collect()}
    c = np.array([[m[a, b] for b in data.names] for a in data.names])
    assert np.allclose(c, c.T) and np.linalg.eigvalsh(c)[0] > 0
    assert np.trace(c) < np.trace(np.cov(x.to_numpy().T))  # heavy tails weigh less


def test_model_queries_of_random_parts(spark, data):
    _, rows = samples(data)
    trees = {r["feature"]: r["mean"] for r in QUERIES["mdi"](spark, DATA).collect()}
    assert sum(trees.values()) == pytest.approx(1) and set(trees) == set(FEATURES)
    lost = {r["feature"]: r["mean"] for r in QUERIES["mda"](spark, DATA).collect()}
    assert max(lost, key=lost.get) == max(((f, np.mean(fold_scores(data, [f]))) for f in FEATURES), key=lambda x: x[1])[0]
    z = (rows[FEATURES] - rows[FEATURES].mean()) / rows[FEATURES].std()
    parts = QUERIES["orthogonal_features"](spark, DATA).toPandas()
    assert np.allclose(parts[["pc_1", "pc_2", "pc_3"]].cov().to_numpy(), np.diag(np.sort(np.linalg.eigvalsh(z.cov()))[::-1]), atol=1e-6)
    bag = QUERIES["sb_bagging"](spark, DATA).toPandas()
    assert bag["estimator"].nunique() == 6 and (bag.groupby("estimator")["coefficient"].apply(lambda c: (c.abs() < 1e-12).sum()) == 1).all() and 0.4 < bag["oob_accuracy"].iloc[0] <= 1
    made = QUERIES["classification_data"](spark, DATA).toPandas()
    assert len(made) == 2000 and abs((made["R_0"] - made["I_0"]).std() - 0.1) < 0.01


def test_fingerprint_query(spark, data):
    rows = pooled(data)
    b = newton(rows[FEATURES].to_numpy(), rows["label"].to_numpy())
    model = lambda x: 1 / (1 + np.exp(-(b[0] + x @ b[1:])))
    got = {(r["effect"], r["feature"]): r["raw"] for r in QUERIES["fingerprint"](spark, DATA).collect()}
    for k, f in enumerate(FEATURES):
        grid, x = np.quantile(rows[f], np.linspace(0, 1, 20)), rows[FEATURES].to_numpy()
        mean = np.array([model(np.column_stack([x[:, :k], np.full(len(x), v), x[:, k + 1 :]])).mean() for v in grid])
        line = np.polyval(np.polyfit(grid, mean, 1), grid)
        assert got["linear", f] == pytest.approx(np.abs(line - mean.mean()).mean(), rel=1e-3) and got["non_linear", f] == pytest.approx(np.abs(line - mean).mean(), rel=1e-2, abs=1e-6)


def test_unions(spark, data):
    for name, members, column in (("clusterers", [f"{k}_clusters" for k in ("kmeans", "hierarchical", "dbscan", "spectral", "mean_shift", "affinity", "constrained")], "method"), ("vines", ["vine_d", "vine_c", "onion"], "method")):
        got = QUERIES[name](spark, DATA)
        for member, part in zip(members, ("kmeans", "hierarchical", "dbscan", "spectral", "mean_shift", "affinity", "constrained") if name == "clusterers" else ("d", "c", "onion")):
            rows = sorted((tuple(r) for r in got.where(got[column] == part).drop(column).collect()), key=order)
            want = sorted((tuple(r) for r in EXPECTED[member](data)), key=order)
            assert len(rows) == len(want) and all(close(x, y) for a, b in zip(rows, want) for x, y in zip(a, b))
    renko_rows = sorted((tuple(r) for r in QUERIES["renko_size"](spark, DATA).collect()), key=order)
    assert [r[2] for r in renko_rows] == pytest.approx([r[4] for r in sorted(renko(data), key=lambda r: order((r[0], r[1], r[4])))], rel=1e-2, abs=1e-5)
    kinds = QUERIES["bootstrap_mats"](spark, DATA).toPandas()
    pair = kinds[kinds["kind"] == "pair"].pivot(index="i", columns="j", values="value").to_numpy()
    assert set(kinds["kind"]) == {"row", "pair", "block"} and np.allclose(pair, pair.T) and np.allclose(np.diag(pair), 1)
    cells = {tuple(np.round(r, 6)) for r in data.hour}
    rows = kinds[kinds["kind"] == "row"].pivot(index="i", columns="j", values="value").to_numpy()
    assert {tuple(np.round(r, 6)) for r in rows} <= cells


def test_random_walk_query(spark):
    assert QUERIES["random_walk"](spark, DATA).count() == 1000


def test_every_query_has_sql_or_a_value_test():
    tested = {*EXPECTED, *SOME, "cov_mcd", "bar_date_stats", "corex_linear", "mdi", "mda", "orthogonal_features", "sb_bagging", "classification_data", "fingerprint", "random_walk", "clusterers", "vines", "renko_size", "bootstrap_mats"}
    assert set(QUERIES) - set(SQL) <= tested
