import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tempograph.functions import names
from tempograph.operators import evaluate, graph, stats, temporal
from tempograph.plans import reports
from tempograph.plans.registry import ORACLES, QUERIES
from tempograph.sources import graph as g

SF = "/root/testdata/sf0.001"
TABLES = ("events", "embeddings", "documents", "labels", "orders", "lineitem")


def test_guards(spark):
    n = spark.createDataFrame([(1001, 1), (1002, 1), (2001, 2)], "txid long, tau int")
    ok = spark.createDataFrame([(1, 1001, 1002)], "tau int, src long, dst long")
    graph.check_edges(ok, n)
    with pytest.raises(graph.IntegrityError, match="orphan"):
        graph.check_edges(spark.createDataFrame([(1, 9999, 1001)], "tau int, src long, dst long"), n)
    with pytest.raises(graph.IntegrityError, match="temporal"):
        graph.check_edges(spark.createDataFrame([(1, 1001, 2001)], "tau int, src long, dst long"), n)


def test_blocks():
    assert temporal.blocks([1, 2, 5, 6, 7], 7) == ([1, 2, 5], 6)
    assert temporal.blocks(list(range(1, 50)), 10, 3) == ([7, 8], 9)
    assert temporal.blocks(list(range(1, 50)), 10, 3, gap=0) == ([7, 8, 9], None)
    with pytest.raises(ValueError):
        temporal.check_splits({1}, {1}, {2})


def test_lags_do_not_look_ahead(spark):
    rows = [(t, float(t), t / 10) for t in range(1, 9)]
    cols = "tau int, n double, rate double"
    one = {r["tau"]: r["features"] for r in temporal.lag_features(spark.createDataFrame(rows, cols), ["n", "rate"], 2, 5).collect()}
    late = [(t, 99.0, 9.0) if t >= 6 else (t, n, r) for t, n, r in rows]
    two = {r["tau"]: r["features"] for r in temporal.lag_features(spark.createDataFrame(late, cols), ["n", "rate"], 2, 5).collect()}
    assert all(one[t] == two[t] for t in range(1, 7)) and one[7] != two[7]


NAMES = [
    ("Ablation: Decay λ=0.125 on 2 T early PCA", ("SGC", "Ablation", 0.125, 2, True, "early", None, "PCA")),
    ("Ablation: Decay λ=0.75 on XGBoost", ("XGBoost", "Ablation", 0.75, None, None, None, None, None)),
    ("Ablation: Decay λ=1 on NoMP Grid: K=1, Dir=T, Topo=late", ("NoMP Grid", "Ablation", 1.0, 1, True, "late", None, None)),
    ("Ablation: Decay λ=0.3 on Grid: K = 2, Dir=F, Topo=None (Var PCA)", ("Grid", "Ablation", 0.3, 2, False, "None", None, "PCA")),
    ("Ablation: IPCA 1 F early", ("IPCA", "Ablation", None, 1, False, "early", None, None)),
    ("Baseline: RandomForest (165)", ("RandomForest", "Baseline", None, None, None, None, None, None)),
    ("Baseline: GCN, K=2", ("GCN", "Baseline", None, None, None, None, None, None)),
    ("WF Champion: Sweep 3: + MLP Head K=1 (Seed 7, Var PCA)", ("SGC+MLP", None, None, 1, None, None, 7, "PCA")),
    ("Sweep 4: SGC, Dir=T, Topo=late", ("SGC", None, None, None, None, "late", None, None)),
    ("Grid: K=1, Dir=F, Topo=None (Seed 44, Var Base)", (None, "Grid", None, 1, False, "None", 44, "Base")),
    ("Best WF: NoMP Grid: K=2, Dir=T, Topo=early", (None, "NoMP Grid", None, 2, True, "early", None, None)),
    ("Ensemble: RF(0.5) + 1 F None Base(0.5)", ("Ensemble", "Ensemble", None, None, None, None, None, None)),
    ("something else", (None,) * 8),
]


def test_names(spark):
    df = spark.createDataFrame([(i, n) for i, (n, _) in enumerate(NAMES)], "i int, name string")
    got = {r["i"]: tuple(r["p"]) for r in df.select("i", names.parse_name(F.col("name")).alias("p")).collect()}
    for i, (_, want) in enumerate(NAMES):
        assert got[i] == want
    one = spark.range(1)
    say = lambda c: one.select(c.alias("c")).first()["c"]
    assert say(names.config_id(F.lit("Grid: K=1, Dir=F, Topo=late (Var PCA) again"))) == "Grid: K=1, Dir=F, Topo=late again"
    assert say(names.config_id(F.lit("Baseline: GCN (165)"))) == "Baseline: GCN (165)"
    assert say(names.without_seed(F.lit("Grid: K=1 (Seed 3, Var PCA)"))) == "Grid: K=1" and say(names.without_seed(F.lit("x (Var PCA)"))) == "x (Var PCA)"
    full = names.canonical_grid(F.lit("Grid: K=2, Dir=T, Topo=late (Seed 5, Var PCA)"), F.lit("Base"))
    assert say(full) == "Grid: K=2, Dir=T, Topo=late (Var PCA)" and say(names.canonical_grid(F.lit("Grid: K=2"), F.lit(None))) == "Grid: K=2 (Var Base)"
    assert tuple(say(names.grid_target(full))) == ("Grid: K=2, Dir=T, Topo=late", 2, True, "late", "PCA") and say(names.grid_target(F.lit("Grid: K=2 (Var Base)"))) is None
    assert say(names.safe_name(F.lit("λ=0.5 é-_x"))) == "λ_0_5_é-_x"


def test_calibration(spark):
    rows = [(1, i, 1 if i < 3 else 0, i / 99) for i in range(100)]
    df = spark.createDataFrame(rows, "tau int, txid long, label int, score double")
    r = evaluate.calibrated_threshold(df, ["tau"]).first()
    assert r["fallback"] and math.isclose(r["threshold"], 0.97)
    assert not evaluate.calibrated_threshold(df, ["tau"], epsilon=3).first()["fallback"]


def test_assignment():
    import numpy as np

    rng = np.random.default_rng(0)
    c = rng.random((5, 5))
    import itertools

    assert math.isclose(stats.assignment_cost(c), min(sum(c[i, p[i]] for i in range(5)) for p in itertools.permutations(range(5))))


@pytest.mark.parametrize("name", ["snapshot_topology", "degree_in_out", "homophily_by_step", "pagerank_fixed20", "clustering_coeff", "average_precision_by_step", "calibrated_threshold", "champion_topn_union", "parse_names", "topo_early", "topo_late", "drift_rank", "drift_alarm", "regime_metrics_full", "class_weights_walk_forward", "onestep_state_sets", "fallback_lookup", "separability_verdict"])
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = c.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert cols == sorted(got.columns)

    def rows(df):
        return sorted(tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in r) for r in df[cols].itertuples(index=False))

    assert rows(want) == rows(got)


def _cloud(spark, n=200, width=3):
    import numpy as np

    v = np.random.default_rng(5).normal(size=(n, width))
    side = np.arange(n) % 3 // 2  # sides of different sizes
    v[side == 1] += 0.2
    df = spark.createDataFrame([(i, 1, int(side[i]), [float(x) for x in v[i]]) for i in range(n)], "vec_id long, label int, side int, v array<double>")
    return v, side, df


def test_points_are_whole(spark):
    import pyarrow.parquet as pq

    from tempograph.plans.registry import _points

    n = pq.read_metadata("/root/testdata/sf0.1/embeddings.parquet").num_rows
    assert _points(spark, "/root/testdata/sf0.1").count() == n


def test_block_pairs_against_brute_force(spark):
    import numpy as np

    v, side, df = _cloud(spark)
    d = ((v[:, None] - v[None]) ** 2).sum(2)
    up = np.triu_indices(len(v), 1)
    got = {(r["a"], r["b"]): r["d2"] for r in stats.pairs_within(df, "label", rows=32).collect()}
    assert sorted(got) == sorted(zip(*(x.tolist() for x in up))) and all(math.isclose(x, d[k], rel_tol=1e-9) for k, x in got.items())
    assert math.isclose(stats.median_distance(df, "label", rows=32).first()["sigma"], np.median(np.sqrt(d[up])), rel_tol=1e-9)
    x, y = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    k = np.exp(-0.3 * d) - np.eye(len(v))

    def mmd(x, y):
        m, n = len(x), len(y)
        return k[np.ix_(x, x)].sum() / (m * (m - 1)) + k[np.ix_(y, y)].sum() / (n * (n - 1)) - 2 * k[np.ix_(x, y)].mean()

    assert math.isclose(stats.mmd2(df, "label", 0.3, rows=32).first()["mmd2"], mmd(x, y), rel_tol=1e-9)
    r = stats.permutation_test(df, "label", 0.3, n_perm=50, rows=32).first()
    rng, order = np.random.default_rng([0, 1]), np.r_[x, y]
    ge = 0
    for _ in range(50):
        s = rng.permutation(side[order])
        ge += mmd(order[s == 0], order[s == 1]) >= mmd(x, y)
    assert math.isclose(r["mmd2"], mmd(x, y), rel_tol=1e-9) and r["p"] == (ge + 1) / 51
    np.fill_diagonal(d, np.inf)
    two = np.sqrt(np.sort(d, axis=1)[:, :2])
    mu = np.sort(np.log(two[:, 1] / two[:, 0]))
    at = np.arange(1, len(mu) + 1)
    mu, q = mu[at <= 0.9 * len(mu)], -np.log(1 - at / len(mu) + 1e-10)[at <= 0.9 * len(mu)]
    assert math.isclose(stats.two_nn(df, "label", rows=32).first()["dimension"], (mu * q).sum() / (mu * mu).sum(), rel_tol=1e-6)


def test_walk_forward_takes_every_step(spark):
    x = QUERIES["lr_walk_forward_decay"](spark, SF).cache()
    want = {(r["tau"], r["txid"]) for r in g.nodes(spark, SF).filter("tau >= 35 and label <> -1").collect()}
    got = x.collect()
    assert {(r["tau"], r["txid"]) for r in got} == want and len(got) == len(want)
    assert all(r["predicted"] == int(r["score"] >= r["threshold"]) for r in got)
    assert len({(r["tau"], r["threshold"]) for r in got}) == len({r["tau"] for r in got})
    assert any(r["threshold"] != 0.5 for r in got)


def test_transport_of_unequal_sides(spark):
    import numpy as np

    rng = np.random.default_rng(8)
    for m, n in ((1, 4), (4, 6), (5, 3), (7, 9)):
        c = rng.random((m, n))
        k = m * n // math.gcd(m, n)
        whole = np.repeat(np.repeat(c, k // m, 0), k // n, 1)  # equal weights as copies
        assert math.isclose(stats.transport_cost(c), stats.assignment_cost(whole) / k, rel_tol=1e-9)
    v, side, df = _cloud(spark, 60, 1)
    x, y = np.sort(v[side == 0, 0]), np.sort(v[side == 1, 0])
    want = np.abs(np.repeat(x, len(y)) - np.repeat(y, len(x))).mean()
    assert len(x) != len(y)
    assert math.isclose(stats.wasserstein_1d(df.withColumn("x", F.col("v")[0]), "label", "x").first()["wasserstein"], want, rel_tol=1e-9)
    assert math.isclose(stats.wasserstein_nd(df, "label").first()["wasserstein"], want, rel_tol=1e-6)


def test_moments_hold_the_covariance(spark):
    import numpy as np

    v = np.random.default_rng(2).normal(size=(40, 4))
    df = spark.createDataFrame([(1 + i // 10, [float(x) for x in v[i]]) for i in range(40)], "tau int, features array<double>")
    for r in stats.incremental_moments(df, 4, cross=True).collect():
        x = v[: 10 * r["tau"]]
        got = [[r[f"q{i}"] if i == j else r[f"p{min(i, j)}_{max(i, j)}"] for j in range(4)] for i in range(4)]
        assert r["n"] == len(x) and np.allclose(got, x.T @ x, atol=1e-4) and np.allclose([r[f"s{i}"] for i in range(4)], x.sum(0), atol=1e-4)


def test_injection_and_leak_guard(spark):
    x = spark.createDataFrame([(1, 1, [2.0]), (1, 2, [4.0])], "tau int, txid long, features array<double>")
    s = spark.createDataFrame([(1, r, c, 0.5) for r in (1, 2) for c in (1, 2)], "tau int, r long, c long, w double")
    topo = spark.createDataFrame([(1, 1, [10.0])], "tau int, txid long, topo array<double>")
    got = lambda mode: {r["txid"]: r["features"] for r in graph.inject_topology(s, x, topo, mode, 1, 1, 1).collect()}
    assert got("early") == {1: [3.0, 5.0], 2: [3.0, 5.0]} and got("late") == {1: [3.0, 10.0], 2: [3.0, 0.0]} and got("none") == {1: [3.0], 2: [3.0]}
    assert graph.feature_columns(["txid", "ts", "a", "Tau", "b"]) == ["a", "b"]
    with pytest.raises(graph.LeakError):
        graph.check_features(["a", "ts"])


def test_every_report_has_a_twin():
    made = [n for n, f in QUERIES.items() if f.__module__ == reports.__name__]
    assert len(made) > 25 and set(made) <= set(ORACLES)


def test_robust_z_without_spread(spark):
    z = stats.robust_z(spark.createDataFrame([(1, 2.0), (2, 2.0), (3, 2.0)], "tau int, v double"), "v").collect()
    assert all(r["z"] == math.inf for r in z)
