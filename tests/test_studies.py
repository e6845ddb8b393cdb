"""Lag matrices, snapshot planes, the drift table, names and triangles against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempograph.functions import names
from tempograph.operators import draws, graph, stats, sums, temporal


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    rows = [(t, t * 100 + i, int(rng.integers(-1, 2)), [float(v) for v in rng.normal(size=4) @ np.diag([3, 2, 1, 0.5]) + t]) for t in (1, 2, 3, 5, 6) for i in range(12 + t)]
    return rows, spark.createDataFrame(rows, "tau int, txid long, label int, features array<double>").repartition(3).cache()


def test_lag_matrix(spark, table):
    rows, x = table
    n = x.select("tau", "txid", "label")
    e = spark.createDataFrame([(t, t * 100, t * 100 + k) for t in (1, 2, 5) for k in range(1, 1 + t)], "tau int, src long, dst long")
    steps = temporal.snapshot_figures(n, e, x, 4)
    window, label_lag = 3, 1
    got = {r["tau"]: r["features"] for r in temporal.lag_matrix(steps, 4, window, 3, label_lag).collect()}
    fig = {}
    for t in (1, 2, 3, 5, 6):
        f = np.array([r[3] for r in rows if r[0] == t])
        y = [r[2] for r in rows if r[0] == t and r[2] >= 0]
        k = {1: 1, 2: 2, 5: 5}.get(t, 0)
        fig[t] = np.mean(y), [len(f), k, 2 * k / len(f), 0.0], [*f.mean(0), *f.std(0)]
    train = [fig[t] for t in (1, 2, 3)]
    rate, head, rest = np.mean([f[0] for f in train]), np.mean([f[1] for f in train], axis=0), np.mean([f[2] for f in train], axis=0)
    for t, own in got.items():
        lags = [[fig[s - label_lag][0] if s - label_lag in fig else rate, *(fig[s][1] if s in fig else head), float(s in fig), *(fig[s][2] if s in fig else rest)] for s in range(t - window, t)]
        diffs = [np.subtract(b, a) if a[5] and b[5] else np.zeros(14) for a, b in zip(lags, lags[1:])]
        want = np.concatenate([np.ravel(lags), *(np.delete(d, 5) for d in diffs)])
        assert len(own) == 14 * window + 13 * (window - 1) and np.allclose(own, want)
    assert temporal.lag_matrix(steps, 4, 0, 3).collect() == [] and len(temporal.lag_matrix(steps, 4, 1, 3).first()["features"]) == 14
    with pytest.raises(ValueError):
        temporal.lag_matrix(steps, 4, 2, 3, -1)


def test_planes_by_svd(table):
    rows, x = table
    packed = sums.pack(x)
    steps = sums.step_covariances(packed)
    got = {r["txid"]: r["features"] for r in sums.projected(packed, {t: sums.basis(c, 2) for t, c in steps.items() if t != 3}).collect()}
    assert len(got) == sum(r[0] != 3 for r in rows)
    for t in (1, 2, 5, 6):
        ids, f = [r[1] for r in rows if r[0] == t], np.array([r[3] for r in rows if r[0] == t])
        v = np.linalg.svd(f - f.mean(0), full_matrices=False)[2][:2]
        v *= np.where(v[range(2), np.abs(v).argmax(1)] < 0, -1, 1)[:, None]
        assert np.allclose([got[i] for i in ids], (f - f.mean(0)) @ v.T)
    n, mean, s = sums.merged(list(steps.values()))
    f = np.array([r[3] for r in rows])
    assert n == len(f) and np.allclose(mean, f.mean(0)) and np.allclose(s / n, np.cov(f.T, bias=True))
    assert sums.projected(packed, {}).collect() == []


def test_drift_table(table):
    _, x = table
    low = x.withColumn("features", F.slice("features", 1, 2))
    got = {r["tau"]: r for r in draws.drift_table(x, low, most=6).collect()}
    assert sorted(got) == [2, 3, 5, 6]
    rows = {r["txid"]: r for r in x.collect()}
    pick = {t: [r["txid"] for r in draws.draws(x, ["tau"], "txid", 6, 1).filter(F.col("tau") == t).collect()] for t in (1, 2, 3, 5, 6)}
    for t, before in ((2, 1), (3, 2), (5, 3), (6, 5)):
        a, b = (np.array([rows[i]["features"] for i in pick[s]]) for s in (before, t))
        z = np.vstack([a, b])
        d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
        k = np.exp(-(d**2) / (2 * np.median(d[np.triu_indices(12, 1)]) ** 2)) - np.eye(12)
        assert np.isclose(got[t]["mmd2"], k[:6, :6].sum() / 30 + k[6:, 6:].sum() / 30 - 2 * k[:6, 6:].mean())
        c = np.sqrt(((a[:, None, :2] - b[None, :, :2]) ** 2).sum(2))
        assert np.isclose(got[t]["wasserstein"], min(sum(c[i, p[i]] for i in range(6)) for p in itertools.permutations(range(6))) / 6)
    assert draws.drift_table(x.filter("tau = 1"), low).collect() == []


def test_split_names_and_members(spark):
    rows = ["Grid: K=3, Dir=T, Topo=late", "MLP-Deep [K=2, Dir=F, Topo=early]", "MLP-Small [K=2]", "Baseline: GCN", "", "Grid: K=x"]
    d = spark.createDataFrame([(i, n) for i, n in enumerate(rows)], "i int, n string")
    got = [tuple(r["s"]) for r in d.orderBy("i").select(names.split_name(F.col("n")).alias("s")).collect()]
    assert got == [("Linear", 3, "T", "late"), ("Deep", 2, "F", "early"), ("Small", 2, "F", "None"), ("Linear", 1, "F", "None"), ("Linear", 1, "F", "None"), ("Linear", 1, "F", "None")]
    s = spark.createDataFrame([("42",), ("x",), (None,), ("44 ",), ("43",)], "s string")
    assert [r[0] for r in s.select(names.safe_member(F.col("s"), [42, 44])).collect()] == [True, False, False, True, False]


def test_triangles_with_a_hub(spark):
    edges = [(1, 0, i) for i in range(1, 200)] + [(1, 1, 2), (1, 2, 3), (1, 2, 1)]
    e = spark.createDataFrame(edges, "tau int, src long, dst long")
    n = spark.createDataFrame([(1, i) for i in range(200)], "tau int, txid long")
    got = {r["txid"]: r["clustering"] for r in graph.clustering(n, e).collect()}
    assert np.isclose(got[0], 2 * 2 / (199 * 198)) and got[1] == 1.0 and np.isclose(got[2], 2 * 2 / (3 * 2)) and got[50] == 0
    u = e.selectExpr("tau", "least(src, dst) as u", "greatest(src, dst) as v").distinct()
    deg = u.selectExpr("tau", "explode(array(u, v)) as txid").groupBy("tau", "txid").agg(F.count("*").alias("d"))
    assert graph.wedges(graph.oriented(u, deg)).count() == 2  # of 19,701 around the hub


def test_spread_keeps_rows(spark):
    d = spark.range(100).withColumn("k", F.col("id") % 7)
    assert stats.spread(d, "k").groupBy("k").count().count() == 7
