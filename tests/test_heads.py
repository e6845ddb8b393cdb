import numpy as np
from pyspark.sql import functions as F

from tempograph.operators import anomaly, stats
from tempograph.plans import models, walk


def _brute_path(tree, row):
    at, steps = 0, 0
    while tree["feature"][at] >= 0:
        at = tree["left"][at] + int(row[tree["feature"][at]] >= tree["cut"][at])
        steps += 1
    return steps, tree["leaf"][at]


def test_paths_of_a_tree():
    x = np.random.default_rng(1).normal(size=(64, 3))
    t = anomaly.grow_tree(x, np.random.default_rng(2))
    assert len(t["feature"]) < anomaly.MAX_NODES
    for row, length in zip(x, anomaly.path_lengths(t, x)):
        steps, leaf = _brute_path(t, row)
        assert length == leaf and steps <= 6 and leaf >= steps
    same = anomaly.grow_tree(np.ones((8, 2)), np.random.default_rng(0))  # equal rows cannot be split
    assert len(same["feature"]) == 1 and np.isclose(same["leaf"][0], anomaly.mean_path(np.array(8)))
    assert list(anomaly.mean_path(np.array([0, 1, 2]))) == [0, 0, 1]


def _steps(spark, far=6.0):
    rng = np.random.default_rng(4)
    rows = []
    for tau in range(1, 7):
        for i in range(40):
            odd = i == 0
            rows.append((tau, tau * 100 + i, int(odd), [float(v) for v in rng.normal(size=2) + far * odd]))
    return spark.createDataFrame(rows, "tau int, txid long, label int, features array<double>")


def test_forest_walk_forward(spark):
    x = _steps(spark)
    got = anomaly.forest_walk_forward(x, [1, 5, 6]).cache()
    best = {t: max((r["score"], r["txid"]) for r in got.collect() if r["tau"] == t) for t in (5, 6)}
    assert best[5][1] == 500 and best[6][1] == 600 and got.count() == 120
    assert {r["score"] for r in got.filter("tau = 1").collect()} == {0.5}  # no step before it
    moved = x.withColumn("features", F.when(F.col("tau") == 6, F.transform("features", lambda v: v + 50)).otherwise(F.col("features")))
    pick = lambda d: sorted((r["txid"], r["score"]) for r in d.collect() if r["tau"] == 5)
    assert pick(anomaly.forest_walk_forward(moved, [1, 5, 6])) == pick(got)  # later steps do not matter
    rates = spark.createDataFrame([(5, 1 / 40)], "tau int, rate double")
    flagged = anomaly.flag_by_prevalence(got.filter("tau = 5"), rates).filter("predicted = 1").collect()
    assert [r["txid"] for r in flagged] == [500]


def test_expanding_bases(spark):
    x = _steps(spark)
    rows = [(r["tau"], r["features"]) for r in x.collect()]
    for tau, (mean, parts) in models.expanding_bases(x, 2, 1).items():
        m = np.array([f for t, f in rows if t <= tau])
        first = np.linalg.svd(m - m.mean(0), full_matrices=False)[2][0]
        assert np.allclose(mean, m.mean(0)) and np.isclose(abs(parts[0] @ first), 1)


def test_walk_forward_on_moving_bases_and_context(spark):
    x = _steps(spark)
    p = models.ipca_walk_forward(x, "lr", 2, 1, [5, 6], list(range(1, 7)))
    assert p.groupBy("tau").count().orderBy("tau").collect() == [(5, 40), (6, 40)]
    m = {r["tau"]: r for r in walk.step_metrics(p).collect()}
    for tau, r in m.items():
        assert r["n"] == 40 and r["tp"] + r["fn"] == 1 and np.isclose(r["f1"], 2 * r["tp"] / (2 * r["tp"] + r["fp"] + r["fn"]))
    c = models.with_context(x, spark.createDataFrame([(1, 9.0)], "tau int, h double"), ["h"])
    assert {r["features"][2] for r in c.filter("tau = 1").collect()} == {9.0} and {r["features"][2] for r in c.filter("tau = 2").collect()} == {0.0}


def test_moving_bases_share_their_scans(spark, monkeypatch):
    x, steps, all_ = _steps(spark, 1.0), [4, 5, 6], list(range(1, 7))
    z = stats.zscore(x, 2, F.col("tau") <= models.TRAIN_END)
    bases = models.expanding_bases(z, 2, 1)
    single = models.walk_forward_scores(z, "lr", 1, steps, all_, prepare=lambda tau, rows: (stats.pca_project(rows, *bases[tau - 1]), 1))
    want = {(r["tau"], r["txid"]): r for r in single.collect()}

    def fit(*_):
        raise AssertionError("a fit for each step")

    monkeypatch.setattr(models, "_score", fit)
    got = {(r["tau"], r["txid"]): r for r in models.ipca_walk_forward(x, "lr", 2, 1, steps, all_).collect()}
    assert got.keys() == want.keys() and len(got) == 120
    for k, r in got.items():
        assert np.isclose(r["score"], want[k]["score"], atol=1e-4) and np.isclose(r["threshold"], want[k]["threshold"], atol=1e-4)
        assert (r["predicted"], r["fallback"], r["label"]) == (want[k]["predicted"], want[k]["fallback"], want[k]["label"])
