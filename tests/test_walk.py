"""Walk-forward fits of all steps at once, against MLlib and NumPy."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tempograph.operators import sums, temporal
from tempograph.plans import walk


def _rows(seed=3, steps=9):
    rng = np.random.default_rng(seed)
    out = []
    for tau in range(1, steps + 1):
        if tau == 4:  # a gap
            continue
        for i in range(60):
            v = rng.normal(size=3) * [1, 5, 0.1] + [0, 3, tau]
            y = int(rng.random() < 1 / (1 + np.exp(-(v[0] - 1 + 0.2 * (v[1] - 3)))))
            out.append((tau, tau * 1000 + i, -1 if i % 5 == 0 else y, [float(c) for c in v] + [2.0]))
    return out


@pytest.fixture(scope="module")
def x(spark):
    return spark.createDataFrame(_rows(), "tau int, txid long, label int, features array<double>").repartition(2).cache()


@pytest.mark.parametrize("window", [None, 4])
def test_coefficients_against_mllib(x, window):
    steps = [6, 9]
    packed = sums.pack(x).cache()
    plan = walk.plan(packed, 4, steps, 0.25, window)
    assert plan.models == steps and plan.calibrate == [5, 8]
    got = walk.fit_logistic(packed, plan, reg=1e-3)
    for k, tau in enumerate(steps):
        train, _ = temporal.blocks([1, 2, 3, 5, 6, 7, 8, 9], tau, window)
        t = temporal.decay_weights(x.filter(F.col("tau").isin(train)), 0.25, ("features",)).withColumn("vec", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
        m = LogisticRegression(featuresCol="vec", weightCol="weight", maxIter=200, tol=1e-9, regParam=1e-3).fit(t)
        assert np.allclose(got[k], [m.intercept, *m.coefficients], atol=1e-4)


def test_scores_thresholds_and_metrics(spark, x):
    p = walk.run(x, 4, [1, 2, 3, 4, 5, 6, 9]).cache()
    assert {(r["tau"], r["step"]) for r in p.select("tau", "step").distinct().collect()} == {(3, 2), (3, 3), (5, 5), (6, 5), (6, 6), (9, 8), (9, 9)}  # 1 and 2 have no block, 4 no rows
    d = walk.decide(p)
    by = {r["tau"]: r for r in d.groupBy("tau").agg(F.max("threshold").alias("t"), F.max("fallback").alias("f"), F.count("*").alias("n")).collect()}
    assert by[5]["t"] == 0.5 and by[5]["f"] and not by[9]["f"] and all(r["n"] == 48 for r in by.values())
    got = {r["tau"]: r for r in walk.step_metrics(d).collect()}
    rows = d.toPandas()
    for tau, r in got.items():
        own = rows[rows["tau"] == tau]
        hit, y = own["score"].to_numpy() >= own["threshold"].iloc[0], own["label"].to_numpy() == 1
        assert (r["tp"], r["fp"], r["fn"], r["n_pos"]) == ((hit & y).sum(), (hit & ~y).sum(), (~hit & y).sum(), y.sum())
        order = np.argsort(-own["score"].to_numpy())
        prec = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        assert np.isclose(r["ap"], prec[y[order]].mean())
    late = x.withColumn("features", F.when(F.col("tau") >= 7, F.transform("features", lambda v: v * 9)).otherwise(F.col("features")))
    pick = lambda q: sorted((r["txid"], round(r["score"], 9)) for r in q.filter("tau = 6").collect())
    assert pick(walk.run(late, 4, [6])) == pick(p)  # later steps do not matter
    both = walk.blend(p, p.withColumn("score", F.lit(1.0)), 0.25)
    assert both.count() == p.count() and np.isclose(both.agg(F.avg("score")).first()[0], 0.75 * p.agg(F.avg("score")).first()[0] + 0.25)


def test_guards(spark, x):
    one = x.withColumn("label", F.when(F.col("tau") < 7, F.lit(0)).otherwise(F.col("label")))
    assert walk.plan(sums.pack(one), 4, [6, 7, 8, 9]).models == [9]  # blocks of one class are left out
    some = walk.decide(walk.run(x.withColumn("label", F.when(F.col("tau") == 9, F.lit(0)).otherwise(F.col("label"))), 4, [8, 9]))
    assert some.filter("tau = 9").count() == 60 and [r["tau"] for r in walk.step_metrics(some).collect()] == [8]  # scored, but without metrics
    assert walk.run(x.limit(0), 4, [5]).collect() == [] and walk.run(one, 4, [6]).collect() == []


def test_head_gradient_by_numpy():
    rng = np.random.default_rng(0)
    z, y, w = rng.normal(size=(30, 3)), rng.integers(0, 2, 30), rng.uniform(0.5, 2, 30)
    p = [rng.normal(size=(3, 5)), rng.normal(size=5), rng.normal(size=5), np.array(0.3)]
    loss, grads = walk.mlp_gradient(z, y, w, p)
    for i, g in enumerate(grads):
        for at in np.ndindex(p[i].shape):
            q = [v.copy() for v in p]
            q[i][at] += 1e-6
            assert np.isclose((walk.mlp_gradient(z, y, w, q)[0] - loss) / 1e-6, g[at], atol=1e-3)


def test_head_fit(spark, x):
    packed = sums.pack(x).cache()
    plan = walk.plan(packed, 4, [6, 9], 0.0)
    params, losses = walk.fit_mlp(packed, plan, hidden=6, epochs=30)
    assert all((losses[0] > losses[-1]).tolist())
    # The same updates over all rows of one model in memory.
    rows = [r for r in _rows() if r[0] <= 7 and r[2] >= 0]
    f = np.array([r[3] for r in _rows() if r[0] <= 7])
    z, y = (np.array([r[3] for r in rows]) - f.mean(0)) / np.where(f.std(0) > 0, f.std(0), 1), np.array([r[2] for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    own, _ = walk.fit_mlp(packed, plan, hidden=6, epochs=0)
    own = [v[1] for v in own]
    loss, grads = walk.mlp_gradient(z, y, w, own)
    assert np.isclose(loss / w.sum(), losses[0][1])
    sparse, _ = walk.fit_mlp(packed, plan, hidden=6, epochs=30, l1=0.5)
    assert (sparse[0] == 0).sum() > (params[0] == 0).sum()


def test_static(x):
    p = walk.static(x, 4, 5, [7, 8, 9])
    plan = walk.plan(sums.pack(x), 4, [7, 8, 9], 0.0, train_end=5)
    assert plan.models == [0] and (plan.weight[0, np.searchsorted(plan.steps, [7, 8, 9])] == 0).all()
    assert {r["tau"] for r in p.select("tau").distinct().collect()} == {7, 8, 9} and p.filter("label = -1").count() == 0


def test_boosted_trees_of_all_steps_equal_single_fits(x):
    from tempograph.operators import boosting

    packed = sums.pack(x).cache()
    plan = walk.plan(packed, 4, [6, 9], 0.25)
    rows = _rows()
    f = np.array([r[3] for r in rows if r[0] <= 4])
    edges = boosting.edges_of(f, 16)
    got = walk.fit_boosted(packed, plan, edges, trees=4, depth=3, eta=0.3)
    for k, last in enumerate((4, 7)):
        own = [r for r in rows if r[0] <= last and r[2] >= 0]
        b = got[k].bins(np.array([r[3] for r in own]))
        y = np.array([r[2] for r in own], float)
        w = plan.weight[k, np.searchsorted(plan.steps, [r[0] for r in own]), y.astype(int)]
        m = np.zeros(len(y))
        assert len(got[k].trees) == 4
        for tree in got[k].trees:
            p = boosting.sigmoid(m)
            bins = max(len(e) + 1 for e in edges)
            want = boosting.grow(lambda t, level, p=p: boosting.histogram(b, boosting.level_nodes(t, b, level), 1 << level, w * (p - y), w * p * (1 - p), bins), 3, 0.3)
            assert (tree.feature == want.feature).all() and (tree.cut == want.cut).all() and np.allclose(tree.value, want.value)
            m += tree.value[tree.nodes(b)]
    out = walk.run(x, 4, [6, 9], "gbt", trees=3, depth=2)
    assert {r["tau"] for r in out.select("tau").distinct().collect()} == {6, 9}


def test_edges_leave_out_odd_values(spark):
    d = spark.createDataFrame([([float(i % 7), 1.0, float("nan") if i % 2 else None],) for i in range(70)], "features array<double>")
    e = walk.feature_edges(d, 3, 8)
    assert len(e[0]) <= 7 and len(e[1]) <= 1 and len(e[2]) == 0
