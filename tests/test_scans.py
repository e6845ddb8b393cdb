"""Walk-forward scans: rows over all cores, one kernel for all heads, sources read no more than once for scores."""

import numpy as np

from tempograph.operators import boosting, sums
from tempograph.plans import walk


def _rows(steps=7, rows=40):
    rng = np.random.default_rng(5)
    return [(t, t * 1000 + i, i % 3 - 1, [float(v) for v in rng.normal(size=3) + i % 3]) for t in range(1, steps + 1) for i in range(rows)]


def test_rows_of_one_file_are_dealt_over_all_cores(spark):
    x = spark.createDataFrame(_rows(rows=12_000), "tau int, txid long, label int, features array<double>").coalesce(1)
    sizes = sums.dealt(sums.pack(x)).rdd.mapPartitions(lambda p: [sum(len(r["txid"]) // 8 for r in p)]).collect()
    assert len(sizes) == spark.sparkContext.defaultParallelism and sum(sizes) == 84_000 and max(sizes) < 40_000


def test_scores_do_not_read_the_source_again(spark):
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    x = spark.createDataFrame(_rows(), "tau int, txid long, label int, features array<double>").mapInArrow(count, "tau int, txid long, label int, features array<double>")
    for head, options in (("lr", {}), ("mlp", {"epochs": 2})):
        before = read.value
        m = walk.step_metrics(walk.decide(walk.run(x, 3, [6, 7], head, **options)))
        assert m.count() == 2 and read.value - before == 280


def test_gradients_of_all_heads_at_once():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(1200, 3)) * [1, 50, 0.01] + [5, 1e4, 0], rng.integers(0, 2, 1200)
    w = rng.uniform(0.5, 2, (1200, 4)) * (rng.random((1200, 4)) < 0.7)
    mean, dev = rng.normal(size=(4, 3)) + [5, 1e4, 0], rng.uniform(0.5, 2, (4, 3)) * [1, 50, 0.01]
    p = [rng.normal(size=s) for s in ((4, 3, 6), (4, 6), (4, 6), (4,))]
    loss, *grads = walk.mlp_gradients(x, y, w, mean, dev, p)
    for k in range(4):
        use = w[:, k] > 0
        one, want = walk.mlp_gradient((x[use] - mean[k]) / dev[k], y[use], w[use, k], [v[k] for v in p])
        assert np.isclose(loss[k], one) and all(np.allclose(g[k], v, rtol=1e-8, atol=1e-8) for g, v in zip(grads, want))


def test_scans_leave_out_rows_that_no_model_trains_on(spark):
    packed = sums.pack(spark.createDataFrame(_rows(), "tau int, txid long, label int, features array<double>")).cache()
    plan = walk.plan(packed, 3, [6, 7], 0.25)
    got = [(t, c) for tau, _, label, _ in sums.unpacked(walk.trained(packed, plan).toArrow().to_batches()) for t, c in zip(tau.tolist(), label.tolist())]
    assert sorted(set(got)) == [(t, c) for t in range(1, 6) for c in (0, 1)] and len(got) == 5 * 26
    assert np.array_equal(walk.hess_weight(plan, walk.trained(packed, plan)), walk.hess_weight(plan, packed))


def test_nodes_by_decisions_looked_up():
    rng = np.random.default_rng(2)
    bins = rng.integers(0, 256, (3, 500))
    for depth in (1, 3, 4, 5):
        tree = boosting.growing(depth)
        for i in range((1 << depth) - 1):
            if not i or tree.feature[(i - 1) // 2] >= 0 and rng.random() < 0.8:  # some stop early
                tree.feature[i], tree.cut[i] = rng.integers(0, 3), rng.integers(0, 255)
        for level in range(depth + 1):
            assert np.array_equal(boosting.reach(tree, level, 3)(bins), tree.nodes(bins.T, level))


def test_boosted_rows_are_ordered_and_trained_on(spark):
    packed = sums.dealt(sums.pack(spark.createDataFrame(_rows(), "tau int, txid long, label int, features array<double>"))).cache()
    plan = walk.plan(packed, 3, [6, 7], 0.25)
    edges = [np.array([0.0, 1.0])] * 3
    parts = list(walk._binned_blocks(walk._binned(packed, plan, edges).toArrow().to_batches(), 3, 2))
    assert all((np.diff(tau) >= 0).all() and b.shape == (3, len(tau)) and not margin.any() for tau, _, b, margin in parts)
    assert sum(len(tau) for tau, *_ in parts) == 5 * 26
    assert [len(b.trees) for b in walk.fit_boosted(packed, plan, edges, trees=3, depth=2)] == [3, 3]
