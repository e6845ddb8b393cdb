"""Personal data: trees and thresholds read every example, and agree with a fit in memory."""

import numpy as np

from tempograph.llm import personal_data
from tempograph.operators import boosting


def _rows(spark, n, parts):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 40, (n, personal_data.N_FEATURES))
    y = (x[:, 0] + x[:, 1] > 40).astype(int)
    held = np.arange(n) % 3 == 0
    batch = lambda at: personal_data._packed(np.zeros(len(at)), y[at], np.ones(len(at)), held[at], x[at], np.zeros(len(at)))
    frames = [tuple(bytes(c[0].as_py()) for c in batch(at).columns) for at in np.array_split(np.arange(n), parts)]
    return spark.createDataFrame(frames, personal_data._PACKED).repartition(parts), x, y, held


def test_fit_reads_every_example(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "TREES", 3)
    n = 3 * 4000 + 500  # more of a label than the bound that once cut them
    edges = [[np.arange(40.0)] * personal_data.N_FEATURES for _ in personal_data.KINDS]
    weight = np.ones((4, 3))
    rows, x, y, held = _rows(spark, n, 3)
    models, last = personal_data.fit_trees(rows, weight, edges)
    again = personal_data.fit_trees(_rows(spark, n, 5)[0], weight, edges)[0]
    one = boosting.Booster(edges[0], models[0].base)
    m = np.full((~held).sum(), one.base)
    assert np.isclose(one.base, np.log(y[~held].mean() / (1 - y[~held].mean())))
    b = x[~held].astype(np.uint8)
    for tree, other in zip(models[0].trees, again[0].trees, strict=True):
        p = boosting.sigmoid(m)
        want = boosting.grow(lambda t, level: boosting.histogram(b, boosting.level_nodes(t, b, level), 1 << level, p - y[~held], p * (1 - p)), personal_data.DEPTH, personal_data.ETA)  # noqa: B023
        assert (tree.feature == want.feature).all() and np.allclose(tree.value, want.value, atol=1e-5)
        assert (tree.value == other.value).all()  # however the rows lie
        m += tree.value[tree.nodes(b)]
    assert len(models[0].trees) == 3 and not models[1].trees
    least = personal_data.thresholds(last, models)
    score, right = models[0].score(x[held].astype(float)), y[held]
    good = [s for s in np.unique(score) if right[score >= s].mean() >= personal_data.PRECISION]
    assert np.isclose(least[0], max(personal_data.LEAST_SCORE, min(good))) if good else least[0] == 2.0
    assert least[1] == 2.0
