"""Boosted trees against brute force."""

import numpy as np

from tempograph.operators import boosting


def test_split_gains_by_brute_force():
    rng = np.random.default_rng(3)
    b = rng.integers(0, 9, size=(400, 5)).astype(np.uint8)
    g, h, node = rng.normal(size=400), rng.uniform(0.05, 0.25, 400), rng.integers(-1, 4, 400)
    hist = boosting.histogram(b, node, 4, g, h, 9)
    feature, cut, gain = boosting.split(hist, lam=1.0, least=0.5)
    for k in range(4):
        rows, best = node == k, (0.0, -1, -1)
        for f in range(5):
            for c in range(8):
                left, right = rows & (b[:, f] <= c), rows & (b[:, f] > c)
                if h[left].sum() >= 0.5 and h[right].sum() >= 0.5:
                    part = [g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, right, rows)]
                    best = max(best, ((part[0] + part[1] - part[2]) / 2, -f, -c))
        assert abs(best[0] - gain[k]) < 1e-9 and (feature[k], cut[k]) == (-best[1], -best[2])


def test_fit_learns_an_interaction():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0.3)).astype(float)
    m = boosting.fit(x[:2000], y[:2000], trees=40, depth=3)
    assert (((m.score(x[2000:]) > 0.5) == (y[2000:] > 0.5)).mean()) > 0.95
    loss = [np.mean(np.log1p(np.exp(-(2 * y[:2000] - 1) * boosting.Booster(m.edges, m.base, m.trees[:k]).margin(m.bins(x[:2000]))))) for k in range(0, 41, 10)]
    assert all(a > b for a, b in zip(loss, loss[1:]))


def test_odd_input():
    for x, y in ((np.zeros((0, 3)), np.zeros(0)), (np.ones((5, 3)), np.ones(5)), (np.ones((4, 2)), np.array([0.0, 1, 0, 1]))):
        m = boosting.fit(x, y)
        assert np.isfinite(m.score(np.array([[np.nan] * x.shape[1]]))).all()
