"""Walk-forward evaluation with one scan an iteration for the models of all steps.

The model of step tau trains on the steps up to tau - 2, its threshold is
calibrated on tau - 1 and it scores tau. A row's weight in a model depends on
its step and label only, so one table of weights covers all models, and a scan
over the packed rows sums what every model needs: its gradient and curvature, or
its head's gradient. What returns to the driver is a few numbers a model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.operators import boosting, evaluate
from tempograph.operators.boosting import sigmoid
from tempograph.operators.running import can_checkpoint, release, settle
from tempograph.operators.sums import dealt, moments, pack, tree_sum, tree_sum_of, unpacked
from tempograph.operators.temporal import blocks

#: Newton rounds at most, and the step below which a fit is done.
ROUNDS, CLOSE = 50, 1e-9


@dataclass
class Walk:
    """Which rows each model sees, and how: by model (test step), by step, by label."""

    models: list[int]
    calibrate: list[int | None]
    scored: list[list[int]]
    steps: np.ndarray
    weight: np.ndarray  # (model, step, label): 0 outside the train block
    mean: np.ndarray  # (model, feature) of all rows of the train block
    dev: np.ndarray
    w_mean: np.ndarray  # (model, feature) of its labelled rows by weight
    w_dev: np.ndarray
    turn: np.ndarray | None = None  # (model, part, feature): a model sees these parts of the features

    def seen(self, k: int, x: np.ndarray) -> np.ndarray:
        """Rows as model k sees them."""
        return x if self.turn is None else x @ self.turn[k].T

    def rows(self, tau: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of labelled rows, and their weights in each model."""
        at = np.flatnonzero((label == 0) | (label == 1))
        step = np.searchsorted(self.steps, tau[at])
        return at, self.weight[:, step, label[at]]


def _merge(parts: list[tuple[float, np.ndarray, np.ndarray]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of groups of (weight, mean, their sum of squared deviations)."""
    total = sum(w for w, _, _ in parts)
    if not total:
        return np.zeros(width), np.zeros(width)
    mean = sum(w * m for w, m, _ in parts) / total
    return mean, sum(v + w * (m - mean) ** 2 for w, m, v in parts)


def plan(packed: DataFrame, width: int, steps: list[int], lam: float = 0.25, window: int | None = None, train_end: int | None = None, turns: dict[int, np.ndarray] | None = None, available: list[int] | None = None) -> Walk:
    """Train blocks, weights and scales of the models of ``steps``, from one scan that sums by step and label.

    Weights are exp(-lam (last step - step)) times the inverse class frequency.
    A step is left out if its train block lacks a class; steps that the table
    does not have are no part of a block. With ``train_end`` there is
    one model (0) instead, trained up to that step, that scores all ``steps``.
    ``turns`` gives the ``width`` parts (part, feature) of the features that each
    step's model sees; steps outside ``available`` are scored only.
    """
    by = all_ = moments(packed, turns is not None)  # three groups a step
    have = sorted({t for t, _ in by})
    use = [t for t in have if available is None or t in available]
    size = lambda t, c: by[t, c][0] if (t, c) in by else 0
    out = Walk([], [], [], np.array(have), *(np.zeros((0,)) for _ in range(5)))
    tables, scales, turned = [], [], []
    for tau in [0] if train_end is not None else steps:
        if train_end is not None:
            train, cal, scored = [t for t in have if t <= train_end], None, steps
        elif tau not in have or not use:
            continue
        else:
            (train, cal), scored = blocks(use, tau, window), [tau]
        counts = [sum(size(t, c) for t in train) for c in (0, 1)]
        if not all(counts):
            continue
        if turns is not None:
            turned.append(turns[tau])
            by = {key: (n, turns[tau] @ m, ((turns[tau] @ v) * turns[tau]).sum(axis=1)) for key, (n, m, v) in all_.items()}
        last = max(t for t in train if size(t, 0) + size(t, 1))
        w = np.zeros((len(have), 2))
        for t in train:
            w[have.index(t)] = [np.exp(-lam * (last - t)) * sum(counts) / (2 * counts[c]) for c in (0, 1)]
        total = sum(w[have.index(t), c] * size(t, c) for t in train for c in (0, 1))
        w /= total / sum(counts)
        mean, dev = _merge([by[t, c] for t in train for c in (-1, 0, 1) if (t, c) in by], width)
        dev = np.sqrt(dev / max(1, sum(by[t, c][0] for t in train for c in (-1, 0, 1) if (t, c) in by)))
        own = [(w[have.index(t), c], by[t, c]) for t in train for c in (0, 1) if (t, c) in by]
        w_mean, w_sq = _merge([(k * n, m, k * v) for k, (n, m, v) in own], width)
        total, squares = sum(k * n for k, (n, _, _) in own), sum(k * k * n for k, (n, _, _) in own)
        w_dev = np.sqrt(w_sq / max(total - squares / total, 1e-300))
        out.models.append(tau)
        out.calibrate.append(cal)
        out.scored.append(scored)
        tables.append(w)
        scales.append((mean, np.where(dev > 0, dev, 1.0), w_mean, w_dev))
    out.weight = np.array(tables).reshape(len(tables), len(have), 2)
    out.mean, out.dev, out.w_mean, out.w_dev = (np.array(s).reshape(len(tables), width) for s in (zip(*scales) if scales else [[]] * 4))
    out.turn = None if turns is None else np.array(turned)
    return out


Params = list[np.ndarray]  # arrays whose first axis is the model
Predict = Callable[[int, Params, np.ndarray], np.ndarray]


def _newton_sums(walk: Walk, beta: np.ndarray) -> Callable[[Iterator], Params | None]:
    inverse = np.where(walk.w_dev > 0, 1 / np.where(walk.w_dev > 0, walk.w_dev, 1), 0.0)

    def one(blocks_: Iterator) -> Params | None:
        m, d = beta.shape
        loss, grad, hess = np.zeros(m), np.zeros((m, d)), np.zeros((m, d, d))
        for tau, _, label, x in blocks_:
            at, weight = walk.rows(tau, label)
            for k in range(m):
                use = weight[k] > 0
                rows, w = at[use], weight[k][use]
                s = np.hstack([np.ones((len(rows), 1)), (walk.seen(k, x[rows]) - walk.w_mean[k]) * inverse[k]])
                y, z = label[rows], s @ beta[k]
                p = sigmoid(z)
                loss[k] += float((w * (np.logaddexp(0, z) - y * z)).sum())
                grad[k] += s.T @ (w * (p - y))
                hess[k] += (s * (w * p * (1 - p))[:, None]).T @ s
        return [loss, grad, hess]

    return one


def fit_logistic(packed: DataFrame, walk: Walk, reg: float = 1e-4) -> np.ndarray:
    """(intercept, coefficients) of each model: weighted logistic loss with an L2 penalty on standardised coefficients.

    Newton rounds over all models, one scan each; a model whose objective rose goes half the way back.
    """
    m, d = walk.w_mean.shape
    beta, step = np.zeros((m, d + 1)), np.zeros((m, d + 1))
    best = np.full(m, np.inf)
    ridge = np.r_[0.0, np.full(d, reg)]
    total = np.zeros(m)
    for _ in range(ROUNDS if m else 0):
        sums = tree_sum(packed, _newton_sums(walk, beta))
        if sums is None:
            break
        loss, grad, hess = sums
        total = hess_weight(walk, packed) if not total.any() else total
        now = loss / total + 0.5 * (ridge * beta**2).sum(axis=1)
        moved = 0.0
        for k in range(m):
            if now[k] > best[k] + 1e-12:
                step[k] /= 2
                beta[k] += step[k]  # ``step`` points back from where the objective rose
            else:
                best[k] = now[k]
                go = np.linalg.solve(hess[k] / total[k] + np.diag(ridge + 1e-12), grad[k] / total[k] + ridge * beta[k])
                beta[k] -= go
                step[k] = go
            moved = max(moved, float(np.abs(step[k]).max()))
        if moved < CLOSE:
            break
    inverse = np.where(walk.w_dev > 0, 1 / np.where(walk.w_dev > 0, walk.w_dev, 1), 0.0)
    out = beta.copy()
    out[:, 1:] = beta[:, 1:] * inverse
    out[:, 0] = beta[:, 0] - (out[:, 1:] * walk.w_mean).sum(axis=1)
    return out


def hess_weight(walk: Walk, packed: DataFrame) -> np.ndarray:
    """Sum of the weights of each model's rows; by construction their number."""
    got = tree_sum(packed, lambda bs: [sum((walk.rows(tau, label)[1].sum(axis=1) for tau, _, label, _ in bs), np.zeros(len(walk.models)))])
    return got[0]


def logistic(walk: Walk) -> Predict:
    return lambda k, params, x: sigmoid(params[0][k][0] + walk.seen(k, x) @ params[0][k][1:])


def mlp_gradient(z: np.ndarray, y: np.ndarray, w: np.ndarray, p: Params) -> tuple[float, Params]:
    """Weighted loss of one model's rows and its gradient by (w1, b1, w2, b2); sums, not means."""
    w1, b1, w2, b2 = p
    a = z @ w1 + b1
    h = np.maximum(a, 0)
    out = h @ w2 + b2
    r = w * (sigmoid(out) - y)
    back = np.outer(r, w2) * (a > 0)
    return float((w * (np.logaddexp(0, out) - y * out)).sum()), [z.T @ back, back.sum(axis=0), h.T @ r, np.array(r.sum())]


#: Rows whose layers of all heads are worked out at once; these stay in a core's cache.
NEAR = 512


def mlp_gradients(x: np.ndarray, y: np.ndarray, w: np.ndarray, mean: np.ndarray, dev: np.ndarray, p: Params) -> Params:
    """``mlp_gradient`` of all models over the same rows, whose weights ``w`` (row, model) are 0 where a model does not see a row.

    Each model scales rows by its own ``mean`` and ``dev``; the first layers take
    that in, so one product serves all models. The gradient of the second layer
    follows from the sums for the first, without the units' values.
    """
    w1, b1, w2, b2 = p
    m, d, h = w1.shape
    mid, unit = mean.mean(axis=0), dev.mean(axis=0)
    scale, shift = unit / dev, (mid - mean) / dev
    first = np.concatenate([scale[:, :, None] * w1, (b1 + np.einsum("kd,kdh->kh", shift, w1))[:, None]], axis=1)  # (model, feature and 1, unit)
    flat = np.ascontiguousarray(first.transpose(1, 0, 2).reshape(d + 1, m * h))
    loss, sums, grad_b2 = np.zeros(m), np.zeros((d + 1, m * h)), np.zeros(m)
    for s in range(0, len(x), NEAR):
        own, weight, t = np.ones((len(x[s : s + NEAR]), d + 1)), w[s : s + NEAR], y[s : s + NEAR, None]
        own[:, :d] = (x[s : s + NEAR] - mid) / unit
        a = np.maximum(own @ flat, 0).reshape(-1, m, h)
        out = np.einsum("nkh,kh->nk", a, w2) + b2
        small = np.exp(-np.abs(out))
        r = weight * (np.where(out >= 0, 1.0, small) / (1 + small) - t)
        loss += (weight * (np.maximum(out, 0) + np.log1p(small) - t * out)).sum(axis=0)
        grad_b2 += r.sum(axis=0)
        sums += own.T @ np.multiply(a > 0, r[:, :, None], out=a).reshape(-1, m * h)
    by = sums.reshape(d + 1, m, h).transpose(1, 0, 2)
    back = by * w2[:, None]
    return [loss, scale[:, :, None] * back[:, :d] + shift[:, :, None] * back[:, d:], back[:, d], (first * by).sum(axis=1), grad_b2]


def trained(packed: DataFrame, walk: Walk) -> DataFrame:
    """Packed rows that some model trains on."""
    keep = walk.weight.any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpacked(batches):
            at = np.flatnonzero((block[2] == 0) | (block[2] == 1))
            at = at[keep[np.searchsorted(walk.steps, block[0][at]), block[2][at]]]
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array([c[at].tobytes()], pa.binary()) for c in block], ["tau", "txid", "label", "x"])

    return packed.mapInArrow(run, "tau binary, txid binary, label binary, x binary")


def fit_mlp(packed: DataFrame, walk: Walk, hidden: int = 16, epochs: int = 100, rate: float = 0.01, decay: float = 5e-4, l1: float = 1e-4, seed: int = 7) -> tuple[Params, list[np.ndarray]]:
    """Heads with one hidden layer of rectified units, class weights, and an L1 penalty on the first layer; with the losses by epoch.

    Full-batch Adam with decoupled weight decay; the penalty is a proximal step
    of the first layer's weights. One scan an epoch for the heads of all steps.
    """
    m, d = walk.mean.shape
    rng = np.random.default_rng(seed)
    init = rng.uniform(-1, 1, (d, hidden)) / np.sqrt(max(d, 1)), np.zeros(hidden), rng.uniform(-1, 1, hidden) / np.sqrt(hidden), np.zeros(())
    params = [np.repeat(v[None], m, axis=0) for v in init]  # equal seeds for all models
    first, second, losses = [np.zeros_like(v) for v in params], [np.zeros_like(v) for v in params], []
    rows = trained(packed, walk).persist(StorageLevel.MEMORY_AND_DISK)
    total = hess_weight(walk, rows) if m else np.zeros(0)
    weight = walk.weight.reshape(m, -1).T.copy() if m else np.zeros((0, 0))  # (step and label, model)

    def sums(now: Params) -> Callable[[Iterator], Params | None]:
        def one(blocks_: Iterator) -> Params | None:
            out = [np.zeros(m), *(np.zeros_like(v) for v in now)]
            for tau, _, label, x in blocks_:
                grads = mlp_gradients(x, label, weight[2 * np.searchsorted(walk.steps, tau) + label], walk.mean, walk.dev, now)
                out = [o + g for o, g in zip(out, grads)]
            return out

        return one

    for t in range(1, (epochs if m else 0) + 1):
        loss, *grads = tree_sum(rows, sums(params))
        losses.append(loss / total)
        for i, g in enumerate(grads):
            g = g / total.reshape(-1, *[1] * (g.ndim - 1))
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            move = rate * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)
            params[i] = params[i] * (1 - rate * decay) - move
        params[0] = np.sign(params[0]) * np.maximum(np.abs(params[0]) - rate * l1, 0)
    rows.unpersist()
    return params, losses


#: Trees after which the margins are checkpointed, if the session has a folder for that.
KEEP = 20


def feature_edges(x: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Inner quantiles of each feature, up to ``bins - 1`` distinct ones; approximate, from mergeable sketches."""
    probs = [i / bins for i in range(1, bins)]
    r = x.agg(*[F.percentile_approx(F.col("features")[i], probs, 10_000) for i in range(width)]).first()
    out = []
    for q in r:
        q = np.unique(np.array([v for v in q or [] if v is not None and np.isfinite(v)], float))
        out.append(q)
    return out


def _binned(packed: DataFrame, walk: Walk, edges: list[np.ndarray]) -> DataFrame:
    """Packed rows that a model trains on, by step in each block, with features as bytes (feature, row); the empty margins stand for zeros."""
    coder, keep = boosting.Booster(edges), walk.weight.any(axis=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tau, _, label, x in unpacked(batches):
            at = np.flatnonzero((label == 0) | (label == 1))
            at = at[keep[np.searchsorted(walk.steps, tau[at]), label[at]]]
            at = at[np.argsort(tau[at], kind="stable")]
            if len(at):
                cols = [*(c.tobytes() for c in (tau[at], label[at], coder.bins(x[at]).T)), b""]
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in cols], ["tau", "label", "bins", "margin"])

    return packed.mapInArrow(run, "tau binary, label binary, bins binary, margin binary")


def _raised(binned: DataFrame, trees: list[boosting.Tree | None], width: int) -> DataFrame:
    """Margins with a tree more for each model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = [t and boosting.reach(t, t.depth, width) for t in trees]
        for tau, label, bins, margin in _binned_blocks(batches, width, len(trees)):
            margin, at = margin.copy(), bins.astype(np.intp)
            for k, t in enumerate(trees):
                if t is not None:
                    margin[k] += t.value[reach[k](at)]
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (tau, label, bins, margin)], ["tau", "label", "bins", "margin"])

    return binned.mapInArrow(run, "tau binary, label binary, bins binary, margin binary")


def _binned_blocks(batches: Iterator[pa.RecordBatch], width: int, models: int) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for i in range(b.num_rows):
            tau, label, bins, margin = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in enumerate((np.int32, np.int32, np.uint8, np.float64)))
            yield tau, label, bins.reshape(width, len(tau)), margin.reshape(models, len(tau)) if len(margin) else np.zeros((models, len(tau)))


def level_sums(walk: Walk, trees: list[boosting.Tree | None], level: int, width: int, bins: int) -> Callable[[Iterator], Params]:
    """(model, node, feature, bin, 2): sums of gradients and curvatures at a level of the models' current trees; None stands for a tree's root.

    A block's rows are in order of steps, so a model's rows lie side by side.
    """
    m, nodes = len(walk.models), 1 << level
    weight = walk.weight.reshape(m, -1)  # (model, step and label)
    ends = [(s[0], s[-1] + 1) if len(s) else (0, 0) for s in (np.flatnonzero(w.any(axis=1)) for w in walk.weight)]
    size = (nodes + 1) * bins  # the last node takes rows that stopped above

    def one(batches: Iterator[pa.RecordBatch]) -> Params:
        out = np.zeros((m, width, 2, size))
        reach = [t and boosting.reach(t, level, width) for t in trees]
        place = np.full((2 << level) - 1, nodes * bins)
        place[nodes - 1 :] = np.arange(nodes) * bins
        for tau, label, b, margin in _binned_blocks(batches, width, m):
            step, b = np.searchsorted(walk.steps, tau), b.astype(np.intp)
            code = 2 * step + label  # all rows are labelled
            for k, (first, last) in enumerate(ends):
                own = slice(*np.searchsorted(step, (first, last)))
                if own.start == own.stop:
                    continue
                w, p = weight[k][code[own]], sigmoid(margin[k, own])
                g, h = w * (p - label[own]), w * p * (1 - p)
                at = None if trees[k] is None else place[reach[k](b[:, own])]
                for f in range(width):
                    cell = b[f, own] if at is None else at + b[f, own]
                    out[k, f, 0] += np.bincount(cell, g, size)
                    out[k, f, 1] += np.bincount(cell, h, size)
        return [np.moveaxis(out.reshape(m, width, 2, nodes + 1, bins)[:, :, :, :nodes], (1, 2, 3, 4), (2, 4, 1, 3))]

    return one


def fit_boosted(packed: DataFrame, walk: Walk, edges: list[np.ndarray], trees: int = 30, depth: int = 4, eta: float = 0.1, lam: float = 1.0, least: float = 1.0) -> list[boosting.Booster]:
    """Boosted trees of every model, grown side by side: one scan a level gives the histograms of all models.

    Features are binned once; margins are a column of the binned rows, raised
    after each tree, so a scan costs the same however many trees there are. What
    returns to the driver is models x nodes x features x bins pairs of numbers.
    """
    m, width = walk.mean.shape
    bins = max([2, *(len(e) + 1 for e in edges)])
    out = [boosting.Booster(edges) for _ in range(m)]
    if not m:
        return out
    # Adaptive plans that are nested in each other, as those of shuffled rows would be, take twice the time to plan with every tree.
    start = rows = settle(_binned(packed, walk, edges))
    save = can_checkpoint(packed)
    alive = [True] * m
    for t in range(trees):
        grown: list[boosting.Tree | None] = [None] * m
        states = [boosting.growing(depth) for _ in range(m)]
        for level in range(depth):
            hist = tree_sum_of(rows, level_sums(walk, [s if level else None for s in states], level, width, bins))
            go = [alive[k] and boosting.grow_level(states[k], level, hist[0][k], eta, lam, least) for k in range(m)]
            if not any(go):
                break
        for k in range(m):
            alive[k] = alive[k] and states[k].feature[0] >= 0
            if alive[k]:
                grown[k] = states[k]
                out[k].trees.append(states[k])
        if not any(alive) or t == trees - 1:
            break
        old, rows = rows, _raised(rows, grown, width)
        if save and t % KEEP == KEEP - 1:
            rows = rows.checkpoint()
        rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
        rows.count()
        old.unpersist()
    rows.unpersist()
    release(start)
    return out


def boosted(boosters: list[boosting.Booster]) -> Predict:
    return lambda k, _params, x: boosters[k].score(x)


def mlp(walk: Walk) -> Predict:
    mean, dev = walk.mean, walk.dev

    def predict(k: int, params: Params, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = (p[k] for p in params)
        return sigmoid(np.maximum((x - mean[k]) / dev[k] @ w1 + b1, 0) @ w2 + b2)

    return predict


def scores(packed: DataFrame, walk: Walk, params: Params, predict: Predict) -> DataFrame:
    """(tau, step, txid, label, score): each model's labelled rows of its calibration step and of the steps it scores."""
    models = [(k, tau, {*scored, cal} - {None}) for k, (tau, cal, scored) in enumerate(zip(walk.models, walk.calibrate, walk.scored))]
    names = ["tau", "step", "txid", "label", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tau, txid, label, x in unpacked(batches):
            for k, model, steps in models:
                at = np.flatnonzero(np.isin(tau, list(steps)) & ((label == 0) | (label == 1)))
                if len(at):
                    cols = [np.full(len(at), model, np.int32), tau[at], txid[at], label[at], predict(k, params, x[at])]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names)

    return packed.mapInArrow(run, "tau int, step int, txid long, label int, score double")


def blend(a: DataFrame, b: DataFrame, weight: float = 0.5) -> DataFrame:
    """Scores of two heads over the same rows: ``weight`` of the second, the rest of the first."""
    j = a.join(b.select("tau", "step", "txid", F.col("score").alias("other")), ["tau", "step", "txid"])
    return j.select("tau", "step", "txid", "label", ((1 - weight) * F.col("score") + weight * F.col("other")).alias("score"))


def decide(p: DataFrame) -> DataFrame:
    """Test rows with their model's threshold: calibrated on the step before, 0.5 and ``fallback`` where that lacks a class."""
    cal = p.filter("step < tau")
    two = cal.groupBy("tau").agg(F.countDistinct("label").alias("kinds")).filter("kinds = 2").select("tau")
    t = evaluate.calibrated_threshold(cal.join(F.broadcast(two), "tau"), ["tau"])  # one row a step
    out = p.filter("step = tau").drop("step").join(F.broadcast(t), "tau", "left")
    out = out.withColumns({"threshold": F.coalesce("threshold", F.lit(0.5)), "fallback": F.coalesce("fallback", F.lit(True))})
    return out.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))


def step_metrics(p: DataFrame) -> DataFrame:
    """Counts, precision, recall, F1 and average precision of each step at its threshold; steps of one class have none."""
    hit, y = F.col("predicted") == 1, F.col("label") == 1
    c = p.groupBy("tau").agg(
        F.count("*").alias("n"), F.count_if(y).alias("n_pos"), F.count_if(hit & y).alias("tp"), F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"),
        F.max("threshold").alias("threshold"), F.max("fallback").alias("fallback"),
    )
    c = c.filter("n_pos > 0 and n_pos < n")
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    c = c.withColumns({"precision": part(F.col("tp"), F.col("tp") + F.col("fp")), "recall": part(F.col("tp"), F.col("tp") + F.col("fn")), "f1": part(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})
    return c.join(evaluate.average_precision(p, ["tau"]), "tau")


def _kept(scored: DataFrame) -> DataFrame:
    """Scores as stored before the packed rows go; thresholds and metrics read them again and again."""
    scored = scored.persist(StorageLevel.MEMORY_AND_DISK)
    scored.count()
    return scored


def run(x: DataFrame, width: int, steps: list[int], head: str = "lr", lam: float = 0.25, window: int | None = None, train_end: int | None = None, turns: dict[int, np.ndarray] | None = None, available: list[int] | None = None, **options) -> DataFrame:
    """Scores of the models of ``steps`` (see ``scores``), fitted over all rows of ``x`` (tau, txid, label, features); see ``plan`` for the rest. They stay persisted until the session's cache is cleared."""
    if turns is not None and head != "lr":
        raise ValueError("only logistic models see parts of the features")
    packed = dealt(pack(x)).persist(StorageLevel.MEMORY_AND_DISK)  # a lost part is computed anew
    try:
        walk = plan(packed, width, steps, lam, window, train_end, turns, available)
        if head == "lr":
            return _kept(scores(packed, walk, [fit_logistic(packed, walk, **options)], logistic(walk)))
        if head == "mlp":
            return _kept(scores(packed, walk, fit_mlp(packed, walk, **options)[0], mlp(walk)))
        if head == "gbt":
            first = min((int(t) for k in range(len(walk.models)) for t in walk.steps[walk.weight[k].any(axis=1)][-1:]), default=0)
            edges = feature_edges(x.filter(F.col("tau") <= first), width, options.pop("bins", boosting.BINS))  # no model sees later rows
            return _kept(scores(packed, walk, [], boosted(fit_boosted(packed, walk, edges, **options))))
        raise ValueError(f"unknown head {head!r}")
    finally:
        packed.unpersist()


def static(x: DataFrame, width: int, train_end: int, steps: list[int], head: str = "lr", **options) -> DataFrame:
    """(tau, txid, label, score) of one model without decay, trained up to ``train_end``."""
    return run(x, width, steps, head, 0.0, None, train_end, **options).select(F.col("step").alias("tau"), "txid", "label", "score")
