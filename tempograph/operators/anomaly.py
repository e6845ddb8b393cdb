"""Isolation forests walked forward over the steps: unsupervised scores, labels only set the share flagged."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.operators import evaluate

TREES, SUBSAMPLE = 100, 256
#: A tree of at most SUBSAMPLE rows has fewer nodes than this; forests are broadcast, so their size is known.
MAX_NODES = 2 * SUBSAMPLE


def mean_path(n: np.ndarray) -> np.ndarray:
    """Mean length of an unsuccessful search among n keys; 0 below 2, 1 at 2."""
    n = np.asarray(n, float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """Random splits down to single rows, equal rows or depth log2(rows); leaves hold the path length they stand for."""
    most = int(np.ceil(np.log2(max(len(x), 2))))
    feature, cut, left, leaf = [-1], [0.0], [0], [0.0]
    todo = [(0, np.arange(len(x)), 0)]
    while todo:
        node, rows, depth = todo.pop()
        low, high = (x[rows].min(0), x[rows].max(0)) if len(rows) else (np.zeros(0), np.zeros(0))
        wide = np.flatnonzero(high > low)
        if depth >= most or len(rows) < 2 or not len(wide):
            leaf[node] = depth + float(mean_path(len(rows)))
            continue
        f = int(rng.choice(wide))
        at = rng.uniform(low[f], high[f])
        below = x[rows, f] < at
        feature[node], cut[node], left[node] = f, at, len(feature)
        for part in (rows[below], rows[~below]):
            todo.append((len(feature), part, depth + 1))
            feature.append(-1), cut.append(0.0), left.append(0), leaf.append(0.0)
    return {"feature": np.array(feature, np.int32), "cut": np.array(cut), "left": np.array(left, np.int32), "leaf": np.array(leaf)}


def path_lengths(tree: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Path length of every row; the right child follows the left one."""
    at = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    while True:
        inner = tree["feature"][at] >= 0
        if not inner.any():
            return tree["leaf"][at]
        f = np.where(inner, tree["feature"][at], 0)
        right = x[rows, f] >= tree["cut"][at]
        at = np.where(inner, tree["left"][at] + right, at)


def anomaly_scores(forest: list[dict[str, np.ndarray]], size: int, x: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 is anomalous, about 0.5 is not."""
    if not forest:
        return np.full(len(x), 0.5)
    depth = np.mean([path_lengths(t, x) for t in forest], 0)
    return 2.0 ** (-depth / max(float(mean_path(size)), 1e-12))


def forest_sample(x: DataFrame, steps: list[int], gap: int, window: int | None, seed: int) -> DataFrame:
    """(target, features): for each target step some TREES * SUBSAMPLE rows of its training steps, drawn by hash.

    Counts of each step give the share to keep, so nothing is sorted and no step meets in one task.
    """
    pairs = [(t, s) for t in steps for s in range(1 if window is None else max(1, t - gap - window), t - gap)]
    if not pairs:
        return x.sparkSession.createDataFrame([], "target int, features array<double>")
    plan = x.sparkSession.createDataFrame(pairs, "target int, tau int")
    n = x.groupBy("tau").agg(F.count("*").alias("n"))
    share = plan.join(F.broadcast(n), "tau")  # one row a step
    total = share.groupBy("target").agg(F.sum("n").alias("total"))
    share = share.join(F.broadcast(total), "target").select("tau", "target", F.least(F.lit(1.0), TREES * SUBSAMPLE / F.col("total")).alias("p"))
    share = share.groupBy("tau").agg(F.collect_list(F.struct("target", "p")).alias("to"))
    u = F.pmod(F.xxhash64(F.lit(seed), "tau", "txid"), F.lit(1 << 30)) / float(1 << 30)
    kept = x.withColumn("u", u).join(F.broadcast(share), "tau").withColumn("to", F.filter("to", lambda t: F.col("u") < t["p"]))
    return kept.select(F.explode("to").alias("to"), "features").select("to.target", "features")


def forest_walk_forward(x: DataFrame, steps: list[int], gap: int = 1, window: int | None = None, seed: int = 42) -> DataFrame:
    """(tau, txid, label, score) of the labelled rows of ``steps``; each step's forest saw only the steps before its gap.

    Null features count as 0. A step without training rows scores 0.5.
    """
    x = x.withColumn("features", F.transform("features", lambda v: F.coalesce(v, F.lit(0.0))))

    def fit(p: pd.DataFrame) -> pd.DataFrame:
        target = int(p["target"].iloc[0])
        m = np.array(p["features"].tolist(), float)
        m = m[np.lexsort(m.T[::-1])]  # the rows' order does not matter
        out = []
        for k in range(TREES):
            rng = np.random.default_rng([seed, target, k])
            rows = rng.choice(len(m), min(SUBSAMPLE, len(m)), replace=False)
            out.append({"target": target, "size": len(rows), **{c: v.tolist() for c, v in grow_tree(m[rows], rng).items()}})
        return pd.DataFrame(out)

    kind = "target int, size int, feature array<int>, cut array<double>, left array<int>, leaf array<double>"
    trees = forest_sample(x, steps, gap, window, seed).groupBy("target").applyInPandas(fit, kind)
    forests: dict[int, tuple[int, list]] = {}
    for r in trees.collect():  # steps * TREES * MAX_NODES nodes at most
        grown = {"feature": np.array(r["feature"], np.int32), "cut": np.array(r["cut"]), "left": np.array(r["left"], np.int32), "leaf": np.array(r["leaf"])}
        forests.setdefault(r["target"], (r["size"], []))[1].append(grown)
    shared = x.sparkSession.sparkContext.broadcast(forests)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            s = np.full(len(p), 0.5)
            for tau, at in p.groupby("tau").indices.items():
                size, forest = shared.value.get(int(tau), (0, []))
                s[at] = anomaly_scores(forest, size, np.array(p["features"].iloc[at].tolist(), float))
            yield p.assign(score=np.round(s, 9))[["tau", "txid", "label", "score"]]

    test = x.filter(F.col("tau").isin(*steps) & (F.col("label") != -1)).select("tau", "txid", "label", "features")
    return test.mapInPandas(score, "tau int, txid long, label int, score double")


def flag_by_prevalence(scores: DataFrame, rates: DataFrame) -> DataFrame:
    """Flag the share of each step's scores that ``rates`` (tau, rate) gives, known from labels before the step."""
    p = scores.join(F.broadcast(rates), "tau", "left").withColumn("rate", F.coalesce("rate", F.lit(0.0)))  # one row a step
    t = evaluate.quantile_at(p, ["tau", "rate"], 1 - F.col("rate")).select("tau", F.col("quantile").alias("threshold"))
    return scores.join(F.broadcast(t), "tau").withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))
