"""Static and walk-forward model evaluation on MLlib."""

from __future__ import annotations

from collections.abc import Callable
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempograph.operators import evaluate, stats
from tempograph.operators.temporal import blocks, decay_weights
from tempograph.plans import walk
from tempograph.sources.graph import TRAIN_END, VAL_END

ESTIMATORS = {
    "lr": lambda: LogisticRegression(labelCol="label", featuresCol="vec", weightCol="weight", maxIter=50, regParam=1e-4),
    "rf": lambda: RandomForestClassifier(labelCol="label", featuresCol="vec", weightCol="weight", numTrees=200, maxDepth=5, seed=7),
    "gbt": lambda: GBTClassifier(labelCol="label", featuresCol="vec", weightCol="weight", maxDepth=3, maxIter=10, stepSize=0.1, seed=7),
    "l1": lambda: LogisticRegression(labelCol="label", featuresCol="vec", weightCol="weight", maxIter=50, regParam=1e-3, elasticNetParam=1.0),
}
#: Fits that run at once in a walk forward.
FITS = 8


def _score(kind: str, train: DataFrame, test: DataFrame, lam: float) -> DataFrame:
    t = decay_weights(train, lam, ("features",)).withColumn("vec", array_to_vector("features")).withColumn("label", F.col("label").cast("double"))
    model = ESTIMATORS[kind]().fit(t)
    return model.transform(test.withColumn("vec", array_to_vector("features"))).select("tau", "txid", "label", vector_to_array("probability")[1].alias("score"))


def static_scores(x: DataFrame, kind: str, width: int) -> DataFrame:
    """Train on early steps, score all after validation; scaled by training statistics."""
    z = stats.zscore(x, width, F.col("tau") <= TRAIN_END)
    return _score(kind, z.filter(F.col("tau") <= TRAIN_END), z.filter((F.col("tau") > VAL_END) & (F.col("label") != -1)), 0.0)


def walk_forward_scores(x: DataFrame, kind: str, width: int, steps: list[int], available: list[int], lam: float = 0.25, window: int | None = None, prepare: Callable[[int, DataFrame], tuple[DataFrame, int]] | None = None) -> DataFrame:
    """For each step: train on its block, calibrate on the step before, score the step. Fits run side by side.

    The threshold is 0.5 where the calibration step has no labelled rows.
    ``prepare`` gives a step's own features and their width, for bases that move with the step.
    """

    def one(tau: int) -> DataFrame:
        train, cal = blocks(available, tau, window)
        held = [tau] if cal is None else [cal, tau]
        rows, wide = (x.filter(F.col("tau").isin(*train, *held)), width) if prepare is None else prepare(tau, x.filter(F.col("tau").isin(*train, *held)))
        z = stats.zscore(rows, wide, F.col("tau").isin(train))
        p = _score(kind, z.filter(F.col("tau").isin(train)), z.filter(F.col("tau").isin(held) & (F.col("label") != -1)), lam)
        t = evaluate.calibrated_threshold(p.filter(F.col("tau") == (-1 if cal is None else cal)), ["tau"]).select("threshold", "fallback")
        p = p.filter(F.col("tau") == tau).join(F.broadcast(t), F.lit(True), "left")
        p = p.withColumns({"threshold": F.coalesce("threshold", F.lit(0.5)), "fallback": F.coalesce("fallback", F.lit(False))})
        return p.withColumn("predicted", (F.col("score") >= F.col("threshold")).cast("int"))

    with ThreadPool(FITS) as pool:
        parts = pool.map(one, steps)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def expanding_bases(x: DataFrame, width: int, keep: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each step the (mean, components) of all rows up to it, from one pass of mergeable sums a step."""
    steps = stats.step_moments(x, width).orderBy("tau").collect()  # width squared numbers a step
    n, s, p, out = 0, np.zeros(width), np.zeros((width, width)), {}
    for r in steps:
        n += r["n"]
        s = s + np.array([r[f"s{i}"] for i in range(width)])
        p = p + np.array([[r[f"p{min(i, j)}_{max(i, j)}"] for j in range(width)] for i in range(width)])
        vec = np.linalg.eigh(p / n - np.outer(s / n, s / n))[1][:, ::-1]
        vec = vec * np.where(vec[np.abs(vec).argmax(0), range(width)] < 0, -1.0, 1.0)
        out[r["tau"]] = s / n, vec[:, :keep].T
    return out


def ipca_walk_forward(x: DataFrame, kind: str, width: int, keep: int, steps: list[int], available: list[int], lam: float = 0.25) -> DataFrame:
    """Walk forward on components of all rows before each step: the basis takes in the step before, then all rows in use are projected anew.

    Features are scaled by the first training steps, as components depend on units.
    Logistic models of all steps share their scans (see ``walk``); a projection is
    linear, so each model takes its own from the same packed rows.
    """
    z = stats.zscore(x, width, F.col("tau") <= TRAIN_END)
    bases = expanding_bases(z, width, keep)
    if kind == "lr":
        turns = {tau: bases[max(t for t in bases if t < tau)][1] for tau in steps if min(bases, default=tau) < tau}
        return walk.decide(walk.run(z, keep, steps, lam=lam, turns=turns, available=available))

    def prepare(tau: int, rows: DataFrame) -> tuple[DataFrame, int]:
        last = max(t for t in bases if t < tau)
        return stats.pca_project(rows, *bases[last]), keep

    return walk_forward_scores(z, kind, keep, steps, available, lam, prepare=prepare)


def with_context(x: DataFrame, context: DataFrame, cols: list[str]) -> DataFrame:
    """Features followed by values of the step (tau, cols), 0 where it has none."""
    j = x.join(F.broadcast(context.select("tau", *cols)), "tau", "left")  # one row a step
    return j.withColumn("features", F.concat("features", F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols]))).drop(*cols)


def save_model(model, path: str) -> None:
    """Write a fitted MLlib model or pipeline, over an older one."""
    model.write().overwrite().save(path)


def load_or(spark: SparkSession, reader, path: str, default=None):
    """The model at ``path``, or ``default`` where nothing is written."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return default
    return reader.load(path)
