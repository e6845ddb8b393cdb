"""Quality classifier: naive Bayes support vectors over n-gram indicators.

Indicators (is the n-gram in the text?) are scaled by the class log-count ratio
of their n-gram, and a linear hinge-loss model is fitted to the scaled
indicators by dual coordinate descent. Features are hashed byte n-grams of the
whole text and n-grams over word repetition, so that nothing depends on a
language's vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tempograph.llm.common import cut, fold, no_clash

BITS = 18
#: Bound on the labelled rows the model is fitted on (those with the smallest seeded hash, half of them from each class at most).
MAX_TRAIN = 8000
SEED = 5
_MUL = np.uint32(2654435761)


def features(text: str, bits: int = BITS) -> np.ndarray:
    """Hashed indicators of a whole text, each once: byte 1- to 4-grams and runs of equal words."""
    raw = text.encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    shift = np.uint32(32 - bits)
    out = []
    code = b
    for n in range(1, 5):
        if n > 1:
            code = (code[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :] if len(b) >= n else b[:0]
        out.append(((code + np.uint32(n * 97)) * _MUL ^ np.uint32(n)) * _MUL >> shift)
    words = raw.split()
    if len(words) > 1:
        same = np.fromiter((x == y for x, y in zip(words, words[1:])), bool, len(words) - 1).astype(np.uint32)
        run = same.copy()
        for n in range(3):  # patterns of one, two and three pairs in a row
            if n:
                run = (run[:-1] << np.uint32(1)) | same[n:]
            out.append((run + np.uint32(1009 + 16 * n)) * _MUL >> shift)
    f = np.concatenate(out)
    mark = _scratch(bits)
    at = np.arange(len(f), dtype=np.int32)
    mark[f] = at
    return f[mark[f] == at]


_marks: dict[int, np.ndarray] = {}


def _scratch(bits: int) -> np.ndarray:
    if bits not in _marks:
        _marks[bits] = np.zeros(1 << bits, np.int32)
    return _marks[bits]


def log_count_ratio(rows: list[np.ndarray], y: np.ndarray, bits: int = BITS, alpha: float = 1.0) -> np.ndarray:
    """log((p / |p|) / (q / |q|)) of smoothed counts of texts that hold each n-gram."""
    p, q = (alpha + sum((np.bincount(r, minlength=1 << bits) for r, c in zip(rows, y) if c == s), np.zeros(1 << bits)) for s in (1, -1))
    return np.log(p / p.sum()) - np.log(q / q.sum())


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, dim: int, epochs: int = 12, seed: int = SEED) -> tuple[np.ndarray, float]:
    """Weights and bias of min |w|^2/2 + sum cost_i max(0, 1 - y_i w.x_i), one dual variable at a time."""
    w, bias = np.zeros(dim), 0.0
    alpha = np.zeros(len(y))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            r, v = rows[i], values[i]
            g = y[i] * (w[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y[i]
            if step:
                most = max(most, abs(step))
                w[r] += step * v
                bias += step
                alpha[i] = new
        if most < 1e-4:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope (positive) and offset of a logistic curve through the margins."""
    a, b = 1.0, 0.0
    n1, n0 = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -35, 35)))
        g, s = p - t, np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * margin**2).sum() + 1e-6, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, [(g * margin).sum(), g.sum()])
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return max(a, 1e-3), b


class Model:
    """score(text) in 0 to 1; without both classes in training every score is ``base``."""

    def __init__(self, weights: np.ndarray | None, bias: float = 0.0, a: float = 1.0, b: float = 0.0, base: float = 0.5, bits: int = BITS):
        self.weights, self.bias, self.a, self.b, self.base, self.bits = weights, bias, a, b, base, bits

    def score(self, text: str) -> float:
        if self.weights is None:
            return self.base
        f = features(text, self.bits)
        m = (float(self.weights[f].sum()) / np.sqrt(len(f)) if len(f) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(self.a * m + self.b, -35, 35))))


def fit(texts: list[str], labels: list[int], bits: int = BITS) -> Model:
    """Fit on texts with labels 0/1. Texts are scaled to unit length, so long ones do not dominate."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if len(set(y.tolist())) < 2:
        return Model(None, base=0.5 if not len(y) else float((1 + (y > 0).sum()) / (2 + len(y))), bits=bits)
    rows = [features(t, bits) for t in texts]
    r = log_count_ratio(rows, y, bits)
    values = [(r[f] / np.sqrt(max(1, len(f)))).astype(np.float32) for f in rows]
    cost = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    half = np.random.default_rng(SEED).random(len(y)) < 0.5
    margins = np.zeros(len(y))
    for part in (half, ~half):  # margins of rows the model has not seen, for the curve
        at = np.flatnonzero(~part)
        if len(set(y[at].tolist())) < 2:
            at = np.arange(len(y))
        w, b = dual_coordinate_descent([rows[i] for i in at], [values[i] for i in at], y[at], cost[at], 1 << bits)
        margins[part] = [w[rows[i]] @ values[i] + b for i in np.flatnonzero(part)]
    a, b0 = platt(margins, y)
    w, b = dual_coordinate_descent(rows, values, y, cost, 1 << bits)
    return Model((w * r).astype(np.float64), b, a, b0, bits=bits)


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = SEED) -> DataFrame:
    """At most ``max_train`` labelled texts outside the held-out fold, by seeded hash of the id."""
    lab = labels.select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("l_id").isNotNull())
    lab = lab.filter(fold("l_id", 3) != 1).groupBy("l_id").agg(F.min("y").alias("y"))
    half = max_train // 2
    # A limit by hash for each class: a top-k, not a window over a class.
    h = F.xxhash64(F.lit(seed), "l_id")
    pick = lab.filter("y = 1").orderBy(h, "l_id").limit(half).unionByName(lab.filter("y = 0").orderBy(h, "l_id").limit(half))
    return docs.select("doc_id", "text").join(F.broadcast(pick), F.col("doc_id") == F.col("l_id")).select("doc_id", "y", F.coalesce("text", F.lit("")).alias("text"))


def classify_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """Append held_out (boolean), score (double) and predicted (int) to every document.

    Labels come only from ids whose crc32 modulo 3 is not 1; null labels and
    labels other than 0 and 1 are ignored, of several labels for an id the
    lowest counts. Null and empty texts are scored like any other (no
    indicators). With labels of one class, or none, the score is constant.
    Repeated rows are scored each, ties in the training order go by id; long
    texts are read whole. Other columns are kept; ``held_out``, ``score`` and
    ``predicted`` must not be among them. An empty table gives no rows.
    """
    no_clash(docs, ["held_out", "score", "predicted"])
    spark = docs.sparkSession
    train = training_rows(docs, labels, max_train).select("doc_id", "y", "text")
    fitted = cut(train.repartition(1).mapInPandas(_fit_task, "bias double, a double, b double, base double, weights array<float>"))
    r = fitted.first()  # one row of 2**BITS weights
    if r is None:  # no labelled row: the plan may have no task at all
        fitted_model = Model(None)
    else:
        weights = np.array(r["weights"], np.float64) if r["weights"] is not None else None
        fitted_model = Model(weights, r["bias"], r["a"], r["b"], r["base"])
    model = spark.sparkContext.broadcast(fitted_model)

    @F.pandas_udf("double")
    def scored(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model.value
        for s in it:
            yield pd.Series([m.score(x) for x in s], dtype="float64")

    out = docs.withColumn("held_out", fold("doc_id", 3) == 1).withColumn("score", scored(F.coalesce(F.col("text"), F.lit(""))))
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def _fit_task(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fit in one task: its rows are bounded by ``max_train``; only their indicators are kept."""
    rows = sorted((r for p in it for r in zip(p["doc_id"].tolist(), p["text"].tolist(), p["y"].tolist())))
    m = fit([r[1] for r in rows], [r[2] for r in rows])
    yield pd.DataFrame({"bias": [m.bias], "a": [m.a], "b": [m.b], "base": [m.base], "weights": [None if m.weights is None else m.weights.astype(np.float32)]})


def drop_low_quality(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """The documents that the classifier accepts, with their own columns whatever their names.

    Nulls, empty and long texts, repeated rows and empty tables as in
    ``classify_quality``; a score of exactly 0.5 is kept.
    """
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    return classify_quality(rows, labels, max_train).filter("predicted = 1").select("row.*")
