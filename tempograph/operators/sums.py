"""Sums over all rows by blocks: one partial result a task, merged in a tree."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Partial results that meet in one place at most.
MEET = 64


def pack(x: DataFrame) -> DataFrame:
    """(tau, txid, label, features) as one row of byte arrays for each Arrow batch; null, NaN and infinite entries become 0.

    All feature arrays have one length. The bytes are what an iterative fit
    reads again and again, so callers persist them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = np.nan_to_num(b.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
                cols = [b.column(i).to_numpy(zero_copy_only=False).astype(t) for i, t in enumerate((np.int32, np.int64, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in (*cols, v)], ["tau", "txid", "label", "x"])

    slim = x.select(F.col("tau").cast("int"), F.col("txid").cast("long"), F.col("label").cast("int"), F.col("features").cast("array<double>"))
    return slim.mapInArrow(run, "tau binary, txid binary, label binary, x binary")


def dealt(packed: DataFrame) -> DataFrame:
    """Packed rows over all cores: a file is often read by few tasks, and every later scan would keep to these."""
    return packed.repartition(packed.sparkSession.sparkContext.defaultParallelism)


Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    """(tau, txid, label, matrix) of each packed row."""
    for b in batches:
        for i in range(b.num_rows):
            tau, txid, label, x = (np.frombuffer(b.column(k)[i].as_py(), t) for k, t in enumerate((np.int32, np.int64, np.int32, np.float64)))
            yield tau, txid, label, x.reshape(len(tau), -1)


def _add_arrays(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b)]


def tree_sum(packed: DataFrame, one: Callable[[Iterator[Block]], object], add: Callable[[object, object], object] = _add_arrays):
    """What ``one`` gives for the blocks of each task, merged by ``add`` (sums of arrays); None where no task gives anything."""
    return tree_sum_of(packed, lambda batches: one(unpacked(batches)), add)


def tree_sum_of(rows: DataFrame, one: Callable[[Iterator[pa.RecordBatch]], object], add: Callable[[object, object], object] = _add_arrays):
    """``tree_sum`` over Arrow batches of any rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = one(batches)
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], ["part"])

    frame = rows.mapInArrow(run, "part binary")
    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    tasks = rows.rdd.getNumPartitions()
    if tasks <= MEET:  # so few partial results need no tree
        return reduce(both, (pickle.loads(r["part"]) for r in frame.collect()), None)
    parts, depth = frame.rdd, 2
    while tasks ** (1 / depth) > MEET:
        depth += 1
    return parts.treeAggregate(None, lambda a, r: both(a, pickle.loads(r["part"])), both, depth)


Moments = dict[tuple[int, int], tuple[int, np.ndarray, np.ndarray]]


def _merge_moments(a: Moments, b: Moments) -> Moments:
    out = dict(a)
    for key, (n, m, s) in b.items():
        if key in out:
            n0, m0, s0 = out[key]
            d = m - m0
            n, m, s = n0 + n, m0 + d * (n / (n0 + n)), s0 + s + (np.outer(d, d) if s.ndim == 2 else d * d) * (n0 * n / (n0 + n))
        out[key] = n, m, s
    return out


def moments(packed: DataFrame, outer: bool = False) -> Moments:
    """(step, label) -> number of rows, mean and sum of squared deviations of each feature, in one scan; with ``outer`` of summed outer products."""

    def one(blocks: Iterator[Block]) -> Moments | None:
        out: Moments = {}
        for tau, _, label, x in blocks:
            for t, c in set(zip(tau.tolist(), label.tolist())):
                own = x[(tau == t) & (label == c)]
                mean = own.mean(axis=0)
                squares = (own - mean).T @ (own - mean) if outer else ((own - mean) ** 2).sum(axis=0)
                out = _merge_moments(out, {(t, c): (len(own), mean, squares)})
        return out or None

    return tree_sum(packed, one, _merge_moments) or {}


def step_covariances(packed: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """step -> rows, mean and summed outer products of centred rows, in one scan; width squared numbers a step."""

    def merge(a: dict, b: dict) -> dict:
        out = dict(a)
        for t, (n, m, s) in b.items():
            if t in out:
                n0, m0, s0 = out[t]
                d = m - m0
                n, m, s = n0 + n, m0 + d * (n / (n0 + n)), s0 + s + np.outer(d, d) * (n0 * n / (n0 + n))
            out[t] = n, m, s
        return out

    def one(blocks: Iterator[Block]) -> dict | None:
        out: dict = {}
        for tau, _, _, x in blocks:
            for t in np.unique(tau).tolist():
                c = x[tau == t]
                mean = c.mean(axis=0)
                out = merge(out, {t: (len(c), mean, (c - mean).T @ (c - mean))})
        return out or None

    return tree_sum(packed, one, merge) or {}


def merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and summed outer products of several steps together."""
    n = sum(p[0] for p in parts)
    mean = sum(k * m for k, m, _ in parts) / n
    return n, mean, sum(s + k * np.outer(m - mean, m - mean) for k, m, s in parts)


def basis(part: tuple[int, np.ndarray, np.ndarray], keep: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and leading unit eigenvectors as rows; the largest entry of each is positive."""
    vec = np.linalg.eigh(part[2])[1][:, ::-1][:, :keep]
    return part[1], (vec * np.where(vec[np.abs(vec).argmax(0), range(vec.shape[1])] < 0, -1.0, 1.0)).T


def projected(packed: DataFrame, bases: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(tau, txid, label, features): rows of the steps in ``bases`` on their step's basis."""
    keep = max((len(c) for _, c in bases.values()), default=0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for tau, txid, label, x in unpacked(batches):
            at = np.flatnonzero(np.isin(tau, list(bases)))
            out = np.zeros((len(at), keep))
            for t in np.unique(tau[at]).tolist():
                mean, c = bases[t]
                out[tau[at] == t, : len(c)] = (x[at][tau[at] == t] - mean) @ c.T
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(at) + 1) * keep, max(keep, 1), dtype=np.int32)[: len(at) + 1]), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(tau[at]), pa.array(txid[at]), pa.array(label[at]), lists], ["tau", "txid", "label", "features"])

    return packed.mapInArrow(run, "tau int, txid long, label int, features array<double>") if bases else packed.select(F.lit(0).alias("tau"), F.lit(0).cast("long").alias("txid"), F.lit(0).alias("label"), F.array().cast("array<double>").alias("features")).limit(0)
