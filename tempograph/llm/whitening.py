"""Whitening of embeddings by a two-pass covariance.

Entries become integers, so the sums behind the mean are exact. A second pass
subtracts the mean and sums the outer products of blocks of rows by matrix
products. Each task leaves one partial result; ``treeAggregate`` merges them, so
the driver receives a few matrices whatever the number of tasks. The eigenvectors
of the covariance go to the tasks in a broadcast of ``width * components`` numbers.

No pass shuffles rows or keeps more than one Arrow batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, OFFSET, COMPONENTS = 1024.0, 100_000, 8
#: Entries beyond this size after scaling count as this size, so that they are whole doubles and fit a long.
LARGEST = 2.0**52
#: Numbers in a block of centred rows.
BLOCK = 1 << 20
#: Partial results that meet in the driver at most, as ``treeAggregate`` is told by its depth.
MEET = 64


@dataclass
class Whitening:
    """What was fitted: rows, exact sums, eigenvalues (falling) and unit eigenvectors as columns, trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(eigenvalue); 0 where the eigenvalue is nothing but rounding."""
        least = len(self.sums) * np.finfo(float).eps * max(self.values.max(initial=0.0), 0.0)
        return np.array([1 / np.sqrt(e) if e > least else 0.0 for e in self.values])


def _whole(col: pa.Array, scale: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the rows that take part, their lengths, and their scaled, floored entries one after the other."""
    lengths = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # null entries become NaN, null rows hold nothing
    row = np.repeat(np.arange(len(col)), lengths)
    good = ~col.is_null().to_numpy(zero_copy_only=False)
    good[row[~np.isfinite(flat)]] = False
    with np.errstate(over="ignore"):
        y = np.clip(np.floor(flat * scale), -LARGEST, LARGEST).astype(np.int64)
    at = np.flatnonzero(good)
    return at, lengths[at], y[good[row]]


def _rows(col: pa.Array, scale: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the rows that take part and their entries as a matrix; missing entries are 0."""
    at, lengths, y = _whole(col, scale)
    if (lengths == width).all():
        return at, y.reshape(len(at), width)
    out = np.zeros((len(at), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = y
    return at, out


def _sum_whole(x: np.ndarray) -> list[int]:
    """Exact sums of columns."""
    if len(x) and float(np.abs(x).max(initial=0)) * len(x) >= 2.0**62:
        x = x.astype(object)
    return [int(v) for v in x.sum(axis=0)]


def _merged(df: DataFrame, one: Callable[[Iterator[pa.Array]], object], add: Callable[[object, object], object]):
    """``one`` of each task's vectors, merged by ``treeAggregate``; None without tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(one(b.column(0) for b in batches))], pa.binary())], ["part"])

    parts = df.mapInArrow(run, "part binary").rdd
    depth, tasks = 2, parts.getNumPartitions()
    while tasks ** (1 / depth) > MEET:
        depth += 1
    both = lambda a, b: b if a is None else a if b is None else add(a, b)
    return parts.treeAggregate(None, lambda a, r: both(a, pickle.loads(r["part"])), both, depth)


def _add_lists(a: list[int], b: list[int]) -> list[int]:
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    return [x + y for x, y in zip(a, b + [0] * (len(a) - len(b)))]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, whole and exact."""
    most = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums), default=0)
    if most < 2**62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def fit(vectors: DataFrame, vec_col: str = "embedding", scale: float = SCALE, offset: int = OFFSET) -> Whitening | None:
    """The covariance's eigenvectors over all rows that take part; None if there is none or none has an entry."""
    only = vectors.select(F.col(vec_col).alias("v"))

    def sums_of(cols: Iterator[pa.Array]) -> tuple[int, list[int]]:
        n, sums = 0, []
        for col in cols:
            at, lengths, _ = _whole(col, scale)
            n += len(at)
            sums = _add_lists(sums, _sum_whole(_rows(col, scale, int(lengths.max(initial=0)))[1]))
        return n, sums

    n, raw = _merged(only, sums_of, lambda a, b: (a[0] + b[0], _add_lists(a[1], b[1]))) or (0, [])
    width = len(raw)
    if not n or not width:
        return None

    def outer(cols: Iterator[pa.Array]) -> np.ndarray:
        total, step = np.zeros((width, width)), max(1, BLOCK // width)
        for col in cols:
            _, x = _rows(col, scale, width)
            for k in range(0, len(x), step):
                c = _centred(x[k : k + step], n, raw).astype(np.float64) / n
                total += c.T @ c
        return total

    cov = _merged(only, outer, lambda a, b: a + b) / n
    values, vecs = np.linalg.eigh((cov + cov.T) / 2)
    # The offset moves every row and the mean alike.
    return Whitening(n, [s + n * offset for s in raw], values[::-1], np.ascontiguousarray(vecs[:, ::-1]), float(np.trace(cov)))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """(id, n, deviation, whitened, explained, identity_error): one row for each vector that takes part.

    An entry c becomes x = floor(scale * c) + offset. ``whitened`` holds the
    first ``components`` (or as many as there are dimensions) centred
    projections over the root of their eigenvalue, ``explained`` the
    eigenvalues over the trace. ``deviation`` is the sum of (n * x - S)**2,
    null where it does not fit a long. ``identity_error`` is the largest entry
    of the whitened rows' covariance minus the identity.

    Vectors that are null, or hold null or non-finite entries, take no part.
    Of vectors of several lengths, missing entries count as 0. Null ids and
    repeated rows are rows of their own; other columns are not looked at.
    Components without variance have null in ``whitened`` and take no part in
    ``identity_error``; without any variance ``explained`` and
    ``identity_error`` are null. Empty tables, and tables of vectors without
    entries, give no rows. Entries above 2**52 after scaling count as 2**52.
    """
    spark = vectors.sparkSession
    schema = "id long, n long, deviation long, whitened array<double>, explained array<double>, identity_error double"
    slim = vectors.select(F.col(vec_col).alias("v"), F.col(id_col).cast("long").alias("id"))
    model = fit(slim, "v", scale, offset)
    if model is None:
        return spark.createDataFrame([], schema)
    k = min(components, len(model.sums))
    n, raw, width = model.n, [s - model.n * offset for s in model.sums], len(model.sums)
    kept = model.scales[:k] > 0
    base = spark.sparkContext.broadcast((model.vectors[:, :k], model.scales[:k]))  # width * components numbers

    def project(c: np.ndarray) -> np.ndarray:
        vecs, scales = base.value
        return (c.astype(np.float64) / n) @ vecs * scales

    def gram(cols: Iterator[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
        # The rows are centred before they are projected; what rounding leaves of a mean goes below.
        s, p, step = np.zeros(k), np.zeros((k, k)), max(1, BLOCK // width)
        for col in cols:
            _, x = _rows(col, scale, width)
            for at in range(0, len(x), step):
                w = project(_centred(x[at : at + step], n, raw))
                s, p = s + w.sum(axis=0), p + w.T @ w
        return s, p

    s, p = _merged(slim.select("v"), gram, lambda a, b: (a[0] + b[0], a[1] + b[1]))
    off = np.abs(p / n - np.outer(s / n, s / n) - np.eye(k))[np.ix_(kept, kept)]
    error = float(off.max()) if off.size else None
    explained = [float(e / model.trace) if kept.any() else None for e in model.values[:k]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, BLOCK // width)
        for b in batches:
            at, x = _rows(b.column(0), scale, width)
            for i in range(0, len(at), step):
                rows, c = at[i : i + step], _centred(x[i : i + step], n, raw)
                if c.dtype != object and float(np.abs(c).max(initial=0)) ** 2 * width >= 2.0**62:
                    c = c.astype(object)
                dev = [d if d < 2**63 else None for d in map(int, (c * c).sum(axis=1))]
                w = project(c)
                flat = pa.array(w.ravel(), pa.float64(), mask=np.tile(~kept, len(rows)))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), n)), pa.array(dev, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (len(rows) + 1) * k, k, dtype=np.int32)), flat),
                        pa.array([explained] * len(rows), pa.list_(pa.float64())), pa.array([error] * len(rows), pa.float64()),
                    ],
                    ["id", "n", "deviation", "whitened", "explained", "identity_error"],
                )

    return slim.mapInArrow(run, schema)


def by_component(rows: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row for each vector and component, numbered from 1."""
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c")
    out = rows.select(F.col("id").alias(id_col), "n", "deviation", "identity_error", each)
    return out.select(id_col, (F.col("at") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.whitened").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
