"""Running sums and exact quantiles of groups of any size.

Rows are partitioned by ranges of (group, order). Each range adds up its own
rows, a group's ranges give each other their offsets, and a window then runs
in one range of one group only, so no task holds a group.
"""

from __future__ import annotations

import tempfile
from collections.abc import Mapping

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def can_checkpoint(df: DataFrame) -> bool:
    """Has the session a folder for checkpoints? One that only the settings name is put to use."""
    sc = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if folder and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().isDefined()


def settle(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by a checkpoint in the folder that ``spark.checkpoint.dir`` names.

    Where none is named, a folder of this machine stands in if driver and
    executors are one process; on a cluster that is an error.
    """
    if not can_checkpoint(df):
        sc = df.sparkSession.sparkContext
        if sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tempograph-"))
    return df.checkpoint()


def release(*settled: DataFrame) -> None:
    """Delete the checkpoints of frames from ``settle`` that nothing reads any more."""
    for df in settled:
        spark = df.sparkSession
        file = df._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
        if file.isDefined():
            path = spark._jvm.org.apache.hadoop.fs.Path(file.get())
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def same(a: DataFrame, b: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, null to null; the columns of ``a``, then those of ``b`` without its keys."""
    other = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in b.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    return a.join(other, on, how).drop(*[f"__{k}" for k in keys])


def running(df: DataFrame, by: list[str], order: list[Column], sums: list[str]) -> DataFrame:
    """``df`` with ``cum_c``, the sum of column c over the group's rows up to and with this one, and ``all_c``, over the whole group.

    Rows that are equal in ``by`` and ``order`` are counted in any sequence.
    The ranges are persisted (memory and disk), as both the sums and the rows
    read them; a lost range is computed anew with the same bounds.
    """
    ranges = df.repartitionByRange(*by, *order).withColumn("__range", F.spark_partition_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = ranges.groupBy(*by, "__range").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    group = Window.partitionBy(*by)  # one row a range
    before = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offset = part.select(*by, "__range", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums], *[F.sum(f"__{c}").over(group).alias(f"all_{c}") for c in sums])
    own = Window.partitionBy(*by, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = same(ranges, offset, [*by, "__range"]).withColumns({f"cum_{c}": F.sum(c).over(own) + F.col(f"__before_{c}") for c in sums})
    return out.drop("__range", *[f"__before_{c}" for c in sums])


def quantiles(counts: DataFrame, by: list[str], value: str, probs: Mapping[str, float | Column]) -> DataFrame:
    """Linear quantiles, exact, of the distinct values of each group with their counts ``n``; all in one pass.

    A probability may be a column of ``by``.
    """
    r = running(counts, by, [F.col(value)], ["n"])
    picks = {}
    for name, q in probs.items():
        at = (F.col("all_n") - 1) * (q if isinstance(q, Column) else F.lit(q))
        holds = lambda i: (F.col("cum_n") - F.col("n") <= i) & (i < F.col("cum_n"))
        lo, hi = (F.max(F.when(holds(f(at)), F.col(value))) for f in (F.floor, F.ceil))
        picks[name] = lo + F.max(at - F.floor(at)) * (hi - lo)
    return r.groupBy(*by).agg(*[c.alias(k) for k, c in picks.items()])
