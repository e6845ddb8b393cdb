"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


#: Bytes (of words and about 150 for each entry) after which a worker's table of words met before starts anew.
MEMO_BYTES = 48 << 20


#: Rows in an Arrow batch of whole texts or sets.
BATCH_ROWS = 1024


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Queries that run inside exchange Arrow batches of at most so many rows, so that whole texts fill neither a task's buffers nor its worker's."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors share.

    ``spark.checkpoint.dir`` names it. Only in local mode, where driver and
    executors are one process, a folder of this machine stands in if it is unset.
    """
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="tempograph-")
    spark.sparkContext.setCheckpointDir(made)
    return made


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_some(df: DataFrame, which: str | Column = "true") -> tuple[DataFrame, bool]:
    """``cut``, and whether there are rows (for which ``which`` holds), seen while they are written and without a job of its own."""
    seen = Observation()
    out = cut(df.observe(seen, F.count_if(F.expr(which) if isinstance(which, str) else which).alias("n")))
    return out, bool(seen.get["n"])


def free(*frames: DataFrame) -> None:
    """Delete the checkpoints behind frames from ``cut``, or projections of them, that nothing reads any more."""
    for df in frames:
        node = df._jdf.queryExecution().analyzed()
        while node.children().size() == 1:
            node = node.children().apply(0)
        file = node.rdd().getCheckpointFile()
        if file.isDefined():
            delete(df.sparkSession, file.get())


#: Plan nodes whose rows are the same, in the same partitions and order, whenever they are computed.
_STABLE = {"Project", "Filter", "SubqueryAlias", "LogicalRelation", "LocalRelation", "LogicalRDD", "Range", "Sample"}


def stable(df: DataFrame) -> DataFrame:
    """``df``, or its checkpoint if a second computation could number its rows differently.

    Row numbers (``monotonically_increasing_id``) that are computed twice agree
    over files and checkpoints, also on another executor; after a shuffle they
    need not.
    """
    waiting = [df._jdf.queryExecution().optimizedPlan()]
    while waiting:
        node = waiting.pop()
        if node.nodeName().split(" ")[0] not in _STABLE:
            return cut(df)
        children = node.children()
        waiting += [children.apply(i) for i in range(children.size())]
    return df


#: Keys with more rows than this are hot; the most frequent HOT_KEYS of them are spread, which affects balance only.
HOT_ROWS, HOT_KEYS, SALTS = 500, 1000, 32


def hot_keys(df: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the keys with very many rows in ``df``, HOT_KEYS at most; counts are combined before the shuffle."""
    counts = df.groupBy(F.xxhash64(*keys).alias("__h")).agg(F.count("*").alias("__n")).filter(F.col("__n") > HOT_ROWS)
    return [r["__h"] for r in counts.orderBy(F.desc("__n")).limit(HOT_KEYS).select("__h").collect()]


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: list[str], how: str = "inner", hot: list[int] | None = None, null_safe: bool = False) -> DataFrame:
    """``left`` joined with ``right`` (few rows a key) on ``keys``; hot keys' rows are dealt to SALTS tasks by ``by``.

    ``left`` is counted first unless ``hot`` is given, so it should be a
    checkpoint or cheap. Keys have equal names and types on both sides and come
    once; with ``null_safe`` null meets null.
    """
    hot = hot_keys(left, keys) if hot is None else hot
    is_hot = F.xxhash64(*keys).isin(hot) if hot else F.lit(False)
    a = left.withColumn("__salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int")).otherwise(0))
    b = right.withColumn("__salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    on = [*keys, "__salt"]
    if not null_safe:
        return a.join(b, on, how).drop("__salt")
    b = b.withColumnsRenamed({k: f"__r_{k}" for k in on})
    cond = F.lit(True)
    for k in on:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    return a.join(b, cond, how).drop("__salt", *[f"__r_{k}" for k in on])


def number_in_order(rows: DataFrame, keys: list[str], out: str, weight: str | None = None) -> DataFrame:
    """Number rows from 0 in the order of their distinct keys: range partitions, then offsets.

    With ``weight`` the number is the sum of that column over all rows before.
    """
    w = F.lit(1) if weight is None else F.col(weight)
    parts = cut(rows.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    sums = {r["__part"]: r["n"] for r in parts.groupBy("__part").agg(F.sum(w).cast("long").alias("n")).collect()}  # one row a partition
    order = sorted(sums)
    before = dict(zip(order, np.r_[0, np.cumsum([sums[p] for p in order])].tolist()))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in it:
            if not b.num_rows:
                continue
            if at is None:
                at = before[b.column(b.num_columns - 1)[0].as_py()]
            n = np.ones(b.num_rows, np.int64) if weight is None else b.column(weight).to_numpy()
            upto = at + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(upto - n)], [*b.schema.names[:-1], out])
            at = int(upto[-1])

    schema = parts.drop("__part").withColumn(out, F.lit(0).cast("long")).schema
    return parts.sortWithinPartitions(*keys).mapInArrow(run, schema)


def no_clash(df: DataFrame, names: list[str]) -> None:
    """Raise if a column that an operator appends is there already (names compare without case)."""
    have = {c.lower() for c in df.columns}
    if bad := [n for n in names if n.lower() in have]:
        raise ValueError(f"column {bad[0]} exists; rename it first")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a path through Hadoop's file systems; missing paths are fine."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def fold(id_col: str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % parts


def word_count(c: str = "text") -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(F.col(c), F.lit(WORD)), F.lit(0)).cast("long")


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have yet (names compare without case)."""
    have = {c.lower() for c in df.columns}
    name = base
    while name.lower() in have:
        name += "_"
    return name
