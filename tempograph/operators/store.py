"""Result-store operators: keyed upserts, resume, rankings, pivots, grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

VERDICTS = ("PASS", "FAIL", "INCONCLUSIVE", "PENDING")


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last row of each key in arrival order."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(new, keys, "left_anti").unionByName(new)


def upsert_verdicts(log: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert by test id; unknown verdicts fail the query."""
    ok = F.assert_true(F.col("verdict").isin(*VERDICTS), F.lit("unknown verdict"))
    return upsert(log, new.filter(ok.isNull()), ["test_id"])


def has_open(log: DataFrame | None) -> bool:
    """Is a verdict pending or failed? A missing log counts as open."""
    return log is None or bool(log.filter(F.col("verdict").isin("PENDING", "FAIL")).limit(1).count())


def remaining(plan: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return plan.join(done, keys, "left_anti")


def seed_summary(df: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(metric), 6).alias("mean"), F.round(F.stddev_samp(metric), 6).alias("std"))


def champions(df: DataFrame, keys: list[str], metrics: list[str], top: int) -> DataFrame:
    """Union of the ``top`` groups by each metric's mean, ties by name, in first-seen order."""
    out = None
    m = df.groupBy(*keys).agg(*[F.round(F.avg(c), 9).alias(c) for c in metrics])
    for i, c in enumerate(metrics):
        r = m.select(*keys, F.row_number().over(Window.orderBy(F.desc(c), *keys)).alias("k")).filter(F.col("k") <= top).withColumn("k", F.col("k") + i * top)
        out = r if out is None else out.unionByName(r)
    return out.groupBy(*keys).agg(F.min("k").alias("place"))


def config_grid(spark: SparkSession) -> DataFrame:
    """Hops x direction x injection x seed x variation, without early injection where there is no topology."""
    g = spark.range(1).select(F.explode(F.array(*[F.lit(k).cast("long") for k in (1, 2, 3)])).alias("k"))
    for name, values in (("dir", ["F", "T"]), ("topo", [False, True]), ("injection", ["early", "late"])):
        g = g.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    g = g.filter("not (injection = 'early' and not topo)")
    g = g.withColumn("seed", F.explode(F.array(*[F.lit(x).cast("long") for x in (42, 43, 44)])))
    return g.withColumn("variation", F.explode(F.array(F.lit("Base"), F.lit("PCA"))))
