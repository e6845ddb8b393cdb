"""The temporal transaction graph, derived from the event table.

Node: an event. Step ``tau`` (1..49) from the time stamp. An event links to the
next and next-but-one event of its user in the same step. Every key carries tau,
so no operator needs a loop over steps.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STEPS = 49
TRAIN_END, VAL_END, SHOCK = 26, 34, 43


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def step_of(ts: str = "ts") -> Column:
    return F.expr(f"CAST(timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', {ts}) * 49 div 2592000000000 + 1 AS INT)")


def label_of(kind: str = "event_type") -> Column:
    """Ternary label: 1 illicit, 0 licit, -1 unknown."""
    c = F.col(kind)
    return F.when(c == "error", 1).when(c.isin("purchase", "signup"), 0).otherwise(-1)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("txid"), step_of().alias("tau"), "user_id", "value", label_of().alias("label"), "ts")


def edges_of(n: DataFrame) -> DataFrame:
    w = Window.partitionBy("user_id", "tau").orderBy("ts", "txid")
    ahead = n.select("tau", F.col("txid").alias("src"), F.array(F.lead("txid", 1).over(w), F.lead("txid", 2).over(w)).alias("d"))
    return ahead.select("tau", "src", F.explode("d").alias("dst")).filter(F.col("dst").isNotNull())


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges_of(nodes(spark, sf_dir))


def dirty_edges(e: DataFrame) -> DataFrame:
    """With duplicates, reciprocal edges and self-loops."""
    out = e.unionByName(e.filter("src % 10 = 0"))
    out = out.unionByName(e.filter("src % 7 = 0").select("tau", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return out.unionByName(e.filter("src % 13 = 0").select("tau", "src", F.col("src").alias("dst")))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tau, txid, label, features[4])."""
    e = table(spark, sf_dir, "events")
    tau = step_of()
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts)")
    into = (micros * 49 % 2592000000000) / 49.0 / 1e6
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(tau.alias("tau"), F.col("event_id").alias("txid"), label_of().alias("label"), F.array(F.col("value"), (F.col("user_id") % 10).cast("double"), k, into).alias("features"))


def regime(tau: str = "tau", shock: int = SHOCK) -> Column:
    return F.when(F.col(tau) < shock, "pre_shock").when(F.col(tau) == shock, "shock").otherwise("recovery")


def split(tau: str = "tau") -> Column:
    return F.when(F.col(tau) <= TRAIN_END, "train").when(F.col(tau) <= VAL_END, "val").otherwise("test")
