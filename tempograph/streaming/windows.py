"""Event-time windows, late data, keyed upserts and smoothed state on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tempograph.operators.stats import step_moments
from tempograph.sources.keyed import KeyedTable


def event_stream(spark: SparkSession, path: str, late: str = "1 day") -> DataFrame:
    """Events as a stream; the time stamp gets a zone, which watermarks need."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(df: DataFrame, length: str = "1 day") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), length)
    return df.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, length: str = "2 days", slide: str = "1 day") -> DataFrame:
    w = F.window(F.col("ts").cast("timestamp"), length, slide)
    return df.groupBy(w.alias("w")).agg(F.count("*").alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    w = F.session_window(F.col("ts").cast("timestamp"), gap)
    return df.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


def first_by_key(stream: DataFrame, key: str) -> DataFrame:
    """Drop repeats of a key inside the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def delayed_labels(events: DataFrame, labels: DataFrame, key: str, most: str = "7 days") -> DataFrame:
    """Stream-stream join of events with labels that arrive up to ``most`` later."""
    lab = labels.select(F.col(key).alias("l_key"), F.col("ts").alias("l_ts"), "label")
    return events.join(lab, F.expr(f"{key} = l_key and l_ts >= ts and l_ts <= ts + interval {most}"))


def smoothed(stream: DataFrame, key: str, alpha: float = 0.3) -> DataFrame:
    """Exponential average of ``value`` for each key, kept as state between batches."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        h = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        for v in rows["value"]:
            h = v if h is None else alpha * v + (1 - alpha) * h
        state.update((h,))
        yield pd.DataFrame({key: [k[0]], "ema": [h], "n": [len(rows)]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} long, ema double, n long", "h double", "update", GroupStateTimeout.NoTimeout)


def upsert_sink(stream: DataFrame, path: str, keys: list[str], checkpoint: str, order: list[str]):
    """Query that keeps a ``KeyedTable`` current, the last row of a key by ``order`` in each batch.

    A batch rewrites the buckets it touches and is known by its number, so a
    repeated batch changes nothing.
    """
    table = KeyedTable(stream.sparkSession, path, keys)

    def merge(batch: DataFrame, number: int) -> None:
        table.upsert(batch, order, f"stream-{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def moments_sink(stream: DataFrame, path: str, width: int, checkpoint: str):
    """Query that adds each batch's mergeable sums a step as one file of its number; ``read_moments`` merges them.

    A repeated batch replaces its own file, so nothing is counted twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        step_moments(batch, width).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_moments(spark: SparkSession, path: str) -> DataFrame:
    m = spark.read.parquet(path).drop("batch")
    return m.groupBy("tau").agg(*[F.sum(c).alias(c) for c in m.columns if c != "tau"])
