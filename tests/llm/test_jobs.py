"""Linking rows takes few jobs, as every job and task stays in the driver's memory."""

from pyspark.sql import functions as F

from tempograph.llm import common, jaccard_join


def components(spark, pairs, n):
    links = spark.createDataFrame(pairs, "a long, b long")
    nodes = spark.range(n).select(F.col("id").alias("uid"), F.struct((n - F.col("id")).alias("k"), F.col("id").alias("uid")).alias("rank"))
    return {r["uid"]: r["label"]["uid"] for r in jaccard_join.connected_components(links, nodes).collect()}


def test_a_round_of_linking_takes_one_checkpoint_and_one_count(spark, monkeypatch):
    made, counted = [], []
    monkeypatch.setattr(common, "cut", lambda df, real=common.cut: made.append(1) or real(df))
    monkeypatch.setattr(jaccard_join, "hot_keys", lambda df, keys, real=jaccard_join.hot_keys: counted.append(1) or real(df, keys))
    actions = []
    frame = type(spark.range(1))
    monkeypatch.setattr(frame, "count", lambda self, real=frame.count: actions.append(1) or real(self))
    chain = [(k, k + 1) for k in range(40)] + [(50, 60), (60, 50), (70, 70)]
    got = components(spark, chain, 80)
    assert got == {k: 40 for k in range(41)} | {50: 60, 60: 60, 70: 70}
    # hubs once, roots once after each round but the last
    assert not actions and len(counted) == len(made)


def test_rows_are_seen_while_they_are_written(spark):
    rows = spark.range(100).repartition(3)
    for which, some in (("true", True), ("id > 98", True), ("id > 99", False), ("null", False)):
        out, got = common.cut_some(rows, which)
        assert got is some and out.count() == 100
    for none in (rows.filter("id < 0"), rows.groupBy("id").count().filter("id < 0"), spark.createDataFrame([], "id long"), rows.filter("id < 0").join(rows, "id")):
        assert common.cut_some(none)[1] is False and common.cut_some(none)[0].count() == 0
