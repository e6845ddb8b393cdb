"""Whole texts reach the join's workers in small Arrow batches, whatever the session's own."""

import pytest

from tempograph.llm import jaccard_join
from tempograph.llm.common import BATCH_ROWS

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def test_join_runs_in_small_batches(spark, monkeypatch):
    docs = spark.range(0, 2 * BATCH_ROWS + 10, numPartitions=1).selectExpr("id as doc_id", "concat('a b c ', id) as text")
    sizes = spark.sparkContext.accumulator(0)
    before, real = spark.conf.get(KEY), jaccard_join._Join._info

    def info(self):
        def run(batches):
            for b in batches:
                if b.num_rows > BATCH_ROWS:
                    sizes.add(1)
                yield b

        self.base.mapInArrow(run, self.base.schema).write.format("noop").mode("overwrite").save()
        return real(self)

    monkeypatch.setattr(jaccard_join._Join, "_info", info)
    out = jaccard_join.jaccard_components(docs, words=2)
    assert sizes.value == 0 and out.count() == 2 * BATCH_ROWS + 10
    assert spark.conf.get(KEY) == before


def test_own_batch_size_comes_back_after_a_failure(spark, monkeypatch):
    before = spark.conf.get(KEY)

    def fail(self):
        assert spark.conf.get(KEY) == "100"
        raise ValueError("stop")

    monkeypatch.setattr(jaccard_join._Join, "_run", fail)
    spark.conf.set(KEY, "100")
    try:
        with pytest.raises(ValueError, match="stop"):
            jaccard_join.jaccard_components(spark.createDataFrame([(1, "a")], "doc_id long, text string"))
        assert spark.conf.get(KEY) == "100"
    finally:
        spark.conf.set(KEY, before)
