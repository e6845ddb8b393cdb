"""The keyed table: reruns, two writers, a lost writer, what readers see."""

import pytest

from tempograph.sources.keyed import Conflict, KeyedTable

KIND = "k long, at long, v string"


@pytest.fixture
def table(spark, tmp_path):
    return KeyedTable(spark, f"file://{tmp_path}/t", ["k"], buckets=4)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_upserts_and_versions(spark, table):
    assert table.read() is None and table.versions() == []
    assert table.upsert(spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")], KIND), ["at"]) == 1
    assert table.upsert(spark.createDataFrame([(2, 5, "e"), (2, 4, "d"), (3, 1, "f"), (None, 2, "m")], KIND), ["at"]) == 2
    assert rows(table.read()) == sorted([(1, 2, "b"), (2, 5, "e"), (3, 1, "f"), (None, 2, "m")], key=str)
    assert rows(table.read(1)) == sorted([(1, 2, "b"), (2, 1, "c"), (None, 1, "n")], key=str)  # a version stays as it was
    assert table.upsert(spark.createDataFrame([], KIND), ["at"]) == 2
    assert table.upsert(spark.createDataFrame([(9,)], "k long"), ["k"]) == 3 and (9, None, None) in rows(table.read())
    with pytest.raises(ValueError, match="not in the table"):
        table.upsert(spark.createDataFrame([(1, 2)], "k long, other long"), ["k"])


def test_only_touched_buckets_are_rewritten(spark, table):
    table.upsert(spark.createDataFrame([(i, 0, "x") for i in range(40)], KIND), ["at"])
    before = table.manifest()["buckets"]
    table.upsert(spark.createDataFrame([(7, 1, "y")], KIND), ["at"])
    after = table.manifest()["buckets"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(after) == 4 and table.read().count() == 40


def test_rerun_of_a_batch(spark, table):
    b = spark.createDataFrame([(1, 1, "a")], KIND)
    assert table.upsert(b, ["at"], "one") == 1 and table.upsert(b, ["at"], "one") == 1
    table.upsert(spark.createDataFrame([(1, 2, "late")], KIND), ["at"], "two")
    assert table.upsert(b, ["at"], "one") == 2 and rows(table.read()) == [(1, 2, "late")]


def test_overtaken_writer_merges_again(spark, table):
    table.upsert(spark.createDataFrame([(1, 0, "a")], KIND), ["at"])
    real, other = table.publish, KeyedTable(spark, table.path, ["k"], buckets=4)

    def late(manifest):
        table.publish = real
        other.upsert(spark.createDataFrame([(1, 0, "theirs"), (5, 0, "theirs")], KIND), ["at"])
        return real(manifest)

    table.publish = late
    assert table.upsert(spark.createDataFrame([(2, 0, "mine")], KIND), ["at"]) == 3
    assert rows(table.read()) == [(1, 0, "theirs"), (2, 0, "mine"), (5, 0, "theirs")]
    table.publish = lambda manifest: False
    with pytest.raises(Conflict):
        table.upsert(spark.createDataFrame([(3, 0, "never")], KIND), ["at"])
    assert not real(table.manifest() | {"version": 3}) and rows(table.read(3)) == rows(table.read())


def test_lost_writer_leaves_no_trace(spark, table):
    table.upsert(spark.createDataFrame([(1, 0, "a")], KIND), ["at"])

    def lost(manifest):
        raise OSError("gone")

    real, table.publish = table.publish, lost
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, 1, "b")], KIND), ["at"])
    table.publish = real
    assert rows(table.read()) == [(1, 0, "a")] and table.vacuum(older_seconds=3600) == []
    assert len(table.vacuum(older_seconds=-60)) == 1 and rows(table.read()) == [(1, 0, "a")]
