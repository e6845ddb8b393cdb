import datetime as dt
import math

from tempograph.sources.keyed import KeyedTable
from tempograph.streaming import windows

START = dt.datetime(2024, 1, 1)


def _write(spark, path, rows, kind):
    spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(path)


def _drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in df.sparkSession.table(name).collect()]


def test_first_of_each_key(spark, tmp_path):
    rows = [(k, START + dt.timedelta(minutes=i), float(i)) for i, k in enumerate([1, 2, 1, 3, 2])]
    _write(spark, str(tmp_path / "in"), rows, "user_id long, ts timestamp_ntz, value double")
    got = _drain(windows.first_by_key(windows.event_stream(spark, str(tmp_path / "in")), "user_id").select("user_id", "value"), "first")
    assert sorted(k for k, _ in got) == [1, 2, 3]


def test_labels_that_come_late(spark, tmp_path):
    _write(spark, str(tmp_path / "e"), [(1, START), (2, START)], "user_id long, ts timestamp_ntz")
    late = [(1, START + dt.timedelta(days=6), 1), (2, START + dt.timedelta(days=8), 0), (2, START - dt.timedelta(days=1), 0)]
    _write(spark, str(tmp_path / "l"), late, "user_id long, ts timestamp_ntz, label int")
    read = lambda p: windows.event_stream(spark, str(tmp_path / p), "10 days")
    got = _drain(windows.delayed_labels(read("e"), read("l").select("user_id", "ts", "label"), "user_id").select("user_id", "label"), "late")
    assert got == [(1, 1)]


def test_smoothed_state_outlives_a_batch(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "user_id long, ts timestamp_ntz, value double"
    for i in (1.0, 2.0, 4.0):
        _write(spark, path, [(7, START + dt.timedelta(minutes=i), i)], kind)
    s = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(path)
    got = _drain(windows.smoothed(s, "user_id", 0.5), "smooth", "update")
    assert len(got) == 3 and math.isclose(got[-1][1], 0.5 * 4 + 0.5 * (0.5 * 2 + 0.5 * 1)) and got[-1][2] == 1


def test_upsert_keeps_the_last_row(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "k long, at long, v string"
    _write(spark, path, [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], kind)
    for step in range(2):
        s = spark.readStream.schema(kind).parquet(path)
        windows.upsert_sink(s, str(tmp_path / "out"), ["k"], str(tmp_path / "cp"), ["at"]).awaitTermination()
        if step == 0:
            _write(spark, path, [(2, 5, "e"), (2, 4, "d"), (3, 1, "f")], kind)
    got = sorted(tuple(r) for r in KeyedTable(spark, str(tmp_path / "out"), ["k"]).read().collect())
    assert got == [(1, 2, "b"), (2, 5, "e"), (3, 1, "f")]


def test_moments_add_up_over_batches(spark, tmp_path):
    path, kind = str(tmp_path / "in"), "tau int, features array<double>"
    for rows in ([(1, [1.0, 2.0]), (2, [3.0, 4.0])], [(1, [5.0, 6.0])]):
        _write(spark, path, rows, kind)
        windows.moments_sink(spark.readStream.schema(kind).parquet(path), str(tmp_path / "m"), 2, str(tmp_path / "cp")).awaitTermination()
    got = {r["tau"]: r for r in windows.read_moments(spark, str(tmp_path / "m")).collect()}
    assert (got[1]["n"], got[1]["s0"], got[1]["p0_1"], got[1]["p1_1"]) == (2, 6.0, 32.0, 40.0) and got[2]["n"] == 1
