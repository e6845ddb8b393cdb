import json

import pytest
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tempograph.operators import store
from tempograph.plans import models
from tempograph.sources import files


def test_positional_csv(spark, tmp_path):
    (tmp_path / "n.csv").write_text("11,1,0.5,2\n12,3,,4\n")
    got = files.read_positional_csv(spark, str(tmp_path / "n.csv"), 2).orderBy("txid").collect()
    assert [tuple(r) for r in got] == [(11, 1, [0.5, 2.0]), (12, 3, [None, 4.0])]


def test_headered_csv_and_missing(spark, tmp_path):
    (tmp_path / "a.csv").write_text("name,x\nN/A,1\nb,N/A\n")
    kept = files.read_csv(spark, str(tmp_path / "a.csv"), "name string, x string").collect()
    assert [tuple(r) for r in kept] == [("N/A", "1"), ("b", "N/A")]
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "a.csv"), "name string, x int", "N/A").collect()] == [(None, 1), ("b", None)]


def test_files_by_name(spark, tmp_path):
    for day in ("2020", "2021"):
        (tmp_path / day).mkdir()
        (tmp_path / day / "out.txt").write_text(f"day\n{day}")
    assert files.find_files(spark, str(tmp_path), "out.*").count() == 2
    last = files.latest_file(spark, str(tmp_path), "out.*")
    assert last.endswith("2021/out.txt") and files.read_text(spark, last).first()[0] == "day\n2021"
    with pytest.raises(FileNotFoundError):
        files.find_files(spark, str(tmp_path), "none.*")


def test_append_keeps_the_schema(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.DoubleType())])
    for sink, read in ((files.append_csv, lambda p: files.read_csv(spark, p, schema)), (files.append_rows, spark.read.parquet)):
        path = str(tmp_path / sink.__name__)
        sink(spark.createDataFrame([(1.5, 7, "x")], "v double, k int, more string"), path, schema)
        sink(spark.createDataFrame([(8,)], "k int"), path, schema)
        back = read(path)
        assert back.columns == ["k", "v"] and sorted(tuple(r) for r in back.collect()) == [(7, 1.5), (8, None)]


def test_catalog_cache_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    files.overwrite(spark.range(3), path)
    files.overwrite(spark.range(2), path)
    files.register_catalog(spark, {"small": path})
    assert spark.sql("select count(*) from small").first()[0] == 2
    assert files.cached(spark, path) is files.cached(spark, path) and files.cached(spark, path).is_cached


def test_report_lines(spark):
    df = spark.createDataFrame([("a", None)], "x string, y int")
    assert files.markdown_rows(df).first()["line"] == "| a |  |"
    assert json.loads(files.json_manifest(df).first()["line"]) == {"x": "a", "y": None}


def test_schema_diff(spark):
    one, two = spark.createDataFrame([], "a int, b string"), spark.createDataFrame([], "a long, b string, c int")
    assert sorted(tuple(r) for r in files.schema_diff(spark, one, two).collect()) == [("left", "a", "int"), ("right", "a", "bigint"), ("right", "c", "int")]


def test_open_verdicts(spark):
    log = lambda *v: spark.createDataFrame([(x,) for x in v], "verdict string")
    assert store.has_open(None) and store.has_open(log("PASS", "PENDING")) and not store.has_open(log("PASS"))


def test_model_on_disk(spark, tmp_path):
    df = spark.createDataFrame([([0.0], 0.0), ([1.0], 1.0), ([0.2], 0.0)], "f array<double>, label double").withColumn("vec", array_to_vector(F.col("f")))
    path = str(tmp_path / "m")
    assert models.load_or(spark, LogisticRegressionModel, path, "none") == "none"
    for iterations in (2, 5):
        m = LogisticRegression(featuresCol="vec", maxIter=iterations).fit(df)
        models.save_model(m, path)
    assert models.load_or(spark, LogisticRegressionModel, path).coefficients == m.coefficients
