"""File sources and sinks with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_positional_csv(spark: SparkSession, path: str, n_features: int) -> DataFrame:
    """Headerless node file: id, step, then features, which are packed into one array."""
    schema = T.StructType([T.StructField("txid", T.LongType()), T.StructField("tau", T.IntegerType()), *(T.StructField(f"f{i}", T.DoubleType()) for i in range(n_features))])
    df = spark.read.schema(schema).csv(path, header=False)
    return df.select("txid", "tau", F.array(*[f"f{i}" for i in range(n_features)]).alias("features"))


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, missing: str | None = None) -> DataFrame:
    """Headered file; without ``missing`` literal N/A and None stay text."""
    reader = spark.read.schema(schema).option("header", True)
    return (reader.option("nullValue", missing) if missing is not None else reader).csv(path)


def find_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Paths below ``root`` whose file name matches a glob; raises if there is none."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path")
    if not df.limit(1).count():
        raise FileNotFoundError(f"{name} below {root}")
    return df


def latest_file(spark: SparkSession, root: str, name: str) -> str:
    """Lexicographically last match."""
    return find_files(spark, root, name).agg(F.max("path")).first()[0]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, whole text."""
    return spark.read.text(path, wholetext=True)


def register_catalog(spark: SparkSession, files: dict[str, str]) -> None:
    """Temp views by name over Parquet or CSV files."""
    for name, path in files.items():
        df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.option("header", True).csv(path)
        df.createOrReplaceTempView(name)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in order: missing ones null, others dropped."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append_rows(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append sink with a fixed schema."""
    conform(df, schema).write.mode("append").parquet(path)


def append_csv(df: DataFrame, path: str, schema: T.StructType) -> None:
    """Append to a folder of headered CSV files with a fixed schema; ``read_csv`` reads them as one table."""
    conform(df, schema).write.mode("append").option("header", True).csv(path)


_CACHED: dict[tuple[str, str], DataFrame] = {}


def cached(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table kept by the session after its first use; a new application reads it again."""
    key = spark.sparkContext.applicationId, path
    if key not in _CACHED:
        _CACHED[key] = spark.read.parquet(path).cache()
    return _CACHED[key]


def schema_diff(spark: SparkSession, left: DataFrame, right: DataFrame) -> DataFrame:
    """(side, name, kind) of the columns that only one of two tables has, or has with another type."""
    one, two = (spark.createDataFrame(sorted(d.dtypes), "name string, kind string") for d in (left, right))
    return one.exceptAll(two).select(F.lit("left").alias("side"), "name", "kind").unionAll(two.exceptAll(one).select(F.lit("right").alias("side"), "name", "kind"))


def json_manifest(df: DataFrame) -> DataFrame:
    """One JSON line a row, nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("line"))


def overwrite(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    df.write.mode("overwrite").format(fmt).save(path)


def markdown_rows(df: DataFrame) -> DataFrame:
    """Rows as lines of a markdown table."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
