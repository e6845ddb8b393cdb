"""Session builder with the settings the operators rely on."""

from pyspark.sql import SparkSession


def session(app: str = "tempograph", **conf: str) -> SparkSession:
    """UTC session with adaptive execution (coalescing and skew joins)."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC")
    b = b.config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
