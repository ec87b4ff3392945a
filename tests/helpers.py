"""Small frames for the operators."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

BASE = datetime(2024, 1, 1, tzinfo=timezone.utc)
BASE_NANOS = 1_704_067_200_000_000_000
SECOND = 1_000_000_000


def points(spark, rows):
    """Rows of (offset seconds, value, labels)."""
    data = [(BASE_NANOS + int(s * SECOND), float(v), labels) for s, v, labels in rows]
    df = spark.createDataFrame(data, "time_unix_nano bigint, value double, labels map<string,string>")
    return df.select(
        "time_unix_nano",
        F.timestamp_micros((F.col("time_unix_nano") / 1000).cast("bigint")).alias("ts"),
        F.col("labels")["__name__"].alias("name"),
        F.col("labels")["service.name"].alias("service"),
        "value",
        F.lit("gauge").alias("point_kind"),
        "labels",
    )


def logs(spark, rows):
    """Rows of (offset seconds, level, message, labels)."""
    data = [(BASE_NANOS + int(s * SECOND), level, m, labels) for s, level, m, labels in rows]
    df = spark.createDataFrame(
        data, "time_unix_nano bigint, level string, message string, labels map<string,string>"
    )
    return df.withColumn("ts", F.timestamp_micros((F.col("time_unix_nano") / 1000).cast("bigint")))


def iso(seconds):
    return (BASE + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
