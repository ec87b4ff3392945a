"""OTLP/JSON requests from text files, a stream of them, or any frame with a text column (Kafka value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulselake.schemas import CORRUPT, REQUESTS


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """One request body per line."""
    return spark.read.text(path)


def stream_requests(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """As ``read_requests`` for files that keep arriving; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(path)


def parse(bodies: DataFrame, signal: str, column: str = "value") -> DataFrame:
    """Adds ``request`` (NULL where the body cannot be decoded) and ``malformed``.

    ``signal`` is metrics, logs or traces. A body counts as malformed when it is no JSON, has a value of
    the wrong kind, is no JSON object, or when anything but white space follows the object, be it a text that would
    close the list the body is parsed in and open another.
    """
    whole = T.StructType(
        [T.StructField("bodies", T.ArrayType(REQUESTS[signal])), T.StructField(CORRUPT, T.StringType(), True)]
    )
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    body = F.col(column).cast("string")
    # Exploding a one-element array keeps the parse in one place: as a plain projection, from_json would be
    # copied into every filter and field access above it and run once for each.
    # The parser stops after the first value of a text; as the only element of an array, the body must end there.
    listed = F.concat(F.lit('{"bodies":['), body, F.lit("]}"))
    parsed = bodies.withColumn("request", F.explode(F.array(F.from_json(listed, whole, options))))
    one = (F.size("request.bodies") == 1) & F.get("request.bodies", F.lit(0)).isNotNull()
    alone = F.json_object_keys(listed) == F.array(F.lit("bodies"))
    good = one & F.col(f"request.{CORRUPT}").isNull() & F.startswith(F.ltrim(body, F.lit(" \t\r\n")), F.lit("{")) & alone
    return parsed.withColumn("malformed", ~F.coalesce(good, F.lit(False))).withColumn(
        "request", F.get("request.bodies", F.lit(0))
    )


def well_formed(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.col("malformed"))


def quarantine(parsed: DataFrame, column: str = "value") -> DataFrame:
    """Bodies that could not be decoded, as text."""
    return parsed.where(F.col("malformed")).select(F.col(column).cast("string").alias("body"))
