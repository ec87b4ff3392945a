"""The given tables seen as telemetry, and as OTLP/JSON requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.times import nanos_of_ts

LEVEL_NUMBERS = {"ERROR": 17}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(**pairs: Column) -> Column:
    items = [c for key, value in pairs.items() for c in (F.lit(key.replace("__dot__", ".")), value)]
    return F.create_map(*items)


def user(column: str = "user_id") -> Column:
    return F.concat(F.lit("user-"), F.col(column).cast("string"))


def event_points(spark: SparkSession, sf_dir: str, with_k: bool = False) -> DataFrame:
    """Metric points: the event type is the metric name, a series is an event type of a user."""
    pairs = {"__name__": F.col("event_type"), "service__dot__name": user()}
    if with_k:
        pairs["k"] = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").select(
        "event_id",
        nanos_of_ts(F.col("ts")).alias("time_unix_nano"),
        "ts",
        F.col("event_type").alias("name"),
        user().alias("service"),
        "value",
        F.lit("gauge").alias("point_kind"),
        labels(**pairs).alias("labels"),
    )


def event_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows: the level is the event type in capitals, the message its properties."""
    level = F.upper("event_type")
    return read(spark, sf_dir, "events").select(
        "event_id",
        nanos_of_ts(F.col("ts")).alias("time_unix_nano"),
        "ts",
        level.alias("level"),
        F.when(level == "ERROR", 17).otherwise(9).alias("severity_number"),
        F.col("props").alias("message"),
        user().alias("service"),
        labels(service__dot__name=user()).alias("labels"),
    )


def document_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows: a document is a message, one a second from 2024 on; language and source are labels."""
    seconds = F.lit(1_704_067_200) + F.col("doc_id")
    return read(spark, sf_dir, "documents").select(
        "doc_id",
        (seconds * 1_000_000_000).alias("time_unix_nano"),
        F.timestamp_seconds(seconds).alias("ts"),
        F.lit("INFO").alias("level"),
        F.lit(9).alias("severity_number"),
        F.col("text").alias("message"),
        F.col("source").alias("service"),
        labels(service__dot__name=F.col("source"), lang=F.col("lang")).alias("labels"),
    )


def order_span_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span points: an order is a trace, a line number a span, each line a point of it."""
    trace_id, span_id = F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")
    service = F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string"))
    parent = F.when(F.col("l_linenumber") == 1, "").otherwise("1")
    name = F.concat("l_returnflag", F.lit("/"), "l_linestatus")
    code = F.when(F.col("l_returnflag") == "R", 2).otherwise(1)
    return read(spark, sf_dir, "lineitem").select(
        nanos_of_ts(F.col("l_shipdate")).alias("time_unix_nano"),
        F.col("l_shipdate").alias("ts"),
        trace_id.alias("trace_id"),
        span_id.alias("span_id"),
        parent.alias("parent_span_id"),
        service.alias("service"),
        name.alias("span_name"),
        F.lit("SERVER").alias("span_kind"),
        F.lit("duration").alias("point_type"),
        F.col("l_quantity").alias("value"),
        F.lit(None).cast("string").alias("event_name"),
        F.lit(None).cast("string").alias("event_attr_key"),
        code.alias("status_code"),
        F.lit("").alias("status_message"),
        labels(
            service__dot__name=service, trace__dot__id=trace_id, span__dot__id=span_id,
            span__dot__name=name, span__dot__kind=F.lit("SERVER"), part=F.col("l_partkey").cast("string"),
        ).alias("labels"),
    )


def attribute(key: str, **value: Column) -> Column:
    """An attribute with one kind of value; the other kinds are absent from the JSON."""
    kinds = {"stringValue": "string", "intValue": "bigint", "doubleValue": "double", "boolValue": "boolean"}
    fields = [value.get(k, F.lit(None)).cast(t).alias(k) for k, t in kinds.items()]
    return F.struct(F.lit(key).alias("key"), F.struct(*fields).alias("value"))


def request(resource: list[Column], outer: str, scopes: str, inner: str, items: Column) -> Column:
    """JSON text of a request with one resource and one scope."""
    scope = F.struct(F.struct(F.lit("gallery").alias("name"), F.lit("1").alias("version")).alias("scope"), items.alias(inner))
    body = F.struct(
        F.struct(F.array(*resource).alias("attributes")).alias("resource"), F.array(scope).alias(scopes)
    )
    return F.to_json(F.struct(F.array(body).alias(outer)))


def metric_request(resource: list[Column], name: Column, kind: str, data_point: Column) -> Column:
    metric = F.struct(name.alias("name"), F.struct(F.array(data_point).alias("dataPoints")).alias(kind))
    return request(resource, "resourceMetrics", "scopeMetrics", "metrics", F.array(metric))


def gauge_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A gauge request per event; the point's host replaces the resource's."""
    dp = F.struct(
        F.array(
            attribute("host", stringValue=F.concat(F.lit("host-"), F.col("event_type"))),
            attribute("k", intValue=F.get_json_object("props", "$.k")),
        ).alias("attributes"),
        nanos_of_ts(F.col("ts")).alias("timeUnixNano"),
        F.col("value").alias("asDouble"),
    )
    resource = [attribute("service.name", stringValue=user()), attribute("host", stringValue=F.lit("none"))]
    return read(spark, sf_dir, "events").select(metric_request(resource, F.col("event_type"), "gauge", dp).alias("value"))


def sum_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sum request per event, integers and times as quoted text."""
    dp = F.struct(
        F.array(attribute("k", stringValue=F.get_json_object("props", "$.k"))).alias("attributes"),
        nanos_of_ts(F.col("ts")).cast("string").alias("timeUnixNano"),
        F.floor("value").cast("string").alias("asInt"),
    )
    return read(spark, sf_dir, "events").select(
        metric_request([attribute("service.name", stringValue=user())], F.col("event_type"), "sum", dp).alias("value")
    )


def histogram_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram request per order: three bounds, four counts."""
    key = F.col("o_custkey")
    dp = F.struct(
        F.array(attribute("status", stringValue=F.col("o_orderstatus"))).alias("attributes"),
        nanos_of_ts(F.col("o_orderdate")).alias("timeUnixNano"),
        (key * 3 + 6).alias("count"),
        F.col("o_totalprice").alias("sum"),
        F.array(key, key + 1, key + 2, F.lit(3).cast("bigint")).alias("bucketCounts"),
        F.array(F.lit(0.005), F.lit(10.0), F.lit(2500000.0)).alias("explicitBounds"),
    )
    resource = [attribute("service.name", stringValue=F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))]
    return read(spark, sf_dir, "orders").select(
        metric_request(resource, F.lit("order_price"), "histogram", dp).alias("value")
    )


def summary_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary request per order: two quantiles."""
    price = F.col("o_totalprice")
    dp = F.struct(
        F.array(attribute("status", stringValue=F.col("o_orderstatus"))).alias("attributes"),
        nanos_of_ts(F.col("o_orderdate")).alias("timeUnixNano"),
        F.col("o_custkey").alias("count"),
        price.alias("sum"),
        F.array(
            F.struct(F.lit(0.5).alias("quantile"), (price / 2).alias("value")),
            F.struct(F.lit(0.99).alias("quantile"), price.alias("value")),
        ).alias("quantileValues"),
    )
    resource = [attribute("service.name", stringValue=F.concat(F.lit("order-"), F.col("o_orderkey").cast("string")))]
    return read(spark, sf_dir, "orders").select(
        metric_request(resource, F.lit("order_price"), "summary", dp).alias("value")
    )


def log_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log request per document; severities run through 0 to 24."""
    record = F.struct(
        ((F.lit(1_704_067_200) + F.col("doc_id")) * 1_000_000_000).alias("timeUnixNano"),
        F.pmod("doc_id", F.lit(25)).alias("severityNumber"),
        F.struct(F.col("text").alias("stringValue")).alias("body"),
        F.array(
            attribute("lang", stringValue=F.col("lang")), attribute("chars", intValue=F.col("n_chars"))
        ).alias("attributes"),
        F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("traceId"),
    )
    return read(spark, sf_dir, "documents").select(
        request(
            [attribute("service.name", stringValue=F.col("source"))],
            "resourceLogs", "scopeLogs", "logRecords", F.array(record),
        ).alias("value")
    )


def span_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace request per order line: one span with one event of four kinds of attribute."""
    start = nanos_of_ts(F.col("l_shipdate"))
    event = F.struct(
        F.lit(0).cast("bigint").alias("timeUnixNano"),
        F.lit("pack").alias("name"),
        F.array(
            attribute("tax", doubleValue=F.col("l_tax")),
            attribute("part", intValue=F.col("l_partkey")),
            attribute("cheap", boolValue=F.col("l_discount") > 0.05),
            attribute("note", stringValue=F.lit("text")),
        ).alias("attributes"),
    )
    returned = F.col("l_returnflag") == "R"
    span = F.struct(
        F.col("l_orderkey").cast("string").alias("traceId"),
        F.col("l_linenumber").cast("string").alias("spanId"),
        F.when(F.col("l_linenumber") > 1, "1").alias("parentSpanId"),
        F.concat(F.lit("ship "), F.col("l_returnflag")).alias("name"),
        F.col("l_linenumber").alias("kind"),
        start.cast("string").alias("startTimeUnixNano"),
        (start + F.col("l_quantity").cast("bigint") * 1_000_500).cast("string").alias("endTimeUnixNano"),
        F.array(attribute("status", stringValue=F.col("l_linestatus"))).alias("attributes"),
        F.array(event).alias("events"),
        F.struct(
            F.when(returned, 2).otherwise(1).alias("code"), F.when(returned, "returned").alias("message")
        ).alias("status"),
    )
    resource = [
        attribute("service.name", stringValue=F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")))
    ]
    return read(spark, sf_dir, "lineitem").select(
        request(resource, "resourceSpans", "scopeSpans", "spans", F.array(span)).alias("value")
    )
