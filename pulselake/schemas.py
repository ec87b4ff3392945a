"""Column contracts: the three telemetry tables and the three OTLP/JSON request envelopes."""

from __future__ import annotations

from pyspark.sql import types as T

# 64-bit integers arrive as JSON numbers or as quoted text (standard OTLP/JSON); declared as text and
# cast, because from_json gives NULL for a quoted number in a BIGINT field.
INT64_TEXT = T.StringType()

CORRUPT = "_corrupt_record"


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


ANY_VALUE = _struct(
    stringValue=T.StringType(),
    intValue=INT64_TEXT,
    doubleValue=T.DoubleType(),
    boolValue=T.BooleanType(),
)
ATTRIBUTES = T.ArrayType(_struct(key=T.StringType(), value=ANY_VALUE))
RESOURCE = _struct(attributes=ATTRIBUTES)

NUMBER_POINTS = T.ArrayType(
    _struct(attributes=ATTRIBUTES, timeUnixNano=INT64_TEXT, asDouble=T.DoubleType(), asInt=INT64_TEXT)
)
HISTOGRAM_POINTS = T.ArrayType(
    _struct(
        attributes=ATTRIBUTES,
        timeUnixNano=INT64_TEXT,
        count=INT64_TEXT,
        sum=T.DoubleType(),
        bucketCounts=T.ArrayType(INT64_TEXT),
        explicitBounds=T.ArrayType(T.DoubleType()),
    )
)
SUMMARY_POINTS = T.ArrayType(
    _struct(
        attributes=ATTRIBUTES,
        timeUnixNano=INT64_TEXT,
        count=INT64_TEXT,
        sum=T.DoubleType(),
        quantileValues=T.ArrayType(_struct(quantile=T.DoubleType(), value=T.DoubleType())),
    )
)
METRIC = _struct(
    name=T.StringType(),
    gauge=_struct(dataPoints=NUMBER_POINTS),
    sum=_struct(dataPoints=NUMBER_POINTS),
    histogram=_struct(dataPoints=HISTOGRAM_POINTS),
    summary=_struct(dataPoints=SUMMARY_POINTS),
)
METRICS_REQUEST = _struct(
    resourceMetrics=T.ArrayType(
        _struct(resource=RESOURCE, scopeMetrics=T.ArrayType(_struct(metrics=T.ArrayType(METRIC))))
    )
)

LOG_RECORD = _struct(
    timeUnixNano=INT64_TEXT,
    severityNumber=T.IntegerType(),
    severityText=T.StringType(),
    body=ANY_VALUE,
    attributes=ATTRIBUTES,
    traceId=T.StringType(),
    spanId=T.StringType(),
)
LOGS_REQUEST = _struct(
    resourceLogs=T.ArrayType(
        _struct(resource=RESOURCE, scopeLogs=T.ArrayType(_struct(logRecords=T.ArrayType(LOG_RECORD))))
    )
)

SPAN_EVENT = _struct(timeUnixNano=INT64_TEXT, name=T.StringType(), attributes=ATTRIBUTES)
SPAN = _struct(
    traceId=T.StringType(),
    spanId=T.StringType(),
    parentSpanId=T.StringType(),
    name=T.StringType(),
    kind=T.IntegerType(),
    startTimeUnixNano=INT64_TEXT,
    endTimeUnixNano=INT64_TEXT,
    attributes=ATTRIBUTES,
    events=T.ArrayType(SPAN_EVENT),
    status=_struct(code=T.IntegerType(), message=T.StringType()),
)
TRACES_REQUEST = _struct(
    resourceSpans=T.ArrayType(
        _struct(resource=RESOURCE, scopeSpans=T.ArrayType(_struct(spans=T.ArrayType(SPAN))))
    )
)

REQUESTS = {"metrics": METRICS_REQUEST, "logs": LOGS_REQUEST, "traces": TRACES_REQUEST}

LABELS = T.MapType(T.StringType(), T.StringType())

POINTS = _struct(
    time_unix_nano=T.LongType(),
    ts=T.TimestampType(),
    name=T.StringType(),
    service=T.StringType(),
    value=T.DoubleType(),
    point_kind=T.StringType(),
    labels=LABELS,
    series_key=T.StringType(),
    dt=T.DateType(),
)
LOGS = _struct(
    time_unix_nano=T.LongType(),
    ts=T.TimestampType(),
    level=T.StringType(),
    severity_number=T.IntegerType(),
    message=T.StringType(),
    service=T.StringType(),
    labels=LABELS,
    dt=T.DateType(),
)
SPAN_POINTS = _struct(
    time_unix_nano=T.LongType(),
    ts=T.TimestampType(),
    trace_id=T.StringType(),
    span_id=T.StringType(),
    parent_span_id=T.StringType(),
    service=T.StringType(),
    span_name=T.StringType(),
    span_kind=T.StringType(),
    point_type=T.StringType(),
    value=T.DoubleType(),
    event_name=T.StringType(),
    event_attr_key=T.StringType(),
    status_code=T.IntegerType(),
    status_message=T.StringType(),
    labels=LABELS,
    dt=T.DateType(),
)
TABLES = {"metrics": POINTS, "logs": LOGS, "traces": SPAN_POINTS}
