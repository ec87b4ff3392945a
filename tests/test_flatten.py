import json

import pytest
from pyspark.sql import functions as F

from pulselake.functions.labels import label_map, merge_labels, series_key
from pulselake.functions.values import number_text, severity_level, span_kind_text
from pulselake.sources.otlp import parse, quarantine
from pulselake.streaming.ingest import flatten


def attr(key, **value):
    return {"key": key, "value": value}


def bodies(spark, *documents):
    rows = [(d if isinstance(d, str) else json.dumps(d),) for d in documents]
    return spark.createDataFrame(rows, "value string")


def metrics(*items, resource=()):
    return {"resourceMetrics": [{"resource": {"attributes": list(resource)}, "scopeMetrics": [{"metrics": list(items)}]}]}


def test_gauge_point(spark):
    dp = {"timeUnixNano": 1704067200123456789, "asDouble": 42.5, "attributes": [attr("host", stringValue="test-server")]}
    body = metrics({"name": "cpu_usage", "gauge": {"dataPoints": [dp]}}, resource=[attr("service.name", stringValue="svc")])
    (row,) = flatten(bodies(spark, body), "metrics").collect()
    assert row.time_unix_nano == 1704067200123456789
    assert (row.name, row.service, row.value, row.point_kind) == ("cpu_usage", "svc", 42.5, "gauge")
    assert row.labels == {"service.name": "svc", "host": "test-server", "__name__": "cpu_usage"}
    assert row.series_key == '{"__name__":"cpu_usage","host":"test-server","service.name":"svc"}'
    assert row.ts.microsecond == 123456 and str(row.dt) == "2024-01-01"


def test_quoted_integers_and_as_int(spark):
    dp = {"timeUnixNano": "1704067200000000001", "asInt": "7"}
    (row,) = flatten(bodies(spark, metrics({"name": "n", "sum": {"dataPoints": [dp]}})), "metrics").collect()
    assert (row.time_unix_nano, row.value, row.point_kind) == (1704067200000000001, 7.0, "sum")


def test_histogram_three_bounds_four_counts(spark):
    dp = {"timeUnixNano": 1, "count": 18446744073709551615, "sum": 9.5, "bucketCounts": ["1", "2", "3", "4"],
          "explicitBounds": [0.5, 10, 1e6]}
    body = bodies(spark, metrics({"name": "h", "histogram": {"dataPoints": [dp]}}))
    rows = {(r.point_kind, r.labels.get("le")): r.value for r in flatten(body, "metrics").collect()}
    assert rows == {("count", None): 18446744073709551615.0, ("sum", None): 9.5, ("bucket", "0.5"): 1.0,
                    ("bucket", "10"): 2.0, ("bucket", "1e+06"): 3.0}
    with_inf = flatten(body, "metrics", include_inf=True).collect()
    assert len(with_inf) == 6 and [r.value for r in with_inf if r.labels.get("le") == "+Inf"] == [4.0]


def test_histogram_with_fewer_counts_than_bounds(spark):
    dp = {"timeUnixNano": 1, "count": 1, "sum": 1.0, "bucketCounts": [5], "explicitBounds": [1.0, 2.0]}
    rows = flatten(bodies(spark, metrics({"name": "h", "histogram": {"dataPoints": [dp]}})), "metrics").collect()
    assert sorted(r.point_kind for r in rows) == ["bucket", "count", "sum"]


def test_histogram_without_buckets(spark):
    dp = {"timeUnixNano": 1, "count": 1, "sum": 1.0}
    for include_inf in (False, True):
        rows = flatten(bodies(spark, metrics({"name": "h", "histogram": {"dataPoints": [dp]}})), "metrics",
                       include_inf=include_inf).collect()
        assert sorted(r.point_kind for r in rows) == ["count", "sum"]


def test_summary_two_quantiles(spark):
    dp = {"timeUnixNano": 1, "count": 3, "sum": 6.0,
          "quantileValues": [{"quantile": 0.5, "value": 2.0}, {"quantile": 0.99, "value": 3.0}]}
    rows = flatten(bodies(spark, metrics({"name": "s", "summary": {"dataPoints": [dp]}})), "metrics").collect()
    assert sorted((r.point_kind, r.labels.get("quantile"), r.value) for r in rows if r.point_kind == "quantile") == [
        ("quantile", "0.5", 2.0), ("quantile", "0.99", 3.0)]
    assert len(rows) == 4


def test_first_kind_wins_and_unknown_kinds_give_nothing(spark):
    dp = {"timeUnixNano": 1, "asDouble": 1.0}
    both = {"name": "both", "gauge": {"dataPoints": [dp]}, "sum": {"dataPoints": [dp, dp]}}
    empty_gauge = {"name": "empty", "gauge": {}, "sum": {"dataPoints": [dp]}}
    other = {"name": "other", "exponentialHistogram": {"dataPoints": [dp]}}
    rows = flatten(bodies(spark, metrics(both, empty_gauge, other)), "metrics").collect()
    assert [(r.name, r.point_kind) for r in rows] == [("both", "gauge")]


def test_point_label_wins_and_other_kinds_are_blank(spark):
    dp = {"timeUnixNano": 1, "asDouble": 1.0,
          "attributes": [attr("host", stringValue="a"), attr("host", stringValue="b"), attr("n", intValue=5),
                         attr("x", doubleValue=0.5), attr("t", boolValue=True)]}
    body = metrics({"name": "m", "gauge": {"dataPoints": [dp]}}, resource=[attr("host", stringValue="r")])
    (row,) = flatten(bodies(spark, body), "metrics").collect()
    assert row.labels == {"host": "b", "n": "", "x": "", "t": "", "__name__": "m"}
    (row,) = flatten(bodies(spark, body), "metrics", stringify=True).collect()
    assert row.labels == {"host": "b", "n": "5", "x": "0.5", "t": "true", "__name__": "m"}


def test_attribute_named_like_a_point_label(spark):
    dp = {"timeUnixNano": 1, "count": 1, "sum": 2.0, "bucketCounts": [1], "explicitBounds": [1.0],
          "attributes": [attr("le", stringValue="mine"), attr("__name__", stringValue="x")]}
    rows = flatten(bodies(spark, metrics({"name": "h", "histogram": {"dataPoints": [dp]}})), "metrics").collect()
    assert {r.point_kind: (r.labels["le"], r.labels["__name__"]) for r in rows} == {
        "count": ("mine", "h"), "sum": ("mine", "h"), "bucket": ("1", "h")}


@pytest.mark.parametrize("number,level", [(0, "INFO"), (1, "TRACE"), (5, "DEBUG"), (9, "INFO"), (10, "INFO"), (13, "WARN"),
                                          (17, "ERROR"), (18, "INFO"), (21, "FATAL"), (None, "INFO")])
def test_severity(spark, number, level):
    assert spark.range(1).select(severity_level(F.lit(number).cast("int"))).first()[0] == level


@pytest.mark.parametrize("number,kind", [(0, "UNSPECIFIED"), (1, "INTERNAL"), (2, "SERVER"), (3, "CLIENT"),
                                         (4, "PRODUCER"), (5, "CONSUMER"), (9, "UNSPECIFIED"), (None, "UNSPECIFIED")])
def test_span_kind(spark, number, kind):
    assert spark.range(1).select(span_kind_text(F.lit(number).cast("int"))).first()[0] == kind


def test_number_text(spark):
    expected = {
        0.0: "0", 1.0: "1", 10.0: "10", 0.5: "0.5", 0.005: "0.005", 0.0005: "0.0005", 0.00012: "0.00012",
        0.0001: "0.0001", 0.00001: "1e-05", 0.000025: "2.5e-05", 123456.0: "123456", 123456.5: "123456.5",
        1e6: "1e+06", 1234567.5: "1.2345675e+06", 1e7: "1e+07", 12345678.0: "1.2345678e+07", 1e21: "1e+21",
        1e100: "1e+100", 1e-7: "1e-07", 1.5e-100: "1.5e-100", -2.5: "-2.5", -1e6: "-1e+06", float("inf"): "+Inf",
        float("-inf"): "-Inf", 9999999.0: "9.999999e+06", 100000.0: "100000",
    }
    rows = spark.createDataFrame([(x,) for x in expected], "x double").select("x", number_text(F.col("x")).alias("t"))
    assert {r.x: r.t for r in rows.collect()} == expected


def test_log_record(spark):
    record = {"timeUnixNano": 5, "severityNumber": 17, "severityText": "x", "body": {"stringValue": "failed"},
              "attributes": [attr("event.type", stringValue="log")], "traceId": "t1", "spanId": ""}
    body = {"resourceLogs": [{"resource": {"attributes": [attr("service.name", stringValue="svc")]},
                              "scopeLogs": [{"logRecords": [record, {"body": {"intValue": 3}}]}]}]}
    first, second = flatten(bodies(spark, body), "logs").orderBy(F.desc("time_unix_nano")).collect()
    assert (first.level, first.severity_number, first.message, first.service) == ("ERROR", 17, "failed", "svc")
    assert first.labels == {"service.name": "svc", "event.type": "log"}
    assert (second.time_unix_nano, second.level, second.message) == (0, "INFO", "")
    kept = flatten(bodies(spark, body), "logs", keep_ids=True).orderBy(F.desc("time_unix_nano")).first()
    assert kept.labels == {"service.name": "svc", "event.type": "log", "trace.id": "t1"}


def span_body(**fields):
    span = {"traceId": "t", "spanId": "s", "name": "op", "kind": 2, "startTimeUnixNano": 1000_000,
            "endTimeUnixNano": 3_500_900, "status": {"code": 1}, **fields}
    resource = {"attributes": [attr("service.name", stringValue="svc")]}
    return {"resourceSpans": [{"resource": resource, "scopeSpans": [{"spans": [span]}]}]}


def test_span_without_events(spark):
    rows = {r.point_type: r for r in flatten(bodies(spark, span_body()), "traces").collect()}
    assert set(rows) == {"duration", "status"}
    duration, status = rows["duration"], rows["status"]
    assert (duration.value, duration.time_unix_nano) == (2500.0, 1_000_000)
    assert (status.value, status.time_unix_nano, status.status_code) == (1.0, 3_500_900, 1)
    identity = {"service.name": "svc", "span.name": "op", "span.kind": "SERVER", "trace.id": "t", "span.id": "s"}
    assert duration.labels == identity and status.labels == {**identity, "status.code": "1"}


def test_span_before_its_start(spark):
    row = flatten(bodies(spark, span_body(endTimeUnixNano=0)), "traces").where("point_type = 'duration'").first()
    assert row.value == -1000.0


def test_span_event_attributes(spark):
    event = {"timeUnixNano": 0, "name": "e", "attributes": [
        attr("n", intValue=20), attr("s", stringValue="x"), attr("b", boolValue=False), attr("z", doubleValue=0.0),
        attr("t", boolValue=True), attr("d", doubleValue=1.5, intValue=9)]}
    body = span_body(events=[event, {"name": "none"}], parentSpanId="p", status={"code": 2, "message": "bad"})
    rows = flatten(bodies(spark, body), "traces").collect()
    events = {r.event_attr_key: r for r in rows if r.point_type == "event"}
    assert {k: r.value for k, r in events.items()} == {"n": 20.0, "t": 1.0, "d": 1.5}
    assert all(r.time_unix_nano == 1_000_000 and r.event_name == "e" for r in events.values())
    assert events["n"].labels["event.attr.key"] == "n" and events["n"].labels["parent.span.id"] == "p"
    (status,) = [r for r in rows if r.point_type == "status"]
    assert status.labels["status.message"] == "bad" and status.status_message == "bad"


def test_service_name_comes_from_the_resource(spark):
    body = span_body(attributes=[attr("service.name", stringValue="own"), attr("status.code", stringValue="mine")])
    body["resourceSpans"][0]["resource"] = {}
    rows = {r.point_type: r for r in flatten(bodies(spark, body), "traces").collect()}
    assert rows["duration"].service == "" and rows["duration"].labels["service.name"] == ""
    assert rows["duration"].labels["status.code"] == "mine" and rows["status"].labels["status.code"] == "1"


@pytest.mark.parametrize("body", ["", "   ", "not json", '{"resourceMetrics": 5}', '{"resourceMetrics": [', "[]", "7",
                                  '{"resourceMetrics": [{"scopeMetrics": {}}]}', '[{"resourceMetrics": []}]'])
def test_malformed_bodies(spark, body):
    parsed = parse(bodies(spark, body), "metrics")
    assert [r.malformed for r in parsed.collect()] == [True]
    assert quarantine(parsed).count() == 1
    assert flatten(bodies(spark, body), "metrics").count() == 0


@pytest.mark.parametrize("body", ["{}", '{"resourceMetrics": []}', '{"other": 1}'])
def test_empty_requests_are_fine(spark, body):
    assert [r.malformed for r in parse(bodies(spark, body), "metrics").collect()] == [False]


def test_label_helpers(spark):
    df = spark.createDataFrame([([("a", "1"), ("b", "2"), ("a", "3")],)], "e array<struct<key:string,value:string>>")
    assert df.select(label_map(F.col("e"))).first()[0] == {"b": "2", "a": "3"}
    left = F.create_map(F.lit("b"), F.lit("1"), F.lit("a"), F.lit("1"))
    right = F.create_map(F.lit("a"), F.lit("2"))
    assert df.select(merge_labels(left, right)).first()[0] == {"b": "1", "a": "2"}
    assert df.select(series_key(left)).first()[0] == '{"a":"1","b":"1"}'
    assert df.select(series_key(F.create_map().cast("map<string,string>"))).first()[0] == "{}"
