import json

import pandas as pd
import pytest
from helpers import BASE, BASE_NANOS, SECOND, iso, points
from pyspark.sql import functions as F

from pulselake.operators.alerts import AlertRule
from pulselake.sources.otlp import parse, stream_requests
from pulselake.sources.tables import read_table
from pulselake.streaming.alerts import alert_stream, by_source_and_lookback, states, use_state_store
from pulselake.streaming.downsample import downsample_stream
from pulselake.streaming.ingest import drop_repeats, start_ingest, write_batch

CPU = {"__name__": "cpu_usage"}
HIGH = AlertRule("High", "metrics", 300, "critical", CPU, threshold=80.0)
SCHEMA = "time_unix_nano bigint, ts timestamp, name string, service string, value double, point_kind string, labels map<string,string>"


def body(*times, name="m"):
    dps = [{"timeUnixNano": t, "asDouble": 1.0} for t in times]
    return json.dumps({"resourceMetrics": [{"scopeMetrics": [{"metrics": [{"name": name, "gauge": {"dataPoints": dps}}]}]}]})


def feed(spark, folder, rows):
    """One more input file with these points."""
    points(spark, rows).coalesce(1).write.mode("append").parquet(str(folder))


def run(spark, df, path, checkpoint):
    query = (
        df.writeStream.outputMode("append").format("parquet").option("path", str(path))
        .option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    )
    query.awaitTermination()


def test_ingest_stores_rows_and_quarantines_bodies(spark, tmp_path):
    inbox, path, checkpoint = tmp_path / "in", str(tmp_path / "points"), str(tmp_path / "cp")
    inbox.mkdir()
    (inbox / "a.txt").write_text("\n".join([body(BASE_NANOS, BASE_NANOS + 86400 * SECOND), "broken", body("soon")]))
    start_ingest(stream_requests(spark, str(inbox), 1), "metrics", path, checkpoint, available_now=True).awaitTermination()
    assert read_table(spark, path, "metrics").count() == 2
    (inbox / "b.txt").write_text(body(BASE_NANOS + SECOND))
    start_ingest(stream_requests(spark, str(inbox), 1), "metrics", path, checkpoint, available_now=True).awaitTermination()
    assert read_table(spark, path, "metrics").count() == 3
    rejected = [r.body for r in spark.read.parquet(f"{path}_rejected").orderBy("body").collect()]
    assert rejected[0] == "broken" and json.loads(rejected[1])["name"] == "m" and len(rejected) == 2


def test_a_repeated_batch_leaves_its_rows_once(spark, tmp_path):
    path, rejected = str(tmp_path / "points"), str(tmp_path / "rejected")
    batch = spark.createDataFrame([(body(BASE_NANOS),), ("broken",)], "value string")
    for batch_id in (0, 0, 1):
        write_batch(batch, batch_id, "metrics", path, rejected)
    assert read_table(spark, path, "metrics").count() == 2
    assert spark.read.parquet(rejected).count() == 2


def test_streams_of_one_table_only_add(spark, tmp_path):
    path = str(tmp_path / "points")
    for i in range(3):
        inbox = tmp_path / f"in{i}"
        inbox.mkdir()
        (inbox / "a.txt").write_text("\n".join([body(BASE_NANOS + i * SECOND), f"broken {i}"]))
        start_ingest(stream_requests(spark, str(inbox)), "metrics", path, str(tmp_path / f"cp{i}"), available_now=True).awaitTermination()
    assert read_table(spark, path, "metrics").select("ts").distinct().count() == 3
    assert spark.read.parquet(f"{path}_rejected").count() == 3


def test_a_body_is_one_object_and_nothing_else(spark, tmp_path):
    good, path = body(BASE_NANOS), str(tmp_path / "points")
    bad = [f"{good} junk", good + good, f"{good},{good}", f"[{good}]", "", "null", "7", f"{good}]"]
    rows = [(b,) for b in [f"\n\t {good}\r\n", "{}", *bad, None]]
    parsed = parse(spark.createDataFrame(rows, "value string"), "metrics")
    assert [r.value for r in parsed.where("malformed").select("value").collect()] == [*bad, None]
    write_batch(spark.createDataFrame(rows, "value string"), 0, "metrics", path, str(tmp_path / "rejected"))
    assert read_table(spark, path, "metrics").count() == 1


def test_ingest_of_logs_and_traces(spark, tmp_path):
    logs = {"resourceLogs": [{"scopeLogs": [{"logRecords": [{"timeUnixNano": BASE_NANOS, "body": {"stringValue": "x"}}]}]}]}
    span = {"traceId": "t", "spanId": "s", "startTimeUnixNano": BASE_NANOS, "endTimeUnixNano": BASE_NANOS + 1}
    traces = {"resourceSpans": [{"scopeSpans": [{"spans": [span]}]}]}
    for signal, document, n in (("logs", logs, 1), ("traces", traces, 2)):
        batch = spark.createDataFrame([(json.dumps(document),)], "value string")
        path = str(tmp_path / signal)
        write_batch(batch, 0, signal, path, f"{path}_rejected")
        assert read_table(spark, path, signal).count() == n


def test_high_silence_high_gives_two_alerts_across_restarts(spark, tmp_path):
    use_state_store(spark)
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    feed(spark, source, [(30, 90, CPU), (90, 91, CPU), (100, 70, {**CPU, "host": "b"})])
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(source))
    run(spark, alert_stream(stream(), [HIGH], "1 minute"), out, checkpoint)
    feed(spark, source, [(1830, 95, CPU), (1900, 20, {"__name__": "other"})])
    run(spark, alert_stream(stream(), [HIGH], "1 minute"), out, checkpoint)
    feed(spark, source, [(7200, 1, CPU)])
    run(spark, alert_stream(stream(), [HIGH], "1 minute"), out, checkpoint)
    events = spark.read.parquet(str(out)).orderBy("tick").collect()
    minutes = [(e.tick.replace(tzinfo=BASE.tzinfo) - BASE).total_seconds() / 60 for e in events]
    assert minutes == [1.0, 31.0]
    assert events[1].body == "Alert: High triggered at 2024-01-01T00:31:00Z. Details: Metric value 95.00 exceeds threshold 80.00"


def test_late_rows_miss_their_window(spark, tmp_path):
    use_state_store(spark)
    source, out, checkpoint = tmp_path / "in", tmp_path / "out", tmp_path / "cp"
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(str(source))
    feed(spark, source, [(3600, 1, CPU)])
    run(spark, alert_stream(stream(), [HIGH], "1 minute"), out, checkpoint)
    feed(spark, source, [(30, 99, CPU), (7200, 1, CPU)])
    run(spark, alert_stream(stream(), [HIGH], "1 minute"), out, checkpoint)
    assert spark.read.schema("rule_name string").parquet(str(out)).count() == 0


def test_trace_rules_count_traces_on_a_stream(spark, tmp_path):
    from test_traces import span_points

    use_state_store(spark)
    source, out = tmp_path / "in", tmp_path / "out"
    rows = [(1000 * i, f"t{i % 2}", "s", "duration", {"name": "pay"}) for i in range(1, 7)] + [(7_200_000, "t", "s", "duration", {})]
    df = span_points(spark, rows)
    df.coalesce(1).write.parquet(str(source))
    stream = spark.readStream.schema(df.schema).parquet(str(source))
    run(spark, alert_stream(stream, [AlertRule("T", "traces", 60, "w", text="pay")], "1 minute"), out, tmp_path / "cp")
    assert [e.details for e in spark.read.parquet(str(out)).collect()] == ["Found 2 traces matching the query"]


def test_rules_of_one_stream_share_source_and_lookback(spark):
    other = AlertRule("x", "metrics", 60)
    with pytest.raises(ValueError):
        states(points(spark, []), [HIGH, other])
    assert by_source_and_lookback([HIGH, other, HIGH]) == [[HIGH, HIGH], [other]]


def test_downsample_stream(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    feed(spark, source, [(0, 1, CPU), (30, 3, CPU), (60, 5, CPU), (7200, 0, CPU)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    run(spark, downsample_stream(stream, "1 minute", "1 minute"), out, tmp_path / "cp")
    rows = spark.read.parquet(str(out)).orderBy("bucket").collect()
    assert [(r["sum"], r["count"]) for r in rows] == [(4.0, 2), (5.0, 1)]


def test_repeats_are_dropped(spark, tmp_path):
    source, out = tmp_path / "in", tmp_path / "out"
    feed(spark, source, [(0, 1, CPU), (0, 1, CPU), (1, 1, CPU)])
    stream = spark.readStream.schema(SCHEMA).parquet(str(source))
    run(spark, drop_repeats(stream, ["time_unix_nano", "name"]), out, tmp_path / "cp")
    assert spark.read.parquet(str(out)).count() == 2
