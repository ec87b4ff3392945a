"""OTLP logs requests to log rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulselake.functions.labels import attribute_entries, entry, label_map, no_entries
from pulselake.functions.times import ts_of_nanos
from pulselake.functions.values import int64, severity_level


def flatten_logs(
    requests: DataFrame, stringify: bool = False, keep_ids: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Log rows of parsed requests (column ``request``).

    The level comes from the severity number, the message from a text body. ``keep_ids`` adds the labels
    ``trace.id`` and ``span.id`` where the record has them.
    """
    records = (
        requests.select(*keep, F.explode("request.resourceLogs").alias("r"))
        .select(*keep, F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeLogs").alias("s"))
        .select(*keep, "resource", F.explode("s.logRecords").alias("l"))
    )
    parts = [
        attribute_entries(F.col("resource"), stringify),
        attribute_entries(F.col("l.attributes"), stringify),
    ]
    if keep_ids:
        for label, field in (("trace.id", "l.traceId"), ("span.id", "l.spanId")):
            present = F.coalesce(F.col(field), F.lit("")) != ""
            parts.append(F.when(present, F.array(entry(label, F.col(field)))).otherwise(no_entries()))
    severity = F.coalesce(F.col("l.severityNumber"), F.lit(0))
    labelled = records.select(
        *keep,
        int64(F.col("l.timeUnixNano")).alias("time_unix_nano"),
        severity_level(severity).alias("level"),
        severity.alias("severity_number"),
        F.coalesce(F.col("l.body.stringValue"), F.lit("")).alias("message"),
        F.concat(*parts).alias("entries"),
    ).select(
        *keep, "time_unix_nano", "level", "severity_number", "message", label_map(F.col("entries")).alias("labels")
    )
    ts = ts_of_nanos(F.col("time_unix_nano"))
    return labelled.select(
        *keep,
        "time_unix_nano",
        ts.alias("ts"),
        "level",
        "severity_number",
        "message",
        F.col("labels")["service.name"].alias("service"),
        "labels",
        ts.cast("date").alias("dt"),
    )
