"""Alert rules on streams: sliding windows, then edge detection with state per rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from pulselake.functions.aggregates import latest
from pulselake.operators.alerts import (
    DEFAULT_TEMPLATE, TICK_SECONDS, AlertRule, found_details, match_rules, metric_details, of_rule, to_events,
)
from pulselake.operators.series import with_series_key

DELAY = "10 minutes"
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """The edge detector's state needs the RocksDB store; set before the query starts."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def states(stream: DataFrame, rules: list[AlertRule], delay: str = DELAY) -> DataFrame:
    """Triggered ticks of rules of one source and one lookback of a second or more, from windows ``[tick - lookback, tick)``.

    Rows later than the watermark still belong to the table, they only miss their alert window.
    """
    source, lookback = rules[0].data_source, rules[0].lookback_s
    if any((r.data_source, r.lookback_s) != (source, lookback) for r in rules):
        raise ValueError("rules of one stream must share source and lookback")
    if source == "metrics":
        stream = with_series_key(stream)
    matched = match_rules(stream.withWatermark("ts", delay), rules, watermarked="ts")
    if lookback < TICK_SECONDS:  # windows of a minute, of which only the end counts
        window = F.window("ts", f"{TICK_SECONDS} seconds").alias("window")
        matched = matched.where(F.pmod(F.unix_micros("ts"), F.lit(TICK_SECONDS * 10**6)) >= (TICK_SECONDS - lookback) * 10**6)
    else:  # windows that end on whole minutes
        window = F.window("ts", f"{lookback} seconds", f"{TICK_SECONDS} seconds", f"{-lookback % TICK_SECONDS} seconds").alias("window")
    if source == "metrics":
        threshold = of_rule([float(r.threshold) for r in rules])
        per_series = matched.groupBy(window, "rule", "series_key").agg(latest().alias("value"))
        found = per_series.groupBy("window", "rule").agg(
            F.max(F.when(F.col("value") > threshold, F.col("value"))).alias("value")
        )
        triggered = found.where(F.col("value").isNotNull()).withColumn(
            "details", metric_details(F.col("value"), threshold)
        )
    elif source == "logs":
        found = matched.groupBy(window, "rule").agg(F.count(F.lit(1)).alias("n"))
        triggered = found.withColumn("details", found_details(F.col("n"), "logs"))
    else:
        per_trace = matched.groupBy(window, "rule", "trace_id").agg(F.count(F.lit(1)).alias("points"))
        found = per_trace.groupBy("window", "rule").agg(F.count(F.lit(1)).alias("n"))
        triggered = found.withColumn("details", found_details(F.col("n"), "traces"))
    minutes = (F.unix_seconds("window.end") / TICK_SECONDS).cast("bigint")
    return triggered.select("rule", minutes.alias("tick"), "details")


class EdgeDetector(StatefulProcessor):
    """Passes a rule's tick on when the tick before it was not triggered; keeps the last tick only."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", T.StructType([T.StructField("tick", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows)).sort_values("tick")
        last = self.last.get()[0] if self.last.exists() else None
        before = ticks["tick"].shift(1)
        if last is not None:
            # A tick already passed over, as after a restart, is no new edge.
            ticks, before = ticks[ticks["tick"] > last], before[ticks["tick"] > last]
            if len(before):
                before.iloc[0] = last
        if len(ticks):
            self.last.update((int(ticks["tick"].iloc[-1]),))
        yield ticks[before.isna() | (before < ticks["tick"] - 1)][["rule", "tick", "details"]]

    def close(self) -> None:
        pass


def alert_stream(
    stream: DataFrame, rules: list[AlertRule], delay: str = DELAY, template: str = DEFAULT_TEMPLATE
) -> DataFrame:
    """Stream of ``alert_events`` for rules of one source and lookback; write it in append mode.

    The detector sees at most one row per rule and minute, whatever the volume of the stream. Its state belongs to the
    rule's name, so rules can be listed in another order, added or removed between two runs.
    """
    edges = (
        states(stream, rules, delay)
        .withColumn("rule_name", of_rule([r.name for r in rules]))
        .groupBy("rule_name")
        .transformWithStateInPandas(
            EdgeDetector(), "rule int, tick bigint, details string", outputMode="Append", timeMode="None"
        )
    )
    return to_events(edges, rules, template)


def by_source_and_lookback(rules: list[AlertRule]) -> list[list[AlertRule]]:
    """The groups of rules that can share a stream."""
    groups: dict[tuple[str, int], list[AlertRule]] = {}
    for rule in rules:
        groups.setdefault((rule.data_source, rule.lookback_s), []).append(rule)
    return list(groups.values())
