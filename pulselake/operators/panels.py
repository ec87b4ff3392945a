"""Dashboard panels as data: saved queries over the last refresh intervals."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulselake.functions.times import div, duration_seconds, instant
from pulselake.sources.tables import PROMOTED

# A panel shows this many refresh intervals; one that cannot be read counts as 30 seconds.
INTERVALS = 10
DEFAULT_REFRESH = 30.0
OVERVIEW = "overview"


@dataclass(frozen=True)
class Panel:
    title: str
    data_source: str
    query: str = ""
    refresh_interval: str = "30s"
    max_rows: int = 0
    type: str = "graph"


def panel_from_config(entry: dict) -> Panel:
    return Panel(
        entry["title"],
        entry["dataSource"],
        entry.get("query") or "",
        entry.get("refreshInterval") or "",
        entry.get("maxRows") or 0,
        entry.get("type") or "",
    )


def panel_table(spark: SparkSession, panels: list[Panel]) -> DataFrame:
    names = ["type", "title", "data_source", "query", "refresh_interval", "max_rows"]
    columns = {"position": list(range(len(panels))), **{n: [getattr(p, n) for p in panels] for n in names}}
    return spark.createDataFrame(pa.table(columns))


def find_panel(panels: DataFrame, wanted: str) -> DataFrame:
    """The first panel whose title or position is ``wanted``."""
    return (
        panels.where((F.col("title") == wanted) | (F.col("position").cast("string") == wanted))
        .orderBy("position")
        .limit(1)
    )


def panels_of_view(panels: DataFrame, view: str) -> DataFrame:
    """All panels for the overview, else those of the source the view is named after."""
    return panels if view == OVERVIEW else panels.where(F.col("data_source") == view)


def panel_range(panel: Panel, now: datetime | str) -> tuple[datetime, datetime]:
    """The last ten refresh intervals in whole seconds; an unreadable interval counts as 30 s."""
    try:
        refresh = duration_seconds(panel.refresh_interval)
    except ValueError:
        refresh = DEFAULT_REFRESH
    end = instant(now)
    start = end - timedelta(seconds=refresh * INTERVALS)
    return start.replace(microsecond=0), end.replace(microsecond=0)


def graph_series(matrix_rows: DataFrame, key: str, by: str = "series_key") -> DataFrame:
    """The points of one series of a matrix, as (ts, value) rows."""
    return (
        matrix_rows.where(F.col(by) == key)
        .select(F.explode("values").alias("p"))
        .select(F.timestamp_seconds("p.unix_seconds").alias("ts"), F.col("p.value").alias("value"))
    )


def log_table_rows(logs: DataFrame) -> DataFrame:
    return logs.select("ts", F.col("message").alias("text"))


def trace_table_rows(traces: DataFrame) -> DataFrame:
    return traces.select(
        F.timestamp_micros(div(F.col("start_unix_nano"), 1000)).alias("ts"),
        F.format_string("%s (%.2fms)", F.col("name"), F.col("duration_ms")).alias("text"),
    )


def first_of_selectors(points: DataFrame, wanted: list[dict[str, str]], n: int, tie: list[str]) -> DataFrame:
    """The earliest ``n`` points for each of many label selectors (column ``query``).

    A dashboard asks many small questions at once; here those over the same labels share one scan and one
    hash lookup per row, and each map task keeps only ``n`` rows per question before the shuffle.
    """
    promoted = {k: c for k, c in PROMOTED["metrics"].items() if c in points.columns}
    by_labels: dict[tuple[str, ...], list[tuple]] = {}
    for i, labels in enumerate(wanted):
        names = tuple(sorted(labels))
        by_labels.setdefault(names, []).append((i, *[labels[k] for k in names]))
    parts = []
    for names, rows in by_labels.items():
        query, *values = zip(*rows)
        columns = {"query": pa.array(query, pa.int32()), **{f"_label_{j}": list(v) for j, v in enumerate(values)}}
        # An Arrow table becomes a local relation of the plan; no Python worker is started for it.
        asked = points.sparkSession.createDataFrame(pa.table(columns))
        columns = [F.col(promoted[k]) if k in promoted else F.col("labels")[k] for k in names]
        parts.append(points.join(asked, [c == F.col(f"_label_{j}") for j, c in enumerate(columns)]).drop(
            *[f"_label_{j}" for j in range(len(names))]
        ))
    order = [F.col("time_unix_nano"), *map(F.col, tie)]
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("position", F.row_number().over(Window.partitionBy("query").orderBy(*order)))
        .where(F.col("position") <= n)
    )
