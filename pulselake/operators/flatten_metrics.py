"""OTLP metrics requests to points: one narrow plan, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulselake.functions.labels import attribute_entries, entry, label_map, merge_labels, no_labels, series_key
from pulselake.functions.times import ts_of_nanos
from pulselake.functions.values import int64, number_text, uint64_value


def _point(value: Column, kind: str, labels: Column | None = None) -> Column:
    return F.struct(
        F.coalesce(value, F.lit(0.0)).alias("value"),
        F.lit(kind).alias("kind"),
        (no_labels() if labels is None else labels).alias("labels"),
    )


def _typed(value: Column, kind: str, **label: Column) -> Column:
    pairs = [F.lit("__metric_type__"), F.lit(kind)]
    for name, text in label.items():
        pairs += [F.lit(name), text]
    return _point(value, kind, F.create_map(*pairs))


def _data_point(dp: Column, points: Column) -> Column:
    return F.struct(
        int64(dp["timeUnixNano"]).alias("time_unix_nano"),
        dp["attributes"].alias("attributes"),
        points.alias("points"),
    )


def _number(dp: Column, kind: str) -> Column:
    return F.array(_point(F.coalesce(dp["asDouble"], dp["asInt"].try_cast("double")), kind))


def _histogram(dp: Column, include_inf: bool) -> Column:
    bounds, counts = dp["explicitBounds"], dp["bucketCounts"]
    # A bound without a count gives no point.
    buckets = F.transform(
        F.slice(bounds, 1, F.least(F.size(bounds), F.size(counts))),
        lambda bound, i: _typed(uint64_value(F.get(counts, i)), "bucket", le=number_text(bound)),
    )
    if include_inf:
        beyond = F.slice(counts, F.size(bounds) + 1, 1)
        buckets = F.concat(
            buckets, F.transform(beyond, lambda n: _typed(uint64_value(n), "bucket", le=F.lit("+Inf")))
        )
    return _with_totals(dp, buckets)


def _summary(dp: Column) -> Column:
    quantiles = F.transform(
        dp["quantileValues"],
        lambda q: _typed(q["value"], "quantile", quantile=number_text(F.coalesce(q["quantile"], F.lit(0.0)))),
    )
    return _with_totals(dp, quantiles)


def _with_totals(dp: Column, more: Column) -> Column:
    totals = F.array(_typed(uint64_value(dp["count"]), "count"), _typed(dp["sum"], "sum"))
    return F.concat(totals, F.coalesce(more, F.array()))


def flatten_metrics(
    requests: DataFrame,
    stringify: bool = False,
    include_inf: bool = False,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Points of parsed requests (column ``request``).

    A metric gives the points of the first kind present: gauge, sum, histogram, summary. Histograms and
    summaries give count and sum points plus one per bound or quantile; bucket counts stay raw and the
    last, unbounded bucket is left out unless ``include_inf``. Data point labels win over resource
    labels. ``keep`` passes columns of the request through.
    """
    metrics = (
        requests.select(*keep, F.explode("request.resourceMetrics").alias("r"))
        .select(*keep, F.col("r.resource.attributes").alias("resource"), F.explode("r.scopeMetrics").alias("s"))
        .select(*keep, "resource", F.explode("s.metrics").alias("m"))
    )
    m = F.col("m")
    kinds = [
        ("gauge", lambda dp: _number(dp, "gauge")),
        ("sum", lambda dp: _number(dp, "sum")),
        ("histogram", lambda dp: _histogram(dp, include_inf)),
        ("summary", _summary),
    ]

    def data_points(kind: str, points) -> Column:
        return F.transform(m[kind]["dataPoints"], lambda dp: _data_point(dp, points(dp)))

    first, *others = kinds
    dispatch = F.when(m[first[0]].isNotNull(), data_points(*first))
    for kind, points in others:
        dispatch = dispatch.when(m[kind].isNotNull(), data_points(kind, points))
    # The labels of a data point are made once, before its points are listed.
    base = F.concat(
        attribute_entries(F.col("resource"), stringify),
        attribute_entries(F.col("d.attributes"), stringify),
        F.array(entry("__name__", F.col("name"))),
    )
    rows = (
        metrics.select(
            *keep, "resource", F.coalesce(m["name"], F.lit("")).alias("name"), F.explode(dispatch).alias("d")
        )
        .select(*keep, "name", "d.time_unix_nano", base.alias("entries"), F.col("d.points").alias("points"))
        .select(*keep, "name", "time_unix_nano", label_map(F.col("entries")).alias("base"), "points")
        .select(*keep, "name", "time_unix_nano", "base", F.explode("points").alias("p"))
        .select(
            *keep, "name", "time_unix_nano", "p.value", F.col("p.kind").alias("point_kind"),
            merge_labels(F.col("base"), F.col("p.labels")).alias("labels"),
        )
    )
    ts = ts_of_nanos(F.col("time_unix_nano"))
    return rows.select(
        *keep,
        "time_unix_nano",
        ts.alias("ts"),
        "name",
        F.col("labels")["service.name"].alias("service"),
        "value",
        "point_kind",
        "labels",
        series_key(F.col("labels")).alias("series_key"),
        ts.cast("date").alias("dt"),
    )
