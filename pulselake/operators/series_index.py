"""An index of series: label filters and rules are answered on it, and points are read by series id alone.

The index is two tables. ``series`` has a row for each label set, with a 64-bit id; ``postings`` has a row for each label of
a series. A selector or pattern is decided on the postings, of which there are as many as series have labels, however many
points there are; what it leaves are ids, and points join by id, without their label map being read.

Rules are rows, too. A metric rule is posted under that pair of its selector which the fewest series have; a series meets
only rules posted under one of its own pairs, and the rest of the selector is checked then. Plans do not grow with the number
of rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.functions.labels import label_match_map, series_key
from pulselake.operators.alerts import valid_rules

ANY = ""  # the pair that every series has, for rules without a selector
BROADCAST_IDS = 1_000_000


def series_id(labels: Column, seed: int = 0) -> Column:
    """64-bit id of a label set."""
    return F.xxhash64(F.lit(seed), series_key(labels))


@dataclass(frozen=True)
class SeriesIndex:
    series: DataFrame  # series_id, labels, points
    postings: DataFrame  # label, value, series_id


SERIES, POSTINGS = "series_id bigint, labels map<string,string>, points bigint", "label string, value string, series_id bigint"


def build_index(points: DataFrame, path: str) -> SeriesIndex:
    """Write the index of points (series_id, labels) under ``path``; postings are sorted, so a label's files are pruned.

    Two label sets of one id are an error; ids of another seed mend it.
    """
    spark, key = points.sparkSession, series_key(F.col("labels"))
    sets = points.groupBy("series_id", key.alias("key")).agg(F.count(F.lit(1)).alias("points"))
    sets.select("series_id", F.from_json("key", "map<string,string>").alias("labels"), "points").write.parquet(f"{path}/series")
    series = spark.read.schema(SERIES).parquet(f"{path}/series")
    if not series.groupBy("series_id").count().where("count > 1").isEmpty():
        raise ValueError("two label sets have one id; take ids of another seed")
    pairs = series.select(F.explode("labels").alias("label", "value"), "series_id")
    pairs.repartitionByRange("label", "value", "series_id").sortWithinPartitions("label", "value").write.parquet(f"{path}/postings")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> SeriesIndex:
    return SeriesIndex(spark.read.schema(SERIES).parquet(f"{path}/series"), spark.read.schema(POSTINGS).parquet(f"{path}/postings"))


def equals(label: str, value: str) -> Column:
    return (F.col("label") == label) & (F.col("value") == value)


def matches(label: str, pattern: str) -> Column:
    """The whole value matches the pattern."""
    return (F.col("label") == label) & F.col("value").rlike(f"^(?:{pattern})\\z")


def contains(label: str, text: str) -> Column:
    return (F.col("label") == label) & F.contains("value", F.lit(text))


def select_series(index: SeriesIndex, *conditions: Column) -> DataFrame:
    """Ids of the series that have a label for each of the conditions; all series without one."""
    if not conditions:
        return index.series.select("series_id")
    met = F.array_compact(F.array(*[F.when(c, F.lit(i)) for i, c in enumerate(conditions)]))
    found = index.postings.select("series_id", met.alias("met")).where(F.size("met") > 0)
    each = found.select("series_id", F.explode("met").alias("one")).groupBy("series_id").agg(F.count_distinct("one").alias("n"))
    return each.where(F.col("n") == len(conditions)).select("series_id")


def points_of(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points of these series; ids go to every executor if they are few."""
    few = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    return points.join(F.broadcast(ids) if few else ids, "series_id", "left_semi")


def post_rules(index: SeriesIndex, rules: DataFrame) -> DataFrame:
    """The metric rules of a rule table with the pair (label, value) under which each is posted."""
    rules = valid_rules(rules).where("data_source = 'metrics'")
    pairs = rules.select("rule_name", F.explode("selector").alias("label", "value"))
    sizes = index.postings.groupBy("label", "value").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.join(sizes, ["label", "value"], "left").select("rule_name", F.struct(F.coalesce("n", F.lit(0)), "label", "value").alias("p"))
    rarest = counted.groupBy("rule_name").agg(F.min("p").alias("p")).select("rule_name", "p.label", "p.value")
    posted = rules.join(rarest, "rule_name", "left")
    return posted.withColumns({c: F.coalesce(c, F.lit(ANY)) for c in ("label", "value")})


def rules_of_series(index: SeriesIndex, rules: DataFrame) -> DataFrame:
    """(series_id, rule_name, threshold, lookback_s, severity) of every series and metric rule that fit; rule names are unique."""
    posted = post_rules(index, rules)
    every = index.series.select("series_id", F.lit(ANY).alias("label"), F.lit(ANY).alias("value"))
    met = index.postings.select("series_id", "label", "value").unionByName(every).join(posted, ["label", "value"])
    full = met.join(index.series.select("series_id", "labels"), "series_id")
    return full.where(label_match_map(F.col("selector"), F.col("labels"))).select("series_id", "rule_name", "threshold", "lookback_s", "severity")


def join_rules_by_index(points: DataFrame, index: SeriesIndex, rules: DataFrame) -> DataFrame:
    """Points (series_id, ...) with each metric rule that fits them."""
    return points.join(rules_of_series(index, rules), "series_id")
