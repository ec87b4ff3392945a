"""Exact percentiles and equal-width histograms without gathering a group in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulselake.session import shared_folder


SPLITS = 4096
MOST_VALUES = 200_000


def _placed(rows: DataFrame, by: list[str], bounds: DataFrame, value: str) -> DataFrame:
    """Rows with the bounds of their group."""
    if by:
        keyed = bounds.select(*[F.col(c).alias(f"_key_{i}") for i, c in enumerate(by)], "_n", "_low", "_high")
        return rows.join(keyed, [F.col(c).eqNullSafe(F.col(f"_key_{i}")) for i, c in enumerate(by)])
    only = bounds.select(F.struct("_n", "_low", "_high").alias("bounds")).scalar()
    return rows.select(value, only.alias("_only")).select(value, "_only.*")


def _covering(q: float, low: Column, high: Column) -> list[Column]:
    """Aggregates of ``low`` and ``high`` over those rows of counts that cover the two wanted ranks."""
    wanted = (F.col("_n") - 1) * F.lit(q)
    covers = lambda rank: (rank < F.col("_upto")) & (rank >= F.col("_upto") - F.col("_c"))
    return [F.max(F.when(covers(F.floor(wanted)), low)), F.max(F.when(covers(F.ceil(wanted)), high))]


def _narrowed(rows: DataFrame, by: list[str], bounds: DataFrame, q: float, value: str) -> DataFrame:
    """Closer bounds: the values between are counted in ``SPLITS`` ranges of equal width, and those with the wanted ranks stay."""
    v = F.col(value)
    place = F.floor((v / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2) * SPLITS)
    part = F.when(v < F.col("_low"), -1).when(F.col("_high") <= F.col("_low"), 0).otherwise(F.least(place, F.lit(SPLITS - 1)))
    counted = _placed(rows, by, bounds, value).where(v <= F.col("_high")).groupBy(*by, "_n", part.alias("_part")).agg(
        F.count(F.lit(1)).alias("_c"), F.min(v).alias("_least"), F.max(v).alias("_most")
    )
    upto = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    low, high = _covering(q, F.col("_least"), F.col("_most"))
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto))
    return ranked.groupBy(*by).agg(F.max("_n").alias("_n"), low.alias("_low"), high.alias("_high"))


def percentile(
    df: DataFrame, by: list[str], percent: float, value: str = "value", out: str = "percentile", accuracy: int = 10_000
) -> DataFrame:
    """Exact percentile per group, interpolated between neighbouring ranks.

    A bounded sketch first gives two values that enclose the wanted ranks. Values below them are only
    counted, values above are dropped from the count, and equal values between them are counted together,
    all before the shuffle. While a group has more than about ``MOST_VALUES`` different values between its bounds, a
    round of counting by ranges brings the bounds closer; what is ordered then is bounded, with or without groups.
    """
    q, margin = percent / 100.0, 4.0 / accuracy
    v = F.col(value)
    rows = df.where(v.isNotNull())
    enclosing = F.percentile_approx(
        v, F.array(F.lit(max(q - margin, 0.0)), F.lit(min(q + margin, 1.0))), F.lit(accuracy)
    )
    exact = F.col("_n") <= accuracy  # the sketch holds every value, and its ranks are rounded
    bounds = (
        rows.groupBy(*by)
        .agg(F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), enclosing.alias("_b"))
        .select(
            *by,
            "_n",
            F.when(exact | F.lit(q - margin <= 0), F.col("_min")).otherwise(F.col("_b")[0]).alias("_low"),
            F.when(exact | F.lit(q + margin >= 1), F.col("_max")).otherwise(F.col("_b")[1]).alias("_high"),
        )
    )
    spark = df.sparkSession
    while True:
        path = shared_folder(spark, "bounds")
        bounds.write.parquet(path)
        bounds = spark.read.parquet(path)
        between = _placed(rows, by, bounds, value).where((v >= F.col("_low")) & (v <= F.col("_high")))
        most = between.groupBy(*by).agg(F.approx_count_distinct(v).alias("n")).agg(F.max("n")).first()[0]
        if (most or 0) <= MOST_VALUES:
            break
        bounds = _narrowed(rows, by, bounds, q, value)
    counted = (
        _placed(rows, by, bounds, value)
        .where(v <= F.col("_high"))
        .groupBy(*by, "_n", F.when(v >= F.col("_low"), v).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    upto = Window.partitionBy(*by).orderBy(F.asc_nulls_first("_v"))
    # Ranks count from 0: value _v covers ranks (_upto - _c) to (_upto - 1).
    ranked = counted.withColumn("_upto", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
    lower, upper = _covering(q, F.col("_v"), F.col("_v"))
    ends = ranked.groupBy(*by).agg(F.max("_n").alias("_n"), lower.alias("_lower"), upper.alias("_upper"))
    wanted = (F.col("_n") - 1) * F.lit(q)
    found = F.col("_lower").isNotNull() & F.col("_upper").isNotNull()
    between = F.col("_lower") + (F.col("_upper") - F.col("_lower")) * (wanted - F.floor(wanted))
    return ends.select(
        *by,
        F.col("_n").alias("n"),
        F.when(found, between).otherwise(F.raise_error(F.lit("percentile outside its bounds"))).alias(out),
    )


def histogram(df: DataFrame, bins: int = 5, value: str = "value", least_width: float = 0.0) -> DataFrame:
    """Counts in equal-width bins from the smallest to the greatest value, the last bin closed.

    The two ends come from a one-row scalar subquery. Empty bins have no row.
    """
    v = F.col(value)
    ends = df.agg(F.struct(F.min(v).alias("low"), F.max(v).alias("high")).alias("ends")).scalar()
    placed = df.where(v.isNotNull()).select(v.alias("_v"), ends.alias("_ends"))
    low = F.col("_ends.low")
    width = F.greatest((F.col("_ends.high") - low) / F.lit(bins), F.lit(least_width))
    bin_of = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("_v") - low) / width), F.lit(bins - 1)))
    return (
        placed.groupBy(bin_of.cast("int").alias("bin"), low.alias("_low"), width.alias("_width"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(
            "bin",
            (F.col("_low") + F.col("bin") * F.col("_width")).alias("bin_from"),
            (F.col("_low") + (F.col("bin") + 1) * F.col("_width")).alias("bin_to"),
            "n",
        )
    )
