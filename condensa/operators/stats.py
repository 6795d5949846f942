"""Length and unknown-word statistics for choosing cutoffs.

All statistics start from `value_counts`, one row per distinct length, so the data is read
once and pre-aggregated; what follows works on that small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from condensa.session import materialize

# The bands of the excess over the cutoff; both ends are open.
EXCESS_BANDS = ((0, 5), (5, 10), (10, 20), (20, 40), (40, 80), (80, None))
OUTLIER_FACTOR = 1.5
AXIS_FACTOR = 2.5
HISTOGRAM_BINS = 100


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    """`value, n`: how often each value occurs; written, as every statistic reads it twice."""
    values = df.select(value.cast("bigint").alias("value"))
    return materialize(values.groupBy("value").agg(F.count("*").alias("n")), "value-counts")


def five_numbers(counts: DataFrame) -> DataFrame:
    """One row: minimum, quartiles (linear interpolation), maximum."""
    quartile = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    return counts.agg(
        F.min("value").alias("min_value"),
        quartile.alias("q"),
        F.max("value").alias("max_value"),
        F.sum("n").alias("total"),
    ).select(
        "min_value",
        F.get("q", F.lit(0)).alias("q1"),
        F.get("q", F.lit(1)).alias("q2"),
        F.get("q", F.lit(2)).alias("q3"),
        "max_value",
        "total",
    )


def length_summary(counts: DataFrame) -> DataFrame:
    """Five numbers and the count of Tukey outliers, in one row."""
    reach = F.lit(OUTLIER_FACTOR) * (F.col("q3") - F.col("q1"))
    outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    names = ["min_value", "q1", "q2", "q3", "max_value"]
    return (
        _with_summary(counts)
        .groupBy(*names)
        .agg(F.sum(F.when(outside, F.col("n")).otherwise(0)).alias("outliers"))
    )


def _with_summary(counts: DataFrame) -> DataFrame:
    """Each value next to the summary, which every task receives as one value."""
    summary = five_numbers(counts).select(F.struct("*")).scalar()
    return counts.withColumn("s", summary).select("value", "n", "s.*")


def band_name(low: int, high: int | None) -> str:
    return f"share_{low}_{high}" if high is not None else f"share_over_{low}"


def cutoff_report(counts: DataFrame, cutoff: int) -> DataFrame:
    """One row of shares of all values: over the cutoff, and per band of the excess."""
    excess = F.col("value") - F.lit(cutoff)

    def share(condition: Column) -> Column:
        return F.sum(F.when(condition, F.col("n")).otherwise(0)) / F.sum("n")

    bands = []
    for low, high in EXCESS_BANDS:
        inside = excess > low if high is None else (excess > low) & (excess < high)
        bands.append(share(inside).alias(band_name(low, high)))
    return counts.agg(share(excess > 0).alias("share_over"), *bands)


def distribution_report(counts: DataFrame, cutoff: int | None = None) -> DataFrame:
    """One row: five numbers, outliers and, if a cutoff is given, the cutoff shares."""
    summary = length_summary(counts)
    if cutoff is None:
        return summary
    shares = cutoff_report(counts, cutoff)
    in_one = shares.select(F.struct("*")).scalar()
    return summary.withColumn("s", in_one).select(
        *summary.columns, *[F.col(f"s.{c}").alias(c) for c in shares.columns]
    )


def histogram(counts: DataFrame, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """`bin, low, high, n, shown`: `bins` equal-width bins, the last one closed on the right.

    `shown` marks the bins that start within `q3 + 2.5 * (q3 - q1)`. Empty bins have `n` = 0; values
    that are all equal lie in the first bin, and without values there are no bins.
    """
    width = (F.col("max_value") - F.col("min_value")) / F.lit(float(bins))
    place = F.when(
        width > 0,
        F.least(F.floor((F.col("value") - F.col("min_value")) / width), F.lit(bins - 1)),
    ).otherwise(0)
    axis_end = F.col("q3") + F.lit(AXIS_FACTOR) * (F.col("q3") - F.col("q1"))
    low = F.col("min_value") + F.col("bin") * F.col("width")
    filled = (
        _with_summary(counts).groupBy(place.cast("int").alias("bin")).agg(F.sum("n").alias("n"))
    )
    summary = five_numbers(counts).where("total > 0").select(
        "min_value", width.alias("width"), axis_end.alias("axis_end")
    )
    every = summary.select("*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(filled, "bin", "left").select(
        "bin",
        low.alias("low"),
        (low + F.col("width")).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
        (low <= F.col("axis_end")).alias("shown"),
    )


def excess_counts(counts: DataFrame, cutoff: int) -> DataFrame:
    """`value, n` of the excesses over the cutoff."""
    return counts.where(F.col("value") > cutoff).select(
        (F.col("value") - F.lit(cutoff)).alias("value"), "n"
    )
