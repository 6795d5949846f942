"""Length statistics that grow with the files: quantile sketches stored per file, merged on demand.

A sketch of a file's values has a bounded size and a bounded error of rank, and sketches merge, so files that are
added later are read alone and no earlier one again. Counts, least and greatest values are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

STORE_SCHEMA = "file string, n bigint, min_value bigint, max_value bigint, sketch binary"
#: Size of a sketch, and how far the share of values up to a quantile may be off, with 99 % certainty.
SIZE, RANK_ERROR = 800, 0.005


def sketch_rows(rows: DataFrame, file: str | Column, value: Column, size: int = SIZE) -> DataFrame:
    """One row of `STORE_SCHEMA` for each file; sketches are made in the map tasks and merged after the shuffle."""
    own = rows.select(F.col(file).alias("file") if isinstance(file, str) else file.alias("file"), value.cast("bigint").alias("v"))
    return own.groupBy("file").agg(
        F.count("v").alias("n"),
        F.min("v").alias("min_value"),
        F.max("v").alias("max_value"),
        F.kll_sketch_agg_bigint("v", size).alias("sketch"),
    )


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """The stored sketches; none where nothing has been stored."""
    try:
        return spark.read.schema(STORE_SCHEMA).parquet(store)
    except AnalysisException:
        return spark.createDataFrame([], STORE_SCHEMA)


def add_files(
    spark: SparkSession, files: str, store: str, value: Column, size: int = SIZE
) -> list[str]:
    """Sketches the Parquet files of a folder that the store does not have; returns their names.

    Only those files are read. Names are compared as Spark lists them; a file that changes under its name
    is not noticed, as data files do not.
    """
    known = {r["file"] for r in read_store(spark, store).select("file").collect()}
    new = sorted(set(spark.read.parquet(files).inputFiles()) - known)
    if new:
        rows = spark.read.parquet(*new)
        sketched = sketch_rows(rows, F.input_file_name(), value, size)
        sketched.write.mode("append").parquet(store)
    return new


def merged_summary(stored: DataFrame) -> DataFrame:
    """`n, min_value, q1, q2, q3, max_value` of all files: exact, but for quartiles within `RANK_ERROR`."""
    merged = stored.where("n > 0").agg(
        F.sum("n").alias("n"),
        F.min("min_value").alias("min_value"),
        F.max("max_value").alias("max_value"),
        F.kll_merge_agg_bigint("sketch").alias("sketch"),
    )
    at = F.kll_sketch_get_quantile_bigint("sketch", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    quartiles = F.when(F.col("n") > 0, at)
    return merged.select(
        "n", "min_value", *[F.get(quartiles, F.lit(i)).alias(f"q{i + 1}") for i in range(3)], "max_value"
    )


def rank_errors(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """`summary` with `error_1` to `error_3`: how far each quartile's rank is off, by exact `counts` (`value, n`)."""
    # one row, which every task receives as one value
    known = counts.withColumn("s", summary.select(F.struct("*")).scalar())
    met = known.select("value", F.col("n").alias("c"), "s.*")

    def error(i: int) -> Column:
        q, share = F.col(f"q{i}"), 0.25 * i
        below = F.sum(F.when(F.col("value") < q, F.col("c")).otherwise(0)) / F.max("n")
        upto = F.sum(F.when(F.col("value") <= q, F.col("c")).otherwise(0)) / F.max("n")
        return F.greatest(below - share, F.lit(share) - upto, F.lit(0.0)).alias(f"error_{i}")

    columns = ["n", "min_value", "q1", "q2", "q3", "max_value"]
    return met.groupBy(*columns).agg(*[error(i) for i in (1, 2, 3)])
