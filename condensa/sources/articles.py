"""JSON-lines articles, normalised CSV, sentence corpora."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import DataType, StringType, StructField, StructType

from condensa.functions.text import flatten_newlines, normalize_text, split_sentences
from condensa.operators.lookup import explode_words
from condensa.operators.sample import head_fraction
from condensa.operators.skew import broadcast_if_small
from condensa.session import materialize


def article_schema(
    fields: list[str], key: str | None = None, key_type: DataType = StringType()
) -> StructType:
    columns = [StructField(key, key_type)] if key else []
    return StructType(columns + [StructField(f, StringType()) for f in fields])


def read_articles(
    spark: SparkSession,
    path: str,
    fields: list[str],
    key: str | None = None,
    key_type: DataType = StringType(),
) -> DataFrame:
    """The named fields of each JSON line; other fields are never parsed.

    Ids are texts unless `key_type` says otherwise; a line without an id, or with one of another
    type, is an error.
    """
    read = spark.read.schema(article_schema(fields, key, key_type)).json(path)
    return read if key is None else with_checked_key(read, key)


def with_checked_key(df: DataFrame, key: str) -> DataFrame:
    """`df`, which fails at a row without a key; the check is a filter, so it is not pruned away."""
    missing = F.raise_error(F.lit(f"an article has no usable {key}")).cast("boolean")
    return df.where(F.when(F.col(key).isNull(), missing).otherwise(F.lit(True)))


# Fixed value: the columns that tell where a row was read.
PLACE = ("_file", "_block", "_line")


def with_place(df: DataFrame) -> DataFrame:
    """`df`, read from files, with the columns `PLACE`: file, start of the split, and a number that rises in it."""
    found = F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()
    return df.withColumns(dict(zip(PLACE, found)))


def by_place(placed: DataFrame, key: str) -> DataFrame:
    """Rows with `PLACE` numbered from 0 by file and line.

    The rows are written once, where they are: a split is read by one task, so its lines have numbers that follow
    one another, and only the splits, one row each, are put in order.
    """
    written = materialize(placed, "placed")
    splits = written.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_line").alias("_first"))
    # one row per split: the window without partitions sees no more than that
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = splits.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    index = (F.col("_before") + F.col("_line") - F.col("_first")).cast("long")
    met = written.join(F.broadcast(offsets), ["_file", "_block"])
    return met.withColumn(key, index).drop(*PLACE, "_before", "_first")


def numbered(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """`df`, read from files, numbered from 0 by file name and line, for files without an id field."""
    return by_place(with_place(df), key)


class SplitArticles(NamedTuple):
    """`good` has the asked columns; `bad` has `file, line, value, reason` of every other line."""

    good: DataFrame
    bad: DataFrame


# Why a line is no article.
BROKEN, NO_KEY = "broken", "no key"


def split_articles(
    spark: SparkSession,
    path: str,
    fields: list[str],
    key: str | None = None,
    key_type: DataType = StringType(),
) -> SplitArticles:
    """The articles of JSON lines, and the lines that are none, from one read.

    A line that is no JSON object, or holds a value of another type, is broken; one without a usable id has
    no key. Blank lines are neither. The parsed lines are written once, and both tables read them. Lines are
    numbered from 1 by file: splits are counted, one row each, and a bad line adds those before its own.
    """
    broken, place = "_broken", ["_file", "_block"]
    schema = StructType([*article_schema(fields, key, key_type).fields, StructField(broken, StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": broken}
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_seq"),
    )
    read = lines.withColumn("_article", F.from_json("value", schema, options))
    no_key = F.col(f"_article.{key}").isNull() if key else F.lit(False)
    reason = (
        F.when(F.trim("value") == "", "")
        .when(F.col("_article").isNull() | F.col(f"_article.{broken}").isNotNull(), BROKEN)
        .when(no_key, NO_KEY)
    )
    read = materialize(read.withColumn("reason", reason), "lines")
    splits = read.groupBy(*place).agg(F.min("_seq").alias("_first"), F.count("*").alias("_n"))
    earlier = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    splits = splits.select(*place, (before - F.col("_first") + 1).alias("_before"))
    bad = read.where(F.col("reason").isin(BROKEN, NO_KEY)).join(broadcast_if_small(splits), place)
    columns = [c.name for c in schema.fields if c.name != broken]
    return SplitArticles(
        read.where("reason IS NULL").select(*[F.col(f"_article.{c}").alias(c) for c in columns]),
        bad.select(F.col("_file").alias("file"), (F.col("_seq") + F.col("_before")).alias("line"), "value", "reason"),
    )


def write_articles(df: DataFrame, path: str) -> None:
    df.write.json(path)


def normalized_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[normalize_text(c).alias(c) for c in columns])


def write_normalized_csv(df: DataFrame, columns: list[str], path: str) -> None:
    """Header and the chosen columns, each normalised."""
    normalized_columns(df, columns).write.options(header=True, escape='"', emptyValue="").csv(path)


def read_normalized_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    read = spark.read.schema(article_schema(columns)).options(header=True, escape='"').csv(path)
    return read.select(*[F.coalesce(c, F.lit("")).alias(c) for c in columns])


def write_sentences(
    df: DataFrame, path: str, key: str = "doc_id", proportion: float = 1.0
) -> None:
    """One lower-case sentence per line, documents in key order across the part files.

    Whole documents are range-partitioned and sorted; unfolding them keeps that order.
    """
    kept = head_fraction(df, key, proportion).select(key, "text")
    ordered = kept.repartitionByRange(key).sortWithinPartitions(key)
    # the cut needs the capitals: split first, lower-case after
    pieces = split_sentences(flatten_newlines("text"))
    lines = explode_words(ordered, pieces).select(F.lower("word").alias("value"))
    lines.write.option("lineSep", "\n").text(path)


def read_lines(spark: SparkSession, path: str, name: str = "sentence") -> DataFrame:
    return spark.read.option("lineSep", "\n").text(path).withColumnRenamed("value", name)
