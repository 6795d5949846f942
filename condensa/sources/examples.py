"""Encoded examples: Parquet as the main form, ragged CSV as the exchange form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from condensa.sources.articles import PLACE, by_place, with_place


def write_examples(examples: DataFrame, path: str) -> None:
    examples.write.parquet(path)


def read_examples(spark: SparkSession, path: str) -> DataFrame:
    """Key, `x, y, oov_cnt, oov`, the key with the type that was written."""
    return spark.read.parquet(path).drop("batch")


def _quoted(word: Column) -> Column:
    doubled = F.concat(F.lit('"'), F.replace(word, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(word.rlike('[",\r\n]'), doubled).otherwise(word)


def csv_line(x: str = "x", y: str = "y", oov_cnt: str = "oov_cnt", oov: str = "oov") -> Column:
    """`x..., y..., oov_cnt, (word, id)...` as one CSV line with minimal quoting."""
    words = F.transform(
        F.map_entries(oov), lambda e: F.concat_ws(",", _quoted(e["value"]), e["key"])
    )
    return F.concat_ws(",", F.array_join(x, ","), F.array_join(y, ","), F.col(oov_cnt), words)


def write_examples_csv(examples: DataFrame, path: str) -> None:
    examples.select(csv_line().alias("value")).write.option("lineSep", "\r\n").text(path)


def read_examples_csv(
    spark: SparkSession, path: str, tx: int, ty: int, max_oov: int, key: str | None = None
) -> DataFrame:
    """`x, y, oov_cnt, oov`; with `key`, also the position of the row in the files, from 0.

    A row whose dictionary does not fit `max_oov` or its count is an error, whatever columns are
    read: one column more than fits is parsed, and rows are filtered by the check.
    """
    head = tx + ty + 1
    names = [f"c{i}" for i in range(head + 2 * max_oov + 1)]
    schema = StructType([StructField(n, StringType()) for n in names])
    rows = spark.read.schema(schema).options(quote='"', escape='"').csv(path)
    if key:
        rows = with_place(rows)
    entries = F.filter(
        F.array(
            *[
                F.struct(
                    F.col(names[i + 1]).cast("int").alias("id"), F.col(names[i]).alias("word")
                )
                for i in range(head, len(names) - 1, 2)
            ]
        ),
        lambda e: e["id"].isNotNull(),
    )
    read = rows.select(
        *(PLACE if key else []),
        F.array(*names[:tx]).cast("array<int>").alias("x"),
        F.array(*names[tx : tx + ty]).cast("array<int>").alias("y"),
        F.col(names[head - 1]).cast("int").alias("oov_cnt"),
        F.map_from_entries(entries).alias("oov"),
        F.col(names[-1]).alias("_more"),
    )
    # the arrays are written for that, and not their many columns
    read = by_place(read, key) if key else read
    whole = (F.size("oov") == F.col("oov_cnt")) & F.col("_more").isNull()
    text = f"a dictionary does not have its count, or more than {max_oov}"
    broken = F.raise_error(F.lit(text)).cast("boolean")
    checked = F.when(F.coalesce(whole, F.lit(False)), F.lit(True)).otherwise(broken)
    return read.where(checked).drop("_more")
