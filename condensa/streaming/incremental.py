"""Encode articles as their files arrive.

Inline encoding needs no shuffle and keeps no state, so the batch operator runs on a stream as it is;
a larger vocabulary is joined batch by batch. The checkpoint folder remembers which files are done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import DataType, StringType

from condensa.operators.encode import encode_examples
from condensa.operators.lookup import way
from condensa.sources.articles import article_schema


def article_stream(
    spark: SparkSession, path: str, fields: list[str], key: str, key_type: DataType = StringType()
) -> DataFrame:
    return spark.readStream.schema(article_schema(fields, key, key_type)).json(path)


def encode_new_articles(
    articles: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    tx: int,
    ty: int,
    max_oov: int,
    out_path: str,
    checkpoint_path: str,
    key: str = "doc_id",
    lookup: str = "auto",
) -> StreamingQuery:
    """Encode all files not seen before into Parquet at `out_path`, then stop.

    With a vocabulary too large for an inline table, each batch of new files is joined to it; a batch
    that is run again after a failure replaces what it wrote.
    """

    def encode(df: DataFrame) -> DataFrame:
        return encode_examples(df, vocab, vocab_size, tx, ty, max_oov, key, lookup=lookup)

    if way(lookup, vocab_size) == "inline":
        writer = encode(articles).writeStream.format("parquet").option("path", out_path)
    else:

        def write(batch: DataFrame, number: int) -> None:
            encode(batch).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

        writer = articles.writeStream.foreachBatch(write)
    return (
        writer.option("checkpointLocation", checkpoint_path).trigger(availableNow=True).start()
    )
