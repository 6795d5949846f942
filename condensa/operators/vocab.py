"""Vocabulary building and loading."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condensa.functions.ids import FIRST_WORD_ID, RESERVED_WORDS
from condensa.operators.lookup import explode_words
from condensa.operators.skew import heaviest


def word_counts(df: DataFrame, tokens: Column) -> DataFrame:
    """`word, n` over all token arrays."""
    return explode_words(df, tokens).groupBy("word").agg(F.count("*").alias("n"))


def build_vocab(counts: DataFrame, words: int) -> DataFrame:
    """`word, id, n` of the `words` most frequent words; ties by word; ids from 4."""
    top = heaviest(counts, "n", "word", words)
    return top.select("word", (F.col("idx") + FIRST_WORD_ID).cast("int").alias("id"), "n")


def vocab_from_mapping(spark: SparkSession, words: Mapping[str, int]) -> DataFrame:
    """A vocabulary from a `word -> id` dictionary, without the reserved words.

    A word of its own on a reserved id is an error: that id would decode to the reserved word.
    """
    own = {w: int(i) for w, i in words.items() if w not in RESERVED_WORDS}
    if wrong := sorted(w for w, i in own.items() if i < FIRST_WORD_ID):
        raise ValueError(f"words on the ids of reserved words: {wrong[:10]}")
    return spark.createDataFrame(list(own.items()), "word string, id int")


def save_vocab(vocab: DataFrame, path: str) -> None:
    vocab.write.parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("word string, id int, n bigint").parquet(path)
