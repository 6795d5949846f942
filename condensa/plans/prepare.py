"""From article files to training files: one call per kind of output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from condensa.operators.encode import encode_examples
from condensa.sources import articles
from condensa.sources.examples import write_examples, write_examples_csv


def _pairs(spark: SparkSession, path: str, fields: tuple[str, str], key: str) -> DataFrame:
    source, target = fields
    read = articles.read_articles(spark, path, list(fields), key)
    return read.withColumnsRenamed({source: "source", target: "target"})


def _write(examples: DataFrame, path: str, form: str) -> None:
    {"parquet": write_examples, "csv": write_examples_csv}[form](examples, path)


def prepare_examples(
    spark: SparkSession,
    source_path: str,
    dest_path: str,
    fields: tuple[str, str],
    vocab: DataFrame,
    vocab_size: int,
    tx: int,
    ty: int,
    max_oov: int,
    key: str = "doc_id",
    form: str = "parquet",
) -> None:
    """JSON lines to word-mode examples; `fields` names the source and the target text."""
    pairs = _pairs(spark, source_path, fields, key)
    _write(encode_examples(pairs, vocab, vocab_size, tx, ty, max_oov, key), dest_path, form)


def prepare_sentences(
    spark: SparkSession,
    source_path: str,
    dest_path: str,
    proportion: float = 1.0,
    field: str = "text",
    key: str = "doc_id",
) -> None:
    """JSON lines to one lower-case sentence per line, from the first part of the articles."""
    read = articles.read_articles(spark, source_path, [field], key)
    articles.write_sentences(read.withColumnRenamed(field, "text"), dest_path, key, proportion)


def prepare_normalized(
    spark: SparkSession, source_path: str, dest_path: str, fields: list[str]
) -> None:
    """JSON lines to a CSV with the normalised fields."""
    read = articles.read_articles(spark, source_path, fields)
    articles.write_normalized_csv(read, fields, dest_path)
