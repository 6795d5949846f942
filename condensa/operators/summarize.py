"""Baseline summaries: the first sentences, and the most informative ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from condensa.functions.text import flatten_newlines, split_sentences, word_tokens
from condensa.operators.skew import attach_by_key
from condensa.session import materialize, partitions_by_size

# scores that differ by rounding noise only count as equal; ties go to the earlier sentence
SCORE_DIGITS = 6
#: Bytes of documents, as Spark estimates them, whose words one task sorts.
TASK_BYTES = 2 << 20


def sentences_of(text: str) -> Column:
    return split_sentences(flatten_newlines(text))


def lead_k(docs: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """`key, summary`: the first `k` sentences."""
    return docs.select(key, F.array_join(F.slice(sentences_of("text"), 1, k), " ").alias("summary"))


def _by_key(docs: DataFrame, key: str) -> DataFrame:
    """The texts dealt by key, so that a task's share does not grow with the input."""
    texts = docs.select(key, "text")
    return texts.repartition(partitions_by_size(texts, TASK_BYTES), key)


def sentence_scores(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, pos, score`: mean tf-idf weight of the tokens of each sentence.

    tf is the count of the word in its document, idf is `ln(documents / documents with it)`.
    A sentence without tokens scores 0. Tokens are counted per sentence before they meet the
    document frequencies.
    """
    return _sentence_scores(docs, _by_key(docs, key), key)


def _sentence_scores(docs: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    tokens = texts.select(
        key, F.posexplode_outer(sentences_of("text")).alias("pos", "sentence")
    ).select(key, "pos", F.explode_outer(word_tokens("sentence")).alias("word"))
    counted = tokens.groupBy(key, "word", "pos").agg(F.count("word").alias("c"))
    of_word = Window.partitionBy(key, "word")
    terms = counted.withColumn("tf", F.sum("c").over(of_word)).withColumn(
        "first", F.row_number().over(of_word.orderBy("pos")) == 1
    )
    terms = materialize(terms, "terms")  # read for document frequencies, frequent words and weights
    frequency = terms.where("first AND word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n"))
    terms = terms.drop("first")
    weighted = attach_by_key(terms, frequency, "word", "n")
    total = docs.agg(F.count("*")).scalar()
    scored = (
        weighted.withColumn("weight", F.col("tf") * F.ln(total / F.col("n")))
        .groupBy(key, "pos")
        .agg(F.sum(F.col("c") * F.col("weight")).alias("weights"), F.sum("c").alias("size"))
    )
    mean = F.when(F.col("size") > 0, F.col("weights") / F.col("size")).otherwise(0.0)
    return scored.select(key, "pos", mean.alias("score"))


def extractive_summary(docs: DataFrame, k: int, key: str = "doc_id") -> DataFrame:
    """`key, summary`: the `k` sentences of highest score, in their original order.

    The texts are shuffled by key once; scoring and the final pick read the same shuffle.
    """
    texts = _by_key(docs, key)
    best = Window.partitionBy(key).orderBy(F.round("score", SCORE_DIGITS).desc(), "pos")
    chosen = (
        _sentence_scores(docs, texts, key)
        .withColumn("place", F.row_number().over(best))
        .where(F.col("place") <= k)
        .groupBy(key)
        .agg(F.array_sort(F.collect_list("pos")).alias("chosen"))
    )
    picked = F.transform("chosen", lambda pos: F.get("sentences", pos))
    sentences = texts.select(key, sentences_of("text").alias("sentences"))
    return sentences.join(chosen, key).select(key, F.array_join(picked, " ").alias("summary"))
