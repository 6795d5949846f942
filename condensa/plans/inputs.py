"""Inputs shared by the registered queries: documents, text pairs, vocabulary, examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from condensa.functions.ids import EOS, UNK
from condensa.functions.text import (
    bind,
    first_word_token,
    flatten_newlines,
    split_sentences,
    word_tokens,
)
from condensa.operators.encode import encode_examples
from condensa.operators.lookup import attach_to_rows, lookup_id, way, word_table
from condensa.operators.sample import ordered_index
from condensa.operators.skew import attach_by_key
from condensa.operators.subword import piece_counts
from condensa.operators.vocab import build_vocab, word_counts
from condensa.session import materialize, spread

TX, TY, MAX_OOV = 100, 30, 20
VOCAB_WORDS = 2000
VOCAB_SIZE = VOCAB_WORDS + 4
CUTOFF = 400
P_GEN = 0.8
BATCH_SIZE = 64
SUMMARY_SENTENCES = 3
SAMPLES, SEED, EPOCH = 25, 7, 3
BEAM_WIDTH, PATH_LENGTH = 4, TY
POINTER_LENGTH, COVERAGE = 8, 1.0
ALIGNMENT_ROUNDS = 3
DISCOUNT, SMOOTHED_LENGTH = 0.75, 12
PIECE_CHARS = 4


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return spread(docs, "doc_id")


def _first_and_rest(text: str) -> Column:
    """Source = all sentences but the first, target = the first; null for a single sentence.

    The text is cut once: the sentences behind the first cut, joined by a space, are the text there.
    """
    return bind(
        split_sentences(flatten_newlines(text), limit=2),
        lambda s: F.when(
            F.size(s) > 1,
            F.struct(F.get(s, F.lit(1)).alias("source"), F.get(s, F.lit(0)).alias("target")),
        ),
    )


def doc_pairs(docs: DataFrame) -> DataFrame:
    """`doc_id, source, target`; the sentences are cut once per text."""
    rows = docs.select("doc_id", F.explode_outer(F.array(_first_and_rest("text"))).alias("p"))
    return rows.where("p IS NOT NULL").select("doc_id", "p.source", "p.target")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`ex_id, source, target`: a user turn and the assistant turn that follows it.

    The next turn of a conversation is the one with the next larger number, whether numbers have
    gaps or not; of rows with one number, the order is that of role and text. All turns are numbered
    over ranges of conversation and turn, and neighbours meet under the number of the first one, so
    a long conversation is spread over all tasks.
    """
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    order = ["conv_id", "turn", "role", "text"]
    placed = ordered_index(turns.select(*order), *order)
    is_user, replies = F.col("role") == "user", F.col("role") == "assistant"
    return (
        placed.where(is_user | replies)
        .select(
            "conv_id",
            F.when(is_user, F.col("idx")).otherwise(F.col("idx") - 1).alias("idx"),
            F.when(is_user, F.col("turn")).alias("turn"),
            F.when(is_user, F.col("text")).alias("source"),
            F.when(replies, F.col("text")).alias("target"),
        )
        .groupBy("conv_id", "idx")
        .agg(*[F.max(c).alias(c) for c in ("turn", "source", "target")])
        .where("source IS NOT NULL AND target IS NOT NULL")
        .select(F.concat_ws(":", "conv_id", "turn").alias("ex_id"), "source", "target")
    )


def vocabulary(docs: DataFrame) -> DataFrame:
    return build_vocab(word_counts(docs, word_tokens("text")), VOCAB_WORDS)


def piece_vocabulary(pairs: DataFrame) -> DataFrame:
    """The vocabulary of the pieces of both cleaned sides."""
    counts = piece_counts(pairs, ["source", "target"], PIECE_CHARS)
    return materialize(build_vocab(counts, VOCAB_WORDS), "pieces")


def written_vocabulary(docs: DataFrame) -> DataFrame:
    """The vocabulary as the file that later steps share."""
    return materialize(vocabulary(docs), "vocab")


def examples(docs: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    vocab = vocabulary(docs) if vocab is None else vocab
    return encode_examples(doc_pairs(docs), vocab, VOCAB_SIZE, TX, TY, MAX_OOV)


def document_ids(docs: DataFrame, vocab: DataFrame, lookup: str = "auto") -> DataFrame:
    """`doc_id, ids`: all tokens of each document as vocabulary ids."""
    words = word_tokens(F.coalesce("text", F.lit("")))
    if way(lookup, VOCAB_SIZE) == "inline":
        ids = F.transform(words, lambda word: lookup_id(F.col("_words"), word))
        return docs.withColumn("_words", word_table(vocab)).select("doc_id", ids.alias("ids"))
    table = vocab.select(F.col("word").alias("key"), F.col("id").cast("int").alias("value"))
    rows = attach_to_rows(docs.select("doc_id", words.alias("words")), F.col("words"), table)
    found = F.transform("words", lambda word: F.coalesce(F.element_at("_found", word), F.lit(UNK)))
    return rows.select("doc_id", found.alias("ids"))


def document_starts(docs: DataFrame, vocab: DataFrame) -> DataFrame:
    """`ex_id, start`: the id of the first token alone, no other one is cut; eos for an empty document."""
    word = first_word_token(F.coalesce("text", F.lit("")))
    if way("auto", VOCAB_SIZE) == "inline":
        found = docs.withColumn("_words", word_table(vocab))
        start = F.when(word.isNull(), EOS).otherwise(lookup_id(F.col("_words"), word))
        return found.select(F.col("doc_id").alias("ex_id"), start.alias("start"))
    firsts = docs.select(F.col("doc_id").alias("ex_id"), word.alias("word"))
    known = attach_by_key(materialize(firsts, "first-words"), vocab, "word", "id")
    start = F.when(F.col("word").isNull(), EOS).otherwise(F.coalesce("id", F.lit(UNK)))
    return known.select("ex_id", start.cast("int").alias("start"))


def lead_pairs(docs: DataFrame) -> DataFrame:
    """`doc_id, pred, ref` token arrays: first sentence of the source against the target."""
    first = F.get(split_sentences("source"), F.lit(0))
    return doc_pairs(docs).select(
        "doc_id", word_tokens(first).alias("pred"), word_tokens("target").alias("ref")
    )
