"""Articles to fixed-length id arrays with a per-document dictionary of unknown words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import (
    MAX_ID,
    UNK,
    close_and_pad,
    extended_ids,
    pad_to,
    slot_map,
    unknown_slots,
)
from condensa.functions.text import head_word_tokens
from condensa.operators.lookup import attach_to_rows, lookup_id, way, word_table


def encode_examples(
    pairs: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    tx: int,
    ty: int,
    max_oov: int,
    key: str = "doc_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key, x, y, oov_cnt, oov` from `key, source, target`.

    Texts are cut to the first `tx` / `ty` tokens. Unknown source words get ids from
    `vocab_size + 1` in order of first appearance; a target word uses such an id only if the
    source has it. `x` is padded, `y` is closed by eos and padded. A null text counts as empty, and
    rows of equal keys stay apart.

    `lookup` is `inline` (no shuffle, vocabulary up to `MAX_INLINE_WORDS`), `join`, or `auto`; the
    result is the same.
    """

    def tokens_of(text: str, width: int) -> Column:
        return head_word_tokens(F.coalesce(text, F.lit("")), width)

    tokens = pairs.select(
        key, tokens_of("source", tx).alias("x_tokens"), tokens_of("target", ty).alias("y_tokens")
    )
    return encode_tokens(tokens, vocab, vocab_size, tx, ty, max_oov, key, lookup)


def encode_tokens(
    tokens: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    tx: int,
    ty: int,
    max_oov: int,
    key: str = "doc_id",
    lookup: str = "auto",
    source_eos: bool = False,
) -> DataFrame:
    """The same from `key, x_tokens, y_tokens`, arrays that are cut already."""
    ids_of = {"inline": _ids_inline, "join": _ids_joined}[way(lookup, vocab_size)]
    with_ids = ids_of(tokens, vocab, key)
    return finish_examples(with_ids, vocab_size, tx, ty, max_oov, key, source_eos)


def finish_examples(
    with_ids: DataFrame,
    vocab_size: int,
    tx: int,
    ty: int,
    max_oov: int,
    key: str = "doc_id",
    source_eos: bool = False,
) -> DataFrame:
    """The steps shared by word and piece mode: slots, extended ids, closing, padding."""
    slots = unknown_slots(F.col("x_tokens"), F.col("x_ids"), max_oov)
    slotted = with_ids.withColumn("slots", slots)
    x = extended_ids(F.col("x_tokens"), F.col("x_ids"), F.col("slots"), vocab_size)
    y = extended_ids(F.col("y_tokens"), F.col("y_ids"), F.col("slots"), vocab_size)
    return slotted.select(
        key,
        (close_and_pad(x, tx) if source_eos else pad_to(x, tx)).alias("x"),
        close_and_pad(y, ty).alias("y"),
        F.size("slots").alias("oov_cnt"),
        slot_map(F.col("slots"), vocab_size).alias("oov"),
    )


def _ids_inline(tokens: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    table = word_table(vocab)

    def ids(name: str) -> Column:
        return F.transform(F.col(name), lambda word: lookup_id(F.col("_words"), word))

    return tokens.withColumn("_words", table).select(
        key,
        "x_tokens",
        "y_tokens",
        ids("x_tokens").alias("x_ids"),
        ids("y_tokens").alias("y_ids"),
    )


def _ids_joined(tokens: DataFrame, vocab: DataFrame, key: str) -> DataFrame:
    table = vocab.select(F.col("word").alias("key"), F.col("id").cast("int").alias("value"))
    known = attach_to_rows(tokens, F.concat("x_tokens", "y_tokens"), table)

    def ids(name: str) -> Column:
        found = F.transform(name, lambda word: F.element_at("_found", word))
        return F.transform(found, lambda i: F.coalesce(i, F.lit(UNK)))

    return known.select(
        key, "x_tokens", "y_tokens", ids("x_tokens").alias("x_ids"), ids("y_tokens").alias("y_ids")
    )


def oov_rows(examples: DataFrame, key: str = "doc_id") -> DataFrame:
    """Long form of the per-document dictionary: `key, id, word`."""
    rows = examples.select(key, F.explode_outer("oov").alias("id", "word"))
    return rows.where("id IS NOT NULL")


def length_filter(
    df: DataFrame, source_len: Column, target_len: Column, max_tx: int, max_ty: int
) -> DataFrame:
    """Drop examples whose source or target is too long."""
    return df.where((source_len <= max_tx) & (target_len <= max_ty))


def id_range_check(examples: DataFrame, largest: int = MAX_ID) -> DataFrame:
    """One row: ids seen, ids outside `0..largest`, largest id."""
    ids = F.concat("x", "y")
    return examples.select(
        F.size(ids).cast("bigint").alias("n"),
        F.size(F.filter(ids, lambda i: (i < 0) | (i > largest))).cast("bigint").alias("bad"),
        F.array_max(ids).alias("top"),
    ).agg(
        F.sum("n").alias("n_ids"),
        F.sum("bad").alias("n_out_of_range"),
        F.max("top").alias("max_id"),
    )
