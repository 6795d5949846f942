"""Id-array column functions: padding, closing, unknown-word slots, masks, n-grams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from condensa.functions.text import as_column, bind

# The reserved ids and the words they decode to.
PAD, SOS, EOS, UNK = 0, 1, 2, 3
RESERVED_WORDS = ("<pad>", "<sos>", "<eos>", "<unk>")
FIRST_WORD_ID = len(RESERVED_WORDS)
# Fixed value: the largest id that fits an unsigned 16-bit field.
MAX_ID = 65535


def pad_to(ids: Column, width: int, pad: int = PAD) -> Column:
    """Cut or right-pad to `width`."""
    kept = F.slice(ids, 1, width)
    return bind(
        kept, lambda a: F.concat(a, F.array_repeat(F.lit(pad), F.lit(width) - F.size(a)))
    )


def close_and_pad(ids: Column, width: int, eos: int = EOS, pad: int = PAD) -> Column:
    """Append eos and pad to `width`; a full array has its last id replaced by eos."""
    return pad_to(F.concat(F.slice(ids, 1, width - 1), F.array(F.lit(eos))), width, pad)


def unknown_slots(tokens: Column, ids: Column, max_oov: int) -> Column:
    """Distinct tokens with the unknown id, in order of first appearance, at most `max_oov`."""
    pairs = F.arrays_zip(tokens.alias("token"), ids.alias("id"))
    unknown = F.filter(pairs, lambda p: p["id"] == UNK)
    return F.slice(F.array_distinct(F.transform(unknown, lambda p: p["token"])), 1, max_oov)


def extended_ids(tokens: Column, ids: Column, slots: Column, vocab_size: int) -> Column:
    """Replace the unknown id by `vocab_size + k` where the token is the k-th slot word."""

    def one(slot_words: Column) -> Callable[[Column], Column]:
        def extend(pair: Column) -> Column:
            slot = F.array_position(slot_words, pair["token"]).cast("int")
            return (
                F.when(pair["id"] != UNK, pair["id"])
                .when(slot > 0, slot + F.lit(vocab_size))
                .otherwise(F.lit(UNK))
            )

        return extend

    pairs = F.arrays_zip(tokens.alias("token"), ids.alias("id"))
    return bind(slots, lambda words: F.transform(pairs, one(words)))


def slot_map(slots: Column, vocab_size: int) -> Column:
    """`extended id -> word` map of the slot words."""
    return F.map_from_entries(
        F.transform(
            slots, lambda word, i: F.struct((i + F.lit(vocab_size + 1)).alias("id"), word)
        )
    )


def collapse_unknown(ids: Column | str, vocab_size: int) -> Column:
    """Ids outside the vocabulary become the unknown id."""
    return F.transform(
        as_column(ids), lambda i: F.when(i > vocab_size - 1, F.lit(UNK)).otherwise(i)
    )


def real_ids(ids: Column | str) -> Column:
    """The ids that are not padding."""
    return F.filter(as_column(ids), lambda i: i != PAD)


def until_eos(ids: Column | str, eos: int = EOS) -> Column:
    """The ids before the first eos; all of them when there is none."""

    def cut(a: Column) -> Column:
        end = F.array_position(a, F.lit(eos)).cast("int")
        return F.when(end > 0, F.slice(a, 1, F.greatest(end - 1, F.lit(0)))).otherwise(a)

    return bind(as_column(ids), cut)


def count_in(values: Column, value: Column) -> Column:
    """How often `value` occurs in the array `values`."""
    return F.size(values) - F.size(F.array_remove(values, value))


def ngrams(tokens: Column | str, n: int) -> Column:
    """The n-grams of a token array, each joined by one space."""
    if n == 1:
        return as_column(tokens)

    def windows(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(a) - F.lit(n - 1))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(a, i, n), " "))
        return F.when(F.size(a) >= n, grams).otherwise(F.array().cast("array<string>"))

    return bind(as_column(tokens), windows)


def masked_mean(values: Column | str, mask: Column | str) -> Column:
    """Mean of the values at the positions where the mask holds; null when it holds nowhere."""
    pairs = F.arrays_zip(as_column(values).alias("v"), as_column(mask).alias("m"))

    def mean(kept: Column) -> Column:
        total = F.aggregate(kept, F.lit(0.0), lambda acc, p: acc + p["v"].cast("double"))
        return F.when(F.size(kept) > 0, total / F.size(kept))

    return bind(F.filter(pairs, lambda p: p["m"]), mean)
