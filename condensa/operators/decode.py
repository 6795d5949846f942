"""Id arrays back to text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import EOS, PAD, RESERVED_WORDS, UNK
from condensa.functions.text import as_column, bind
from condensa.operators.lookup import attach_to_rows, id_table, way, with_reserved



def _no_ids() -> Column:
    return F.array().cast("array<int>")


def _kept(ids: Column, remove_paddings: bool, remove_eos: bool) -> Column:
    dropped = [i for i, drop in ((PAD, remove_paddings), (EOS, remove_eos)) if drop]
    return F.filter(ids, lambda i: ~i.isin(dropped)) if dropped else ids


def words_of(
    ids: Column | str,
    oov: Column | str,
    word_of: Callable[[Column], Column],
    vocab_size: int,
    remove_paddings: bool = False,
    remove_eos: bool = False,
) -> Column:
    """Word array of an id array: ids above `vocab_size` from `oov`, the others by `word_of`.

    An id in neither place gives the unknown word. Null ids have no words.
    """
    kept = _kept(F.coalesce(as_column(ids), _no_ids()), remove_paddings, remove_eos)

    def word(dictionary: Column, i: Column) -> Column:
        known = F.when(i > vocab_size, F.element_at(dictionary, i)).otherwise(word_of(i))
        return F.coalesce(known, F.lit(RESERVED_WORDS[UNK]))

    return bind(as_column(oov), lambda d: F.transform(kept, lambda i: word(d, i)))


def decode_words(
    examples: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    columns: dict[str, str],
    key: str = "doc_id",
    remove_paddings: bool = False,
    remove_eos: bool = False,
    lookup: str = "auto",
    keep: tuple[str, ...] = (),
    separator: str = " ",
) -> DataFrame:
    """`key`, the columns `keep`, and one text per entry of `columns` (id column -> text column).

    Null ids give an empty text, and rows of equal keys stay apart. `lookup` is as in encoding.
    """
    if way(lookup, vocab_size) == "inline":
        known = examples.withColumn("_words", id_table(vocab, vocab_size))
        word_of = lambda i: F.get(F.col("_words"), i)
    else:
        table = with_reserved(vocab).select(
            F.col("id").cast("string").alias("key"), F.col("word").alias("value")
        )
        every = F.concat(*[F.coalesce(F.col(c), _no_ids()) for c in columns])
        in_vocab = F.filter(every, lambda i: i <= vocab_size)
        known = attach_to_rows(examples, F.transform(in_vocab, lambda i: i.cast("string")), table)
        word_of = lambda i: F.element_at("_found", i.cast("string"))
    texts = [
        F.array_join(
            words_of(ids, "oov", word_of, vocab_size, remove_paddings, remove_eos),
            separator,
        ).alias(text)
        for ids, text in columns.items()
    ]
    return known.select(key, *keep, *texts)
