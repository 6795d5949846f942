"""Piece mode: texts given as arrays of pieces, as a subword model cuts them.

Which model cuts them is the caller's choice: these are column functions and joins over piece arrays,
with a vocabulary table of pieces. A piece that starts a word begins with `SPACE_PIECE`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import EOS, PAD, SOS
from condensa.functions.text import as_column
from condensa.operators.decode import decode_words
from condensa.operators.encode import encode_tokens
from condensa.operators.lookup import explode_words

# Fixed value: the piece that stands for a space.
SPACE_PIECE = "\u2581"


def cut_pieces(text: Column | str, chars: int, first: int | None = None) -> Column:
    """Pieces of at most `chars` characters of each word; the first one has the space before it.

    The simplest cut that gives pieces, for texts that no model has cut. `first` asks for the first pieces
    only: those of as many words hold them, and the words behind them are not cut.
    """
    words = F.split(F.trim(as_column(text)), " +", -1 if first is None else first + 1)
    # behind the first ones the text is not cut: it is one part
    words = words if first is None else F.slice(words, 1, first)

    def cut(word: Column) -> Column:
        parts = F.regexp_extract_all(word, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
        return F.transform(
            parts, lambda p, i: F.when(i == 0, F.concat(F.lit(SPACE_PIECE), p)).otherwise(p)
        )

    return F.flatten(F.transform(F.filter(words, lambda w: w != ""), cut))


def piece_counts(df: DataFrame, columns: list[str], chars: int) -> DataFrame:
    """`word, n` of the pieces that `cut_pieces` gives of all texts in `columns`."""
    words = explode_words(df, F.split(F.concat_ws(" ", *columns), " ")).where("word <> ''")
    numbers = F.sequence(F.lit(0), F.floor((F.length("word") - 1) / chars).cast("int"))
    places = words.select("word", F.explode_outer(numbers).alias("_i"))
    part = F.substring("word", F.col("_i") * chars + 1, F.lit(chars))
    piece = F.when(F.col("_i") == 0, F.concat(F.lit(SPACE_PIECE), part)).otherwise(part)
    return places.groupBy(piece.alias("word")).agg(F.count("*").alias("n"))


def encode_pieces(
    pairs: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    tx: int,
    ty: int,
    max_oov: int,
    key: str = "doc_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key, x, y, oov_cnt, oov` from piece arrays: as in word mode, but `x` also ends in eos."""

    def first(pieces: str, width: int) -> Column:
        return F.slice(F.coalesce(pieces, F.array().cast("array<string>")), 1, width)

    tokens = pairs.select(
        key, first("source", tx).alias("x_tokens"), first("target", ty).alias("y_tokens")
    )
    return encode_tokens(
        tokens, vocab, vocab_size, tx, ty, max_oov, key, lookup, source_eos=True
    )


def merge_fragments(pieces: Column, max_len: int) -> Column:
    """Join the pieces of a word into one if there are `max_len` or more, spaces not counted."""
    counted = F.size(F.filter(pieces, lambda p: p != SPACE_PIECE))
    return F.when(counted >= max_len, F.array(F.array_join(pieces, ""))).otherwise(pieces)


def decode_pieces(
    examples: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    columns: dict[str, str],
    key: str = "doc_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key` and one text per entry of `columns` (id column -> text column).

    Pieces are put together and `SPACE_PIECE` is a space again; unknown pieces with an extended id
    come back from the dictionary, in their place.
    """
    spoken = {c: F.filter(c, lambda i: ~i.isin(PAD, SOS, EOS)) for c in columns}
    kept = examples.withColumns(spoken)
    texts = decode_words(kept, vocab, vocab_size, columns, key, lookup=lookup, separator="")

    def shown(text: str) -> Column:
        return F.regexp_replace(F.replace(text, F.lit(SPACE_PIECE), F.lit(" ")), "^ ", "")

    return texts.select(key, *[shown(t).alias(t) for t in columns.values()])
