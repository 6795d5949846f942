"""Words cut into pieces by a table of scored pieces: the cut of the highest total score.

Every word is a lattice of the pieces that the table has, each over its characters, and of single
characters, which any word can be cut into. One pass over the ends keeps the best score up to each place and
where its last piece begins; another one follows those from the end of the word. Words are cut where they are,
in Arrow batches: a task keeps the cuts of words that it has met, and nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import FIRST_WORD_ID
from condensa.functions.text import as_column
from condensa.operators.lookup import MAX_INLINE_WORDS
from condensa.operators.skew import heaviest
from condensa.operators.subword import SPACE_PIECE
from condensa.operators.vocab import word_counts
from condensa.session import materialize

#: Digits of a piece's score, and of sums that count as equal.
TABLE_DIGITS, SUM_DIGITS = 6, 9
# Fixed value: a character that is no piece scores so much less than the worst piece.
UNKNOWN_PENALTY = 10.0
# Fixed value: sums that differ by more than this differ in their rounded values.
CLEAR = 1e-8
#: Words, of so many characters at most, whose cuts a task keeps; rows that it cuts at once.
KEPT_WORDS, KEPT_CHARS, BATCH_ROWS = 50_000, 40, 1_000


def marked_words(text: Column | str, first: int | None = None) -> Column:
    """The words between spaces, each with `SPACE_PIECE` before it; the `first` ones, if that is given."""
    words = F.split(F.trim(as_column(text)), " +", -1 if first is None else first + 1)
    kept = F.coalesce(words, F.array().cast("array<string>"))
    # behind the first ones the text is not cut: it is one part
    kept = kept if first is None else F.slice(kept, 1, first)
    return F.transform(F.filter(kept, lambda w: w != ""), lambda w: F.concat(F.lit(SPACE_PIECE), w))


def marked_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """`word, n` of the marked words of all texts in `columns`; they are marked when they are counted."""
    counts = word_counts(df, F.split(F.concat_ws(" ", *columns), " ")).where("word <> ''")
    return counts.select(F.concat(F.lit(SPACE_PIECE), "word").alias("word"), "n")


def _substrings(counts: DataFrame, max_chars: int) -> DataFrame:
    """`word, n` of every substring of up to `max_chars` characters, for each place it has in each word."""
    # a number tells the place and the length; none for an empty word
    numbers = F.when(F.length("word") > 0, F.sequence(F.lit(0), F.length("word") * max_chars - 1))
    places = counts.select("word", "n", F.explode_outer(numbers).alias("_k")).where("_k IS NOT NULL")
    start, chars = F.floor(F.col("_k") / max_chars).cast("int"), F.col("_k") % max_chars + 1
    inside = places.where(start + chars <= F.length("word"))
    return inside.select(F.substring("word", start + 1, chars).alias("word"), "n")


def piece_scores(counts: DataFrame, max_chars: int, pieces: int) -> DataFrame:
    """`word, id, n, score`: the most frequent substrings of counted words (`word, n`), as a piece table.

    A score is the logarithm of the share among the chosen ones. Any other table of that form will do as well.
    """
    found = _substrings(counts, max_chars).groupBy("word").agg(F.sum("n").alias("n"))
    top = materialize(heaviest(found, "n", "word", pieces), "piece-counts")
    total = top.agg(F.sum("n")).scalar()
    return top.select(
        "word",
        (F.col("idx") + FIRST_WORD_ID).cast("int").alias("id"),
        "n",
        F.round(F.ln(F.col("n") / total), TABLE_DIGITS).alias("score"),
    )


def _cutter(scores: dict[str, float], unknown: float, max_chars: int) -> Callable[[str], list[str]]:
    """The cut of the highest total score of a word, kept for the words that a task meets again."""

    def cut(word: str) -> list[str]:
        best, starts = [0.0], [0]
        for end in range(1, len(word) + 1):
            top, begin = None, end - 1
            for start in range(max(end - max_chars, 0), end):
                score = scores.get(word[start:end])
                if score is None:
                    if end - start > 1:
                        continue
                    score = unknown
                total = best[start] + score
                # of equal totals the first one stays: that of the longest piece
                if top is None or total > top + CLEAR or total > top and rounded(total) > rounded(top):
                    top, begin = total, start
            best.append(top)
            starts.append(begin)
        pieces, end = [], len(word)
        while end > 0:
            pieces.append(word[starts[end] : end])
            end = starts[end]
        return pieces[::-1]

    def rounded(total: float) -> float:
        return round(total, SUM_DIGITS)

    known = lru_cache(KEPT_WORDS)(cut)
    return lambda word: (known if len(word) <= KEPT_CHARS else cut)(word)


def _sent(table: DataFrame):  # noqa: ANN202
    """The scores of all pieces, that of an unknown character, and the length of the longest piece, broadcast."""
    few = table.select("word", F.col("score").cast("double").alias("score")).limit(MAX_INLINE_WORDS + 1)
    rows = [tuple(r) for r in few.collect()]
    if len(rows) > MAX_INLINE_WORDS:
        raise ValueError(f"more than {MAX_INLINE_WORDS} rows in a table of pieces")
    scores = dict(rows)
    if len(scores) < len(rows):
        raise ValueError("a piece that is in its table more than once")
    worst = min((s for s in scores.values() if s is not None), default=0.0)
    chars = max((len(w) for w in scores if w is not None), default=1)
    unknown = round(worst - UNKNOWN_PENALTY, TABLE_DIGITS)
    return table.sparkSession.sparkContext.broadcast((scores, unknown, chars))


def _cut_lists(df: DataFrame, columns: list[str], table: DataFrame) -> DataFrame:
    """`df` with the word arrays in `columns` as arrays of the pieces of all their words, without a shuffle."""
    sent = _sent(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cutter(*sent.value)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                part = batch.slice(at, BATCH_ROWS)
                for c in columns:
                    cuts = [[p for w in words or () for p in cut(w or "")] for words in part.column(c).to_pylist()]
                    at_c = part.schema.get_field_index(c)
                    part = part.set_column(at_c, c, pa.array(cuts, pa.list_(pa.string())))
                yield part

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, kinds)


def cut_words(words: DataFrame, table: DataFrame) -> DataFrame:
    """`word, pieces` of distinct words: the cut of the highest total score.

    `table` is `word, score` and is sent to every task, its size checked as a vocabulary's is. Of cuts that
    score the same the last piece is the longest one. Characters that are no piece stand by themselves.
    """
    return _cut_lists(words.select("word", F.array("word").alias("pieces")), ["pieces"], table)


def scored_pieces(
    df: DataFrame, columns: list[str], table: DataFrame, first: dict[str, int] | None = None
) -> DataFrame:
    """`df` with the texts in `columns` as piece arrays; a null text has none.

    `first` (column -> number) asks for the first pieces only of a text: those of as many words hold them, as
    a word has one at least, and the words behind them are not cut. There may be more pieces than asked for.
    """
    asked = first or {}
    return _cut_lists(df.withColumns({c: marked_words(c, asked.get(c)) for c in columns}), columns, table)
