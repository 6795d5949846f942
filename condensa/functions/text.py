"""Text column functions: tokenizers, cleaning, sentence splitting, detokenizing.

Everything here is built from Spark's own functions and runs inside one projection.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

# Token, cleaning and sentence patterns. `\p{L}\p{N}_` is the Unicode word
# class; Java's plain `\w` knows ASCII only and would cut accented words.
WORD_PATTERN = r"""[\p{L}\p{N}_']+|[.,!?;"]"""
# what lies between two words, and the whole of a word, are never given back
GAP_PATTERN = r"""[^\p{L}\p{N}_'.,!?;"]*+"""
PLAIN_PATTERN = r"""[\p{L}\p{N}_]+|[.,!?;"]"""
REMOVED_CHARS_PATTERN = r"""[^\p{L}\p{N}_.,!?;" ]"""
SENTENCE_GAP = {
    "ascii": r"(?<=[.?!]) (?=[A-Z])",
    "unicode": r"(?<=[.?!]) (?=\p{Lu})",
}
SENTENCE_ENDERS = (".", "!", "?")
QUOTES = ('"', "'")
MARK_PATTERN = r"""(?<= )[.!?,;"'](?= )"""
# white space as Python's `str.split` sees it
UNSPACED_PATTERN = r"(?U)[^\s\x1c-\x1f]+"


FOLD_STEPS = 64


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and hand it to `body`, however often `body` uses it.

    A column that a lambda captures may be inlined into it by the optimizer and then be
    computed per element; a lambda argument never is.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def word_tokens(text: Column | str) -> Column:
    """Lower-cased words (apostrophes kept inside) and single punctuation marks."""
    return F.regexp_extract_all(F.lower(as_column(text)), F.lit(WORD_PATTERN), F.lit(0))


def head_word_tokens(text: Column | str, n: int) -> Column:
    """The first `n` of the `word_tokens`; the text behind them is not cut into words."""
    head = F.regexp_extract(F.lower(as_column(text)), rf"^(?:{GAP_PATTERN}(?>{WORD_PATTERN})){{0,{n}}}", 0)
    return F.regexp_extract_all(head, F.lit(WORD_PATTERN), F.lit(0))


def first_word_token(text: Column | str) -> Column:
    """The first of the `word_tokens`; null when there is none."""
    first = F.regexp_extract(F.lower(as_column(text)), WORD_PATTERN, 0)
    return F.nullif(first, F.lit(""))


def plain_tokens(text: Column | str) -> Column:
    """As `word_tokens`, but apostrophes separate words and the case is kept."""
    return F.regexp_extract_all(as_column(text), F.lit(PLAIN_PATTERN), F.lit(0))


def clean_chars(text: Column | str) -> Column:
    """Lower-case and delete all but word characters, `.,!?;"` and the space.

    Newlines and tabs go too, so the words on either side are glued together.
    """
    return F.regexp_replace(F.lower(as_column(text)), REMOVED_CHARS_PATTERN, "")


def normalize_text(text: Column | str) -> Column:
    """Word tokens joined by one space."""
    return F.array_join(word_tokens(text), " ")


def flatten_newlines(text: Column | str) -> Column:
    return F.replace(as_column(text), F.lit("\n"), F.lit(" "))


def split_sentences(text: Column | str, upper: str = "ascii", limit: int = -1) -> Column:
    """Cut at the space between a sentence mark and a capital.

    `upper="ascii"` sees A-Z only; `"unicode"` also sees accented capitals. The last piece
    is always kept, so an empty text gives one empty sentence. With `limit` there are so many
    pieces at most, the last of which is all the rest.
    """
    return F.split(as_column(text), SENTENCE_GAP[upper], limit)


def detokenize(tokens: Column | str) -> Column:
    """Readable text from an array of tokens without spaces.

    No space before `. ! ? , ;`; the first token and the first word after a sentence end
    are capitalised; an opening quote takes a space before it and none after it.

    Words between two marks are handled as one run, so the fold takes a step per mark and
    per run. It writes pieces of `FOLD_STEPS` steps that are joined at the end: the cost
    grows with the text and not with its square.
    """

    def whole(a: Column) -> Column:
        first = F.coalesce(F.get(a, F.lit(0)), F.lit(""))
        return F.concat(F.initcap(first), _fold_runs(_runs_and_marks(F.slice(a, F.lit(2), F.size(a)))))

    return bind(as_column(tokens), whole)


def _runs_and_marks(tokens: Column) -> Column:
    """Marks as they are; the words between two of them as one string led by a space."""
    spaced = F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" "))
    # tokens hold no white space, so a newline is free to separate
    return F.filter(
        F.split(F.regexp_replace(spaced, MARK_PATTERN, "\n$0\n"), "\n"),
        lambda part: F.trim(part) != "",
    )


def _fold_runs(parts: Column) -> Column:
    flags = ("capital_next", "in_quotes", "after_open")

    def step(state: Column, part: Column) -> Column:
        is_run = part.startswith(" ")
        is_quote = part.isin(*QUOTES)
        opens = is_quote & ~state["in_quotes"]
        run = F.trim(part)
        head = F.substring_index(run, " ", 1)
        capitalised = F.concat(F.initcap(head), F.substr(run, F.length(head) + 1))
        return F.struct(
            F.concat(
                state["text"],
                F.when(opens | (is_run & ~state["after_open"]), F.lit(" ")).otherwise(F.lit("")),
                F.when(is_run & state["capital_next"], capitalised).otherwise(run),
            ).alias("text"),
            (~is_run & (state["capital_next"] | part.isin(*SENTENCE_ENDERS))).alias("capital_next"),
            (is_quote != state["in_quotes"]).alias("in_quotes"),
            (~is_run & (opens | state["after_open"])).alias("after_open"),
        )

    def piece(state: Column, chunk: Column) -> Column:
        start = F.struct(F.lit("").alias("text"), *[state[f].alias(f) for f in flags])
        return F.aggregate(
            chunk,
            start,
            step,
            lambda end: F.struct(
                F.concat(state["pieces"], F.array(end["text"])).alias("pieces"),
                *[end[f].alias(f) for f in flags],
            ),
        )

    start = F.struct(
        F.array().cast("array<string>").alias("pieces"),
        *[F.lit(False).alias(f) for f in flags],
    )
    return F.aggregate(
        in_chunks(parts, FOLD_STEPS), start, piece, lambda end: F.array_join(end["pieces"], "")
    )


def in_chunks(array: Column, size: int) -> Column:
    """The array cut into arrays of `size`; no chunk for an empty array."""

    def cut(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(size))
        chunks = F.transform(starts, lambda i: F.slice(a, i, size))
        return F.filter(chunks, lambda c: F.size(c) > 0)

    return bind(array, cut)


def detokenize_text(text: Column | str) -> Column:
    """`detokenize` of a text that is first cut at white space."""
    return detokenize(F.regexp_extract_all(as_column(text), F.lit(UNSPACED_PATTERN), F.lit(0)))
