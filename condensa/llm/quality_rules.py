"""Quality rules: a threshold table compiled into one projection, without user functions."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.text import bind
from condensa.llm.common import fresh, words

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A text is rejected where `measure` is below `least` or above `most` (None: no bound).

    Rules hold for texts of at least `min_words` words.
    """

    measure: str
    least: float | None
    most: float | None
    min_words: int = 0


#: Frequent function words of the languages that the tables hold.
STOP_WORDS = tuple(
    (
        "a an and as at be by for from he in is it of on or that the this to was with "
        "das den der des die ein eine für im ist mit nicht sich und von zu "
        "au avec dans de des du elle en est et la le les par pas pour que qui sur un une "
        "al como con del el es esta la las los más no para por que se su un una y"
    ).split()
)

#: The threshold table. Ratios are of words, characters or lines.
RULES = (
    Rule("n_words", 50, None),
    Rule("repeat_share", None, 0.5),
    Rule("mean_word_chars", 2.0, 12.0),
    Rule("symbol_share", None, 0.04),
    Rule("stop_share", 0.02, None, 100),
    Rule("dup_line_share", None, 0.8),
    Rule("upper_share", None, 0.3),
    Rule("mark_share", None, 0.25),
)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_like(line, F.lit(r"[^\x20\x09-\x0D]")))
    return bind(lines, lambda a: F.struct(F.size(a).alias("n"), F.size(F.array_distinct(a)).alias("d")))


def _repeat_words(w: Column) -> Column:
    """Words in 3-word windows that occur twice or more, the first occurrence included.

    Windows are sorted by hash and content, so equal ones are neighbours; the places of those
    with an equal neighbour are sorted again, and each adds the words that the next one does not.
    """
    n = F.size(w)
    window = lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    grams = F.transform(
        F.sequence(F.lit(0), n - 3),
        lambda i: bind(window(i), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"), i.alias("i"))),
    )

    def equal(a: Column, b: Column) -> Column:
        return F.coalesce((a["h"] == b["h"]) & (a["g"] == b["g"]), F.lit(False))

    def repeated(s: Column) -> Column:
        return F.filter(
            s, lambda x, k: equal(x, F.get(s, k + 1)) | equal(x, F.get(s, k - 1))
        )

    places = F.array_sort(F.transform(bind(F.array_sort(grams), repeated), lambda x: x["i"]))
    covered = bind(
        places,
        lambda p: F.aggregate(
            F.transform(p, lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p, k + 1) - x, F.lit(3)))),
            F.lit(0),
            lambda total, x: total + x,
        ),
    )
    return F.when(n < 4, F.lit(0)).otherwise(covered)


def _measures(text: Column) -> Column:
    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).alias("n_words"),
            F.length(F.array_join(w, "")).alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
            F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).alias("n_stop"),
            F.size(F.filter(w, lambda x: F.regexp_like(x, F.lit(r"[!?|]$")))).alias("n_mark"),
            F.length(F.regexp_replace(F.array_join(w, ""), r"\P{Lu}+", "")).alias("n_upper"),
        )

    return F.struct(
        bind(words(text), of_words).alias("w"),
        F.length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).alias("n_symbols"),
        _dup_lines(text).alias("lines"),
        F.length(text).alias("n_chars"),
    )


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def _broken(rule: Rule, measure: Column, n_words: Column) -> Column:
    bounds = [measure < rule.least] * (rule.least is not None)
    bounds += [measure > rule.most] * (rule.most is not None)
    broken = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
    return (broken & (n_words >= rule.min_words)) if rule.min_words else broken


def quality_rules(
    docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES
) -> DataFrame:
    """`docs` with the measures of each text, `base_failed`, `failed_rules` and `kept`.

    One projection, no shuffle and no user function. A null text counts as empty, has no words and
    fails. Every row is answered, repeated rows each on their own. Columns that the input has
    already under a name of the result are replaced by the result's.
    """
    raw, m = fresh("_text", docs.columns), fresh("_measures", docs.columns)
    named = {
        "n_words": F.col(f"{m}.w.n_words").cast("long"),
        "word_chars": F.col(f"{m}.w.word_chars").cast("long"),
        "n_symbols": F.col(f"{m}.n_symbols").cast("long"),
        "n_dup_lines": (F.col(f"{m}.lines.n") - F.col(f"{m}.lines.d")).cast("long"),
        "n_repeat_words": F.col(f"{m}.w.n_repeat_words").cast("long"),
    }
    n = named["n_words"]
    measures = named | {
        "repeat_share": _share(named["n_repeat_words"], n),
        "mean_word_chars": _share(named["word_chars"], n),
        "symbol_share": _share(named["n_symbols"], F.col(f"{m}.n_chars")),
        "stop_share": _share(F.col(f"{m}.w.n_stop"), n),
        "dup_line_share": _share(named["n_dup_lines"], F.col(f"{m}.lines.n")),
        "upper_share": _share(F.col(f"{m}.w.n_upper"), named["word_chars"]),
        "mark_share": _share(F.col(f"{m}.w.n_mark"), n),
    }
    base = (n < 50) | (100 * named["n_repeat_words"] > 50 * n)
    failed = F.array_compact(
        F.array(*[F.when(_broken(r, measures[r.measure], n), F.lit(r.measure)) for r in rules])
    )
    # explode of one element keeps the optimizer from computing the measures once per use
    one = docs.withColumn(raw, F.coalesce(F.col(text), F.lit("")))
    one = one.select(*docs.columns, F.explode(F.array(_measures(F.col(raw)))).alias(m))
    result = named | {
        "base_failed": base,
        "failed_rules": failed,
        "kept": ~base & (F.size(failed) == 0),
    }
    clash = {c.lower() for c in result}
    return one.select(
        *[c for c in docs.columns if c.lower() not in clash],
        *[c.alias(name) for name, c in result.items()],
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs`, with their own columns, that the rules keep."""
    verdict = fresh("_verdict", docs.columns)
    own = F.struct(*docs.columns)
    judged = quality_rules(docs.select(own.alias(verdict), F.col(text).alias("_judged")), "_judged")
    return judged.where("kept").select(f"{verdict}.*")
