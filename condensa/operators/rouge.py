"""ROUGE-1, ROUGE-2 and ROUGE-L of (prediction, reference) pairs.

Every measure is array expressions over one row: no shuffle, and rows of equal keys stay apart. A null
side counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import EOS, ngrams, until_eos
from condensa.functions.text import bind

MEASURES = ("r", "p", "f")


def scores(overlap: Column, pred_size: Column, ref_size: Column) -> list[Column]:
    """Recall, precision and F; 0 where a side is empty or nothing overlaps."""
    recall = F.when(ref_size > 0, overlap / ref_size).otherwise(F.lit(0.0))
    precision = F.when(pred_size > 0, overlap / pred_size).otherwise(F.lit(0.0))
    f = F.when(overlap > 0, 2 * recall * precision / (recall + precision)).otherwise(F.lit(0.0))
    return [recall.alias("r"), precision.alias("p"), f.alias("f")]


def _or_empty(side: str, like: str = "array<string>") -> Column:
    return F.coalesce(F.col(side), F.array().cast(like))


def _runs(grams: Column) -> Column:
    """Distinct elements with their counts, from the bounds of equal neighbours in sorted order."""

    def cut(a: Column) -> Column:
        places = F.transform(a, lambda g, i: F.when((i == 0) | (F.get(a, i - 1) != g), i))
        starts = F.array_compact(places)
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda i, k: F.struct(
                    F.get(a, i).alias("gram"),
                    (F.coalesce(F.get(s, k + 1), F.size(a)) - i).alias("n"),
                ),
            ),
        )

    return bind(F.array_sort(grams), cut)


def clipped_overlap(pred: Column, ref: Column) -> Column:
    """How many elements both sides have, each as often as both do."""

    def neighbours(a: Column) -> Column:
        shared = F.transform(
            a,
            lambda g, i: bind(
                F.get(a, i + 1),
                lambda n: F.when(n["gram"] == g["gram"], F.least(n["n"], g["n"])).otherwise(0),
            ),
        )
        return F.aggregate(shared, F.lit(0), lambda total, n: total + F.coalesce(n, F.lit(0)))

    return bind(F.array_sort(F.concat(_runs(pred), _runs(ref))), neighbours)


def _n_measures(n: int, counting: str = "clipped") -> list[Column]:
    """Overlap and sizes of the n-grams of the columns `pred` and `ref`."""
    if counting not in ("clipped", "set"):
        raise ValueError("counting is 'clipped' or 'set'")

    def measured(pair: Column) -> Column:
        pred, ref = pair["pred"], pair["ref"]
        if counting == "set":
            overlap = F.size(F.array_intersect(pred, ref))
        else:
            overlap = clipped_overlap(pred, ref)
        return F.struct(overlap.alias("o"), F.size(pred).alias("p"), F.size(ref).alias("r"))

    sides = [ngrams(_or_empty(side), n) for side in ("pred", "ref")]
    if counting == "set":
        sides = [F.array_distinct(side) for side in sides]
    both = bind(F.struct(sides[0].alias("pred"), sides[1].alias("ref")), measured)
    return [both["o"], both["p"], both["r"]]


def rouge_n(
    pairs: DataFrame, n: int, key: str = "doc_id", counting: str = "clipped"
) -> DataFrame:
    """`key, r, p, f` from token arrays `pred` and `ref`.

    `clipped` counts a shared n-gram as often as both sides have it, `set` once.
    """
    return _scored(pairs, key, _n_measures(n, counting))


def _scored(pairs: DataFrame, key: str, measures: list[Column]) -> DataFrame:
    # explode of one element computes the measures once, however often the scores use them
    one = F.struct(*[m.alias(n) for m, n in zip(measures, ("o", "ps", "rs"))])
    sized = pairs.select(key, F.explode(F.array(one)).alias("m"))
    return sized.select(key, *scores(F.col("m.o"), F.col("m.ps"), F.col("m.rs")))


def _not_below(rising: Column, value: Column) -> Column:
    """The first place of a rising array whose element is not below `value` (its size if none is)."""

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        below = F.get(rising, middle) < value
        waiting = s["low"] < s["high"]
        return F.struct(
            F.when(waiting & below, middle + 1).otherwise(s["low"]).alias("low"),
            F.when(waiting & ~below, middle).otherwise(s["high"]).alias("high"),
        )

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(rising) + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("low"), F.size(rising).alias("high"))
    return F.aggregate(steps, start, halve, lambda s: s["low"])


def _places(ref: Column, shared: Column) -> Column:
    """The places of shared tokens, by token and from right to left, next to their tokens."""
    numbered = F.transform(ref, lambda t, i: F.struct(t.alias("t"), (-i).alias("i")))
    ordered = F.array_sort(F.filter(numbered, lambda n: F.array_contains(shared, n["t"])))
    return bind(
        ordered,
        lambda places: F.struct(
            shared.alias("shared"),
            F.transform(places, lambda n: n["t"]).alias("tokens"),
            F.transform(places, lambda n: -n["i"]).alias("places"),
        ),
    )


def lcs_length(pred: Column, ref: Column) -> Column:
    """Length of the longest common subsequence of two arrays.

    The places in `ref` of each element of `pred`, from right to left, follow one another; the longest
    rising run of that sequence is what both have in order. The state holds, for each length, the
    smallest place that a run of that length ends with.
    """

    def place(tails: Column, at: Column) -> Column:
        return bind(
            _not_below(tails, at),
            lambda k: F.when(F.get(tails, k) == at, tails).otherwise(
                F.concat(F.slice(tails, 1, k), F.array(at), F.slice(tails, k + 2, F.size(tails) + 1))
            ),
        )

    def of_pair(pair: Column) -> Column:
        return bind(
            F.array_sort(F.array_intersect(pair["pred"], pair["ref"])),
            lambda shared: bind(_places(pair["ref"], shared), lambda m: of_places(pair["pred"], m)),
        )

    def of_places(tokens: Column, m: Column) -> Column:
        return bind(
            F.transform(m["shared"], lambda t: _not_below(m["tokens"], t)),
            lambda starts: F.size(
                F.aggregate(tokens, F.array().cast("array<int>"), of_token(m, starts))
            ),
        )

    def of_token(m: Column, starts: Column) -> Callable[[Column, Column], Column]:
        """Takes up all places of a token: a slice that the token's rank among shared ones tells."""

        def step(tails: Column, token: Column) -> Column:
            def taken(k: Column) -> Column:
                start = F.get(starts, k)
                end = F.coalesce(F.get(starts, k + 1), F.size(m["places"]))
                return F.when(
                    F.get(m["shared"], k) == token,
                    F.aggregate(F.slice(m["places"], start + 1, end - start), tails, place),
                ).otherwise(tails)

            return bind(_not_below(m["shared"], token), taken)

        return step

    return bind(F.struct(pred.alias("pred"), ref.alias("ref")), of_pair)


def _l_measures(like: str = "array<string>") -> list[Column]:
    pred, ref = _or_empty("pred", like), _or_empty("ref", like)
    return [lcs_length(pred, ref), F.size(pred), F.size(ref)]


def rouge_l(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, r, p, f` of the longest common subsequence of arrays `pred` and `ref`."""
    return _scored(pairs, key, _l_measures(pairs.schema["pred"].dataType.simpleString()))


METRICS = ("rouge-1", "rouge-2", "rouge-l")


def all_scores(pairs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key` and a struct `r, p, f` per metric, all from one pass over the pairs."""
    measures = {"rouge-1": _n_measures(1), "rouge-2": _n_measures(2), "rouge-l": _l_measures()}
    sized = [
        F.struct(*[m.alias(n) for m, n in zip(ms, ("o", "ps", "rs"))]).alias(metric)
        for metric, ms in measures.items()
    ]
    one = pairs.select(key, F.explode(F.array(F.struct(*sized))).alias("m"))
    return one.select(
        key,
        *[
            F.struct(*scores(*[F.col(f"m.`{x}`.{n}") for n in ("o", "ps", "rs")])).alias(x)
            for x in METRICS
        ],
    )


def averages(scored: DataFrame) -> DataFrame:
    """`metric, r, p, f`: the means of `all_scores`, one aggregation for all metrics."""
    means = scored.agg(
        *[F.avg(f"`{x}`.{m}").alias(f"{x}:{m}") for x in METRICS for m in MEASURES]
    )
    rows = [
        F.struct(F.lit(x).alias("metric"), *[F.col(f"`{x}:{m}`").alias(m) for m in MEASURES])
        for x in METRICS
    ]
    return means.select(F.inline(F.array(*rows)))


def rouge_l_ids(pairs: DataFrame, key: str = "doc_id", eos: int = EOS) -> DataFrame:
    """ROUGE-L of id arrays, each read up to its first eos."""
    cut = pairs.select(
        key, until_eos("pred", eos).alias("pred"), until_eos("ref", eos).alias("ref")
    )
    return rouge_l(cut, key)


def rouge_average(scored: dict[str, DataFrame]) -> DataFrame:
    """`metric, r, p, f`: the mean over all pairs, one row per metric."""
    rows = None
    for metric, df in scored.items():
        mean = df.agg(*[F.avg(m).alias(m) for m in MEASURES])
        row = mean.select(F.lit(metric).alias("metric"), *MEASURES)
        rows = row if rows is None else rows.unionByName(row)
    return rows


def joined_pairs(predictions: DataFrame, references: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each prediction next to its reference."""
    return predictions.select(key, "pred").join(references.select(key, "ref"), key)
