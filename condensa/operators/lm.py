"""Corpus tables: copy and corpus distributions, their mixture, repetition, transitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import PAD, collapse_unknown, count_in, masked_mean, real_ids
from condensa.functions.text import bind, flatten_newlines, split_sentences, word_tokens
from condensa.operators.lookup import attach_to_rows, dense_table, way
from condensa.operators.skew import attach_by_key, broadcast_if_small
from condensa.session import materialize

# Fixed value: the smallest probability the logarithm sees.
MIN_PROBABILITY = 1e-7


def copy_distribution(
    examples: DataFrame, key: str = "doc_id", ids: str = "x", weights: str | None = None
) -> DataFrame:
    """`key, id, p`: the weights of equal source ids added up.

    Without a weights column every real position weighs `1 / length`. All positions of an
    example lie in one row, so they are added up there, without a shuffle.
    """
    rows = examples.select(key, F.explode_outer(copy_weights(ids, weights)).alias("e"))
    return rows.where("e IS NOT NULL").select(key, "e.id", "e.p")


def copy_weights(ids: str, weights: str | None = None) -> Column:
    """`id, p` of each distinct real id of a row, by id, as an array."""
    if weights is None:
        real = bind(
            real_ids(ids),
            lambda a: F.transform(a, lambda i: F.struct(i.alias("id"), (1.0 / F.size(a)).alias("w"))),
        )
    else:
        pairs = F.arrays_zip(F.col(ids).alias("id"), F.col(weights).alias("w"))
        real = F.filter(pairs, lambda p: p["id"] != PAD)
    return _summed_runs(F.array_sort(real))


def _summed_runs(sorted_pairs: Column) -> Column:
    """`id, p` of an array of `id, w` sorted by id: the weights of equal neighbours added up."""

    def total(pairs: Column, first: Column, after: Column) -> Column:
        own = F.slice(pairs, first + 1, after - first)
        return F.aggregate(own, F.lit(0.0), lambda acc, p: acc + p["w"].cast("double"))

    def cut(a: Column) -> Column:
        changed = lambda e, i: (i == 0) | (F.get(a, i - 1)["id"] != e["id"])
        starts = F.array_compact(F.transform(a, lambda e, i: F.when(changed(e, i), i)))
        return bind(
            starts,
            lambda s: F.transform(
                s,
                lambda i, k: F.struct(
                    F.get(a, i)["id"].alias("id"),
                    total(a, i, F.coalesce(F.get(s, k + 1), F.size(a))).alias("p"),
                ),
            ),
        )

    return bind(sorted_pairs, cut)


def corpus_distribution(examples: DataFrame, vocab_size: int, ids: str = "y") -> DataFrame:
    """`id, p`: relative frequency of vocabulary ids (unknown ones as one id) over all rows."""
    known = real_ids(collapse_unknown(ids, vocab_size))
    counts = (
        examples.select(F.explode_outer(known).alias("id"))
        .where("id IS NOT NULL")
        .groupBy("id")
        .agg(F.count("*").alias("n"))
    )
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("id", (F.col("n") / total).alias("p"))


def token_probabilities(
    examples: DataFrame,
    corpus: DataFrame,
    vocab_size: int,
    p_gen: float,
    key: str = "doc_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key, probs`: per real target position the corpus, copy and mixed probability.

    The mixture is `p_gen * corpus + (1 - p_gen) * copy`, read only at the target ids; the
    corpus side is zero for extended ids. `lookup` is as in encoding: the corpus distribution is one
    inline array, or, for a vocabulary too large for that, joined to the ids of each row.
    """
    real = real_ids("y")

    def per_position(source: Column, p_of: Callable[[Column], Column]) -> Column:
        def one(i: Column, pos: Column) -> Column:
            p_corpus = F.coalesce(p_of(i), F.lit(0.0))
            p_copy = F.when(F.size(source) > 0, count_in(source, i) / F.size(source)).otherwise(0.0)
            return F.struct(
                pos.alias("pos"), i.alias("id"), p_corpus.alias("p_corpus"), p_copy.alias("p_copy")
            )

        return F.transform(real, one)

    def mix(e: Column) -> Column:
        mixed = F.lit(p_gen) * e["p_corpus"] + F.lit(1.0 - p_gen) * e["p_copy"]
        return e.withField("p_final", mixed)

    if way(lookup, vocab_size) == "inline":
        known = examples.withColumn("_corpus", dense_table(corpus, "id", "p", vocab_size))
        p_of = lambda i: F.get(F.col("_corpus"), i)
    else:
        found = corpus.select(F.col("id").cast("string").alias("key"), F.col("p").alias("value"))
        known = attach_to_rows(examples, F.transform(real, lambda i: i.cast("string")), found)
        p_of = lambda i: F.element_at("_found", i.cast("string"))
    return known.select(
        key, F.transform(bind(real_ids("x"), lambda x: per_position(x, p_of)), mix).alias("probs")
    )


def mixture_nll(
    examples: DataFrame,
    corpus: DataFrame,
    vocab_size: int,
    p_gen: float,
    key: str = "doc_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key, nll`: mean negative log probability of the real target positions."""
    probs = token_probabilities(examples, corpus, vocab_size, p_gen, key, lookup)
    losses = F.transform("probs", lambda e: -F.ln(F.greatest(e["p_final"], F.lit(MIN_PROBABILITY))))
    mask = F.transform("probs", lambda e: F.lit(True))
    return probs.select(key, masked_mean(losses, mask).alias("nll"))


def masked_average(df: DataFrame, values: str, mask: str) -> DataFrame:
    """One row: mean over the masked positions of each sequence, then mean over sequences."""
    return df.select(masked_mean(values, mask).alias("m")).agg(F.avg("m").alias("masked_average"))


def coverage_repetition(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """`key, penalty`: how much each sentence repeats the words of the earlier ones.

    Sentence = step, weight = share of a word in its sentence; the penalty adds up
    `least(weight, sum of the word's earlier weights)`. The words of a document are sorted by word and
    step, and one fold over them carries the word's weights so far: no shuffle.
    """
    pieces = split_sentences(flatten_newlines("text"))

    def weighted(sentence: Column, step: Column) -> Column:
        return bind(
            word_tokens(sentence),
            lambda ws: F.transform(
                ws,
                lambda word: F.struct(
                    word.alias("word"), step.alias("step"), (1.0 / F.size(ws)).alias("w")
                ),
            ),
        )

    words = F.array_sort(F.flatten(F.transform(pieces, weighted)))
    start = F.struct(
        F.lit("").alias("word"),
        F.lit(-1).alias("step"),
        F.lit(0.0).alias("before"),  # the word's weights in earlier steps
        F.lit(0.0).alias("own"),  # and in this one
        F.lit(0.0).alias("penalty"),
    )

    def closed(s: Column) -> Column:
        return s["penalty"] + F.least(s["own"], s["before"])

    def add(s: Column, t: Column) -> Column:
        same_word = s["word"] == t["word"]
        same = same_word & (s["step"] == t["step"])
        earlier = F.when(same_word, s["before"] + s["own"]).otherwise(F.lit(0.0))
        return F.struct(
            t["word"].alias("word"),
            t["step"].alias("step"),
            F.when(same, s["before"]).otherwise(earlier).alias("before"),
            F.when(same, s["own"] + t["w"]).otherwise(t["w"]).alias("own"),
            F.when(same, s["penalty"]).otherwise(closed(s)).alias("penalty"),
        )

    return docs.select(key, F.aggregate(words, start, add, closed).alias("penalty"))


def bigram_counts(df: DataFrame, tokens: Column, first: Column, last: Column) -> DataFrame:
    """`prev, next, n` over neighbouring tokens, with `first` and `last` at the ends."""
    rows = df.select(tokens.alias("_a"))
    places = F.when(F.col("_a").isNotNull(), F.sequence(F.lit(0), F.size("_a")))
    steps = rows.select("_a", F.explode_outer(places).alias("_i")).where("_i IS NOT NULL")
    prev = F.when(F.col("_i") == 0, first).otherwise(F.get("_a", F.col("_i") - 1))
    following = F.when(F.col("_i") == F.size("_a"), last).otherwise(F.get("_a", F.col("_i")))
    return steps.groupBy(prev.alias("prev"), following.alias("next")).agg(F.count("*").alias("n"))


def bigram_transitions(counts: DataFrame, bounded: bool = False) -> DataFrame:
    """`prev, next, n, logp`: log share of each next token after its previous token.

    `bounded` says that `prev` is a vocabulary id: its totals are broadcast if they are counted and
    found few. For words the totals are joined with the frequent ones split off. The counts are read for the
    totals and for the join; they are written once, so the texts are counted once.
    """
    counts = materialize(counts, "bigrams")
    totals = counts.groupBy("prev").agg(F.sum("n").alias("total"))
    if bounded:
        joined = counts.join(broadcast_if_small(totals), "prev")
    else:
        joined = attach_by_key(counts, totals, "prev", "total")
    return joined.select("prev", "next", "n", F.ln(F.col("n") / F.col("total")).alias("logp"))


def continuation_shares(counts: DataFrame) -> DataFrame:
    """`next, p_next`: the share of a token among all distinct pairs of neighbours, as the second one."""
    follows = materialize(counts.groupBy("next").agg(F.count("*").alias("kinds")), "continuations")
    total = follows.agg(F.sum("kinds")).scalar()
    return follows.select("next", (F.col("kinds") / total).alias("p_next"))


def backoff_weights(counts: DataFrame, discount: float) -> DataFrame:
    """`prev, total, backoff`: of each token its pairs, and the share that `discount` off each kind frees."""
    sums = counts.groupBy("prev").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    return sums.select("prev", "total", (F.lit(discount) * F.col("kinds") / F.col("total")).alias("backoff"))


def smoothed_transitions(counts: DataFrame, discount: float) -> DataFrame:
    """`prev, next, n, logp` of the seen pairs, with absolute discounting and continuation back-off.

    A pair's share is `(n - discount) / total` and its part of the back-off, which any next token has: unseen
    ones have `backoff * p_next` alone, so the shares of all tokens behind one add up to 1. `counts`
    (`prev, next, n`) is written by the caller; the two small sides are broadcast where they are.
    """
    arcs = counts.join(broadcast_if_small(backoff_weights(counts, discount)), "prev")
    arcs = arcs.join(broadcast_if_small(continuation_shares(counts)), "next")
    share = (F.col("n") - F.lit(discount)) / F.col("total") + F.col("backoff") * F.col("p_next")
    return arcs.select("prev", "next", "n", F.ln(share).alias("logp"))


def smoothed_next_tokens(counts: DataFrame, discount: float, keep: int) -> DataFrame:
    """`prev, next, logp`: the seen pairs, and of the unseen ones those that can be among the `keep` best.

    Unseen pairs differ by `p_next` alone. The `keep` tokens of largest `p_next` are at least as likely behind
    any token as an unseen one beyond them, so no other unseen pair has to be there.
    """
    seen = smoothed_transitions(counts, discount).select("prev", "next", "logp")
    order = F.struct((-F.col("p_next")).alias("rank"), "next", "p_next")
    # at most `keep` rows are collected into one cell
    head = continuation_shares(counts).orderBy(F.desc("p_next"), "next").limit(keep)
    listed = F.array_sort(F.collect_list(order))
    likely = head.agg(listed).scalar()
    weights = backoff_weights(counts, discount)
    unseen = weights.withColumn("h", F.explode(likely)).select(
        "prev", F.col("h.next").alias("next"), F.ln(F.col("backoff") * F.col("h.p_next")).alias("logp")
    )
    # where both are, the seen pair is the more likely one
    return seen.unionByName(unseen).groupBy("prev", "next").agg(F.max("logp").alias("logp"))
