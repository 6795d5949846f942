"""Most likely continuations over a table of token transitions.

The search depends on the start token only, so it runs once per distinct token and the result is joined
back to the examples. Where the pruned next tokens are few, which is counted, they are one array that
every task receives, and all steps of a start are one fold over its hypotheses: no join and no shuffle.

For more of them all starts advance together, one join per step. Hypotheses that closed or got stuck
within the steps between two writings of the state are carried under keys of their own, which match
nothing and spread over all tasks; with the writing they leave the state. The search ends early when
nothing is open.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from condensa.functions.ids import EOS, UNK
from condensa.functions.text import bind
from condensa.operators.lookup import dense_table, way
from condensa.operators.skew import BROADCAST_ROWS, broadcast_if_small
from condensa.session import materialize

# scores that differ by rounding noise only count as equal; ties go to the smaller sequence
SCORE_DIGITS = 9
#: Next tokens, at most, that every task receives as one array.
INLINE_NEXTS = 1_000_000
#: Steps between two writings of the state.
WRITE_EVERY = 6
# The length penalty is ((PENALTY + t) / (PENALTY + 1)) ** alpha.
PENALTY = 5


def _score(value: Column) -> Column:
    return F.round(value, SCORE_DIGITS)


def prune_transitions(transitions: DataFrame, keep: int, block_unk: bool) -> DataFrame:
    """The `keep` best next tokens of every token, and those that rounding makes equal to the last.

    Of exactly equal steps the `keep` smallest tokens are enough.
    """
    if block_unk:
        transitions = transitions.where(F.col("next") != UNK)
    equal = Window.partitionBy("prev", "logp").orderBy("next")
    best = Window.partitionBy("prev").orderBy(F.desc("logp"), "next")
    limit = Window.partitionBy("prev")
    noise = 10.0**-SCORE_DIGITS
    return (
        transitions.withColumn("nth", F.row_number().over(equal))
        .where(F.col("nth") <= keep)
        .withColumn("place", F.row_number().over(best))
        .withColumn("least", F.min(F.when(F.col("place") <= keep, F.col("logp"))).over(limit))
        .where(F.col("logp") >= F.col("least") - noise)
        .select("prev", "next", F.col("logp").alias("step_logp"))
    )


def length_factor(t: int, alpha: float, length_norm: str) -> float:
    factor = (PENALTY + t) ** alpha / (PENALTY + 1) ** alpha
    return {"divide": 1 / factor, "multiply": factor}[length_norm]


def beam_search(
    starts: DataFrame,
    transitions: DataFrame,
    vocab_size: int,
    bw: int = 4,
    max_len: int = 8,
    alpha: float = 0.7,
    length_norm: str = "divide",
    block_unk: bool = True,
    key: str = "ex_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key, start, seq, score, done, n_finished` from `starts(key, start)`.

    Each step extends every open hypothesis, keeps the `bw` best per start and closes those
    that end in eos; closed ones are not extended. The answer is the best closed hypothesis
    by length-normalised score, or the best open one (`done = false`) if none closed.
    `transitions` holds ids below `vocab_size`. Keeping `bw + 1` next tokens per token is
    exact: one hypothesis fills at most `bw` places, and eos is not allowed first. `lookup` is as in
    encoding: `inline` for the fold, `join` for a join per step, or `auto` by the counted tokens.
    """
    nexts = _next_tokens(transitions, bw + 1, block_unk)
    factors = [length_factor(t, alpha, length_norm) for t in range(max_len)]
    if _next_way(lookup, nexts, vocab_size) == "inline":
        answers = _beam_folds(starts, nexts, vocab_size, bw, factors)
    else:
        answers = _beam_joins(starts, broadcast_if_small(nexts, _most()), bw, factors)
    return starts.select(key, "start").join(broadcast_if_small(answers, _most()), "start")


def _next_way(lookup: str, nexts: DataFrame, vocab_size: int) -> str:
    """`inline` where ids and next tokens both fit into what a task receives."""
    chosen = way(lookup, vocab_size)
    if lookup == "auto" and chosen == "inline" and nexts.count() > INLINE_NEXTS:
        return "join"
    return chosen


def _next_table(nexts: DataFrame, vocab_size: int) -> Column:
    """Scalar column: by token, its next tokens with their `step_logp`."""
    listed = nexts.groupBy("prev").agg(F.collect_list(F.struct("next", "step_logp")).alias("nexts"))
    return dense_table(listed, "prev", "nexts", vocab_size)


def _beam_folds(
    starts: DataFrame, nexts: DataFrame, vocab_size: int, bw: int, factors: list[float]
) -> DataFrame:
    """The answer of each distinct start, by one fold over the steps."""
    hypothesis = "struct<rank:double,seq:array<int>,logp:double,last:int>"
    first = F.struct(
        F.array(
            F.struct(
                F.lit(0.0).alias("rank"),
                F.array().cast("array<int>").alias("seq"),
                F.lit(0.0).alias("logp"),
                F.col("start").alias("last"),
            )
        ).cast(f"array<{hypothesis}>").alias("open"),
        F.lit(None).cast(hypothesis).alias("closed"),  # the best one, by normalised score
        F.lit(None).cast(hypothesis).alias("stuck"),  # the best one that nothing follows
        F.lit(0).alias("finished"),
    )
    by_step = F.array(*[F.lit(f) for f in factors])

    def follow(h: Column, t: Column) -> Column:
        own = F.coalesce(F.get(F.col("_nexts"), h["last"]), F.array())
        return F.filter(own, lambda n: (t > 0) | (n["next"] != EOS))

    def grow(h: Column, t: Column) -> Column:
        def grown(n: Column) -> Column:
            logp = h["logp"] + n["step_logp"]
            return F.struct(
                (-_score(logp)).alias("rank"),
                F.concat(h["seq"], F.array(n["next"])).alias("seq"),
                logp.alias("logp"),
                n["next"].alias("last"),
            )

        return F.transform(follow(h, t), grown)

    def least(one: Column, more: Column) -> Column:
        """The best of one hypothesis, which may be null, and an array of them."""
        return F.array_min(F.array_compact(F.concat(F.array(one), more)))

    def normalised(h: Column, factor: Column) -> Column:
        value = h["logp"] * factor
        return F.struct((-_score(value)).alias("rank"), h["seq"].alias("seq"), value.alias("logp"), h["last"].alias("last"))

    def step(s: Column, t: Column) -> Column:
        moved = F.transform(s["open"], lambda h: F.struct(h.alias("h"), grow(h, t).alias("to")))
        return bind(
            moved,
            lambda m: bind(
                F.slice(F.array_sort(F.flatten(F.transform(m, lambda g: g["to"]))), 1, bw),
                lambda best: bind(
                    F.filter(best, lambda h: h["last"] == EOS),
                    lambda ended: F.struct(
                        F.filter(best, lambda h: h["last"] != EOS).alias("open"),
                        least(
                            s["closed"],
                            F.transform(ended, lambda h: normalised(h, F.get(by_step, t))),
                        ).alias("closed"),
                        least(
                            s["stuck"],
                            F.transform(F.filter(m, lambda g: F.size(g["to"]) == 0), lambda g: g["h"]),
                        ).alias("stuck"),
                        (s["finished"] + F.size(ended)).alias("finished"),
                    ),
                ),
            ),
        )

    steps = F.sequence(F.lit(0), F.lit(len(factors) - 1))
    first_starts = starts.select("start").distinct().withColumn("_nexts", _next_table(nexts, vocab_size))
    found = first_starts.select(
        "start", F.explode(F.array(F.aggregate(steps, first, step))).alias("s")
    )
    unfinished = least(F.col("s.stuck"), F.col("s.open"))
    return found.select(
        "start", F.coalesce("s.closed", unfinished).alias("h"),
        F.col("s.closed").isNotNull().alias("done"),
        F.col("s.finished").cast("long").alias("n_finished"),
    ).select("start", "h.seq", F.col("h.logp").alias("score"), "done", "n_finished")


def _beam_joins(starts: DataFrame, nexts: DataFrame, bw: int, factors: list[float]) -> DataFrame:
    """The answer of each distinct start, all starts a step at a time."""
    state, ended = _first_state(starts), []
    for t, factor in enumerate(factors):
        state = _beam_step(state, nexts, t, bw, factor)
        if t % WRITE_EVERY == WRITE_EVERY - 1 or t == len(factors) - 1:
            written = materialize(state, "paths")
            state = written.where("last >= 0")
            ended.append(written.where("last < 0"))
            if state.isEmpty():
                break
    whole_state = reduce(DataFrame.unionByName, ended, state)
    best = Window.partitionBy("start").orderBy(F.desc("done"), _score(F.col("logp")).desc(), "seq")
    whole = Window.partitionBy("start")
    return (
        whole_state.withColumn("place", F.row_number().over(best))
        .withColumn("n_finished", F.count_if("done").over(whole))
        .where("place = 1")
        .select("start", "seq", F.col("logp").alias("score"), "done", "n_finished")
    )


def _most() -> int:
    return BROADCAST_ROWS


def _first_state(starts: DataFrame) -> DataFrame:
    """One open hypothesis per distinct start; `last` is a token, or below 0 when not open."""
    first = starts.select("start").distinct()
    return first.select(
        "start",
        F.col("start").alias("last"),
        F.array().cast("array<int>").alias("seq"),
        F.lit(0.0).alias("logp"),
        F.lit(False).alias("done"),
    )


def _not_open() -> Column:
    """A key that no token has, of the hypothesis' own."""
    return (-1 - F.pmod(F.hash("start", "seq"), F.lit(1 << 30))).cast("int")


def _grown(state: DataFrame, nexts: DataFrame, match: Column) -> DataFrame:
    """Every hypothesis with its next tokens; `moved` where there are some."""
    moved = F.col("next").isNotNull()
    return (
        state.join(nexts, match, "left")
        .withColumn("moved", moved)
        .withColumn("logp", F.col("logp") + F.coalesce("step_logp", F.lit(0.0)))
        .withColumn("seq", F.when(moved, F.concat("seq", F.array("next"))).otherwise(F.col("seq")))
    )


def _next_tokens(transitions: DataFrame, keep: int, block_unk: bool) -> DataFrame:
    """The pruned transitions, written once because they are counted, and every step reads them."""
    return materialize(prune_transitions(transitions, keep, block_unk), "next-tokens")


def _beam_step(state: DataFrame, nexts: DataFrame, t: int, bw: int, factor: float) -> DataFrame:
    match = F.col("last") == F.col("prev")
    if t == 0:
        match = match & (F.col("next") != EOS)
    # one window per start, so the rows of a start stay where they are from step to step
    order = Window.partitionBy("start").orderBy(
        F.desc("moved"), _score(F.col("logp")).desc(), "seq"
    )
    ranked = (
        _grown(state, nexts, match)
        .withColumn("rank", F.row_number().over(order))
        .where(~F.col("moved") | (F.col("rank") <= bw))
    )
    ends = F.col("moved") & (F.col("next") == EOS)
    return ranked.select(
        "start",
        F.when(F.col("moved") & ~ends, F.col("next")).otherwise(_not_open()).alias("last"),
        "seq",
        F.when(ends, F.col("logp") * F.lit(factor)).otherwise(F.col("logp")).alias("logp"),
        (F.col("done") | ends).alias("done"),
    )


def greedy_path(
    starts: DataFrame,
    transitions: DataFrame,
    vocab_size: int,
    max_len: int = 8,
    block_unk: bool = False,
    key: str = "ex_id",
    lookup: str = "auto",
) -> DataFrame:
    """`key, start, seq, logp, done`: always the most likely next token, up to eos."""
    nexts = _next_tokens(transitions, 1, block_unk)
    # ties within rounding noise go to the smaller token
    best = Window.partitionBy("prev").orderBy(_score(F.col("step_logp")).desc(), "next")
    one = nexts.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")
    one = materialize(one, "next-token")
    if _next_way(lookup, one, vocab_size) == "inline":
        found = _greedy_folds(starts, one, vocab_size, max_len)
    else:
        found = _greedy_joins(starts, broadcast_if_small(one, _most()), max_len)
    return starts.select(key, "start").join(broadcast_if_small(found, _most()), "start")


def _greedy_folds(starts: DataFrame, one: DataFrame, vocab_size: int, max_len: int) -> DataFrame:
    first = F.struct(
        F.col("start").alias("last"),
        F.array().cast("array<int>").alias("seq"),
        F.lit(0.0).alias("logp"),
        F.lit(False).alias("done"),
    )

    def step(s: Column, _: Column) -> Column:
        def moved(n: Column) -> Column:
            return F.when(n.isNull() | s["done"], s).otherwise(
                F.struct(
                    n["next"].alias("last"),
                    F.concat(s["seq"], F.array(n["next"])).alias("seq"),
                    (s["logp"] + n["step_logp"]).alias("logp"),
                    (n["next"] == EOS).alias("done"),
                )
            )

        return bind(F.get(F.get(F.col("_nexts"), s["last"]), F.lit(0)), moved)

    steps = F.sequence(F.lit(1), F.lit(max_len))
    each = starts.select("start").distinct().withColumn("_nexts", _next_table(one, vocab_size))
    found = each.select("start", F.explode(F.array(F.aggregate(steps, first, step))).alias("s"))
    return found.select("start", "s.seq", "s.logp", "s.done")


def _greedy_joins(starts: DataFrame, one: DataFrame, max_len: int) -> DataFrame:
    state, ended = _first_state(starts), []
    for t in range(max_len):
        ends = F.col("moved") & (F.col("next") == EOS)
        state = _grown(state, one, F.col("last") == F.col("prev")).select(
            "start",
            F.when(F.col("moved") & ~ends, F.col("next")).otherwise(_not_open()).alias("last"),
            "seq",
            "logp",
            (F.col("done") | ends).alias("done"),
        )
        if t % WRITE_EVERY == WRITE_EVERY - 1 or t == max_len - 1:
            written = materialize(state, "paths")
            state = written.where("last >= 0")
            ended.append(written.where("last < 0"))
            if state.isEmpty():
                break
    return reduce(DataFrame.unionByName, ended, state).drop("last")
