"""Beam search through the mixture of next tokens and the tokens of the example's own source.

The probability of a token is `p_gen` times that of the corpus transitions plus `1 - p_gen` times its copy
weight, so ids beyond the vocabulary can be written, too; after one of them the transitions are those of
the unknown id. Each token has a list of its best next tokens. What is on the list of a hypothesis' last token is
scored with what copying adds; a source id beyond the end of the list contributes no more than the list's last entry
and its copy weight, so its transition is looked up only where that may be among the best.

A hypothesis may carry its coverage: how much each source id has been copied so far. Copying it again
costs `coverage` times the smaller one of that and of the share that the new token owes to copying.

The examples of a batch advance together, as arrays, in the task that holds them. Where the transitions are few, which
is counted, every task receives them, and there is no join. For more of them an example that asks for transitions it
does not have is put aside; what was asked is joined, and the example is searched again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from condensa.functions.ids import EOS, PAD, UNK
from condensa.operators.beam import SCORE_DIGITS, length_factor, prune_transitions
from condensa.operators.lookup import way
from condensa.operators.skew import attach_by_key
from condensa.session import materialize

#: Transitions, at most, that every task receives as one table.
INLINE_TRANSITIONS = 1_000_000
#: Next tokens on the list of a token, besides as many as a step keeps.
LISTED = 60
#: Examples that a task searches at once.
BATCH_ROWS = 1_000
#: Bounds are lowered by this much, as scores that differ by rounding noise only count as equal.
SLACK = 1e-8
ANSWER = "seq array<int>, score double, done boolean, n_finished bigint"


@dataclass
class _Settings:
    vocab_size: int
    start: int
    listed: int
    bw: int
    coverage: float
    factors: list[float]
    p_gen: float
    block_unk: bool


@dataclass
class _Lists:
    """Lists of next tokens, best first, a line each; the last line is an empty one."""

    lasts: np.ndarray
    ids: np.ndarray
    p: np.ndarray
    beyond: np.ndarray

    @classmethod
    def of(cls, lasts: np.ndarray, sizes: np.ndarray, ids: np.ndarray, p: np.ndarray, s: _Settings) -> _Lists:
        """From flat lists of `sizes`, by ascending `lasts`."""
        width = max(s.bw, int(sizes.max(initial=0)))
        shape = (len(lasts) + 1, width)
        lines, places = np.repeat(np.arange(len(lasts)), sizes), _places(sizes)
        table, parts = np.full(shape, -1, dtype=np.int64), np.zeros(shape)
        table[lines, places], parts[lines, places] = ids, p
        # of a list that was cut, what is not on it may contribute as much as its last entry
        beyond = np.zeros(len(lasts) + 1)
        cut = np.flatnonzero(sizes >= s.listed)
        beyond[cut] = parts[cut, sizes[cut] - 1]
        return cls(lasts, table, parts, beyond)

    def line(self, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The line of each token, and whether it has one."""
        return _found(self.lasts, last)


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each of the groups of `sizes`."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _found(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of `wanted` in the ascending `keys` (their number for what is not there), and what is there."""
    at = np.searchsorted(keys, wanted)
    there = at < len(keys)
    there[there] = keys[at[there]] == wanted[there]
    return np.where(there, at, len(keys)), there


def _pair(prev: np.ndarray, following: np.ndarray) -> np.ndarray:
    return (prev.astype(np.int64) << 32) | following


def _first_of_rows(row: np.ndarray, score: np.ndarray, seq: np.ndarray, shape: tuple) -> np.ndarray:
    """Of each row the place of its best entry, -1 for none; ties go to the smaller sequence."""
    order = np.lexsort((*seq.T[::-1], -np.round(score, SCORE_DIGITS), row))
    first = np.full(shape, -1)
    # the last write to a row is that of its first entry
    first[row[order[::-1]]] = order[::-1]
    return first


class _Search:
    """The examples of a batch; `sizes`, `ids` and `c` are their copy entries, by id within each."""

    def __init__(
        self, sizes: np.ndarray, ids: np.ndarray, c: np.ndarray, lists: _Lists,
        share_of: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], complete: bool, settings: _Settings,
    ):
        self.n, self.s, self.lists, self.share_of, self.complete = len(sizes), settings, lists, share_of, complete
        self.sizes, self.ids, self.c = sizes, ids.astype(np.int64), c
        self.starts = np.cumsum(sizes) - sizes
        self.keys = _pair(np.repeat(np.arange(self.n), sizes), self.ids)
        self.asked_lists: list[tuple[np.ndarray, np.ndarray]] = []
        self.asked_pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.blocked = np.zeros(self.n, dtype=bool)
        self.ended: list[tuple] = []
        self.left: list[tuple] = []
        self.finished = np.zeros(self.n, dtype=np.int64)

    def run(self) -> None:
        s, most = self.s, len(self.s.factors)
        self.row, self.last = np.arange(self.n), np.full(self.n, s.start, dtype=np.int64)
        self.logp = np.zeros(self.n)
        # what is behind the end of a sequence sorts before every id
        self.seq = np.full((self.n, most), -1, dtype=np.int64)
        self.copied = np.zeros((self.n, most))
        for t in range(most):
            if not len(self.row):
                break
            self._step(t)
        self.left.append((self.row, self.logp, self.seq))

    def _keep(self, kept: np.ndarray) -> None:
        for name in ("row", "last", "logp", "seq", "copied"):
            setattr(self, name, getattr(self, name)[kept])

    def _block(self, rows: np.ndarray) -> None:
        self.blocked[rows] = True

    def _penalty(self, h: np.ndarray, ids: np.ndarray, share: np.ndarray, t: int) -> np.ndarray:
        again = self.seq[h, :t] == ids[:, None]
        before = np.where(again, self.copied[h, :t], 0.0).sum(axis=1)
        return self.s.coverage * np.minimum(share, before)

    def _step(self, t: int) -> None:
        s = self.s
        line, known = self.lists.line(self.last)
        if not self.complete and not known.all():
            self.asked_lists.append((self.row[~known], self.last[~known]))
            self._block(self.row[~known])
            kept = ~self.blocked[self.row]
            self._keep(kept)
            line = line[kept]
            if not len(self.row):
                return
        ids, p = self.lists.ids[line], self.lists.p[line]
        real = (ids >= 0) & ((t > 0) | (ids != EOS))
        h, place = np.nonzero(real)
        token, own = ids[real], p[real]
        at, is_copy = _found(self.keys, _pair(self.row[h], token))
        c = np.zeros(len(h))
        c[is_copy] = self.c[at[is_copy]]
        gain = np.log(own + c)
        share = c / (own + c)
        if s.coverage:
            gain[is_copy] -= self._penalty(h[is_copy], token[is_copy], share[is_copy], t)
        value = self.logp[h] + gain
        # what the bw-th best of each example has at least
        table = np.full(ids.shape, -np.inf)
        table[h, place] = value
        best = -np.partition(-table, s.bw - 1, axis=1)[:, : s.bw]
        slots = np.bincount(self.row, minlength=self.n)
        ranked = np.full((self.n, s.bw, s.bw), -np.inf)
        ranked[self.row, _places(slots[slots > 0])] = best
        least = -np.partition(-ranked.reshape(self.n, -1), s.bw - 1, axis=1)[:, s.bw - 1]
        # source ids that are not on the list
        sizes = self.sizes[self.row]
        more, entry = np.repeat(np.arange(len(self.row)), sizes), _places(sizes)
        firsts = np.cumsum(sizes) - sizes
        open_ = np.ones(len(more), dtype=bool)
        open_[firsts[h[is_copy]] + at[is_copy] - self.starts[self.row[h[is_copy]]]] = False
        entry += np.repeat(self.starts[self.row], sizes)
        if t == 0:
            open_ &= self.ids[entry] != EOS
        beyond = self.lists.beyond[line]
        possible = self.logp[more] + np.log(self.c[entry] + beyond[more]) >= least[self.row[more]] - SLACK
        any_copy = np.bincount(more[open_], minlength=len(self.row)) > 0
        open_ &= possible
        more, entry = more[open_], entry[open_]
        wanted = beyond[more] > 0
        part = np.zeros(len(more))
        pairs = _pair(self.last[more[wanted]], self.ids[entry[wanted]])
        part[wanted], known = self.share_of(pairs)
        if not known.all():
            rows = self.row[more[wanted]][~known]
            self.asked_pairs.append((rows, pairs[~known]))
            self._block(rows)
        c_more = self.c[entry]
        gain = np.log(part + c_more)
        share_more = c_more / (part + c_more)
        if s.coverage:
            gain -= self._penalty(more, self.ids[entry], share_more, t)
        stuck = ~any_copy & (np.bincount(h, minlength=len(self.row)) == 0)
        self.left.append((self.row[stuck], self.logp[stuck], self.seq[stuck]))
        near = value >= least[self.row[h]] - SLACK
        self._choose(
            t,
            np.concatenate([h[near], more]),
            np.concatenate([token[near], self.ids[entry]]),
            np.concatenate([value[near], self.logp[more] + gain]),
            np.concatenate([share[near], share_more]),
        )

    def _choose(self, t: int, h: np.ndarray, token: np.ndarray, value: np.ndarray, share: np.ndarray) -> None:
        """The best of each example go on; those that end are put by."""
        s = self.s
        place = np.empty(len(self.row), dtype=np.int64)
        place[np.lexsort(self.seq.T[::-1])] = np.arange(len(self.row))
        row = self.row[h]
        order = np.lexsort((token, place[h], -np.round(value, SCORE_DIGITS), row))
        sizes = np.bincount(row, minlength=self.n)
        order = order[_places(sizes[sizes > 0]) < s.bw]
        h, token, value, share, row = h[order], token[order], value[order], share[order], row[order]
        seq, copied = self.seq[h], self.copied[h]
        seq[:, t], copied[:, t] = token, share
        ends = token == EOS
        self.ended.append((row[ends], value[ends] * s.factors[t], seq[ends]))
        self.finished += np.bincount(row[ends], minlength=self.n)
        self.row, self.logp, self.seq, self.copied = row, value, seq, copied
        self.last = np.where(token >= s.vocab_size, UNK, token)
        self._keep(~ends & ~self.blocked[row])

    def answers(self) -> list[pa.Array]:
        """`seq, score, done, n_finished`; null where an example is blocked."""
        none = (np.empty(0, dtype=np.int64), np.empty(0), np.empty((0, len(self.s.factors)), dtype=np.int64))
        pools = [[np.concatenate(c) for c in zip(none, *pool)] for pool in (self.ended, self.left)]
        ended, left = (_first_of_rows(*pool, self.n) for pool in pools)
        done = ended >= 0
        score, seq = np.zeros(self.n), np.full((self.n, len(self.s.factors)), -1, dtype=np.int64)
        for chosen, at, pool in ((done, ended, pools[0]), (~done & (left >= 0), left, pools[1])):
            score[chosen], seq[chosen] = pool[1][at[chosen]], pool[2][at[chosen]]
        shown = seq >= 0
        offsets = np.append(0, np.cumsum(shown.sum(axis=1)))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(seq[shown], pa.int32()))
        return [
            lists, pa.array(score, mask=self.blocked), pa.array(done, mask=self.blocked), pa.array(self.finished),
        ]


def _flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Lengths and elements of a list column without nulls."""
    return np.diff(column.offsets.to_numpy()), column.flatten()


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _copies(batch: pa.RecordBatch, s: _Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, ids and parts of the mixture of the copy entries: the weights of equal ids of a row added up."""
    lengths, ids = _flat(batch.column("_ids"))
    ids, row = _numbers(ids).astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    real = ids != PAD
    given = batch.column("_weights")
    if given.null_count < len(given):
        # without an own weight a place weighs nothing
        own, found = _flat(given.fill_null([]))
        weight = np.zeros(len(ids))
        there = np.flatnonzero(np.repeat(own, lengths) > _places(lengths))
        weight[there] = np.nan_to_num(_numbers(found)[np.repeat(np.cumsum(own) - own, lengths)[there] + _places(lengths)[there]])
    else:
        weight = (1.0 / np.maximum(np.bincount(row[real], minlength=len(lengths)), 1))[row]
    row, ids, weight = row[real], ids[real], weight[real]
    order = np.lexsort((weight, ids, row))
    keys, group = np.unique(_pair(row, ids)[order], return_inverse=True)
    total = np.bincount(group, weight[order], minlength=len(keys))
    kept = total > 0
    if s.block_unk:
        kept &= (keys & 0xFFFFFFFF) != UNK
    keys, total = keys[kept], total[kept]
    return np.bincount(keys >> 32, minlength=len(lengths)), keys & 0xFFFFFFFF, (1.0 - s.p_gen) * total


def _lists(transitions: DataFrame, keep: int, p_gen: float, block_unk: bool) -> DataFrame:
    """`prev, ids, p`: by token its best next tokens with their part of the mixture, best first."""
    part = F.lit(p_gen) * F.exp("step_logp")
    entry = F.struct((-part).alias("rank"), "next", part.alias("p"))
    listed = F.array_sort(F.collect_list(entry))
    pruned = prune_transitions(transitions, keep, block_unk)
    lists = pruned.groupBy("prev").agg(listed.alias("l"))
    return lists.select("prev", F.transform("l", lambda n: n["next"]).alias("ids"), F.transform("l", lambda n: n["p"]).alias("p"))


def _collected_lists(lists: DataFrame, settings: _Settings) -> tuple[np.ndarray, ...]:
    """The parts of `_Lists`: what is broadcast holds nothing of this package."""
    found = lists.orderBy("prev").toArrow().combine_chunks()
    columns = [found.column(c).combine_chunks() for c in ("prev", "ids", "p")]
    lasts = _numbers(columns[0]).astype(np.int64)
    if not len(lasts):
        none = _Lists.of(lasts, lasts, lasts, np.empty(0), settings)
        return none.lasts, none.ids, none.p, none.beyond
    sizes, ids = _flat(columns[1])
    made = _Lists.of(lasts, sizes, _numbers(ids), _numbers(columns[2].flatten()), settings)
    return made.lasts, made.ids, made.p, made.beyond


def _folded(rows: DataFrame, key: str, lists: DataFrame, pairs: DataFrame, settings: _Settings) -> DataFrame:
    """Every task has all lists and pairs: no join."""
    spark = rows.sparkSession
    found = pairs.select(F.shiftleft(F.col("prev").cast("long"), 32) + F.col("next"), "p").toArrow()
    keys, parts = _numbers(found.column(0)), _numbers(found.column(1))
    order = np.argsort(keys)
    sent = spark.sparkContext.broadcast((_collected_lists(lists, settings), keys[order], np.append(parts[order], 0.0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, keys, parts = sent.value
        lists = _Lists(*table)

        def share_of(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return parts[_found(keys, wanted)[0]], np.ones(len(wanted), dtype=bool)

        for batch in _small(batches):
            search = _Search(*_copies(batch, settings), lists, share_of, True, settings)
            search.run()
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key"), *search.answers()], names=["_key", "seq", "score", "done", "n_finished"]
            )

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, {ANSWER}").withColumnRenamed("_key", key)


def _known_lists(batch: pa.RecordBatch, settings: _Settings) -> _Lists:
    lasts, ids, parts = batch.column("_lists").flatten().flatten()
    found, at = np.unique(_numbers(lasts).astype(np.int64), return_index=True)
    sizes, ids = _flat(ids.take(pa.array(at)))
    return _Lists.of(found, sizes, _numbers(ids), _numbers(parts.take(pa.array(at)).flatten()), settings)


def _asked(n: int, asked: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.Array:
    """Of each example the distinct values that it asked for."""
    rows, values = (np.concatenate([np.empty(0, dtype=np.int64), *part]) for part in zip(*asked)) if asked else ([], [])
    rows, values = np.unique(np.stack([rows, values]).astype(np.int64), axis=1)
    offsets = np.append(0, np.cumsum(np.bincount(rows, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _joined(rows: DataFrame, key: str, lists: DataFrame, pairs: DataFrame, settings: _Settings) -> DataFrame:
    """Examples that ask for lists or pairs get those joined, and are searched again until none asks."""
    spark = rows.sparkSession
    lists = materialize(lists, "next-lists")
    pair = (F.shiftleft(F.col("prev").cast("long"), 32) + F.col("next")).alias("pair")
    pairs = materialize(pairs.select(pair, "p"), "pairs")
    most = INLINE_TRANSITIONS // 100
    complete = lists.limit(most + 1).count() <= most
    sent = spark.sparkContext.broadcast(_collected_lists(lists, settings) if complete else None)
    list_kind, pair_kind = "array<struct<prev:int,ids:array<int>,p:array<double>>>", "array<struct<pair:bigint,p:double>>"
    state = rows.select(
        F.monotonically_increasing_id().alias("_row"), "*",
        F.array().cast(list_kind).alias("_lists"), F.array().cast(pair_kind).alias("_pairs"),
    )
    state = materialize(state, "copy-entries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            keys, parts = (_numbers(c) for c in batch.column("_pairs").flatten().flatten())
            keys, at = np.unique(keys.astype(np.int64), return_index=True)
            parts = np.append(parts[at], 0.0)

            def share_of(wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
                places, there = _found(keys, wanted)
                return parts[places], there  # noqa: B023

            known = _Lists(*sent.value) if complete else _known_lists(batch, settings)
            search = _Search(*_copies(batch, settings), known, share_of, complete, settings)
            search.run()
            asked = [
                _asked(batch.num_rows, search.asked_lists, pa.int32()),
                _asked(batch.num_rows, search.asked_pairs, pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *search.answers(), *asked],
                names=[*batch.schema.names, "seq", "score", "done", "n_finished", "ask_lists", "ask_pairs"],
            )

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in state.schema)
    schema = f"{kinds}, {ANSWER}, ask_lists array<int>, ask_pairs array<bigint>"
    answers = []
    while True:
        searched = materialize(state.mapInArrow(run, schema), "searched")
        answers.append(searched.where("done IS NOT NULL").select("_key", "seq", "score", "done", "n_finished"))
        waiting = searched.where("done IS NULL")
        if waiting.isEmpty():
            break
        for asked, name, table, kind in (
            ("ask_lists", "_lists", lists.select(F.col("prev").alias("k"), F.struct("prev", "ids", "p").alias("v")), list_kind),
            ("ask_pairs", "_pairs", pairs.select(F.col("pair").alias("k"), F.struct("pair", "p").alias("v")), pair_kind),
        ):
            if complete and name == "_lists":
                continue
            wanted = materialize(waiting.select("_row", F.explode(asked).alias("k")), "asked")
            if table.limit(INLINE_TRANSITIONS + 1).count() <= INLINE_TRANSITIONS and name == "_pairs":
                met = wanted.join(F.broadcast(table), "k", "left")
            else:
                met = attach_by_key(wanted, table, "k", "v", wanted.groupBy("k").agg(F.count("*").alias("weight")))
            # what is not there is known, too: an empty list, a share of zero
            empty = (
                F.struct(F.col("k").alias("prev"), F.array().cast("array<int>").alias("ids"), F.array().cast("array<double>").alias("p"))
                if name == "_lists" else F.struct(F.col("k").alias("pair"), F.lit(0.0).alias("p"))
            )
            told = met.groupBy("_row").agg(F.collect_list(F.coalesce("v", empty)).alias("_told"))
            waiting = (
                waiting.join(told, "_row", "left")
                .withColumn(name, F.concat(name, F.coalesce("_told", F.array().cast(kind))))
                .drop("_told")
            )
        state = waiting.select(*state.columns)
    found = answers[0]
    for more in answers[1:]:
        found = found.unionByName(more)
    return found.withColumnRenamed("_key", key)


def pointer_beam_search(
    examples: DataFrame,
    transitions: DataFrame,
    vocab_size: int,
    p_gen: float,
    start: int,
    bw: int = 4,
    max_len: int = 8,
    alpha: float = 0.7,
    length_norm: str = "divide",
    block_unk: bool = True,
    coverage: float = 0.0,
    key: str = "doc_id",
    ids: str = "x",
    weights: str | None = None,
    lookup: str = "auto",
) -> DataFrame:
    """`key, seq, score, done, n_finished`: the best sequence that each example's own source leads to.

    `seq` has vocabulary ids and extended ids of the example. Every hypothesis begins behind `start`, and
    may not end at once. Each step keeps the `bw` best of an example by log probability less what
    `coverage` takes off; those that end in eos close, and the best closed one by normalised
    score is the answer, or the best open one (`done = false`) if none closed. Copy weights are those of
    `lm.copy_weights`; an example without any follows the transitions alone. Lists are cut, and what is beyond
    their ends is looked up for source ids, so the result is that of scoring every token. `lookup` is as in
    encoding; rows of equal or null keys are answered each.
    """
    # a null source is an empty one
    rows = examples.select(
        F.col(key).alias("_key"),
        F.coalesce(ids, F.array().cast("array<int>")).alias("_ids"),
        (F.col(weights) if weights else F.lit(None)).cast("array<double>").alias("_weights"),
    )
    transitions = materialize(transitions.select("prev", "next", "logp"), "transitions")
    # as many of a list may be copied again as a sequence is long; the others are not made worse
    listed = bw + max(LISTED, max_len if coverage else 0)
    lists = _lists(transitions, listed, p_gen, block_unk)
    pairs = transitions.select("prev", "next", (F.lit(p_gen) * F.exp("logp")).alias("p"))
    chosen = way(lookup, vocab_size)
    if lookup == "auto" and chosen == "inline" and transitions.count() > INLINE_TRANSITIONS:
        chosen = "join"
    factors = [length_factor(t, alpha, length_norm) for t in range(max_len)]
    settings = _Settings(vocab_size, start, listed, bw, coverage, factors, p_gen, block_unk)
    search = _folded if chosen == "inline" else _joined
    return search(rows, key, lists, pairs, settings)
