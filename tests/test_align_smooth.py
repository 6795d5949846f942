"""Alignment by expectation-maximisation and discounted transitions, against loops and their sums."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from condensa.operators import align, beam, lm
from condensa.session import materialize

VOCAB_SIZE = 8


def loop_alignment(examples, rounds):
    """Table and likelihoods, a pair at a time."""
    sides = []
    for x, y in examples:
        shown = lambda ids: Counter(3 if i >= VOCAB_SIZE else i for i in ids or [] if i not in (0, 2))
        if shown(x) and shown(y):
            sides.append((shown(x), shown(y)))
    kinds = len({j for _, y in sides for j in y})
    table, course = None, []
    for _ in range(rounds):
        counts, value = defaultdict(float), 0.0
        for x, y in sides:
            for j, ny in y.items():
                own = {i: nx * (table.get((i, j), 0) if table else 1.0) for i, nx in x.items()}
                total = sum(own.values())
                value += ny * math.log(total / sum(x.values()) / (1 if table else kinds))
                for i, w in own.items():
                    counts[i, j] += ny * w / total
        sums = Counter()
        for (i, _), c in counts.items():
            sums[i] += c
        table = {(i, j): c / sums[i] for (i, j), c in counts.items()}
        course.append(value)
    return table, course


@pytest.fixture(scope="module")
def examples():
    random.seed(12)
    found = [([4, 5, 0], [6, 2]), ([], [4, 2]), ([0, 0], [0, 0]), (None, [4]), ([4], None), ([9, 10, 3], [9, 3, 2])]
    for _ in range(60):
        x = [random.choice([4, 5, 6, 7, 9]) for _ in range(random.randrange(1, 7))]
        y = [i + 1 if i < 7 else i for i in random.sample(x, random.randrange(len(x) + 1))] + [2]
        found.append((x, y))
    return found


def test_alignment_equals_loops(spark, examples):
    rows = [(i % 5, x, y) for i, (x, y) in enumerate(examples)]
    numbered = align.numbered(spark.createDataFrame(rows, "doc_id int, x array<int>, y array<int>"))
    pairs = materialize(align.id_pairs(numbered, VOCAB_SIZE))
    table, likelihood = align.align(pairs, 4)
    want, course = loop_alignment(examples, 4)
    assert {(r["x"], r["y"]): r["p"] for r in table.collect()} == pytest.approx(want)
    found = [r["log_likelihood"] for r in likelihood.orderBy("round").collect()]
    assert found == pytest.approx(course)
    assert all(b >= a - 1e-9 for a, b in zip(found, found[1:]))
    weighted = align.aligned_weights(numbered, pairs, table, VOCAB_SIZE).collect()
    assert len(weighted) == len(rows)
    for row in weighted:
        real = [w for i, w in zip(row["x"] or [], row["weights"] or []) if i not in (0, 2)]
        assert not real or sum(real) == pytest.approx(1)


def test_tasks_add_up_what_the_join_does(spark, monkeypatch, examples):
    """The shares of all pairs are not written: tasks give sums, and weights equal those of the join."""
    rows = [(i % 5, x, y) for i, (x, y) in enumerate(examples)]
    numbered = align.numbered(spark.createDataFrame(rows, "doc_id int, x array<int>, y array<int>"))
    pairs = materialize(align.id_pairs(numbered, VOCAB_SIZE))
    assert pairs.count() == len(rows)

    def results():
        table, likelihood = align.align(pairs, 3)
        weighted = align.aligned_weights(numbered, pairs, table, VOCAB_SIZE).collect()
        shown = lambda v: None if v is None else [round(w, 9) for w in v]
        return (
            {(r["x"], r["y"]): r["p"] for r in table.collect()},
            [r["log_likelihood"] for r in likelihood.orderBy("round").collect()],
            sorted((r["doc_id"], str(r["x"]), str(r["y"]), str(shown(r["weights"]))) for r in weighted),
        )

    summed = results()
    monkeypatch.setattr(align, "CELLS", 0)
    joined = results()
    assert summed[0] == pytest.approx(joined[0]) and summed[1] == pytest.approx(joined[1])
    assert summed[2] == joined[2]
    assert summed[0] == pytest.approx(loop_alignment(examples, 3)[0])


def test_alignment_finds_what_a_word_becomes(spark, examples):
    """In the examples a word 4, 5 or 6 becomes the next number."""
    numbered = align.numbered(spark.createDataFrame(examples, "x array<int>, y array<int>"))
    table, _ = align.align(materialize(align.id_pairs(numbered, VOCAB_SIZE)), 8)
    best = {}
    for r in table.collect():
        best[r["x"]] = max(best.get(r["x"], (0, 0)), (r["p"], r["y"]))
    assert [best[i][1] for i in (4, 5, 6)] == [5, 6, 7]


@pytest.fixture(scope="module")
def counts(spark):
    random.seed(4)
    seen = Counter((random.choice([1, 4, 5, 6, 7]), random.choice([2, 3, 4, 5, 6, 7, 8, 9])) for _ in range(90))
    rows = [(p, n, c) for (p, n), c in seen.items()]
    return seen, materialize(spark.createDataFrame(rows, "prev int, next int, n long"))


def full_table(seen, discount):
    kinds, total, follows = Counter(), Counter(), Counter()
    for (p, n), c in seen.items():
        kinds[p] += 1
        total[p] += c
        follows[n] += 1
    share = {n: k / len(seen) for n, k in follows.items()}
    return {
        (p, n): (max(seen.get((p, n), 0) - discount, 0) + discount * kinds[p] * share[n]) / total[p]
        for p in total
        for n in share
    }


def test_smoothed_shares_sum_to_one(counts):
    seen, rows = counts
    want = full_table(seen, 0.6)
    for p in {p for p, _ in want}:
        assert sum(v for (q, _), v in want.items() if q == p) == pytest.approx(1)
    found = {(r["prev"], r["next"]): math.exp(r["logp"]) for r in lm.smoothed_transitions(rows, 0.6).collect()}
    assert found == pytest.approx({k: want[k] for k in seen})
    left = {r["prev"]: r["backoff"] for r in lm.backoff_weights(rows, 0.6).collect()}
    share = {r["next"]: r["p_next"] for r in lm.continuation_shares(rows).collect()}
    for p, weight in left.items():
        unseen = sum(weight * s for n, s in share.items() if (p, n) not in seen)
        assert unseen + sum(v for (q, _), v in found.items() if q == p) == pytest.approx(1)


@pytest.mark.parametrize("keep", [1, 3, 6])
def test_the_best_next_tokens_are_there_seen_or_not(counts, keep):
    seen, rows = counts
    want = full_table(seen, 0.9)
    nexts = lm.smoothed_next_tokens(rows, 0.9, keep)
    pruned = beam.prune_transitions(nexts, keep, False).collect()
    for p in {p for p, _ in want}:
        best = sorted((v for (q, _), v in want.items() if q == p), reverse=True)[:keep]
        got = sorted((math.exp(r["step_logp"]) for r in pruned if r["prev"] == p), reverse=True)
        assert got[:keep] == pytest.approx(best)
    assert keep < 6 or any((r["prev"], r["next"]) not in seen for r in nexts.collect())


def test_a_search_follows_unseen_pairs(spark):
    """After 4 nothing but itself was seen; the way to the end leads through the back-off."""
    rows = spark.createDataFrame([(1, 4, 5), (4, 4, 9), (5, 2, 1)], "prev int, next int, n long")
    starts = spark.createDataFrame([(1, 1)], "ex_id int, start int")
    nexts = lm.smoothed_next_tokens(materialize(rows), 0.75, 5)
    found = beam.beam_search(starts, nexts, 8, 3, 4).first()
    assert found["done"] and found["seq"][-1] == 2
    assert lm.smoothed_transitions(rows.where(F.lit(False)), 0.75).collect() == []
