"""Search through the mixture of transitions and copying, with and without coverage, against loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from test_lm_beam import as_rows, factor, random_table

from condensa.operators import pointer

VOCAB_SIZE = 9


def plain_search(table, source, p_gen, bw, max_len, norm, block_unk, coverage, start=1):
    """Every step scores every token that has any probability; nothing is pruned."""
    real = [i for i in source if i]
    copy = {i: real.count(i) / len(real) for i in real}
    live, shut, stuck = [(0.0, (), ())], [], []
    for t in range(max_len):
        grown = []
        for logp, seq, used in live:
            last = seq[-1] if seq else start
            nexts = table.get(3 if last >= VOCAB_SIZE else last, {})
            options = []
            for i in set(nexts) | set(copy):
                if (block_unk and i == 3) or (t == 0 and i == 2):
                    continue
                own = (1 - p_gen) * copy.get(i, 0.0)
                p = p_gen * (math.exp(nexts[i]) if i in nexts else 0.0) + own
                before = sum(r for j, r in used if j == i)
                gain = math.log(p) - coverage * min(own / p, before)
                options.append((logp + gain, (*seq, i), (*used, (i, own / p))))
            if not options:
                stuck.append((logp, seq, used))
            grown += options
        grown.sort(key=lambda h: (-round(h[0], 9), h[1]))
        ended = [h for h in grown[:bw] if h[1][-1] == 2]
        shut += [(h[0] * factor(t, 0.7, norm), h[1]) for h in ended]
        live = [h for h in grown[:bw] if h[1][-1] != 2]
    pool = shut or [h[:2] for h in live + stuck]
    return min(pool, key=lambda h: (-round(h[0], 9), h[1])), bool(shut), len(shut)


def sources():
    random.seed(9)
    # 9 is no id; from 10 on ids are those of the example's own words
    found = [[4, 10, 4, 5, 11], [3, 3, 3], [], [0, 0], [10], [12, 10, 11, 12, 13, 14], [2, 4]]
    for _ in range(12):
        found.append([random.choice([3, 4, 5, 6, 7, 8, 10, 11, 12]) for _ in range(random.randrange(1, 12))])
    return [ids + [0] * (12 - len(ids)) for ids in found]


@pytest.mark.parametrize("lookup, listed", [("inline", 60), ("inline", 1), ("join", 1)])
@pytest.mark.parametrize(
    "bw, norm, block, coverage, p_gen",
    [(1, "divide", True, 0.0, 0.8), (4, "divide", True, 1.5, 0.3), (3, "multiply", False, 0.7, 0.6)],
)
def test_search_equals_loops(spark, monkeypatch, bw, norm, block, coverage, p_gen, lookup, listed):
    monkeypatch.setattr(pointer, "LISTED", listed)
    table = random_table(bw + 20)
    rows = [(i // 2, ids) for i, ids in enumerate(sources())]  # keys twice each
    df = spark.createDataFrame(rows, "doc_id int, x array<int>")
    found = pointer.pointer_beam_search(
        df, as_rows(spark, table), VOCAB_SIZE, p_gen, 1, bw, 6, 0.7, norm, block, coverage, lookup=lookup
    ).collect()
    got = sorted((r["doc_id"], tuple(r["seq"]), round(r["score"], 8), r["done"], r["n_finished"]) for r in found)
    want = []
    for key, ids in rows:
        (score, seq), done, n = plain_search(table, ids, p_gen, bw, 6, norm, block, coverage)
        want.append((key, seq, round(score, 8), done, n))
    assert got == sorted(want)


def test_copied_words_and_coverage(spark):
    """An own word of the example wins, again and again without coverage, and once with it."""
    table = {1: {4: 0.0}, 3: {4: 0.0}, 4: {5: 0.0}, 5: {4: 0.0}}
    df = spark.createDataFrame([(1, [10, 10, 10, 5])], "doc_id int, x array<int>")

    def best(coverage):
        found = pointer.pointer_beam_search(
            df, as_rows(spark, table), VOCAB_SIZE, 0.3, 1, 4, 3, coverage=coverage
        )
        return found.first()["seq"]

    assert best(0.0) == [10, 10, 10]
    assert best(20.0).count(10) == 1


def test_null_and_empty_sources_follow_the_transitions(spark):
    table = {1: {4: math.log(0.9), 5: math.log(0.1)}, 4: {2: 0.0}, 5: {2: 0.0}}
    df = spark.createDataFrame([(1, None), (None, []), (2, [0, 0])], "doc_id int, x array<int>")
    found = pointer.pointer_beam_search(df, as_rows(spark, table), VOCAB_SIZE, 0.5, 1, 2, 4)
    assert [r["seq"] for r in found.collect()] == [[4, 2]] * 3
    none = pointer.pointer_beam_search(df.limit(0), as_rows(spark, table), VOCAB_SIZE, 0.5, 1, 2, 4)
    assert none.collect() == []


def test_many_transitions_are_joined(spark, monkeypatch):
    monkeypatch.setattr(pointer, "INLINE_TRANSITIONS", 1)
    monkeypatch.setattr(pointer, "_folded", None)
    table = random_table(3)
    df = spark.createDataFrame(list(enumerate(sources())), "doc_id int, x array<int>")
    found = pointer.pointer_beam_search(df, as_rows(spark, table), VOCAB_SIZE, 0.5, 1, 2, 4)
    for row in found.collect():
        (_, seq), _, _ = plain_search(table, sources()[row["doc_id"]], 0.5, 2, 4, "divide", True, 0.0)
        assert tuple(row["seq"]) == seq


def test_examples_of_a_task_advance_together(spark):
    """The rows of a batch are searched as arrays, without a fold in each row."""
    table = random_table(11)
    given = [ids for ids in sources() if any(ids)] * 60
    transitions = sorted((p, n, v) for p, nexts in table.items() for n, v in nexts.items() if n != 3)
    s = pointer._Settings(VOCAB_SIZE, 1, 64, 3, 0.7, [factor(t, 0.7, "divide") for t in range(5)], 0.5, True)
    lasts = np.array(sorted({p for p, _, _ in transitions}))
    ordered = sorted(transitions, key=lambda e: (e[0], -e[2], e[1]))
    lists = pointer._Lists.of(
        lasts, np.array([sum(p == q for p, _, _ in transitions) for q in lasts]),
        np.array([n for _, n, _ in ordered]), np.array([0.5 * math.exp(v) for _, _, v in ordered]), s,
    )
    columns = [pa.array(given, pa.list_(pa.int32())), pa.nulls(len(given), pa.list_(pa.float64()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["_ids", "_weights"])
    search = pointer._Search(*pointer._copies(batch, s), lists, None, True, s)
    # no list is cut, so no pair is looked up
    search.share_of = lambda wanted: (np.zeros(0), np.ones(0, dtype=bool)) if not len(wanted) else 1 / 0
    search.run()
    seqs, scores, done, _ = search.answers()
    for ids, seq, score, ended in zip(given[:40], seqs.to_pylist(), scores.to_pylist(), done.to_pylist()):
        (want, best), closed, _ = plain_search(table, ids, 0.5, 3, 5, "divide", True, 0.7)
        assert (tuple(seq), round(score, 8), ended) == (best, round(want, 8), closed)


def test_weighted_sources(spark):
    """Weights take the place of counts, also where they are missing."""
    rows = [(1, [10, 4, 10, 0], [0.1, 0.5, 0.2, 0.2]), (2, [10, 4], None), (3, [5, 10], [0.9])]
    df = spark.createDataFrame(rows, "doc_id int, x array<int>, w array<double>")
    table = {1: {6: 0.0}, 6: {2: 0.0}}
    found = pointer.pointer_beam_search(df, as_rows(spark, table), VOCAB_SIZE, 0.1, 1, 1, 1, weights="w")
    score = {r["doc_id"]: (r["seq"], round(math.exp(r["score"]), 9)) for r in found.collect()}
    assert score[1] == ([4], 0.45) and score[3] == ([5], 0.81)
