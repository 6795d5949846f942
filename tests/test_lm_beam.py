import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from condensa.operators import beam, lm


def test_copy_distribution_adds_repeats_and_sums_to_1(spark):
    df = spark.createDataFrame(
        [(1, [5, 6, 5, 0, 0]), (2, [0, 0, 0, 0, 0]), (3, [7, 7, 7, 7, 9])], "doc_id int, x array<int>"
    )
    got = {(r["doc_id"], r["id"]): r["p"] for r in lm.copy_distribution(df).collect()}
    assert got == pytest.approx({(1, 5): 2 / 3, (1, 6): 1 / 3, (3, 7): 0.8, (3, 9): 0.2})


def test_copy_distribution_with_weights(spark):
    df = spark.createDataFrame(
        [(1, [5, 6, 5, 0], [0.25, 0.5, 0.25, 0.9])], "doc_id int, x array<int>, w array<double>"
    )
    got = {r["id"]: r["p"] for r in lm.copy_distribution(df, weights="w").collect()}
    assert got == pytest.approx({5: 0.5, 6: 0.5})


def test_masked_average_is_macro(spark):
    df = spark.createDataFrame(
        [([1.0, 3.0], [True, True]), ([5.0, 99.0], [True, False])],
        "v array<double>, m array<boolean>",
    )
    assert lm.masked_average(df, "v", "m").first()[0] == 3.5


def test_mixture(spark):
    examples = spark.createDataFrame(
        [(1, [4, 6, 0, 0], [4, 6, 2, 0]), (2, [5, 5, 5, 4], [4, 2, 0, 0])],
        "doc_id int, x array<int>, y array<int>",
    )
    corpus = lm.corpus_distribution(examples, 5)
    assert {r["id"]: r["p"] for r in corpus.collect()} == {4: 0.4, 3: 0.2, 2: 0.4}
    probs = {r["doc_id"]: r["probs"] for r in lm.token_probabilities(examples, corpus, 5, 0.8).collect()}
    assert [p["p_final"] for p in probs[1]] == pytest.approx([0.8 * 0.4 + 0.1, 0.1, 0.32])
    nll = {r["doc_id"]: r["nll"] for r in lm.mixture_nll(examples, corpus, 5, 0.8).collect()}
    assert nll[1] == pytest.approx(-sum(map(math.log, (0.42, 0.1, 0.32))) / 3)


def test_mixture_has_a_floor(spark):
    examples = spark.createDataFrame([(1, [4], [9])], "doc_id int, x array<int>, y array<int>")
    corpus = spark.createDataFrame([(4, 1.0)], "id int, p double")
    assert lm.mixture_nll(examples, corpus, 5, 0.5).first()["nll"] == pytest.approx(-math.log(1e-7))


def test_coverage_counts_earlier_sentences_only(spark):
    df = spark.createDataFrame(
        [(1, "A b. A c. A b."), (2, "One two."), (3, "")], "doc_id int, text string"
    )
    got = {r["doc_id"]: r["penalty"] for r in lm.coverage_repetition(df).collect()}
    third = 1 / 3
    # step 2 repeats `a` and `.`, step 3 also `b`
    assert got == pytest.approx({1: 2 * third + 3 * third, 2: 0.0, 3: 0.0})


def test_transitions_sum_to_1(spark):
    df = spark.createDataFrame([(["a", "b", "a"],), (["a"],), ([],)], "t array<string>")
    counts = lm.bigram_counts(df, F.col("t"), F.lit("<s>"), F.lit("</s>"))
    expected = {
        ("<s>", "a"): 2,
        ("<s>", "</s>"): 1,
        ("a", "b"): 1,
        ("b", "a"): 1,
        ("a", "</s>"): 2,
    }
    assert {(r["prev"], r["next"]): r["n"] for r in counts.collect()} == expected
    for bounded in (False, True):
        rows = lm.bigram_transitions(counts, bounded).collect()
        for prev in ("<s>", "a", "b"):
            total = sum(math.exp(r["logp"]) for r in rows if r["prev"] == prev)
            assert total == pytest.approx(1)


def random_table(seed, size=9, fan=6):
    """`prev -> {next: logp}` over ids 1, 4.., with eos 2 and unk 3 among the next ones."""
    rng = random.Random(seed)
    words = [2, 3, *range(4, size)]
    table = {}
    for prev in [1, *range(4, size)]:
        nexts = rng.sample(words, min(fan, len(words)))
        weights = [rng.random() + 0.01 for _ in nexts]
        table[prev] = {n: math.log(w / sum(weights)) for n, w in zip(nexts, weights)}
    return table


def as_rows(spark, table):
    rows = [(p, n, lp) for p, nexts in table.items() for n, lp in nexts.items()]
    return spark.createDataFrame(rows, "prev int, next int, logp double")


def factor(t, alpha, norm):
    f = (5 + t) ** alpha / 6**alpha
    return f if norm == "multiply" else 1 / f


def plain_beam(table, start, bw, max_len, alpha, norm, block_unk):
    """The search over the unpruned table, stated as loops."""
    live, shut, stuck = [(0.0, ())], [], []
    for t in range(max_len):
        grown = []
        for logp, seq in live:
            options = {
                n: lp
                for n, lp in table.get(seq[-1] if seq else start, {}).items()
                if not (block_unk and n == 3) and not (t == 0 and n == 2)
            }
            if not options:
                stuck.append((logp, seq))
            grown += [(logp + lp, (*seq, n)) for n, lp in options.items()]
        grown.sort(key=lambda h: (-round(h[0], 9), h[1]))
        shut += [(s * factor(t, alpha, norm), q) for s, q in grown[:bw] if q[-1] == 2]
        live = [h for h in grown[:bw] if h[1][-1] != 2]
    pool = shut or live + stuck
    best = min(pool, key=lambda h: (-round(h[0], 9), h[1]))
    return best, bool(shut), len(shut)


@pytest.mark.parametrize("lookup", ["inline", "join"])
@pytest.mark.parametrize("bw, norm, block", [(1, "divide", True), (3, "multiply", True), (4, "divide", False)])
def test_beam_equals_loops(spark, bw, norm, block, lookup):
    table = random_table(bw)
    starts = [(100 + i, s) for i, s in enumerate([1, 4, 5, 6, 4, 8, 3])]
    df = spark.createDataFrame(starts, "ex_id int, start int")
    got = beam.beam_search(
        df, as_rows(spark, table), 9, bw, 8, 0.7, norm, block, lookup=lookup
    ).collect()
    assert len(got) == len(starts)
    for row in got:
        (score, seq), done, n = plain_beam(table, row["start"], bw, 8, 0.7, norm, block)
        assert tuple(row["seq"]) == seq
        assert row["score"] == pytest.approx(score)
        assert (row["done"], row["n_finished"]) == (done, n)


def test_wide_beam_finds_the_best_of_all(spark):
    table = random_table(11, size=8, fan=6)
    best = None
    words = range(4, 8)
    for length in range(1, 4):
        for path in itertools.product(words, repeat=length):
            steps = list(zip((1, *path), (*path, 2)))
            if all(n in table[p] for p, n in steps):
                score = sum(table[p][n] for p, n in steps) * factor(length, 0.7, "divide")
                best = max(best or (-1e9, ()), (score, (*path, 2)))
    df = spark.createDataFrame([(1, 1)], "ex_id int, start int")
    row = beam.beam_search(df, as_rows(spark, table), 8, 500, 4).first()
    assert (row["score"], tuple(row["seq"])) == (pytest.approx(best[0]), best[1])


@pytest.mark.parametrize("lookup", ["inline", "join"])
def test_nothing_finished_gives_the_best_open_one(spark, lookup):
    table = {1: {4: math.log(0.6), 5: math.log(0.4)}, 4: {4: 0.0}, 5: {4: 0.0}}
    df = spark.createDataFrame([(1, 1), (2, 7)], "ex_id int, start int")
    got = {r["ex_id"]: r for r in beam.beam_search(df, as_rows(spark, table), 9, 2, 3, lookup=lookup).collect()}
    assert (got[1]["seq"], got[1]["done"], got[1]["n_finished"]) == ([4, 4, 4], False, 0)
    assert (got[2]["seq"], got[2]["done"]) == ([], False)


@pytest.mark.parametrize("lookup", ["inline", "join"])
def test_eos_is_not_allowed_first_in_a_beam(spark, lookup):
    table = {1: {2: math.log(0.9), 4: math.log(0.1)}, 4: {2: 0.0}}
    df = spark.createDataFrame([(1, 1)], "ex_id int, start int")
    assert beam.beam_search(df, as_rows(spark, table), 9, 1, 3, lookup=lookup).first()["seq"] == [4, 2]


@pytest.mark.parametrize("lookup", ["inline", "join"])
def test_greedy(spark, lookup):
    table = {1: {4: math.log(0.6), 3: math.log(0.4)}, 4: {3: math.log(0.7), 2: math.log(0.3)}}
    df = spark.createDataFrame([(1, 1), (2, 4)], "ex_id int, start int")
    rows = as_rows(spark, table)
    blocked = {r["ex_id"]: r for r in beam.greedy_path(df, rows, 9, 5, block_unk=True, lookup=lookup).collect()}
    assert (blocked[1]["seq"], blocked[1]["done"]) == ([4, 2], True)
    assert blocked[1]["logp"] == pytest.approx(math.log(0.6 * 0.3))
    free = {r["ex_id"]: r for r in beam.greedy_path(df, rows, 9, 5, lookup=lookup).collect()}
    assert (free[2]["seq"], free[2]["done"]) == ([3], False)


def test_many_next_tokens_are_joined(spark, monkeypatch):
    """By the count of next tokens a fold becomes joins, first broadcast and then shuffled ones."""
    table = random_table(5)
    df = spark.createDataFrame([(i, s) for i, s in enumerate([1, 4, 5])], "ex_id int, start int")
    search = lambda: sorted(
        (r["ex_id"], tuple(r["seq"]), round(r["score"], 9))
        for r in beam.beam_search(df, as_rows(spark, table), 9, 3, 4).collect()
    )
    folded = search()
    monkeypatch.setattr(beam, "INLINE_NEXTS", 1)
    monkeypatch.setattr(beam, "_beam_folds", None)
    assert search() == folded
    monkeypatch.setattr(beam, "BROADCAST_ROWS", 1)
    assert search() == folded


def test_a_fold_has_no_exchange_for_its_steps(spark):
    """However many steps, only the distinct starts are shuffled, and the answers joined."""
    plans = []
    for steps in (2, 40):
        starts = spark.createDataFrame([(1, 1)], "ex_id int, start int")
        found = beam.beam_search(starts, as_rows(spark, random_table(5)), 9, 3, steps)
        plans.append(found._jdf.queryExecution().executedPlan().toString().count("Exchange"))
    assert plans[0] == plans[1] <= 6


def test_no_joined_key_is_null_or_shared_by_closed_rows(spark):
    rows = [(s, l, q, 0.0, l < 0) for s, l, q in ((1, -5, [2]), (4, 4, []), (5, -9, [4, 2]))]
    state = spark.createDataFrame(rows, "start int, last int, seq array<int>, logp double, done boolean")
    nexts = beam.prune_transitions(as_rows(spark, random_table(5)), 4, True)
    for t in range(3):
        state = beam._beam_step(state, nexts, t, 3, 1.0)
        assert state.where("last IS NULL").count() == 0
    shut = state.where("last < 0").collect()
    assert len({r["last"] for r in shut}) == len(shut)


def test_pruning_keeps_steps_that_rounding_makes_equal(spark):
    rows = [(1, 9, -1.0), (1, 4, -1.0 - 1e-10), (1, 5, -1.5), (4, 7, -1.0), (4, 8, -1.0), (4, 9, -1.0)]
    df = spark.createDataFrame(rows, "prev int, next int, logp double")
    kept = beam.prune_transitions(df, 1, False).collect()
    assert {(r["prev"], r["next"]) for r in kept} == {(1, 9), (1, 4), (4, 7)}


def test_mixture_by_the_join_way_is_the_same(spark):
    examples = spark.createDataFrame(
        [(1, [4, 6, 0, 0], [4, 6, 2, 0]), (1, [5, 5, 5, 4], [4, 2, 0, 0])],
        "doc_id int, x array<int>, y array<int>",
    )
    corpus = lm.corpus_distribution(examples, 5)
    ways = [lm.mixture_nll(examples, corpus, 5, 0.8, lookup=w).collect() for w in ("inline", "join")]
    assert sorted(ways[0]) == sorted(ways[1]) and len(ways[0]) == 2
    assert len(lm.mixture_nll(examples, corpus, 300_000, 0.8).collect()) == 2


def test_copying_and_coverage_need_no_shuffle(spark):
    examples = spark.createDataFrame([(1, [4, 6])], "doc_id int, x array<int>")
    docs = spark.createDataFrame([(1, "A b.")], "doc_id int, text string")
    for df in (lm.copy_distribution(examples), lm.coverage_repetition(docs)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_neighbours_are_rows(spark):
    rows = [(["a", "b", "a", "b"],), ([],), (None,), (["a"],)]
    df = spark.createDataFrame(rows, "t array<string>")
    counts = lm.bigram_counts(df, F.col("t"), F.lit("<s>"), F.lit("</s>"))
    found = {(r["prev"], r["next"]): r["n"] for r in counts.collect()}
    want = {("<s>", "a"): 2, ("a", "b"): 2, ("b", "a"): 1, ("b", "</s>"): 1, ("<s>", "</s>"): 1, ("a", "</s>"): 1}
    assert found == want
    # no array of pairs is made for a text
    assert "arrays_zip" not in counts._jdf.queryExecution().optimizedPlan().toString()
