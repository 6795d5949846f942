"""Cuts of the highest score: against all cuts of short words, on odd texts, and copies cut alike."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from condensa.operators import lattice

TABLE = [("a", -1.0), ("b", -2.5), ("ab", -3.0), ("ba", -2.0), ("aba", -4.5), ("▁", -0.5), ("▁a", -1.2), ("é", -3.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(TABLE, "word string, score double")


def best_cut(word, table, unknown):
    """Every way to cut the word; of equal scores the longest last piece, then the next to last, ..."""
    found = []
    for marks in itertools.product([0, 1], repeat=len(word) - 1):
        cuts = [0, *[i + 1 for i, m in enumerate(marks) if m], len(word)]
        pieces = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in table or len(p) == 1 for p in pieces):
            score = sum(table.get(p, unknown) for p in pieces)
            found.append((-round(score, 9), cuts[-2::-1], pieces))
    return min(found)[2]


def test_every_cut_of_short_words(spark, table):
    random.seed(2)
    words = {"".join(random.choice("abxé▁") for _ in range(random.randrange(1, 9))) for _ in range(150)}
    df = spark.createDataFrame([(w,) for w in sorted(words)], "word string")
    found = {r["word"]: r["pieces"] for r in lattice.cut_words(df, table).collect()}
    assert found == {w: best_cut(w, dict(TABLE), -14.5) for w in words}


def test_empty_word_and_long_word(spark, table):
    df = spark.createDataFrame([("",), ("ab" * 2000,)], "word string")
    found = {r["word"]: r["pieces"] for r in lattice.cut_words(df, table).collect()}
    assert found[""] == [] and "".join(found["ab" * 2000]) == "ab" * 2000


def test_rows_keep_their_pieces(spark, table):
    rows = [(1, "ab  a", "x"), (1, "ab  a", "x"), (2, None, ""), (None, " ", "ab"), (3, "ab " * 300, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, target string")
    found = lattice.scored_pieces(df, ["source", "target"], table).collect()
    got = sorted(((r["doc_id"], r["source"], r["target"]) for r in found), key=str)
    cut = lambda w: best_cut("▁" + w, dict(TABLE), -14.5)
    ab, a, x = cut("ab"), cut("a"), cut("x")
    want = [(1, ab + a, x), (1, ab + a, x), (2, [], []), (None, [], ab), (3, ab * 300, [])]
    assert got == sorted(want, key=str)
    assert lattice.scored_pieces(df.limit(0), ["source"], table).collect() == []


def test_an_empty_table_cuts_into_characters(spark, table):
    df = spark.createDataFrame([("abé",)], "word string")
    assert lattice.cut_words(df, table.limit(0)).first()["pieces"] == ["a", "b", "é"]


def test_piece_scores(spark):
    counts = spark.createDataFrame([("▁aa", 3), ("▁b", 1)], "word string, n long")
    found = {r["word"]: (r["id"], r["n"]) for r in lattice.piece_scores(counts, 2, 4).collect()}
    assert found == {"a": (4, 6), "▁": (5, 4), "aa": (6, 3), "▁a": (7, 3)}


def test_words_are_cut_in_their_rows(spark, table):
    df = spark.createDataFrame([(1, "ab " * 50, " a  x ab")], "doc_id long, source string, target string")
    cut = lattice.scored_pieces(df, ["source", "target"], table, {"source": 3, "target": 2})
    row, ab = cut.first(), best_cut("▁ab", dict(TABLE), -14.5)
    assert row["source"] == ab * 3
    assert row["target"] == best_cut("▁a", dict(TABLE), -14.5) + best_cut("▁x", dict(TABLE), -14.5)
    plans = [cut, lattice.cut_words(df.select(F.col("source").alias("word")), table)]
    assert not any("Exchange" in p._jdf.queryExecution().executedPlan().toString() for p in plans)


def test_marked_counts(spark):
    df = spark.createDataFrame([(" a  b", "a"), (None, "b\n c ")], "source string, target string")
    found = {r["word"]: r["n"] for r in lattice.marked_counts(df, ["source", "target"]).collect()}
    assert found == {"▁a": 2, "▁b": 1, "▁b\n": 1, "▁c": 1}
    assert lattice.marked_counts(df.limit(0), ["source", "target"]).collect() == []


def test_a_piece_twice_in_its_table_is_an_error(spark, table):
    with pytest.raises(ValueError):
        lattice.cut_words(spark.createDataFrame([("a",)], "word string"), table.union(table)).collect()
