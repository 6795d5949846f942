import random

import pytest
from pyspark.sql import functions as F

from condensa.operators import rouge, summarize


def pairs(spark, rows):
    data = [(i, a, b) for i, (a, b) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, pred array<string>, ref array<string>")


def by_id(df):
    return {r["doc_id"]: (r["r"], r["p"], r["f"]) for r in df.collect()}


def test_rouge_1_example(spark):
    got = by_id(rouge.rouge_n(pairs(spark, [(list("abc"), list("acde"))]), 1))
    assert got[0] == pytest.approx((0.5, 2 / 3, 4 / 7))


def test_counting(spark):
    df = pairs(spark, [(list("aaab"), list("aab"))])
    assert by_id(rouge.rouge_n(df, 1))[0][:2] == pytest.approx((1.0, 3 / 4))
    assert by_id(rouge.rouge_n(df, 1, counting="set"))[0] == pytest.approx((1.0, 1.0, 1.0))
    with pytest.raises(ValueError):
        rouge.rouge_n(df, 1, counting="other")


def test_empty_sides_and_identity(spark):
    df = pairs(spark, [([], list("ab")), (list("ab"), []), ([], []), (list("xyz"), list("xyz"))])
    for scored in (rouge.rouge_n(df, 1), rouge.rouge_n(df, 2), rouge.rouge_l(df)):
        got = by_id(scored)
        assert [got[i] for i in range(3)] == [(0.0, 0.0, 0.0)] * 3
        assert got[3] == (1.0, 1.0, 1.0)


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        old = row
        row = [0]
        for j, y in enumerate(b):
            row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
    return row[-1]


def lengths(spark, rows):
    found = pairs(spark, rows).select("doc_id", rouge.lcs_length(F.col("pred"), F.col("ref")).alias("n"))
    return [r["n"] for r in sorted(found.collect())]


def test_lcs_example(spark):
    assert lengths(spark, [(list("abcbdab"), list("bdcaba"))]) == [4]


def test_lcs_equals_table_on_random_sequences(spark):
    rng = random.Random(2)
    rows = [tuple(rng.choices("abcde", k=rng.randrange(60)) for _ in range(2)) for _ in range(200)]
    assert lengths(spark, rows) == [plain_lcs(a, b) for a, b in rows]


def test_lcs_reads_whole_long_sequences(spark):
    a = [str(i % 50) for i in range(1000)]
    df = pairs(spark, [(a, a[500:] + ["new"] * 250)])
    assert by_id(rouge.rouge_l(df))[0][0] == pytest.approx(500 / 750)


def test_null_sides_and_equal_keys(spark):
    rows = [(1, None, ["a"]), (1, ["a"], None), (2, ["a", "b"], ["a"]), (2, ["c"], ["a"])]
    df = spark.createDataFrame(rows, "doc_id long, pred array<string>, ref array<string>")
    for scored in (rouge.rouge_n(df, 1), rouge.rouge_l(df)):
        got = sorted((r["doc_id"], r["r"], r["p"]) for r in scored.collect())
        assert got == [(1, 0.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0), (2, 1.0, 0.5)]
    assert rouge.all_scores(df).count() == 4


def test_rouge_l_ids_stop_at_eos(spark):
    df = spark.createDataFrame(
        [(1, [5, 6, 2, 7, 0], [5, 6, 7, 2])], "doc_id long, pred array<int>, ref array<int>"
    )
    assert by_id(rouge.rouge_l_ids(df))[1] == pytest.approx((2 / 3, 1.0, 0.8))


def test_average(spark):
    df = pairs(spark, [(list("ab"), list("ab")), (list("x"), list("y"))])
    got = {tuple(r) for r in rouge.averages(rouge.all_scores(df)).collect()}
    assert got == {("rouge-1", 0.5, 0.5, 0.5), ("rouge-2", 0.5, 0.5, 0.5), ("rouge-l", 0.5, 0.5, 0.5)}


DOCS = [
    (1, "Common words here. Rare zebra quux. Common words."),
    (2, "Common words. Words here."),
    (3, ""),
]


def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string")


def test_lead(spark):
    got = dict(summarize.lead_k(docs(spark), 2).collect())
    assert got == {1: "Common words here. Rare zebra quux.", 2: "Common words. Words here.", 3: ""}


def test_extractive_prefers_rare_words_and_keeps_order(spark):
    got = dict(summarize.extractive_summary(docs(spark), 1).collect())
    assert got[1] == "Rare zebra quux."
    assert got[3] == ""
    late = [(1, "Common words. Here words. Rare zebra quux."), (2, "Common words."), (3, "Here. Common.")]
    df = spark.createDataFrame(late, "doc_id long, text string")
    scores = {r["pos"]: r["score"] for r in summarize.sentence_scores(df).where("doc_id = 1").collect()}
    assert scores[2] > scores[1] > scores[0] >= 0
    got = dict(summarize.extractive_summary(df, 2).collect())
    assert got[1] == "Here words. Rare zebra quux."


def test_sentence_scores_match_the_definition(spark):
    import math

    got = {(r["doc_id"], r["pos"]): r["score"] for r in summarize.sentence_scores(docs(spark)).collect()}
    idf = lambda df: math.log(3 / df)
    first = (2 + 2 + 1 + 3) * idf(2) / 4
    assert got[(1, 0)] == pytest.approx(first)
    assert got[(3, 0)] == 0.0
    assert len(got) == 6


def test_rouge_needs_no_shuffle_and_no_python(spark):
    df = pairs(spark, [(list("ab"), list("ab"))])
    for scored in (rouge.rouge_n(df, 2), rouge.rouge_l(df), rouge.all_scores(df)):
        plan = scored._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Python" not in plan


def test_scores_are_between_0_and_1(spark):
    rng = random.Random(4)
    rows = [(rng.choices("abcd", k=rng.randrange(9)), rng.choices("abcd", k=rng.randrange(9))) for _ in range(100)]
    df = pairs(spark, rows)
    for scored in (rouge.rouge_n(df, 1), rouge.rouge_l(df)):
        bounds = scored.agg(F.min(F.least("r", "p", "f")), F.max(F.greatest("r", "p", "f"))).first()
        assert 0 <= bounds[0] and bounds[1] <= 1
        assert scored.count() == 100


def test_tasks_of_the_summary_grow_in_number_with_the_input(spark, monkeypatch, tmp_path):
    rows = [(i, f"One word {i}. Two words {i}. Three.") for i in range(400)]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert summarize._by_key(docs, "doc_id").rdd.getNumPartitions() == usual
    before = {r["doc_id"]: r["summary"] for r in summarize.extractive_summary(docs, 2).collect()}
    monkeypatch.setattr(summarize, "TASK_BYTES", 100)
    assert summarize._by_key(docs, "doc_id").rdd.getNumPartitions() > 2 * usual
    assert {r["doc_id"]: r["summary"] for r in summarize.extractive_summary(docs, 2).collect()} == before
