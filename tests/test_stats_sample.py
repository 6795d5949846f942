import random

import pytest
from pyspark.sql import functions as F

from condensa.operators.skew import heaviest
from condensa.operators import sample, sketch, stats


def counts(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v int")
    return stats.value_counts(df, F.col("v"))


def test_five_numbers(spark):
    row = stats.five_numbers(counts(spark, range(1, 11))).first()
    assert tuple(row) == (1, 3.25, 5.5, 7.75, 10, 10)


def test_outliers(spark):
    row = stats.length_summary(counts(spark, [1, 2, 3, 4, 100, -90])).first()
    assert row["outliers"] == 2


def test_cutoff_bands_are_open(spark):
    row = stats.cutoff_report(counts(spark, [12, 15, 16, 20, 25, 100]), 10).first().asDict()
    sixth = pytest.approx(1 / 6)
    assert row == {
        "share_over": 1.0,
        "share_0_5": sixth,
        "share_5_10": sixth,
        "share_10_20": sixth,
        "share_20_40": 0.0,
        "share_40_80": 0.0,
        "share_over_80": sixth,
    }


def test_histogram_closes_the_last_bin(spark):
    rows = stats.histogram(counts(spark, [0, 1, 9, 10, 10]), bins=10).orderBy("bin").collect()
    assert [(r["bin"], r["n"]) for r in rows if r["n"]] == [(0, 1), (1, 1), (9, 3)]
    assert [r["bin"] for r in rows] == list(range(10))
    assert rows[-1]["high"] == pytest.approx(10)


def test_histogram_of_one_value(spark):
    rows = stats.histogram(counts(spark, [5, 5])).collect()
    assert [(r["bin"], r["n"], r["shown"]) for r in rows if r["n"]] == [(0, 2, True)]
    assert len(rows) == 100 and stats.histogram(counts(spark, [])).collect() == []


def test_report_without_cutoff_has_no_shares(spark):
    data = counts(spark, [1, 2, 3, 4])
    assert "share_over" not in stats.distribution_report(data).columns
    row = stats.distribution_report(data, 3).first()
    assert (row["min_value"], row["max_value"], row["share_over"]) == (1, 4, 0.25)


def test_excess(spark):
    rows = stats.excess_counts(counts(spark, [1, 12, 12, 10]), 10).collect()
    assert [tuple(r) for r in rows] == [(2, 2)]


def keyed(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "k long").repartition(7)


def test_ordered_index_with_gaps_and_clusters(spark):
    rng = random.Random(5)
    keys = list({rng.randrange(100) ** 3 for _ in range(60)} | set(range(10**9, 10**9 + 500)))
    rng.shuffle(keys)
    got = {r["k"]: r["idx"] for r in sample.ordered_index(keyed(spark, keys), "k").collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}


def test_batches(spark):
    got = sample.batches(keyed(spark, range(10, 20)), "k", 4).orderBy("k").collect()
    assert [(r["batch_id"], r["row_in_batch"]) for r in got] == [
        (i // 4, i % 4) for i in range(10)
    ]


def test_kth_key(spark):
    keys = [i * i - 500 for i in range(400)]
    df = keyed(spark, keys)
    assert [sample.kth_key(df, "k", k) for k in (1, 57, 400)] == [keys[0], keys[56], keys[399]]
    assert sample.kth_key(df, "k", 401) is None
    assert sample.kth_key(keyed(spark, [4] * 10), "k", 7) == 4


def test_string_keys(spark):
    keys = [f"{i}:{i % 7}" for i in range(300)]
    df = spark.createDataFrame([(k,) for k in keys], "k string").repartition(5)
    got = {r["k"]: (r["batch_id"], r["row_in_batch"]) for r in sample.batches(df, "k", 16).collect()}
    assert got == {k: divmod(i, 16) for i, k in enumerate(sorted(keys))}
    assert sorted(r[0] for r in sample.head_fraction(df, "k", 0.1).collect()) == sorted(keys)[:30]


def test_head_fraction_rounds_up(spark):
    df = keyed(spark, range(10))
    assert sorted(r[0] for r in sample.head_fraction(df, "k", 0.25).collect()) == [0, 1, 2]
    assert sample.head_fraction(df, "k").count() == 10
    assert sample.head_fraction(df, "k", 0.0).count() == 0


def test_evaluated_rows_check_sizes(spark):
    df = keyed(spark, range(10))
    assert sorted(r[0] for r in sample.evaluated_rows(df, "k", 3, 3, 8).collect()) == list(range(9))
    with pytest.raises(ValueError):
        sample.evaluated_rows(df, "k", 5, 2, 3)
    with pytest.raises(ValueError):
        sample.evaluated_rows(df, "k", 3, 3, 9)


def test_random_sample_repeats_and_can_draw_every_row(spark):
    df = keyed(spark, range(30))
    draw = lambda seed, d=df: {r[0] for r in sample.random_sample(d, "k", 10, seed).collect()}
    assert draw(1) == draw(1, df.repartition(3)) != draw(2)
    assert set().union(*[draw(s) for s in range(25)]) == set(range(30))


@pytest.mark.parametrize("n", [1, 2, 5, 16, 17, 1000])
def test_an_epoch_is_a_permutation(spark, n):
    rows = spark.range(n).select("id", *[sample.permuted(F.col("id"), n, 7, e).alias(f"e{e}") for e in range(4)])
    columns = list(zip(*[r[1:] for r in rows.collect()]))
    assert all(sorted(c) == list(range(n)) for c in columns)
    if n == 1000:
        assert len(set(columns)) == 4
        assert all(sum(a == b for a, b in zip(c, range(n))) < 20 for c in columns)


def test_epoch_batches(spark):
    df = spark.createDataFrame([(f"k{i:03d}",) for i in range(100)], "k string").repartition(5)
    first, again, other = (
        {r["k"]: (r["batch_id"], r["row_in_batch"]) for r in sample.epoch_batches(d, "k", 16, 3, e).collect()}
        for d, e in ((df, 0), (df.repartition(3), 0), (df, 1))
    )
    assert first == again != other
    assert sorted(first.values()) == [divmod(i, 16) for i in range(100)]
    assert sample.epoch_batches(df.limit(0), "k", 16, 3, 0).collect() == []


def test_derived_rows_are_computed_once_for_a_head(spark):
    """Counting, ordering and cutting read written keys; only the cut itself computes the rows again."""
    computed = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            computed.add(len(f))
            yield f

    derived = keyed(spark, range(200)).mapInPandas(seen, "k long")
    kept = sample.evaluated_rows(derived, "k", 10, 5, 3)
    assert computed.value == 200
    assert kept.count() == 50 and computed.value <= 400


def test_top_words_compute_their_counts_once(spark):
    computed = spark.sparkContext.accumulator(0)

    def seen(frames):
        for f in frames:
            computed.add(len(f))
            yield f

    rows = spark.createDataFrame([(f"w{i}", i % 50) for i in range(500)], "k string, n long")
    found = heaviest(rows.mapInPandas(seen, "k string, n long"), "n", "k", 12).collect()
    assert computed.value == 500
    want = sorted(((f"w{i}", i % 50) for i in range(500)), key=lambda r: (-r[1], r[0]))[:12]
    assert [(r["k"], r["n"], r["idx"]) for r in sorted(found, key=lambda r: r["idx"])] == [(*w, i) for i, w in enumerate(want)]


def test_sketches_of_added_files(spark, tmp_path):
    """Only new files are read, merging is as good as one sketch, and quartiles are within the bound."""
    folder, store = str(tmp_path / "in"), str(tmp_path / "sketches")
    value = F.col("v")
    rng = random.Random(2)
    values = [int(rng.lognormvariate(5, 1)) for _ in range(30_000)]
    names = []
    for part in range(3):
        own = [(v,) for v in values[part::3]]
        spark.createDataFrame(own, "v int").repartition(2).write.mode("append").parquet(folder)
        names.append(sketch.add_files(spark, folder, store, value))
    assert [len(n) for n in names] == [2, 2, 2] and len(set(sum(names, []))) == 6
    assert sketch.add_files(spark, folder, store, value) == []
    summary = sketch.merged_summary(sketch.read_store(spark, store))
    row = summary.first()
    assert (row["n"], row["min_value"], row["max_value"]) == (30_000, min(values), max(values))
    ordered = sorted(values)
    for i in (1, 2, 3):
        below = sum(v < row[f"q{i}"] for v in ordered) / 30_000
        upto = sum(v <= row[f"q{i}"] for v in ordered) / 30_000
        assert below - sketch.RANK_ERROR <= 0.25 * i <= upto + sketch.RANK_ERROR
    errors = sketch.rank_errors(summary, stats.value_counts(spark.createDataFrame([(v,) for v in values], "v int"), value))
    assert all(errors.first()[f"error_{i}"] <= sketch.RANK_ERROR for i in (1, 2, 3))


def test_no_sketches(spark, tmp_path):
    empty = sketch.read_store(spark, str(tmp_path / "none"))
    assert tuple(sketch.merged_summary(empty).first()) == (None,) * 6
    nulls = spark.createDataFrame([("a", None), ("b", 3)], "f string, v int")
    row = sketch.merged_summary(sketch.sketch_rows(nulls, "f", F.col("v"))).first()
    assert tuple(row) == (1, 3, 3, 3, 3, 3)
