import pytest

from condensa.operators.encode import encode_examples
from condensa.operators.vocab import vocab_from_mapping
from condensa.plans.evaluate import evaluate

VOCAB = {"a": 4, "b": 5, ".": 6}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, f"a b w{i} .", f"w{i} b" if i % 2 else "a zz") for i in range(10)]
    pairs = spark.createDataFrame(rows, "doc_id long, source string, target string")
    vocab = vocab_from_mapping(spark, VOCAB)
    predictions = [(i, f"w{i} b" if i % 2 else "b") for i in range(10)]
    return (
        encode_examples(pairs, vocab, 7, 6, 4, 3),
        spark.createDataFrame(predictions, "doc_id long, pred_summary string"),
        vocab,
    )


def test_all_examples(tables):
    result = evaluate(*tables, 7, samples=4, seed=1)
    scores = {r["metric"]: (r["r"], r["p"], r["f"]) for r in result.averages.collect()}
    # odd examples are predicted exactly, even ones share nothing
    assert scores == {m: (0.5, 0.5, 0.5) for m in ("rouge-1", "rouge-2", "rouge-l")}
    drawn = {r["doc_id"]: r for r in result.samples.collect()}
    assert len(drawn) == 4
    for i, row in drawn.items():
        assert row["text"] == f"a b w{i} ."
        assert row["ref_summary"] == (f"w{i} b" if i % 2 else "a <unk>")


def test_first_batches_only(tables):
    result = evaluate(*tables, 7, samples=2, seed=1, batch_size=3, total_batches=1)
    row = result.averages.where("metric = 'rouge-1'").first()
    assert row["f"] == pytest.approx(1 / 3)
    assert {r["doc_id"] for r in result.samples.collect()} <= {0, 1, 2}
    with pytest.raises(ValueError):
        evaluate(*tables, 7, samples=2, seed=1, batch_size=5, total_batches=2)


def test_missing_predictions_score_0_and_ids_are_decoded(tables):
    examples, predictions, vocab = tables
    some = predictions.where("doc_id <> 1")
    result = evaluate(examples, some, vocab, 7, samples=20, seed=1)
    rows = {r["doc_id"]: r for r in result.samples.collect()}
    assert len(rows) == 10 and rows[1]["pred_summary"] == ""
    assert result.averages.where("metric = 'rouge-1'").first()["f"] == pytest.approx(0.4)
    ids = examples.selectExpr("doc_id", "y AS pred_ids")
    for lookup in ("inline", "join"):
        own = evaluate(examples, ids, vocab, 7, samples=20, seed=1, lookup=lookup)
        assert {r["f"] for r in own.averages.collect()} == {1.0}
