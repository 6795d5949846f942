"""The evaluation job: decode, score, average, sample."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from condensa.operators.decode import decode_words
from condensa.operators.rouge import all_scores, averages
from condensa.operators.sample import evaluated_rows, random_sample
from condensa.operators.skew import broadcast_if_small
from condensa.session import materialize


@dataclass
class Evaluation:
    averages: DataFrame
    samples: DataFrame


def _split(text: str) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda t: t != "")


def evaluate(
    examples: DataFrame,
    predictions: DataFrame,
    vocab: DataFrame,
    vocab_size: int,
    samples: int,
    seed: int,
    key: str = "doc_id",
    batch_size: int | None = None,
    total_batches: int | None = None,
    lookup: str = "auto",
) -> Evaluation:
    """Score `predictions` against the decoded targets of `examples`; keys are unique on both sides.

    Predictions are `key, pred_summary`, texts of space-separated tokens as decoding gives them, or
    `key, pred_ids`, id arrays that are decoded with the dictionary of their own example. An example
    without a prediction counts as one that predicts nothing, and scores 0. A prediction without an
    example is not evaluated.

    With `batch_size` and `total_batches` only the first batches are evaluated, otherwise all
    examples. `averages` has one row per metric; `samples` holds the drawn
    `key, text, ref_summary, pred_summary`.
    """
    if batch_size and total_batches:
        examples = evaluated_rows(examples, key, batch_size, total_batches, samples)
    columns, keep = {"x": "text", "y": "ref_summary"}, ()
    given = "pred_ids" if "pred_ids" in predictions.columns else "pred_summary"
    paired = examples.join(predictions.select(key, given), key, "left")
    if given == "pred_ids":
        columns |= {"pred_ids": "pred_summary"}
    else:
        keep = ("pred_summary",)
    texts = decode_words(
        paired,
        vocab,
        vocab_size,
        columns,
        key,
        remove_paddings=True,
        remove_eos=True,
        lookup=lookup,
        keep=keep,
    )
    # the scores and the samples read the pairs: write them once
    texts = texts.withColumn("pred_summary", F.coalesce("pred_summary", F.lit("")))
    judged = materialize(texts, "evaluated")
    pairs = judged.select(
        key, _split("pred_summary").alias("pred"), _split("ref_summary").alias("ref")
    )
    drawn = random_sample(judged, key, samples, seed)
    kept = judged.join(broadcast_if_small(drawn), key, "left_semi")
    return Evaluation(
        averages(all_scores(pairs, key)), kept.select(key, "text", "ref_summary", "pred_summary")
    )
