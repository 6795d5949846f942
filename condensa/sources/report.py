"""The evaluation report: `[scores, config, sampled triples...]` as one JSON list."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Samples, at most, that one report lists.
MAX_SAMPLES = 10_000


def report_line(averages: DataFrame, samples: DataFrame, config: dict, key: str) -> DataFrame:
    """One row `value` holding the JSON list.

    `averages` has one row per metric; `samples` (`key, text, ref_summary, pred_summary`) is put in key
    order. The list is one value, so more than `MAX_SAMPLES` samples are an error, told before they are
    collected.
    """
    if samples.limit(MAX_SAMPLES + 1).count() > MAX_SAMPLES:
        raise ValueError(f"a report holds {MAX_SAMPLES} samples at most")
    entry = F.struct("metric", F.struct("r", "p", "f").alias("s"))
    scores = averages.agg(
        F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("scores")
    )
    triple = F.to_json(F.struct("text", "ref_summary", "pred_summary"))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), triple.alias("j"))))
    triples = samples.agg(F.transform(ordered, lambda t: t["j"])).scalar()
    parts = F.concat(F.array("scores", F.lit(json.dumps(config))), triples)
    line = scores.select(F.array_join(parts, ", ").alias("body"))
    return line.select(F.concat(F.lit("["), "body", F.lit("]")).alias("value"))


def write_report(
    averages: DataFrame, samples: DataFrame, config: dict, path: str, key: str = "doc_id"
) -> None:
    report_line(averages, samples, config, key).coalesce(1).write.text(path)


def read_report(spark: SparkSession, path: str) -> list:
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])
