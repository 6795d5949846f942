"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: table folder; BENCH_CPUS: cores; BENCH_QUERIES: `all`, or names with commas.
Each query is built and run to the end once. Before that every query runs on the smallest
table folder next to BENCH_SF_DIR, if there is one, so that the JVM is warm.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from condensa.plans.queries import all_queries  # noqa: E402
from condensa.session import local_session  # noqa: E402

HEADLINE = [
    "tokenize_words",
    "clean_chars",
    "split_sentences",
    "sentence_corpus",
    "detokenize",
    "build_vocab",
    "encode_examples",
    "encode_turns",
    "ragged_csv_roundtrip",
    "decode_examples",
    "length_summary",
    "cutoff_report",
    "length_histogram",
    "batches",
    "rouge_1",
    "rouge_2",
    "rouge_l",
    "eval_report",
    "extractive_summary",
    "copy_distribution",
    "mixture_nll",
    "coverage_repetition",
    "bigram_transitions",
    "beam_search",
    "greedy_path",
    "subword_encode",
    "merge_pieces",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    asked = os.environ.get("BENCH_QUERIES", "")
    known = all_queries()
    names = list(known) if asked == "all" else asked.split(",") if asked else HEADLINE

    spark = local_session(cpus, "bench")
    spark.sparkContext.setLogLevel("OFF")

    def run(name: str, tables: str) -> float:
        started = time.perf_counter()
        known[name](spark, tables).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - started, 3)

    small = os.path.join(os.path.dirname(os.path.abspath(sf_dir)), "sf0.001")
    for name in names if os.path.isdir(small) else ():
        run(name, small)
    times = {name: run(name, sf_dir) for name in names}
    spark.stop()
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(found.group(1)) if found else sf_dir,
                "cpus": cpus,
            }
        )
    )


if __name__ == "__main__":
    main()
