"""The registered queries of the package against their SQL, their contracts and the pipeline."""

import os
import random

import corpus_pipeline
import pytest
from oracle_check import differences

from condensa.llm.oracles import all_oracles
from condensa.llm.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")

COLUMNS = {
    "op1_": {"doc_id", "held_out", "score", "predicted"},
    "op2_": {"doc_id", "fingerprint", "component_id"},
    "op4_": {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    "op5_": {"doc_id", "held_out", "score", "predicted"},
    "op6_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
    "op7_": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op8_": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op9_": {"vec_id", "n_links", "component_id", "kept"},
}


@pytest.mark.parametrize("name", sorted(all_oracles()))
def test_equals_sql(spark, name):
    assert differences(all_queries()[name](spark, SF_DIR), all_oracles()[name], SF_DIR) == []


@pytest.mark.parametrize("prefix", sorted(COLUMNS))
def test_one_row_for_each_of_the_table(spark, prefix):
    name = next(n for n in all_queries() if n.startswith(prefix))
    found = all_queries()[name](spark, SF_DIR)
    assert COLUMNS[prefix] <= set(found.columns)
    table, key = ("embeddings", "vec_id") if prefix == "op9_" else ("documents", "doc_id")
    every = spark.read.parquet(f"{SF_DIR}/{table}.parquet").count()
    rows = found.collect()
    first = [r for r in rows if prefix != "op6_" or r["piece"] == 0]
    assert len(first) == len({r[key] for r in first}) == every


def test_scores_of_held_out_documents(spark):
    """At sf0.01, documents that the classifiers have not learned from."""
    folder = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    for prefix, label, least in (("op1_", "quality", 0.95), ("op5_", "toxic", 0.9)):
        name = next(n for n in all_queries() if n.startswith(prefix))
        rows = all_queries()[name](spark, folder).collect()
        held = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
        right = sum(r["predicted"] == labels[r["doc_id"]][label] for r in held)
        assert right >= least * len(held)


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "quality rules", "SimHash near-dedup", "best-fit packing",
    ]
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, left, SF_DIR).cache()
        assert after.columns == docs.columns
        assert {r["doc_id"] for r in after.collect()} <= {r["doc_id"] for r in left.collect()}
        left = after
    packed = corpus_pipeline.STAGES[-1][1](spark, left, SF_DIR).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in left.collect()}
    whole = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {(r["doc_id"], r["piece"]) for r in whole} == {(r["doc_id"], r["piece"]) for r in packed}


def _jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.lower().split(), b.lower().split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_pipeline_drops_planted_near_copies(spark):
    """Pairs of Jaccard 0.8 to 0.95 lose the copy, those below 0.8 and unlike texts stay."""
    random.seed(11)
    rows, copies, others = [], [], []
    for i in range(300):
        words = [f"w{random.randrange(5000)}" for _ in range(random.randint(80, 400))]
        changed = list(words)
        for at in random.sample(range(len(words)), max(1, round(len(words) * random.uniform(0.003, 0.04)))):
            changed[at] = f"x{random.randrange(5000)}"
        pair = " ".join(words), " ".join(changed)
        rows += [(2 * i, pair[0]), (2 * i + 1, pair[1])]
        near = _jaccard(*pair)
        if near <= 0.95:
            (copies if near >= 0.8 else others).append(2 * i + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SF_DIR).collect()}
    assert len(copies) > 100 and len(others) > 30
    assert kept >= {2 * i for i in range(300)} | set(others)
    assert len(kept & set(copies)) <= 0.03 * len(copies)


def test_toxicity_stage_keeps_clean_documents(spark):
    folder = os.path.join(os.path.dirname(SF_DIR), "sf0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    labels = spark.read.parquet(f"{folder}/labels.parquet").collect()
    toxic = [r["doc_id"] in kept for r in labels if r["toxic"] == 1]
    clean = [r["doc_id"] in kept for r in labels if r["toxic"] == 0]
    assert sum(toxic) <= 0.35 * len(toxic) and sum(clean) >= 0.98 * len(clean)
