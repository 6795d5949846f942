"""The registered queries on the smallest test tables against libraries and loops, row by row."""

import hashlib
import os
import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from condensa.llm import bpe, toxicity
from condensa.llm.queries import all_queries, toxicity_model

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def texts(spark):
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    return {r["doc_id"]: r["text"] or "" for r in rows}


def rows_of(spark, prefix):
    name = next(n for n in all_queries() if n.startswith(prefix))
    return all_queries()[name](spark, SF_DIR).collect()


def joined_sets(n, linked):
    """The smallest member of each one's component."""
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in linked:
        a, b = sorted((root(a), root(b)))
        label[b] = a
    return [root(i) for i in range(n)]


def test_op2_against_all_pairs(spark, texts):
    prints = {}
    for key, text in texts.items():
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        counts = np.zeros(64, dtype=int)
        for s in shingles:
            h = xxhash.xxh64_intdigest(s.encode(), 42)
            counts += [h >> b & 1 for b in range(64)]
        prints[key] = sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))
    ids = sorted(prints)
    near = [(i, j) for i, a in enumerate(ids) for j in range(i) if (prints[a] ^ prints[ids[j]]).bit_count() <= 4]
    label = joined_sets(len(ids), near)
    want = {k: (f"{prints[k]:016x}", ids[label[i]]) for i, k in enumerate(ids)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op2_")} == want


def test_op4_against_the_library(spark, texts):
    ranks = bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for key, text in texts.items():
        ids = own.encode_ordinary(text)
        shown = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        want[key] = (len(ids), shown, hashlib.sha256(text.encode()).hexdigest())
    found = rows_of(spark, "op4_")
    assert {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found} == want


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_op6_against_the_library(spark, texts):
    """Pieces hold the library's ids, sequences are gapless, and no fewer would do by much."""
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    pieces, places, total = {}, {}, 0
    for r in rows_of(spark, "op6_"):
        pieces.setdefault(r["doc_id"], []).append(r)
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for key, own in pieces.items():
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 0]
        own.sort(key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) == list(range(-(-len(ids) // 2048)))
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in own[1:])
        total += at
    for spans in places.values():
        ends = 0
        for offset, length in sorted(spans):
            assert offset == ends
            ends += length
        assert ends <= 2048
    assert len(places) <= 1.05 * -(-total // 2048) + 1


def test_op7_against_the_library(spark, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want, start = {}, 0
    for key in sorted(texts):
        ids = [*library.encode(texts[key], add_special_tokens=False).ids, 1]
        want[key] = (start, len(ids), crc(ids))
        start += len(ids)
    found = rows_of(spark, "op7_")
    assert {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in found} == want


def test_op8_against_the_library(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = {}
    for key, text in texts.items():
        n = len(library.encode(text, add_special_tokens=False).ids)
        want[key] = (len(text.encode()), n, n > 512)
    found = rows_of(spark, "op8_")
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in found} == want


def test_op9_against_all_pairs(spark):
    rows = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").select("vec_id", "embedding").collect()
    rows = sorted(rows, key=lambda r: r["vec_id"])
    vectors = np.array([r["embedding"] for r in rows], dtype=np.float64)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    links = (vectors @ vectors.T >= 0.9) & ~np.eye(len(rows), dtype=bool)
    found = {r["vec_id"]: r for r in rows_of(spark, "op9_")}
    assert len(found) == len(rows)
    got = sum(r["n_links"] for r in found.values())
    assert 0.9 * links.sum() <= got <= links.sum()
    for i, r in enumerate(rows):
        assert found[r["vec_id"]]["n_links"] <= links[i].sum()


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_op5_against_a_loop(spark, texts):
    """Every token against every term, then the rules of the contexts and the logistic weights."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity_model(docs, spark, SF_DIR)
    near = {}

    def term_of(token):
        bare = toxicity.core(token)
        if bare not in near:
            hits = [
                (edits(bare, t), t) for t in model.terms
                if bare and abs(len(bare) - len(t)) <= toxicity.allowed_edits(t)
            ]
            hits = [h for h in hits if h[0] <= toxicity.allowed_edits(h[1])]
            best = min(hits, default=None)
            near[bare] = None if best and best[0] and bare in model.ordinary else best
        return near[bare]

    def score(text):
        tokens = text.split()
        plain = misspelled = quoted = addressed = 0
        for at, token in enumerate(tokens):
            hit = term_of(token)
            if not hit:
                continue
            if toxicity.is_quoted(tokens, at):
                quoted += 1
                continue
            plain, misspelled = plain + (hit[0] == 0), misspelled + (hit[0] > 0)
            window = tokens[max(0, at - toxicity.WINDOW) : at + toxicity.WINDOW + 1]
            addressed += any(toxicity.core(t) in toxicity.ADDRESS for t in window)
        abuse = plain + 0.5 * misspelled
        share = 100 * abuse / len(tokens) if tokens else 0.0
        x = np.log1p([plain, misspelled, quoted, addressed, share])
        return 1 / (1 + np.exp(-(x @ model.weights[:-1] + model.weights[-1])))

    found = {r["doc_id"]: r["score"] for r in rows_of(spark, "op5_")}
    assert found == pytest.approx({k: score(t) for k, t in texts.items()}, abs=1e-9)


def test_pipeline_against_loops(spark, texts):
    """What each stage is to keep, from the stages' own measures and from all pairs of shingle sets."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    model = toxicity_model(docs, spark, SF_DIR)
    toxic = {r["doc_id"] for r in toxicity.score(docs, model).collect() if r["score"] >= 0.7}
    good = {r["doc_id"] for r in rows_of(spark, "op10_") if r["kept"]}
    left = [k for k in sorted(texts) if k not in toxic and k in good]
    sets = []
    for key in left:
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in texts[key]))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))})
    near = [
        (i, j) for i, a in enumerate(sets) for j, b in enumerate(sets[:i])
        if len(a & b) >= 0.8 * len(a | b)
    ]
    label = joined_sets(len(left), near)
    want = {k for i, k in enumerate(left) if label[i] == i}
    found = corpus_pipeline.run(spark, SF_DIR).collect()
    assert {r["doc_id"] for r in found} == want
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    sizes = {}
    for r in found:
        sizes[r["doc_id"]] = sizes.get(r["doc_id"], 0) + r["length"]
    assert sizes == {k: len(library.encode(texts[k], add_special_tokens=False).ids) + 1 for k in want}


def test_pipeline_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF_DIR)
        assert docs.collect() == []
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect() == []
