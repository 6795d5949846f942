"""Class bigrams: gains and scores against loops, probabilities that sum up to 1, odd rows, the query."""

import math
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from condensa.llm import brown
from condensa.llm.queries import all_queries
from condensa.session import materialize

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def tokens(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in found] + [None]


def base_of(texts, learned):
    """n_tokens, n_known, train_tokens, base_score of each text."""
    count = Counter(w for t, own in zip(texts, learned) if own for w in tokens(t))
    n, v = sum(count.values()), len(count)
    found = []
    for text in texts:
        own = tokens(text)
        score = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)
        found.append((len(own), sum(count[w] > 0 for w in own), n, score))
    return found


def test_gains_are_the_change_of_the_likelihood():
    rng = np.random.default_rng(5)
    units, k = 12, 5
    pairs = rng.integers(0, 4, (units, units)) * rng.integers(0, 2, (units, units))
    classes = rng.integers(0, k - 1, units)
    classes[-1] = k - 1

    def table(own):
        found = np.zeros((k, k), dtype=np.int64)
        np.add.at(found, (own[:, None], own[None, :]), pairs)
        return found

    for unit in range(units - 1):
        others = np.arange(units) != unit
        after = np.bincount(classes[others], pairs[unit][others], k).astype(np.int64)
        before = np.bincount(classes[others], pairs[:, unit][others], k).astype(np.int64)
        gains = brown.move_gains(table(classes), classes[unit], after, before, int(pairs[unit, unit]))
        for target in range(k - 1):
            moved = classes.copy()
            moved[unit] = target
            change = brown.likelihood(table(moved)) - brown.likelihood(table(classes))
            assert gains[target] == pytest.approx(change, abs=1e-9)
        assert gains[k - 1] == -np.inf


def _grammar(n, seed):
    """Texts of two invented languages, so that classes of words exist to be found."""
    random.seed(seed)
    kinds = [[f"{language}{kind}{i}" for i in range(40)] for language in "pq" for kind in "nva"]
    found = []
    for _ in range(n):
        at = 3 * random.randrange(2)
        words = [random.choice(kinds[at + j % 3]) for j in range(random.randrange(0, 40))]
        found.append(" ".join(words))
    return found


@pytest.fixture(scope="module")
def small(spark):
    texts = _grammar(300, 1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return texts, docs, F.col("doc_id") % 5 != 0


def _parts(docs, learn, heads=240, endings=16, classes=8, rounds=12):
    packets = 8
    batches = materialize(brown._batches(docs, "doc_id", "text", learn, packets))
    counts = brown._word_counts(batches, packets)
    return brown._model(batches, counts, packets, heads, endings, classes, rounds)


def test_model(small):
    """The likelihood rises, shares sum up to 1, and scores are those of a loop."""
    texts, docs, learn = small
    model = _parts(docs, learn)
    assert list(model.course) == sorted(set(model.course)) and len(model.course) > 3
    count = Counter(w for i, t in enumerate(texts) if i % 5 for w in tokens(t)[:-1])
    unit = {w: model.units.of(brown.pa.array([w]))[0] for t in texts for w in tokens(t)[:-1]}
    own = {w: int(model.classes[u]) for w, u in unit.items()}
    k = len(model.steps)

    def emitted(word):
        c = own[word]
        if not count[word]:
            return model.unseen[c]
        return math.log10((count[word] - model.discounts[c]) / model.sizes[c])

    assert np.allclose((10.0**model.steps).sum(1), 1)
    within = np.zeros(k)
    for word in count:
        within[own[word]] += 10 ** emitted(word)
    assert np.allclose((within + 10.0**model.unseen)[:-1], 1)
    assert within[-1] == 0 and model.sizes[-1] == 0
    found = brown.class_scores(docs, learn, heads=240, endings=16, classes=8, rounds=12).collect()
    for row in found:
        score, last = 0.0, k - 1
        for word in tokens(texts[row["doc_id"]]):
            here = k - 1 if word is None else own[word]
            score += model.steps[last, here] + (0 if word is None else emitted(word))
            last = here
        assert row["score"] == pytest.approx(score, abs=1e-6)
    held = [r for r in found if r["doc_id"] % 5 == 0]
    gain = sum(r["score"] - r["base_score"] for r in held) / sum(r["n_tokens"] for r in held)
    assert gain > 0.5  # each token is over three times as likely


def test_classes_are_found(small):
    """Words of one kind and language come to lie in few classes, and no class mixes the languages."""
    texts, docs, learn = small
    model = _parts(docs, learn)
    classes = {}
    for number, word in enumerate(model.units.heads):
        classes.setdefault(int(model.classes[number]), Counter())[word[0]] += 1
    mixed = sum(min(c["p"], c["q"]) for c in classes.values())
    assert mixed <= 0.1 * len(model.units.heads)


LONG = " ".join(f"Word{i % 977} the" for i in range(60_000))
ODD = [
    (1, "A b c a B"), (1, "A b c a B"), (2, None), (3, ""), (4, LONG), (None, "a É é"), (5, " \t\n"), (6, "a\x1cb z"),
]


@pytest.mark.parametrize("learn", ["doc_id <> 1", "doc_id = 3", "true", "false"])
def test_odd_rows(spark, learn):
    schema = "doc_id long, text string, batch int, words int, score string"
    docs = spark.createDataFrame([(k, t, 1, 2, "s") for k, t in ODD], schema)
    rows = brown.class_scores(docs, F.expr(learn), classes=4, rounds=2).collect()
    keep = {"doc_id <> 1": lambda k: k not in (None, 1), "doc_id = 3": lambda k: k == 3}
    learned = [keep.get(learn, lambda k: learn == "true")(k) for k, _ in ODD]
    want = [(k, *row) for (k, _), row in zip(ODD, base_of([t for _, t in ODD], learned))]
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in rows]
    order = lambda r: (str(r[0]), r[1])
    for a, b in zip(sorted(got, key=order), sorted(want, key=order), strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9)
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in rows)
    assert brown.class_scores(docs.limit(0), F.expr(learn)).collect() == []


def test_small_batches_give_the_same(spark, small, monkeypatch):
    texts, docs, learn = small
    whole = {r[0]: tuple(r) for r in brown.class_scores(docs, learn, heads=50, rounds=1).collect()}
    monkeypatch.setattr(brown, "BATCH_BYTES", 700)
    for row in brown.class_scores(docs, learn, heads=50, rounds=1).collect():
        assert tuple(row) == pytest.approx(whole[row[0]], rel=1e-9)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    held = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0 for r in docs}
    want = base_of([r["text"] for r in docs], [not held[r["doc_id"]] for r in docs])
    rows = {r["doc_id"]: r for r in all_queries()["op13_brown_scores"](spark, SF_DIR).collect()}
    assert len(rows) == len(docs)
    for doc, (n, known, train, base) in zip(docs, want):
        row = rows[doc["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n, known, train)
        assert row["held_out"] == held[doc["doc_id"]]
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
    assert sum(r["score"] - r["base_score"] for r in rows.values() if r["held_out"]) > 0
