"""Periodic runs: against a loop over all periods, on odd texts, and the query on the test table."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import pytest

from condensa.llm import runs
from condensa.llm.queries import all_queries

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def loop_runs(words, least=runs.LEAST):
    """Every period by itself; of one stretch the smallest period counts."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            first = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            if i + p - first >= max(least, 2 * p):
                found.setdefault((first, i + p), p)
            i += i == first
    return sorted((s, e - s, p) for (s, e), p in found.items())


def collapsed(words, found):
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.fixture(scope="module")
def sequences():
    random.seed(3)
    found = [[], [0], [0] * 11, [0] * 12, [0] * 300, ([0] * 30 + [1]) * 9, fibonacci(400), [0, 1] * 6]
    for _ in range(150):
        kinds = random.choice([1, 2, 2, 3, 50])
        found.append([random.randrange(kinds) for _ in range(random.randrange(140))])
    for _ in range(80):
        base = [random.randrange(3) for _ in range(random.randrange(1, 40))]
        ends = [[random.randrange(9) for _ in range(random.randrange(20))] for _ in range(2)]
        found.append(ends[0] + (base * 8)[: random.randrange(1, 8 * len(base) + 1)] + ends[1])
    return found


def test_all_runs_are_found(sequences):
    for words in sequences:
        found = runs.sequence_runs(np.array(words, dtype=np.int64))
        assert [tuple(r) for r in found.tolist()] == loop_runs(words)


def test_appending_gives_the_same_at_any_step(sequences):
    random.seed(4)
    for words in sequences:
        catcher, at = runs.SquareCatcher(), 0
        while at < len(words):
            step = random.choice([1, 1, 1, 2, 5, 17])
            catcher.append(np.array(words[at : at + step]))
            at = min(len(words), at + step)
            if random.random() < 0.1:
                assert [tuple(r) for r in catcher.runs().tolist()] == loop_runs(words[:at])
        assert [tuple(r) for r in catcher.runs().tolist()] == loop_runs(words)


def test_texts_together_are_as_each_alone(sequences):
    sizes = np.array([len(w) for w in sequences])
    ids = np.concatenate([np.array(w, dtype=np.int64) for w in sequences])
    found = [tuple(r) for r in runs.text_runs(ids, sizes).tolist()]
    assert found == [(i, *r) for i, w in enumerate(sequences) for r in loop_runs(w)]


def test_names_that_lie_are_noticed(monkeypatch):
    """With names that take all windows for equal the stretches do not hold."""
    monkeypatch.setattr(runs.SquareCatcher, "_name", lambda self, start, size: np.zeros(len(start)))
    monkeypatch.setattr(runs.SquareCatcher, "_windows", lambda self, a, b, size: np.zeros(b - a))
    catcher = runs.SquareCatcher()
    catcher.append(np.arange(40))
    assert not catcher.holds()


def test_long_periodic_text():
    """Work in proportion to the words, not to the pairs of equal ones."""
    found = runs.sequence_runs(np.zeros(300_000, dtype=np.int64))
    assert found.tolist() == [[0, 300_000, 1]]


ODD = [
    (1, "a b " * 8),
    (1, "a b " * 8),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b "),
    (None, "x\ty\n" * 9 + "z"),
    (5, "é b " * 13),
    (6, " ".join(f"w{i % 20_011}" for i in range(50_000))),
    (7, "one two three"),
    (8, "a\x1cb " * 12),
]


def test_odd_rows(spark):
    schema = "doc_id long, text string, runs int, collapsed string, _text string"
    docs = spark.createDataFrame([(k, t, 1, "c", "t") for k, t in ODD], schema)
    rows = runs.find_runs(docs).collect()
    got = sorted(
        ((r["doc_id"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in rows), key=str
    )
    want = []
    for key, text in ODD:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        found = [(0, 50_000, 20_011)] if key == 6 else loop_runs(words)
        want.append((key, found, collapsed(words, found)))
    assert got == sorted(want, key=str)
    assert runs.find_runs(docs.limit(0)).collect() == []


def brute(key, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h, n = zlib.crc32(str(key).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = loop_runs(words)
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    listed = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    return (
        key, len(found), *best, 1000 * best[1] // best[2] if found else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(collapsed(words, found).encode()).hexdigest(),
    )


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_on_the_table(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    rows = all_queries()["op11_periodic_runs"](spark, SF_DIR).collect()
    assert sorted(map(tuple, rows)) == sorted(brute(r["doc_id"], r["text"]) for r in docs)
    assert sum(r["n_runs"] > 0 for r in rows) > 10
