"""Conversation repair: against a search over whole audits, on odd rows, and the query on the test table."""

import hashlib
import itertools
import os
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from condensa.llm import repair
from condensa.llm.queries import all_queries, damaged_turns

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
GRAMMAR = re.compile(r"(s?(ua)+)?")
WHITE = re.compile(r"[^\x20\x09-\x0D]")
sys.setrecursionlimit(20_000)


def faults_of(rows):
    """`blank`, `duplicate`, `truncated` or None of each (role, text)."""
    found, seen = [], set()
    for role, text in rows:
        marks = WHITE.findall(text)
        if not marks:
            found.append("blank")
        elif (role, text) in seen:
            found.append("duplicate")
        else:
            found.append(None if marks[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return found


def best_audit(rows):
    """The least (cost, audit) and its rows, by trying every edit behind every prefix of roles.

    Only what the grammar needs to know of the rows so far is kept: the last initial, or none.
    """
    faults = faults_of(rows)

    @lru_cache(maxsize=None)
    def rest(i, last, inserted):
        options = []
        if i == len(rows) and last in ("", "a"):
            options.append((0, "", ()))
        after = {"": ("s", "u"), "s": ("u",), "u": ("a",), "a": ("u",)}[last]
        names = {"u": "user", "a": "assistant"}
        if inserted < 3:
            for r in after:
                if r in names:
                    c, a, out = rest(i, r, inserted + 1)
                    options.append((c + 2, "I" + a, ((names[r], ""), *out)))
        if i < len(rows):
            role, text = rows[i]
            c, a, out = rest(i + 1, last, 0)
            options.append((c + 3, "D" + a, out))
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                for r in after:
                    if role[:1] == r:
                        c, a, out = rest(i + 1, r, 0)
                        options.append((c + more, "K" + a, ((role, text), *out)))
                    if r in names:
                        c, a, out = rest(i + 1, r, 0)
                        options.append((c + more + 2, "R" + a, ((names[r], text), *out)))
        return min(options, default=(10**9, "~", ()))

    return rest(0, "", 0)


def summary(rows):
    """`conversations` of one conversation, from (turn, role, text) in order."""
    faults = faults_of([(r, t) for _, r, t in rows])
    turns = [n for n, _, _ in rows if n is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    initials = [r[:1] for _, r, _ in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    cost, audit, out = best_audit(tuple((r, t) for _, r, t in rows))
    assert GRAMMAR.fullmatch("".join(r[0] for r, _ in out))
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
    return (gaps, *counts, illegal, cost, audit, digest)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))


def found_rows(spark, table, schema="conv_id long, turn long, role string, text string"):
    pieces = repair.repair(spark.createDataFrame(table, schema))
    return {r[0]: tuple(r[1:]) for r in repair.conversations(pieces).collect()}


def expected(table):
    groups = {}
    for conv, turn, role, text in table:
        groups.setdefault(conv, []).append((turn, role or "", text or ""))
    return {conv: summary(in_order(rows)) for conv, rows in groups.items()}


def test_the_graph_is_small_and_closed():
    graph = repair.graph()
    assert len(graph.costs) == len(set(graph.costs)) < 64
    assert graph.before.max() < len(graph.costs)


@pytest.mark.parametrize("size", range(6))
def test_every_short_signature(size):
    """All audits of all signatures up to five rows: cost and audit are the least there are."""
    kinds = [("user", "a."), ("assistant", "b."), ("system", "c."), ("tool", "d."), ("user", "e"), ("", " ")]
    for drawn in itertools.product(kinds, repeat=size):
        rows = [(r, f"{i}{t}" if t != " " else t) for i, (r, t) in enumerate(drawn)]
        faults = bytes(repair.fault(t, False) for _, t in rows)
        letters = repair.signature([r for r, _ in rows], faults)
        edits, _ = repair.best_edits(letters, 0, repair.START, True)
        assert "".join(edits) == best_audit(tuple(rows))[1]


def _drawn(n, keys, turns):
    random.seed(n)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["yes.", "no", "what?", None, "", " \t\n", "é!", "so be it. \n"]
    found = []
    for _ in range(n):
        turn = random.choice([None, *range(turns)])
        found.append((random.choice(keys), turn, random.choice(roles), random.choice(texts)))
    return found


def test_odd_rows(spark):
    table = _drawn(400, [None, 0, 1, 2, 3, 9007199254740993, -5], 40)
    assert found_rows(spark, table) == expected(table)
    assert found_rows(spark, table + table) == expected(table + table)
    assert found_rows(spark, []) == {}


def test_text_keys_and_other_columns(spark):
    table = [(str(c), t, r, x) for c, t, r, x in _drawn(100, list("ab"), 30)]
    schema = "conv_id string, turn int, role string, text string, part int, _name string, cost int"
    rows = [(*row, 1, "n", 2) for row in table]
    assert found_rows(spark, rows, schema) == expected(table)


def test_pieces_of_a_long_conversation(spark, monkeypatch):
    """Small pieces over many ranges give what one piece gives, copies across them included."""
    monkeypatch.setattr(repair, "PIECE_TURNS", 7)
    table = _drawn(300, [4], 10_000) + _drawn(60, [1, 2, None], 12) + [(4, 3, "user", "again.")] * 50
    pieces = repair.repair(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    assert pieces.where("conv_id = 4").count() > 40
    assert found_rows(spark, table) == expected(table)


def test_long_text_and_one_conversation_of_copies(spark):
    table = [(1, i, "user", "w " * 200_000 + str(i)) for i in range(3)]
    table += [(2, None, "user", "again.")] * 2000
    found = found_rows(spark, table)
    assert found[1] == expected(table[:3])[1]
    assert found[2][:7] == (0, 0, 1999, 0, 1999, 5997 + 2, "K" + "D" * 1999 + "I")


def damage(table):
    found = []
    for conv, turn, role, text in table:
        one = lambda v: " " if v is None else str(v)
        draw = zlib.crc32(f"{one(conv)}:{one(turn)}".encode()) % 20
        role, text = one(role), one(text)
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        found += [(conv, turn, "user" if draw == 4 else role, text)] * {0: 0, 3: 2}.get(draw, 1)
    return found


def test_damage(spark):
    table = _drawn(300, [None, 0, 1, 2, 77], 90)
    rows = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, damaged_turns(rows).collect()), key=str) == sorted(damage(table), key=str)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
def test_query_on_the_table(spark):
    table = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    empty = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    want = {conv: empty for conv, *_ in table} | expected(damage(table))
    rows = all_queries()["op12_conversation_repair"](spark, SF_DIR).collect()
    assert {r[0]: tuple(r[1:]) for r in rows} == want and len(rows) == len(want)
