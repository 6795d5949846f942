"""Conversations repaired to turns that alternate, at the least cost of edits.

A conversation's signature has a letter for each row: the initial of its role, whether it is truncated, or
that it has to go. Signatures are read from the end: suffixes that cost the same from every state of the
grammar, up to a constant, are one node of a word graph, minimised while it is built. The graph of all
signatures, of whatever length, closes at a few nodes, so cost-to-go and the first edit of the best
audit are computed once for each node, letter and state, and all conversations share them. The best audit
is read off by following the edits.

Rows are dealt to ranges of conversation and turn. A conversation that is long, or crosses the border of
a range, is several pieces; a piece is a function of the node behind it, and of the state before it, and
those functions are composed over the pieces. No task holds a whole long conversation.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b, sha256
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from condensa.llm.common import parallelism
from condensa.session import materialize

#: Rows and characters at which a piece of a conversation is closed.
PIECE_TURNS, PIECE_CHARS = 4096, 4 << 20
#: Characters of a text that the borders of ranges are made of.
BORDER_CHARS = 64

# The grammar `(s?(ua)+)?` of role initials; states are start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ROLE_AFTER = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
EXPECTED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
KEPT = {
    (START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT,
    (ASSISTANT, "u"): USER,
}
FINAL = (START, ASSISTANT)
LEGAL = {"su", "ua", "au"}
# What edits cost, and a truncated row that stays.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

NO_FAULT, BLANK, DUPLICATE, CUT = range(4)
GONE = "x"
LETTERS = (GONE, "s", "u", "a", "o", "S", "U", "A", "O")
WHITE = " \t\n\x0b\x0c\r"
_FAR = 1 << 30

Costs = tuple[int, ...]


class Graph(NamedTuple):
    """The minimised word graph: node 0 is the end; `before[letter][node]` is the node before it."""

    costs: list[Costs]  # by node and state, less the least of them
    before: np.ndarray
    edits: list[list[str]]  # by letter, node behind, then state: the first edit of the best audit
    at_end: list[str]  # by state: I until the end is allowed


def _inserted(options: list[tuple[int, str]]) -> tuple[Costs, str]:
    """Cost and first edit by state, when turns may be inserted before what is given by state."""
    best = list(options)
    for _ in EXPECTED:
        for state, after in EXPECTED.items():
            best[state] = min(best[state], (best[after][0] + INSERT, "I"))
    return tuple(c for c, _ in best), "".join(e for _, e in best)


def _row_options(letter: str, costs: Costs, state: int) -> Iterator[tuple[int, str]]:
    yield costs[state] + DELETE, "D"
    if letter != GONE:
        stays = TRUNCATED * letter.isupper()
        if (state, letter.lower()) in KEPT:
            yield costs[KEPT[state, letter.lower()]] + stays, "K"
        yield costs[EXPECTED[state]] + REROLE + stays, "R"


@lru_cache(maxsize=1)
def graph() -> Graph:
    """All nodes that any signature reaches from the end.

    Different edits of a state begin with different letters, so of equal costs the least first letter
    gives the least audit.
    """
    end, at_end = _inserted([(0, " ") if s in FINAL else (_FAR, "~") for s in EXPECTED])
    nodes = {end: 0}
    before: list[list[int]] = []
    edits: list[list[str]] = []
    for costs in (known := [end]):  # grows while it is walked
        row, firsts = [], []
        for letter in LETTERS:
            found, first = _inserted([min(_row_options(letter, costs, s)) for s in EXPECTED])
            found = tuple(c - min(found) for c in found)
            if found not in nodes:
                nodes[found] = len(known)
                known.append(found)
            row.append(nodes[found])
            firsts.append(first)
        before.append(row)
        edits.append(firsts)
    by_letter = [[edits[node][k] for node in range(len(known))] for k in range(len(LETTERS))]
    return Graph(known, np.array(before, dtype=np.uint8).T.copy(), by_letter, list(at_end))


def initial(role: str) -> str:
    return role[0] if role[:1] in ("s", "u", "a") else "o"


def signature(roles: list[str], faults: bytes) -> bytes:
    """The number of each row's letter."""
    return bytes(
        0 if fault in (BLANK, DUPLICATE) else LETTERS.index(initial(role)) + 4 * (fault == CUT)
        for role, fault in zip(roles, faults)
    )


def nodes_behind(letters: bytes, node: int) -> list[int]:
    """Of each row the node of what follows it, when `node` follows the last one."""
    before, found = graph().before, [node]
    for letter in reversed(letters[1:]):
        found.append(int(before[letter, found[-1]]))
    return found[::-1] if letters else []


def best_edits(letters: bytes, node: int, state: int, last: bool) -> tuple[list[str], int]:
    """The edits of each row (insertions before it, then its own) and the state behind the rows.

    If nothing follows (`last`), one more entry has the insertions at the end.
    """
    edits, found = graph().edits, []
    for letter, behind in zip(letters, nodes_behind(letters, node)):
        own, choice = "", edits[letter][behind]
        while choice[state] == "I":
            own, state = own + "I", EXPECTED[state]
        edit = choice[state]
        if edit == "K":
            state = KEPT[state, LETTERS[letter].lower()]
        elif edit == "R":
            state = EXPECTED[state]
        found.append(own + edit)
    if last:
        own = ""
        while graph().at_end[state] == "I":
            own, state = own + "I", EXPECTED[state]
        found.append(own)
    return found, state


def fault(text: str, seen: bool) -> int:
    """The first fault of a row."""
    rest = text.rstrip(WHITE)
    if not rest:
        return BLANK
    return DUPLICATE if seen else NO_FAULT if rest[-1] in ".!?" else CUT


# --- pieces of conversations ----------------------------------------------------------

PIECE_SCHEMA = (
    "_name string, `{key}` {kind}, part int, piece int, edge boolean, turns array<bigint>,"
    " roles array<string>, texts array<string>, faults binary, digests array<binary>"
)


def _pieces(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """The sorted rows of a task as pieces; `edge` where a conversation may have other pieces.

    Faults are as far as the rows of one task tell; `digests` has those of an edge's role and text.
    """
    schema = PIECE_SCHEMA.format(key=key, kind=kind)
    names = ["_name", key, "part", "piece", "edge", "turns", "roles", "texts", "faults", "digests"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []  # the rows of the piece: turn, role, text, fault, digest
        done: list[tuple] = []
        seen: set[bytes] = set()
        name, value, chars, pieces, several, first = None, None, 0, 0, False, True
        types = None

        def close(edge: bool) -> None:
            nonlocal held, chars, pieces
            turns, roles, texts, faults, digests = zip(*held)
            done.append(
                (name, value, part, pieces, edge, turns, roles, texts, bytes(faults), digests if edge else None)
            )
            held, chars, pieces = [], 0, pieces + 1

        def written() -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*done), types)]
            done.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            types = [
                pa.string(), batch.schema.field(1).type, pa.int32(), pa.int32(), pa.bool_(),
                pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.binary(),
                pa.list_(pa.binary()),
            ]
            for own, conv, turn, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if own != name:
                    if held:
                        close(several or first)
                    if name is not None:
                        first = False
                    name, value, several = own, conv, False
                    seen = set()
                elif len(held) >= PIECE_TURNS or chars >= PIECE_CHARS:
                    several = True
                    close(True)
                digest = blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
                held.append((turn, role, text, fault(text, digest in seen), digest))
                seen.add(digest)
                chars += len(text)
            if done:
                yield written()
        if held:
            close(True)
        if done:
            yield written()

    return rows.mapInArrow(run, schema=schema)


def _repeats(edges: DataFrame) -> DataFrame:
    """`part, piece, repeats`: the rows whose role and text an earlier range has for the conversation.

    A task has marked repeats among its own rows, so a text is one row a range here at most.
    """
    rows = edges.select(
        "_name", "part", "piece", "faults", F.posexplode("digests").alias("at", "digest")
    )
    own = F.ascii(F.substring(F.col("faults"), F.col("at") + 1, F.lit(1)).cast("string"))
    rows = rows.where(~own.isin(BLANK, DUPLICATE))
    firsts = rows.groupBy("_name", "digest").agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    later = rows.join(firsts.where("_first < _last"), ["_name", "digest"]).where("part > _first")
    return later.groupBy("part", "piece").agg(F.collect_list("at").alias("repeats"))


def _marked(faults: bytes, repeats: list[int] | None) -> bytes:
    found = bytearray(faults)
    for at in repeats if repeats is not None else ():
        found[at] = DUPLICATE
    return bytes(found)


def _node_map(letters: bytes) -> bytes:
    """The node before the rows, by the node behind them."""
    before = graph().before
    found = np.arange(before.shape[1], dtype=np.uint8)
    for letter in reversed(letters):
        found = before[letter][found]
    return found.tobytes()


def _state_map(letters: bytes, node: int) -> bytes:
    """The state behind the rows, by the state before them."""
    return bytes(best_edits(letters, node, state, False)[1] for state in EXPECTED)


MAP_SCHEMA = "_name string, part int, piece int, letters binary, node int, map binary"


def _scanned(maps: DataFrame, backward: bool) -> DataFrame:
    """`part, piece, value, outer`: what the pieces before (or behind) a piece make of value 0.

    `maps` is `_name, part, piece, map`. `outer` marks the outermost piece on the side it comes from.
    The maps of a range are composed first, then those of the ranges, one row each.
    """

    def walked(frame: pd.DataFrame, order: str, value: int, outer: bool) -> pd.DataFrame:
        frame = frame.sort_values(order, ascending=not backward)
        values, marks = [], []
        for own in frame["map"]:
            values.append(value)
            marks.append(outer)
            value, outer = own[value], False
        return frame.drop(columns="map").assign(value=values, outer=marks)

    def of_range(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("piece", ascending=not backward)
        whole = bytes(range(len(frame["map"].iloc[0])))
        for own in frame["map"]:
            whole = bytes(own[v] for v in whole)
        return pd.DataFrame({"_name": frame["_name"][:1], "part": frame["part"][:1], "map": [whole]})

    def of_conversation(frame: pd.DataFrame) -> pd.DataFrame:
        return walked(frame, "part", 0, True)

    def of_pieces(frame: pd.DataFrame) -> pd.DataFrame:
        value, outer = int(frame["value"].iloc[0]), bool(frame["outer"].iloc[0])
        return walked(frame.drop(columns=["value", "outer"]), "piece", value, outer)

    ranges = maps.select("_name", "part", "piece", "map").groupBy("_name", "part")
    whole = ranges.applyInPandas(of_range, "_name string, part int, map binary")
    entered = whole.groupBy("_name").applyInPandas(
        of_conversation, "_name string, part int, value int, outer boolean"
    )
    met = maps.select("_name", "part", "piece", "map").join(entered, ["_name", "part"])
    return (
        met.groupBy("_name", "part")
        .applyInPandas(of_pieces, "_name string, part int, piece int, value int, outer boolean")
        .drop("_name")
    )


def _lettered(edges: DataFrame) -> DataFrame:
    """The letters of edge pieces with their repeats, and the map of nodes."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = zip(f["roles"], f["faults"], f["repeats"])
            letters = [signature(list(r), _marked(x, again)) for r, x, again in rows]
            yield f[["_name", "part", "piece"]].assign(
                letters=letters, node=0, map=[_node_map(x) for x in letters]
            )

    return edges.mapInPandas(run, MAP_SCHEMA)


def _with_state_map(pieces: DataFrame) -> DataFrame:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield f.assign(map=[_state_map(x, n) for x, n in zip(f["letters"], f["node"])])

    return pieces.mapInPandas(run, MAP_SCHEMA)


def _contexts(pieces: DataFrame) -> DataFrame:
    """`part, piece, node, state, is_first, is_last, repeats` of edge pieces, written."""
    edges = pieces.where("edge")
    edges = materialize(
        edges.join(_repeats(edges), ["part", "piece"], "left").select(
            "_name", "part", "piece", "roles", "faults", "repeats"
        ),
        "edges",
    )
    lettered = materialize(_lettered(edges), "letters")
    behind = materialize(_scanned(lettered, backward=True), "nodes").select(
        "part", "piece", F.col("value").alias("node"), F.col("outer").alias("is_last")
    )
    known = lettered.drop("node", "map").join(behind, ["part", "piece"])
    states = _scanned(
        _with_state_map(known.select("_name", "part", "piece", "letters", "node", F.lit(b"").alias("map"))),
        backward=False,
    ).select("part", "piece", F.col("value").alias("state"), F.col("outer").alias("is_first"))
    return materialize(
        edges.select("part", "piece", "repeats").join(behind, ["part", "piece"]).join(states, ["part", "piece"]),
        "contexts",
    )


REPAIRED = (
    "is_first boolean, is_last boolean, first_turn bigint, last_turn bigint, n_turns bigint,"
    " blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_initial string,"
    " last_initial string, cost bigint, audit string, roles array<string>, texts array<string>"
)


def _repaired_piece(turns, roles, texts, faults, repeats, node, state, first, last) -> tuple:
    """The columns of `REPAIRED` for a piece, given what stands around it."""
    faults = _marked(faults, repeats)
    letters = signature(roles, faults)
    edits, _ = best_edits(letters, node, state, last)
    cost, out_roles, out_texts = 0, [], []
    for place, own in enumerate(edits):
        for edit in own:
            here = place < len(roles) and edit != "I"
            if edit == "D":
                cost += DELETE
                continue
            if edit == "K":
                state = KEPT[state, initial(roles[place])]
                out_roles.append(roles[place])
            else:
                state = EXPECTED[state]
                cost += REROLE if edit == "R" else INSERT
                out_roles.append(ROLE_AFTER[state])
            out_texts.append(texts[place] if here else "")
            cost += TRUNCATED * (here and faults[place] == CUT)
    initials = [role[:1] for role in roles]
    numbered = [t for t in turns if t is not None]
    return (
        first, last, min(numbered, default=None), max(numbered, default=None), len(set(numbered)),
        faults.count(BLANK), faults.count(DUPLICATE), faults.count(CUT),
        sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])),
        initials[0], initials[-1], cost, "".join(edits), out_roles, out_texts,
    )


def repair(
    turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Pieces of repaired conversations: `key, part, piece` and the columns of `REPAIRED`.

    Rows follow their turn (nulls first); of equal turns the order is that of role and text, so equal
    rows are neighbours. A row's first fault counts: blank, duplicate (its role and text came earlier),
    truncated (ends without `.`, `!` or `?`). `audit` has the cheapest edits' initials (Keep, Rerole,
    Delete, Insert), of equally cheap ones the least, `roles` and `texts` the rows that result,
    counts are those of the rows as given. A conversation is one piece (`is_first` and `is_last`)
    unless it is long or crosses a border of ranges; its pieces follow `part, piece`, and what sums up
    over pieces needs the neighbours' initials and turns (`conversations`). A null role or text is an
    empty one, null keys are one conversation, other columns are not read, an empty table gives no pieces.
    """
    kind = turns.schema[key].dataType.simpleString()
    own = F.col(key)
    rows = turns.select(
        F.when(own.isNull(), "").otherwise(F.concat(F.lit("="), own.cast("string"))).alias("_name"),
        own.alias("_conv"),
        F.col(turn).cast("long").alias("_turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("_role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"),
    ).withColumns(
        {
            "_start": F.substring("_text", 1, BORDER_CHARS),
            "_hash": F.xxhash64("_text"),
            "_tie": F.monotonically_increasing_id(),  # copies of one row spread, too
        }
    )
    order = ["_conv", "_turn", "_role", "_start", "_hash"]
    dealt = rows.repartitionByRange(parallelism(turns), *order, "_tie")
    dealt = dealt.sortWithinPartitions(*order, "_text")
    dealt = dealt.select("_name", "_conv", "_turn", "_role", "_text")
    pieces = materialize(_pieces(dealt, key, kind), "pieces")
    contexts = _contexts(pieces)
    alone = pieces.where("NOT edge").select(
        key, "part", "piece", "turns", "roles", "texts", "faults",
        F.lit(None).cast("array<int>").alias("repeats"), F.lit(0).alias("node"),
        F.lit(0).alias("state"), F.lit(True).alias("is_first"), F.lit(True).alias("is_last"),
    )
    edges = pieces.where("edge").join(contexts, ["part", "piece"])
    schema = f"`{key}` {kind}, part int, piece int, {REPAIRED}"
    names = [key, "part", "piece", *(field.split()[0] for field in REPAIRED.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            given = zip(*(c.to_pylist() for c in batch.columns[3:]))
            found = [_repaired_piece(*row) for row in given]
            columns = [pa.array(c, t) for c, t in zip(zip(*found), _TYPES)] if found else []
            if found:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], names=names)

    return alone.unionByName(edges.select(*alone.columns)).mapInArrow(run, schema=schema)


_KINDS = {
    "boolean": pa.bool_(), "bigint": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()),
}
_TYPES = [_KINDS[field.split()[1]] for field in REPAIRED.split(", ")]

SUMMARY = (
    "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint,"
    " audit string, repaired_sha256 string"
)


def _folded(pieces: DataFrame, key: str, kind: str) -> DataFrame:
    """One row for each conversation of several pieces, which arrive one by one in their order.

    A digest reads its text from the first character to the last, so this is one task a conversation; it
    holds one piece, and of the conversation its audit.
    """
    names = [key, *(field.split()[0] for field in SUMMARY.split(", "))]
    sums = ("blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: dict = {}

        def closed() -> pa.RecordBatch:
            gaps = state["last_turn"] - state["first_turn"] + 1 - state["n_turns"] if state["n_turns"] else 0
            values = [state["key"], gaps, *(state[c] for c in sums), "".join(state["audit"])]
            values.append(state["sha"].hexdigest())
            types = [state["type"], *(_KINDS[f.split()[1]] for f in SUMMARY.split(", "))]
            columns = [pa.array([v], t) for v, t in zip(values, types)]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            for place in range(batch.num_rows):
                row = batch.slice(place, 1).to_pylist()[0]
                if row["is_first"]:
                    if state:
                        yield closed()
                    state = {
                        "key": row[key], "type": batch.schema.field(key).type, "sha": sha256(),
                        "audit": [], "n_turns": 0, "first_turn": None, "last_turn": None,
                        "initial": None, "lines": 0, **dict.fromkeys(sums, 0),
                    }
                elif state["initial"] + row["first_initial"] not in LEGAL:
                    state["illegal"] += 1
                for c in sums:
                    state[c] += row[c]
                if row["n_turns"]:
                    state["n_turns"] += row["n_turns"] - (state["last_turn"] == row["first_turn"])
                    state["last_turn"] = row["last_turn"]
                    if state["first_turn"] is None:
                        state["first_turn"] = row["first_turn"]
                state["initial"] = row["last_initial"]
                state["audit"].append(row["audit"])
                for role, text in zip(row["roles"], row["texts"]):
                    state["sha"].update(("\n" * (state["lines"] > 0) + f"{role}:{text}").encode())
                    state["lines"] += 1
        if state:
            yield closed()

    return pieces.mapInArrow(run, schema=f"`{key}` {kind}, {SUMMARY}")


def conversations(pieces: DataFrame, key: str = "conv_id") -> DataFrame:
    """`key` and the columns of `SUMMARY`, one row for each conversation of `repair`."""
    kind = pieces.schema[key].dataType.simpleString()
    pieces = materialize(pieces, "repaired")
    whole = F.col("is_first") & F.col("is_last")
    line = F.transform(F.arrays_zip("roles", "texts"), lambda r: F.concat_ws(":", r["roles"], r["texts"]))
    gaps = F.when(F.col("n_turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("n_turns"))
    alone = pieces.where(whole).select(
        key, F.coalesce(gaps, F.lit(0)).cast("long").alias("gaps"),
        "blank", "duplicate", "truncated", "illegal", "cost", "audit",
        F.sha2(F.array_join(line, "\n"), 256).alias("repaired_sha256"),
    )
    others = pieces.where(~whole).repartition(parallelism(pieces), key)
    others = others.sortWithinPartitions(key, "part", "piece")
    return alone.unionByName(_folded(others, key, kind))
