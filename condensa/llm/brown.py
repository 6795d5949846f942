"""Class-based bigrams: words in classes by exchange, scores from class transitions and word emissions.

Texts are turned once into batches of word numbers, each with its own dictionary. Dictionaries are cut
into packets by a hash of the word; where the packets of a hash meet, every word is counted over all
batches, and its count returns in the order of the packet, so a word costs a few bytes a batch however
often it occurs.

The units that are clustered are the most frequent words and, for all others, groups of words with the same
ending; so every word has a class, and a class is looked up without a join. Pairs of neighbouring units
are counted over the whole corpus and dealt by unit. A round of exchange computes for each unit what the
likelihood gains by moving it to each class, next to the one table of class pairs. All units that gain
move together until that lowers the likelihood; from then on half of them do, another half each round.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import partial
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from condensa.llm.common import parallelism
from condensa.session import materialize

#: Words that are units of their own, groups of endings of all others, and characters of an ending.
HEADS, ENDINGS, ENDING_CHARS = 8192, 2048, 3
#: Classes of words, besides the one of the text's ends, and rounds of exchange.
CLASSES, ROUNDS = 64, 12
#: UTF-8 bytes of the texts of a batch, unless one text alone has more.
BATCH_BYTES = 4 << 20
#: Packets of words for each partition of a shuffle.
PACKETS = 4
#: Ranges that units are dealt in: as many as a shuffle has partitions, within these bounds.
LEAST_RANGES, MOST_RANGES = 64, 1024
#: Different pairs of units that a task adds up before they leave it, with those of the batch that fills it.
COMBINED = 1 << 18
# Fixed values of the base score: what is added to each count.
ADDED = 0.1
#: What a seen class pair gives to unseen ones.
PAIR_DISCOUNT = 0.5


# --- batches of word numbers ----------------------------------------------------------


def _bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts that have `BATCH_BYTES` together at most, or are one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + BATCH_BYTES, side="right")))
        yield start, end
        start = end


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All lower-case words of the texts one behind the other, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = parts.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    offsets = parts.offsets.to_numpy()
    until = np.concatenate([[0], np.cumsum(real)])[offsets - offsets[0]]
    return words.filter(pa.array(real)), np.diff(until)


def _hashes(words: pa.Array, packets: int) -> np.ndarray:
    return np.array([crc32(w) for w in words.cast(pa.binary()).to_pylist()], dtype=np.int64) % packets


BATCH_SCHEMA = "batch long, sizes binary, learned binary, ids binary, words array<string>, counts binary, packets binary"


def _batches(docs: DataFrame, key: str, text: str, learn: Column, packets: int) -> DataFrame:
    """A row for each batch: keys, sizes, whether learned from, the numbers of all words, and its dictionary.

    The dictionary is ordered by packet; `counts` are those in the texts that are learned from.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = ["keys", *(field.split()[0] for field in BATCH_SCHEMA.split(", "))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = TaskContext.get().partitionId() << 32
        for whole in batches:
            texts = pc.fill_null(whole.column(1), "")
            for start, end in _bounded(texts):
                keys = whole.column(0)[start:end]
                learned = whole.column(2)[start:end].to_numpy(zero_copy_only=False).astype(bool)
                words, sizes = split_words(texts[start:end])
                coded = words.dictionary_encode()
                found = coded.dictionary
                packet = _hashes(found, packets)
                order = np.argsort(packet, kind="stable")
                number = np.empty(len(order), dtype=np.int32)
                number[order] = np.arange(len(order), dtype=np.int32)
                ids = number[coded.indices.to_numpy()] if len(found) else np.zeros(0, dtype=np.int32)
                counts = np.bincount(ids[np.repeat(learned, sizes)], minlength=len(order))
                cuts = np.searchsorted(packet[order], np.arange(packets + 1))
                columns = [
                    pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys),
                    pa.array([name]),
                    pa.array([sizes.astype(np.int64).tobytes()]),
                    pa.array([learned.tobytes()]),
                    pa.array([ids.tobytes()], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), found.take(pa.array(order))),
                    pa.array([counts.astype(np.int64).tobytes()], pa.binary()),
                    pa.array([cuts.astype(np.int64).tobytes()]),
                ]
                del words, coded, found, ids
                yield pa.RecordBatch.from_arrays(columns, names=names)
                name += 1
            pa.default_memory_pool().release_unused()

    rows = docs.select(
        F.col(key).alias("_key"),
        F.col(text).cast("string").alias("_text"),
        F.coalesce(learn, F.lit(False)).alias("_learn"),
    )
    return rows.mapInArrow(run, schema=f"keys array<{kind}>, {BATCH_SCHEMA}")


def _numbers(value, kind=np.int64) -> np.ndarray:
    return np.frombuffer(value, dtype=kind)


# --- counts of words ------------------------------------------------------------------

PACKET_SCHEMA = "packet int, batch long, words array<string>, counts binary"
COUNT_SCHEMA = "batch long, packet int, counts binary, words array<string>"


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for place in range(rows.num_rows):
            batch, words, counts, cuts = (rows.column(c)[place] for c in range(4))
            words, counts, cuts = words.values, _numbers(counts.as_py()), _numbers(cuts.as_py())
            n = len(cuts) - 1
            columns = [
                pa.array(range(n), pa.int32()),
                pa.array([batch.as_py()] * n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), words),
                pa.array([counts[a:b].tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["packet", "batch", "words", "counts"])


def _counted(group: pa.Table) -> pa.Table:
    """Each packet's counts over all batches, and a row (of no batch) of all its words and counts."""
    rows = group.combine_chunks()
    words = pa.concat_arrays([c for c in rows.column("words").chunks]).flatten()
    coded = words.dictionary_encode()
    numbers = coded.indices.to_numpy()
    own = _numbers(b"".join(rows.column("counts").to_pylist()))
    total = np.zeros(len(coded.dictionary), dtype=np.int64)
    np.add.at(total, numbers, own)
    found = total[numbers]
    ends = np.cumsum([0, *(len(c) // 8 for c in rows.column("counts").to_pylist())])
    seen = np.flatnonzero(total)
    counts = [found[a:b].tobytes() for a, b in zip(ends, ends[1:])] + [total[seen].tobytes()]
    packet = rows.column("packet")[0].as_py()
    listed = [None] * rows.num_rows + [coded.dictionary.take(pa.array(seen)).to_pylist()]
    columns = [
        pa.array([*rows.column("batch").to_pylist(), None], pa.int64()),
        pa.array([packet] * (rows.num_rows + 1), pa.int32()),
        pa.array(counts, pa.binary()),
        pa.array(listed, pa.list_(pa.string())),
    ]
    return pa.Table.from_arrays(columns, names=["batch", "packet", "counts", "words"])


def _word_counts(batches: DataFrame, packets: int) -> DataFrame:
    """`batch, packet, counts` for each batch, and `packet, words, counts` where the batch is null."""
    cut = batches.select("batch", "words", "counts", "packets").mapInArrow(
        lambda rows: _packets(
            pa.RecordBatch.from_arrays([r.column(i) for i in range(4)], names=["a", "b", "c", "d"]) for r in rows
        ),
        schema=PACKET_SCHEMA,
    )
    dealt = cut.repartition(parallelism(batches), "packet")
    return materialize(dealt.groupBy("packet").applyInArrow(_counted, COUNT_SCHEMA), "word-counts")


# --- units and classes ----------------------------------------------------------------


@dataclass(frozen=True)
class Units:
    """What is clustered: `heads` by number, behind them groups of endings, last the ends of texts."""

    heads: tuple[str, ...]
    endings: int = ENDINGS

    def __post_init__(self):
        if self.number >= 1 << 16:
            raise ValueError("pairs of units are 32-bit numbers: fewer heads or endings")

    @property
    def number(self) -> int:
        return len(self.heads) + self.endings + 1

    def of(self, words: pa.Array) -> np.ndarray:
        """The unit of each word."""
        head = pc.index_in(words, value_set=pa.array(self.heads, pa.string()))
        endings = pc.utf8_slice_codeunits(words, -ENDING_CHARS).dictionary_encode()
        groups = [crc32(e.encode()) % self.endings for e in endings.dictionary.to_pylist()]
        group = np.array(groups, dtype=np.int64)[endings.indices.to_numpy()] if groups else np.zeros(0, np.int64)
        known = head.fill_null(-1).to_numpy().astype(np.int64)
        return np.where(known >= 0, known, len(self.heads) + group)


def _top_words(counts: DataFrame, heads: int, packets: int) -> tuple[str, ...]:
    """The most frequent words; a packet, which is a hash of words, is asked for four times its share."""
    share = 4 * -(-heads // packets) + 64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for place in range(rows.num_rows):
                words = rows.column("words")[place].values
                n = _numbers(rows.column("counts")[place].as_py())
                best = np.argsort(-n, kind="stable")[:share] if len(n) <= share else np.argpartition(-n, share)[:share]
                columns = [words.take(pa.array(best)), pa.array(n[best], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["word", "n"])

    listed = counts.where("batch IS NULL").select("words", "counts").mapInArrow(run, schema="word string, n long")
    return tuple(r["word"] for r in listed.orderBy(F.desc("n"), "word").limit(heads).collect())


PAIR_SCHEMA = "range int, side int, salt int, pairs binary, counts binary"


def _sequences(ids, sizes, of_word, end) -> tuple[np.ndarray, np.ndarray]:
    """Values of all words with `end` behind each text, and the place of each text's end."""
    ends = np.cumsum(sizes + 1) - 1
    found = np.empty(int(len(ids) + len(sizes)), dtype=np.int64)
    inside = np.ones(len(found), dtype=bool)
    inside[ends] = False
    found[inside], found[ends] = of_word[ids], end
    return found, ends


def _added_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different keys in order, and the sums of their counts."""
    order = np.argsort(keys)
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    return keys[starts], np.add.reduceat(counts, starts, dtype=np.int64) if len(starts) else counts.astype(np.int64)


def _dealt_pairs(keys: np.ndarray, counts: np.ndarray, n: int, ranges: int, salt: int) -> Iterator[pa.RecordBatch]:
    """Pairs of units by ranges of the first one and of the second one."""
    for side in (0, 1):
        own, other = np.divmod(keys.astype(np.int64), n)[:: 1 - 2 * side]
        # frequent units, which have the low numbers, spread over all ranges
        order = np.argsort(own % ranges, kind="stable")
        pairs, times = (own * n + other)[order].astype(np.uint32), counts[order]
        cuts = np.searchsorted((own % ranges)[order], np.arange(ranges + 1))
        spans = [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        columns = [
            pa.array([k for k, _, _ in spans], pa.int32()),
            *(pa.array([v] * len(spans), pa.int32()) for v in (side, salt)),
            pa.array([pairs[a:b].tobytes() for _, a, b in spans], pa.binary()),
            pa.array([_short(times[a:b]) for _, a, b in spans], pa.binary()),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=["range", "side", "salt", "pairs", "counts"])


def _short(counts: np.ndarray) -> bytes:
    """Counts as 32-bit numbers if they fit, else as 64-bit ones; their number tells which."""
    return counts.astype(np.uint32 if counts.max() < 1 << 32 else np.int64).tobytes()


def _long(counts: bytes, n: int) -> np.ndarray:
    return np.frombuffer(counts, dtype=np.uint32 if len(counts) == 4 * n else np.int64).astype(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch], units: Units, ranges: int, salts: int) -> Iterator[pa.RecordBatch]:
    """Pairs of neighbouring units of learned texts, added up in the task."""
    n, salt = units.number, TaskContext.get().partitionId() % salts
    keys, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
    for rows in batches:
        for place in range(rows.num_rows):
            sizes, learned, ids = (
                _numbers(rows.column(c)[place].as_py(), k) for c, k in (("sizes", np.int64), ("learned", bool), ("ids", np.int32))
            )
            ids, sizes = ids[np.repeat(learned, sizes)], sizes[learned]
            of_word = units.of(rows.column("words")[place].values)
            after, _ = _sequences(ids, sizes, of_word, n - 1)
            if not len(after):
                continue
            before = np.concatenate([[n - 1], after[:-1]])  # the end of a text begins the next
            both = (before * n + after).astype(np.uint32)
            del ids, after, before, of_word
            met, times = np.unique(both, return_counts=True)
            del both
            keys, counts = _added_up(np.concatenate([keys, met]), np.concatenate([counts, times]))
            if len(keys) >= COMBINED:
                yield from _dealt_pairs(keys, counts, n, ranges, salt)
                keys, counts = keys[:0].copy(), counts[:0].copy()
        pa.default_memory_pool().release_unused()
    if len(keys):
        yield from _dealt_pairs(keys, counts, n, ranges, salt)


def _summed(group: pa.Table) -> pa.Table:
    """One row of all pairs of a group."""
    listed = group.column("pairs").to_pylist()
    times = [_long(c, len(p) // 4) for p, c in zip(listed, group.column("counts").to_pylist())]
    keys, counts = _added_up(_numbers(b"".join(listed), np.uint32), np.concatenate(times))
    own = [pa.array([group.column(c)[0].as_py()], pa.int32()) for c in ("range", "side", "salt")]
    columns = [*own, pa.array([keys.tobytes()]), pa.array([_short(counts)])]
    return pa.Table.from_arrays(columns, names=["range", "side", "salt", "pairs", "counts"])


def _unit_pairs(batches: DataFrame, units: Units) -> DataFrame:
    """One row of pairs for each range and side, written.

    Pairs are added up in the tasks, then over a share of the tasks, then over all: a sum has no more pairs
    than there are of units, so what a group reads grows with the root of the number of tasks.
    """
    parts = parallelism(batches)
    ranges = min(MOST_RANGES, max(LEAST_RANGES, parts))
    salts = max(1, round(parts**0.5))
    cut = batches.select("sizes", "learned", "ids", "words").mapInArrow(
        partial(_pairs, units=units, ranges=ranges, salts=salts), PAIR_SCHEMA
    )
    for group in (["range", "side", "salt"], ["range", "side"]):
        cut = cut.repartition(parts, *group).groupBy(*group).applyInArrow(_summed, PAIR_SCHEMA)
    return materialize(cut, "pairs")


def _class_pairs(rows: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """How often a class follows a class: the pairs of all ranges, summed where they lie first."""
    n = len(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(k * k, dtype=np.int64)
        for batch in batches:
            for pairs, counts in zip(batch.column("pairs").to_pylist(), batch.column("counts").to_pylist()):
                keys = _numbers(pairs, np.uint32).astype(np.int64)
                at = classes[keys // n] * k + classes[keys % n]
                np.add.at(found, at, _long(counts, len(keys)))
        seen = np.flatnonzero(found)
        columns = [pa.array(seen, pa.int64()), pa.array(found[seen], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["at", "n"])

    cells = rows.where("side = 0").select("pairs", "counts").mapInArrow(run, schema="at long, n long")
    table = np.zeros(k * k, dtype=np.int64)
    for row in cells.groupBy("at").agg(F.sum("n").alias("n")).collect():  # k * k rows at most
        table[row["at"]] = row["n"]
    return table.reshape(k, k)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def likelihood(table: np.ndarray) -> float:
    """Of the class pairs, but for what no class changes: the words' own counts."""
    return float(_xlogx(table).sum() - _xlogx(table.sum(1)).sum() - _xlogx(table.sum(0)).sum())


def move_gains(table: np.ndarray, own: int, after: np.ndarray, before: np.ndarray, itself: int) -> np.ndarray:
    """What the likelihood gains when a unit leaves class `own` for each class.

    `after` and `before` count the classes next to the unit in each direction, without the unit's pairs
    with itself, which `itself` counts. The last class, of the ends of texts, takes no unit.
    """
    k = len(table)
    grown = _xlogx(table + after) - _xlogx(table)  # row b gains the unit's followers
    grown += (_xlogx(table + before[:, None]) - _xlogx(table)).T  # and column b what it follows
    rest = grown.sum(1) - grown[:, own] - grown.diagonal()
    lost = _xlogx(table[own] - after) - _xlogx(table[own])
    lost += _xlogx(table[:, own] - before) - _xlogx(table[:, own])
    rest += lost.sum() - lost[own] - lost
    b = np.arange(k)
    corner = _xlogx(table[own, own] - after[own] - before[own] - itself) - _xlogx(table[own, own])
    rest += corner
    rest += _xlogx(table[own] - after + before[own]) - _xlogx(table[own])
    rest += _xlogx(table[:, own] + after[own] - before) - _xlogx(table[:, own])
    rest += _xlogx(table[b, b] + after + before + itself) - _xlogx(table[b, b])
    for totals, n in ((table.sum(1), after.sum() + itself), (table.sum(0), before.sum() + itself)):
        rest -= _xlogx(totals[own] - n) - _xlogx(totals[own])
        rest -= _xlogx(totals + n) - _xlogx(totals)
    rest[own], rest[k - 1] = 0.0, -np.inf
    return rest


def _proposals(pairs: DataFrame, classes: np.ndarray, table: np.ndarray, wanted: Callable) -> list:
    """`unit, target, gain` of the units that gain by a move and are `wanted`; one row a unit at most."""
    n, k = len(classes), len(table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for place in range(batch.num_rows):
                own = [batch.column(c)[place].as_py() or b"" for c in range(4)]
                sides = []
                for pairs, counts in (own[:2], own[2:]):
                    keys = _numbers(pairs, np.uint32).astype(np.int64)
                    sides += [keys, _long(counts, len(keys))]
                units = np.unique(np.concatenate([sides[0] // n, sides[2] // n]))
                units = units[units < n - 1]
                near = np.zeros((2, len(units) + 1, k), dtype=np.int64)
                itself = np.zeros(len(units) + 1, dtype=np.int64)
                for side, (keys, counts) in enumerate((sides[:2], sides[2:])):
                    own, other = keys // n, keys % n
                    row = np.where(own < n - 1, np.searchsorted(units, own), len(units))
                    unlike = own != other
                    np.add.at(near[side], (row[unlike], classes[other[unlike]]), counts[unlike])
                    if side == 0:
                        np.add.at(itself, row[~unlike], counts[~unlike])
                found = []
                for i, unit in enumerate(units.tolist()):
                    if not wanted(unit):
                        continue
                    gains = move_gains(table, int(classes[unit]), near[0, i], near[1, i], int(itself[i]))
                    target = int(gains.argmax())
                    if gains[target] > 1e-6:
                        found.append((unit, target, float(gains[target])))
                columns = [pa.array(c, t) for c, t in zip(zip(*found), (pa.int64(), pa.int64(), pa.float64()))]
                if found:
                    yield pa.RecordBatch.from_arrays(columns, names=["unit", "target", "gain"])

    return [tuple(r) for r in pairs.mapInArrow(run, schema="unit long, target long, gain double").collect()]


def exchange(pairs: DataFrame, units: int, classes: int = CLASSES, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """The class of each unit, the table of class pairs, and the likelihood round by round.

    `pairs` has one row for each range and side. Units begin in the class of their number modulo
    `classes`, so every class has one of the most frequent words. Units that gain move at once, each as if
    alone. If the likelihood falls by that, half of them stay, and only half of all units move in each
    round from then on.
    """
    k = classes + 1
    current = np.arange(units) % classes
    current[-1] = classes  # the ends of texts
    sides = [
        pairs.where(F.col("side") == s).select("range", F.col("pairs").alias(f"p{s}"), F.col("counts").alias(f"c{s}"))
        for s in (0, 1)
    ]
    both = materialize(sides[0].join(sides[1], "range", "full").select("p0", "c0", "p1", "c1"), "unit-pairs")
    table = _class_pairs(pairs, current, k)
    course = [likelihood(table)]
    halved = False
    for turn in range(rounds):

        def own_turn(unit: int) -> bool:
            return crc32(f"{unit}:{turn}".encode()) % 2 == 0

        moves = _proposals(both, current, table, own_turn if halved else lambda unit: True)
        while moves:
            tried = current.copy()
            tried[[m[0] for m in moves]] = [m[1] for m in moves]
            found = _class_pairs(pairs, tried, k)
            if likelihood(found) > course[-1]:
                current, table = tried, found
                course.append(likelihood(found))
                break
            moves = [m for m in moves if own_turn(m[0])] if not halved else moves[::2] if len(moves) > 1 else []
            halved = True
    return current, table, course


# --- the model ------------------------------------------------------------------------


@dataclass(frozen=True)
class Model:
    units: Units
    classes: np.ndarray  # of each unit
    steps: np.ndarray  # log10 of the probability of a class behind a class
    sizes: np.ndarray  # learned words by class
    discounts: np.ndarray  # by class
    unseen: np.ndarray  # log10 of the probability of an unseen word by class
    tokens: int  # learned tokens, the ends of texts too
    types: int
    texts: int  # that were learned from
    course: tuple[float, ...]


def _transitions(table: np.ndarray) -> np.ndarray:
    """log10 of discounted shares, the discounts going to all classes by how often they occur."""
    k = len(table)
    general = (table.sum(0) + 1) / (table.sum() + k)
    totals = table.sum(1, keepdims=True)
    kept = np.maximum(table - PAIR_DISCOUNT, 0)
    free = totals - kept.sum(1, keepdims=True)
    shares = np.where(totals > 0, (kept + free * general) / np.maximum(totals, 1), general)
    return np.log10(shares)


def _class_words(counts: DataFrame, units: Units, classes: np.ndarray, k: int) -> np.ndarray:
    """By class: words, words seen once and twice, and all their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros((k, 4), dtype=np.int64)
        for rows in batches:
            for place in range(rows.num_rows):
                n = _numbers(rows.column("counts")[place].as_py())
                own = classes[units.of(rows.column("words")[place].values)]
                for c, values in enumerate((n > 0, n == 1, n == 2, n)):
                    np.add.at(found[:, c], own, values.astype(np.int64))
        columns = [pa.array(range(k), pa.int32()), *(pa.array(found[:, c]) for c in range(4))]
        yield pa.RecordBatch.from_arrays(columns, names=["class", "types", "once", "twice", "tokens"])

    listed = counts.where("batch IS NULL").select("words", "counts")
    parts = listed.mapInArrow(run, schema="class int, types long, once long, twice long, tokens long")
    names = ("types", "once", "twice", "tokens")
    found = np.zeros((k, 4), dtype=np.int64)
    for row in parts.groupBy("class").agg(*[F.sum(c).alias(c) for c in names]).collect():  # k rows
        found[row["class"]] = [row[c] for c in names]
    return found


def _model(batches: DataFrame, counts: DataFrame, packets: int, heads: int, endings: int, classes: int, rounds: int) -> Model:
    units = Units(_top_words(counts, heads, packets), endings)
    pairs = _unit_pairs(batches, units)
    found, table, course = exchange(pairs, units.number, classes, rounds)
    k = classes + 1
    words = _class_words(counts, units, found, k)
    types, once, twice, tokens = words.T
    discounts = np.clip(once / np.maximum(once + 2 * twice, 1), 0.1, 0.9)
    unseen = np.where(tokens > 0, discounts * types / np.maximum(tokens, 1), 1.0)
    texts = int(table[:, -1].sum())
    return Model(
        units, found, _transitions(table), tokens, discounts, np.log10(unseen),
        int(tokens.sum()) + texts, int(types.sum()) + (texts > 0), texts, tuple(course),
    )


SCORE_SCHEMA = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model, ids, sizes, words: pa.Array, counts: np.ndarray) -> list[np.ndarray]:
    """The columns of `SCORE_SCHEMA` of the texts of a batch."""
    end = len(model.steps) - 1
    own = model.classes[model.units.of(words)]
    known = counts > 0
    emitted = np.log10(np.where(known, counts - model.discounts[own], 1.0)) - np.log10(np.maximum(model.sizes[own], 1))
    emitted = np.where(known, emitted, model.unseen[own])
    based = np.log10(counts + ADDED)
    classes, ends = _sequences(ids, sizes, own, end)
    before = np.concatenate([[end], classes[:-1]])[: len(classes)]
    steps = model.steps[before, classes]
    inside = np.ones(len(classes), dtype=bool)
    inside[ends] = False
    steps[inside] += emitted[ids]
    base = np.full(len(classes), np.log10(model.texts + ADDED))
    base[inside] = based[ids]
    seen = np.full(len(classes), model.texts > 0, dtype=np.int64)
    seen[inside] = known[ids]
    starts = ends - sizes
    n = sizes + 1
    per_token = np.log10(model.tokens + ADDED * (model.types + 1))
    total = [np.add.reduceat(v, starts) if len(starts) else v[:0] for v in (seen, base, steps)]
    return [n, total[0], np.full(len(n), model.tokens), total[1] - n * per_token, total[2]]


def class_scores(
    docs: DataFrame,
    learn: Column,
    key: str = "doc_id",
    text: str = "text",
    heads: int = HEADS,
    endings: int = ENDINGS,
    classes: int = CLASSES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """`key, n_tokens, n_known, train_tokens, base_score, score` of each row.

    Tokens are the lower-case words (A-Z only) and one end. The model learns from rows where `learn` is
    true (null is not). `score` is log10 of the text's probability: of each token's class behind the
    class before it, times that of the word in its class. Each class keeps a share, by its words that
    were seen once and twice, for words that were not seen; the probabilities of all words and of an unseen
    one in each class sum up to 1 behind every class. `base_score` is that of additively smoothed words.
    A null text counts as empty and has its end only; rows with repeated or null keys are answered each;
    other columns are not read; an empty table gives an empty one; without rows to learn from all words
    are unseen. Whole texts are read, a long one as a batch of its own (some 60 bytes a word).
    """
    packets = PACKETS * parallelism(docs)
    kind = docs.schema[key].dataType.simpleString()
    batches = materialize(_batches(docs, key, text, learn, packets), "batches")
    counts = _word_counts(batches, packets)
    model = _model(batches, counts, packets, heads, endings, classes, rounds)
    of_batch = counts.where("batch IS NOT NULL").groupBy("batch").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("packet", "counts"))), lambda p: p["counts"]
        ).alias("totals")
    )
    joined = batches.select("batch", "keys", "sizes", "ids", "words").join(of_batch, "batch")
    names = [key, *(field.split()[0] for field in SCORE_SCHEMA.split(", "))]
    names_in = ["keys", "sizes", "ids", "words", "totals"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for place in range(batch.num_rows):
                keys, sizes, ids, words, totals = (batch.column(c)[place] for c in names_in)
                found = _scored(
                    model, _numbers(ids.as_py(), np.int32), _numbers(sizes.as_py()), words.values,
                    _numbers(b"".join(totals.as_py())),
                )
                yield pa.RecordBatch.from_arrays([keys.values, *map(pa.array, found)], names=names)

    return joined.select(*names_in).mapInArrow(run, schema=f"`{key}` {kind}, {SCORE_SCHEMA}")
