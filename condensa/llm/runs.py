"""Periodic runs of words: squares caught online by catchers over power-of-two blocks.

A run is a stretch of words that are equal to the words one period before, and as long as that holds.
When a block of `B` words is complete, its catcher compares the suffix of `B` words of all text that
is appended from `2 * B` to `4 * B` words behind the block's start; an equal one is a square's two halves at
that period. Every run of period `2 * B` to `4 * B` holds a whole block in its first half, so a level of
blocks for each power of two finds all runs. Suffixes are compared by polynomial names that need no
reading back, so an appended word costs two comparisons a level, and a found pair grows to both sides
by bisection over the names. Reported stretches are compared word by word in the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

#: A run has at least this many words.
LEAST = 12
#: Blocks of the lowest level, whose catchers see the periods below `4 * LOWEST`.
LOWEST = 2
#: Words that are appended together, of several texts (a longer text stands alone).
TOGETHER = 1 << 20
_PRIME = np.uint64((1 << 31) - 1)


def _reduced(x: np.ndarray) -> np.ndarray:
    """Numbers below 2 ** 62 modulo the prime 2 ** 31 - 1."""
    x = (x & _PRIME) + (x >> np.uint64(31))
    x = (x & _PRIME) + (x >> np.uint64(31))
    return np.where(x >= _PRIME, x - _PRIME, x)


def _powers(base: int, n: int) -> np.ndarray:
    """`base ** i` modulo the prime, for i below n."""
    found = np.ones(1, dtype=np.uint64)
    while len(found) < n:
        step = np.uint64(pow(base, len(found), int(_PRIME)))
        found = np.concatenate([found, _reduced(found * step)])
    return found[:n]


class _Names:
    """Names of all windows of a growing sequence: equal windows have equal names."""

    def __init__(self, base: int):
        self.base = base
        self.inverse = np.ones(0, dtype=np.uint64)
        self.sums = np.zeros(1, dtype=np.uint64)  # of value * base ** place, before each place

    def append(self, values: np.ndarray) -> None:
        n0, n = len(self.sums) - 1, len(self.sums) - 1 + len(values)
        first = np.uint64(pow(self.base, n0, int(_PRIME)))
        powers = _reduced(_powers(self.base, len(values)) * first)
        terms = _reduced(_reduced(values) * powers)
        sums = np.cumsum(np.concatenate([self.sums[-1:], terms]))
        self.sums = np.concatenate([self.sums, _reduced(sums[1:])])
        if len(self.inverse) < n:
            back = pow(self.base, -1, int(_PRIME))
            self.inverse = _powers(back, max(n, 2 * len(self.inverse)))

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        return self._turned(self.sums[start + size] + _PRIME - self.sums[start], self.inverse[start])

    def span(self, first: int, after: int, size: int) -> np.ndarray:
        """The names of the windows that start from `first` on, before `after`."""
        own = self.sums[first + size : after + size] + _PRIME - self.sums[first:after]
        return self._turned(own, self.inverse[first:after])

    @staticmethod
    def _turned(difference: np.ndarray, inverse: np.ndarray) -> np.ndarray:
        return _reduced(_reduced(difference) * inverse)


def _scattered(ids: np.ndarray, seed: int) -> np.ndarray:
    """Every id as a 64-bit number that looks random."""
    x = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class SquareCatcher:
    """Finds the runs of a sequence of numbers that grows by appending, a word or many at a time."""

    def __init__(self, longest: int | None = None, least: int = LEAST, seed: int = 1):
        """`longest`: the longest period that is looked for, else any."""
        self.longest, self.least, self.seed = longest, least, seed
        self.words = np.zeros(0, dtype=np.int64)
        rng = np.random.default_rng(seed)
        self.names = [_Names(int(b)) for b in rng.integers(1 << 20, (1 << 31) - 2, 2)]
        self.seen: list[int] = []  # by level, the windows that its catchers have seen
        self.open: set[tuple[int, int]] = set()  # (period, start) of stretches that reach the end
        self.closed: set[tuple[int, int, int]] = set()
        self.cover_end = np.zeros(0, dtype=np.int64)  # of the run that reaches on farthest,
        self.cover_period = np.ones(0, dtype=np.int64)  # and its period

    def append(self, words: np.ndarray) -> None:
        n0 = len(self.words)
        self.words = np.concatenate([self.words, np.asarray(words, dtype=np.int64)])
        n = len(self.words)
        scattered = _scattered(self.words[n0:], self.seed)
        for names, shift in zip(self.names, (0, 32)):
            names.append((scattered >> np.uint64(shift)) & np.uint64(0xFFFFFFFF))
        self.cover_end = np.concatenate([self.cover_end, np.zeros(n - n0, dtype=np.int64)])
        self.cover_period = np.concatenate([self.cover_period, np.ones(n - n0, dtype=np.int64)])
        for period, start in list(self.open):
            self.open.discard((period, start))
            unlike = np.flatnonzero(self.words[n0:] != self.words[n0 - period : n - period])
            self._settle(period, start, n0 + int(unlike[0]) if len(unlike) else n)
        longest = n if self.longest is None else self.longest
        level, block = 0, LOWEST
        # a level begins, from the first word on, when the text can hold a square of its periods
        while level == 0 or 2 * block <= min(longest, n // 2):
            if level == len(self.seen):
                self.seen.append(0)
            self._compare(level, block, longest)
            level, block = level + 1, 2 * block

    def runs(self) -> np.ndarray:
        """`start, length, period` of the runs so far, by start and period; the text may go on."""
        n = len(self.words)
        found: dict[tuple[int, int], int] = {}
        ended = [(p, s, n) for p, s in self.open if n - s >= max(self.least, 2 * p)]
        for period, start, end in [*self.closed, *ended]:
            extent = start, end
            found[extent] = min(period, found.get(extent, period))
        rows = sorted((s, e - s, p) for (s, e), p in found.items())
        return np.array(rows, dtype=np.int64).reshape(-1, 3)

    def holds(self) -> bool:
        """Whether the found stretches are equal word by word; names alone err once in 2 ** 60."""
        return all(
            np.array_equal(self.words[s + p : s + size], self.words[s : s + size - p])
            for s, size, p in self.runs().tolist()
        )

    def _name(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        low, high = (names.of(start, size) for names in self.names)
        return low << np.uint64(31) | high

    def _windows(self, first: int, after: int, size: int) -> np.ndarray:
        low, high = (names.span(first, after, size) for names in self.names)
        return low << np.uint64(31) | high

    def _compare(self, level: int, block: int, longest: int) -> None:
        """The new windows of a level against its catchers that are live there."""
        first, after = self.seen[level], len(self.words) - block + 1
        if after <= first:
            return
        self.seen[level] = after
        windows = self._windows(first, after, block)
        low = max(0, first // block - 3)
        heads = self._name(np.arange(low, (after - 1) // block + 1) * block, block)
        blocks, periods = [], []
        for back in range(0 if level == 0 else 2, 4):
            start = max(first, back * block)
            if start >= after:
                continue
            lead = np.repeat(heads[start // block - back - low :], block)[start % block :]
            size = after - start
            at = np.flatnonzero(windows[start - first :] == lead[:size]) + start
            blocks.append(at // block - back)
            periods.append(at - (at // block - back) * block)
        if not blocks:
            return
        blocks, periods = np.concatenate(blocks), np.concatenate(periods)
        wanted = (periods > 0) & (periods <= longest)
        if level:  # not those of a run whose period divides this one
            place = blocks * block
            inside = self.cover_end[place] >= place + periods + block
            wanted &= ~(inside & (periods % self.cover_period[place] == 0))
        blocks, periods = blocks[wanted], periods[wanted]
        if len(blocks):
            self._grow(blocks, periods, block)

    def _grow(self, blocks: np.ndarray, periods: np.ndarray, block: int) -> None:
        """Equal blocks as stretches as long as they are equal; neighbouring blocks are one."""
        order = np.lexsort((blocks, periods))
        blocks, periods = blocks[order], periods[order]
        begins = np.ones(len(blocks), dtype=bool)
        begins[1:] = (periods[1:] != periods[:-1]) | (blocks[1:] != blocks[:-1] + 1)
        heads = np.flatnonzero(begins)
        tails = np.append(heads[1:], len(blocks)) - 1
        period, start = periods[heads], blocks[heads] * block
        end = (blocks[tails] + 1) * block
        n = len(self.words)
        start = start - self._equal(start, period, start, block, forward=False)
        end = end + self._equal(end, period, n - period - end, block, forward=True) + period
        whole = (end - start >= np.maximum(self.least, 2 * period)) | (end == n)
        for p, s, e in zip(period[whole].tolist(), start[whole].tolist(), end[whole].tolist()):
            self._settle(p, s, e)

    def _equal(
        self, place: np.ndarray, period: np.ndarray, room: np.ndarray, block: int, forward: bool
    ) -> np.ndarray:
        """How many words on (or back) from each place are equal to those a period later."""
        found = np.zeros(len(place), dtype=np.int64)
        going = np.flatnonzero(room > 0)
        step = block
        while len(going):  # doubled steps while all is equal, which is seldom more than one
            ahead = np.minimum(step, room[going] - found[going])
            same = self._same(place[going], period[going], found[going], ahead, forward)
            found[going[same]] += ahead[same]
            self._bisect(place, period, found, going[~same], ahead[~same], forward)
            going = going[same & (room[going] > found[going])]
            step *= 2
        return found

    def _same(self, place, period, done, size, forward: bool) -> np.ndarray:
        start = place + done if forward else place - done - size
        return self._name(start, size) == self._name(start + period, size)

    def _bisect(self, place, period, found, which, limit, forward: bool) -> None:
        """Adds to `found` how many of less than `limit` more words are equal."""
        low, high = np.zeros(len(which), dtype=np.int64), limit.copy()
        while len(which) and (high - low > 1).any():
            middle = (low + high) // 2
            same = self._same(place[which], period[which], found[which], middle, forward)
            low, high = np.where(same, middle, low), np.where(same, high, middle)
        found[which] += low

    def _settle(self, period: int, start: int, end: int) -> None:
        """A stretch up to `end`: open if that is the end of the text, else whole."""
        if end == len(self.words):
            self.open.add((period, start))
        if end - start >= max(self.least, 2 * period):
            if end < len(self.words):
                self.closed.add((period, start, end))
            farther = self.cover_end[start:end] < end
            self.cover_end[start:end][farther] = end
            self.cover_period[start:end][farther] = period


def sequence_runs(words: np.ndarray, longest: int | None = None, least: int = LEAST) -> np.ndarray:
    """`start, length, period` of all runs of a sequence of numbers, which are not below 0."""
    seed = 1
    while True:
        catcher = SquareCatcher(longest, least, seed)
        catcher.append(words)
        if catcher.holds():
            return catcher.runs()
        seed += 1


def _several(sizes: np.ndarray) -> Iterator[np.ndarray]:
    """Texts of like length together, so that none is looked through for periods beyond it."""
    order = np.argsort(sizes, kind="stable")
    order = order[sizes[order] >= LEAST]
    group: list[int] = []
    held = 0
    for text in order.tolist():
        unlike = group and int(sizes[text]).bit_length() != int(sizes[group[0]]).bit_length()
        if group and (unlike or held + sizes[text] > TOGETHER):
            yield np.array(group)
            group, held = [], 0
        group.append(text)
        held += int(sizes[text]) + 1
    if group:
        yield np.array(group)


def text_runs(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> np.ndarray:
    """`text, start, length, period` of the runs of texts whose word ids lie one behind the other.

    Texts are appended to one catcher with a word of its own behind each, which no run holds.
    """
    begins = np.cumsum(sizes) - sizes
    marks = int(ids.max()) + 1 if len(ids) else 0
    found = [np.zeros((0, 4), dtype=np.int64)]
    for group in _several(sizes):
        own = sizes[group]
        places = np.cumsum(own + 1) - own - 1
        words = np.empty(int((own + 1).sum()), dtype=np.int64)
        words[places + own] = marks + np.arange(len(group))
        inside = np.ones(len(words), dtype=bool)
        inside[places + own] = False
        offsets = np.repeat(begins[group] - places, own + 1) + np.arange(len(words))
        words[inside] = ids[offsets[inside]]
        runs = sequence_runs(words, int(own.max()) // 2, least)
        text = np.searchsorted(places, runs[:, 0], side="right") - 1
        runs[:, 0] -= places[text]
        found.append(np.column_stack([group[text], runs]))
    rows = np.concatenate(found)
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


RUN_TYPE = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts one behind the other, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    words = parts.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    ends = np.cumsum(real)
    offsets = parts.offsets.to_numpy()
    offsets = offsets - offsets[0]
    until = np.concatenate([[0], ends])[offsets]
    return words.filter(pa.array(real)), np.diff(until)


def find_runs(
    docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST
) -> DataFrame:
    """`key, runs, collapsed` of each row.

    `runs` has start, length and period (in words) of every run of `least` words or more, by start and
    period; `collapsed` is the text with the first period of each run only, its words joined by one
    space. A null or empty text has no runs and an empty collapsed text; rows with repeated
    or null keys are answered each; other columns are not read; an empty table gives an empty one. A text
    is worked on whole: it takes some 100 bytes a word, however periodic it is.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes = _words(batch.column(1))
            ids = words.dictionary_encode().indices.to_numpy().astype(np.int64)
            found = text_runs(ids, sizes, least)
            begins = np.cumsum(sizes) - sizes
            depth = np.zeros(len(ids) + 1, dtype=np.int32)
            start = begins[found[:, 0]] + found[:, 1]
            np.add.at(depth, start + found[:, 3], 1)
            np.add.at(depth, start + found[:, 2], -1)
            kept = np.cumsum(depth[:-1]) == 0
            counts = np.concatenate([[0], np.cumsum(kept)])
            offsets = counts[np.append(begins, len(ids))].astype(np.int32)
            left = pa.ListArray.from_arrays(pa.array(offsets), words.filter(pa.array(kept)))
            runs = pa.StructArray.from_arrays(
                [pa.array(found[:, c]) for c in (1, 2, 3)], names=["start", "length", "period"]
            )
            of_text = np.searchsorted(found[:, 0], np.arange(len(sizes) + 1)).astype(np.int32)
            columns = [
                batch.column(0),
                pa.ListArray.from_arrays(pa.array(of_text), runs),
                pc.binary_join(left, " "),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "runs", "collapsed"])

    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema=f"`{key}` {kind}, runs {RUN_TYPE}, collapsed string")
