"""Byte-level BPE by a rank queue of hierarchical bitmaps, and decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from condensa.llm.common import map_texts
from condensa.llm.pieces import ChunkCache, SpacedChunks, as_bytes

#: Bits of a bitmap word: one word on a level says which words below it are not empty.
WORD = 64
SHIFT, LOW = 6, 63


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file with a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class RankQueue:
    """Places waiting under merge ranks; the smallest rank is found first.

    Three levels of 64-bit words: a bit of the lowest level says that a rank's bucket holds places,
    a bit above that a word below is not zero. The next rank is found by three find-first-set
    steps, whatever the number of ranks and places. Levels are sparse, so few ranks touch few words.
    Holds ranks below 64 ** 3.
    """

    def __init__(self) -> None:
        self.top = 0
        self.middle: dict[int, int] = {}
        self.low: dict[int, int] = {}
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, place: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(place)
        else:
            self.put(rank, [place])

    def put(self, rank: int, places: list[int]) -> None:
        """Places under a rank that has none."""
        self.buckets[rank] = places
        word = rank >> SHIFT
        self.low[word] = self.low.get(word, 0) | 1 << (rank & LOW)
        above = word >> SHIFT
        self.middle[above] = self.middle.get(above, 0) | 1 << (word & LOW)
        self.top |= 1 << above

    def pop(self) -> tuple[int, list[int]]:
        """The smallest rank and its places, from left to right."""
        above = (self.top & -self.top).bit_length() - 1
        bits = self.middle[above]
        word = (above << SHIFT) + (bits & -bits).bit_length() - 1
        bits = self.low[word]
        rank = (word << SHIFT) + (bits & -bits).bit_length() - 1
        self.low[word] = bits = bits & (bits - 1)
        if not bits:
            self.middle[above] = bits = self.middle[above] & (self.middle[above] - 1)
            if not bits:
                self.top &= self.top - 1
        places = self.buckets.pop(rank)
        places.sort()
        return rank, places


def pair_table(ranks: dict[bytes, int]) -> np.ndarray:
    """The rank of every pair of bytes, -1 where they are no token."""
    table = np.full(1 << 16, -1, dtype=np.int32)
    for token, rank in ranks.items():
        if len(token) == 2:
            table[token[0] << 8 | token[1]] = rank
    return table


def _first_ranks(data: bytes, starts: bytearray, two: np.ndarray) -> np.ndarray:
    """Ranks of the pairs of neighbouring bytes; -1 across pieces and for the last byte."""
    octets = np.frombuffer(data, dtype=np.uint8).astype(np.int32)
    found = np.full(len(octets), -1, dtype=np.int32)
    found[:-1] = two[octets[:-1] << 8 | octets[1:]]
    found[np.frombuffer(starts, dtype=np.uint8)[1:] == 1] = -1
    return found


def merge(pieces: list[bytes], ranks: dict[bytes, int], two: np.ndarray) -> list[list[int]]:
    """Ids of pre-tokens: in each, the pair of smallest rank, leftmost first, until none is left.

    All pieces go through one queue, which shares its cost among short ones: merges of one piece do
    not touch another, so the common order is the right one in each. Symbols are a linked list over
    the places where they start. An entry is stale when the pair at its place has another rank by
    now, and is skipped; n bytes make at most 3 n entries. A merge that leads to a smaller rank
    puts the rest of its bucket back.
    """
    data = b"".join(pieces)
    n = len(data)
    if not n:
        return [[] for _ in pieces]
    bounds = [0, *accumulate(map(len, pieces))]
    starts = bytearray(n + 1)  # whether a piece starts (or all end) here
    for bound in bounds:
        starts[bound] = 1
    end = list(range(1, n + 1))  # of the symbol that starts here
    before = list(range(-1, n - 1))  # start of the symbol before, in the same piece or not
    first_ranks = _first_ranks(data, starts, two)
    pair = first_ranks.tolist()  # rank of the pair that starts here
    queue, get = RankQueue(), ranks.get
    order = np.argsort(first_ranks, kind="stable")
    cuts = np.flatnonzero(np.diff(first_ranks[order], prepend=-2))
    for places in np.split(order, cuts[1:]):
        if pair[places[0]] >= 0:
            queue.put(pair[places[0]], places.tolist())
    push = queue.push
    while queue.top:
        rank, places = queue.pop()
        for nth, place in enumerate(places):
            if pair[place] != rank:
                continue
            second = end[place]
            after = end[place] = end[second]
            pair[second] = -1
            lower = False
            if starts[after]:
                pair[place] = -1
                if after < n:
                    before[after] = place
            else:
                before[after] = place
                made = pair[place] = get(data[place : end[after]], -1)
                if made >= 0:
                    push(made, place)
                    lower = made < rank
            if not starts[place]:
                first = before[place]
                made = pair[first] = get(data[first:after], -1)
                if made >= 0:
                    push(made, first)
                    lower = lower or made < rank
            if lower and nth + 1 < len(places):
                queue.put(rank, places[nth + 1 :])
                break
    found = []
    for start, stop in zip(bounds, bounds[1:]):
        ids, place = [], start
        while place < stop:
            ids.append(ranks[data[place : end[place]]])
            place = end[place]
        found.append(ids)
    return found


class ByteBpe:
    """Encodes whole texts, each match of `pattern` by itself, and decodes ids.

    Chunks between single spaces go through a bounded cache; so do the pre-tokens within them.
    """

    def __init__(self, path: str, pattern: str):
        self.ranks = read_ranks(path)
        self.two = pair_table(self.ranks)
        self.pattern = regex.compile(pattern)
        size = max(self.ranks.values(), default=-1) + 1
        self.tokens = [b""] * size
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.numbers = [str(i) for i in range(size)]
        self.merged = ChunkCache(self._merge)
        self.chunks = SpacedChunks(self._chunk)

    def _merge(self, asked: list[str]) -> list[bytes]:
        """A piece that is a token is that token; the others are merged together."""
        pieces = [piece.encode() for piece in asked]
        whole = [self.ranks.get(piece) for piece in pieces]
        merged = iter(merge([p for p, w in zip(pieces, whole) if w is None], self.ranks, self.two))
        return [as_bytes(next(merged) if w is None else [w]) for w in whole]

    def _chunk(self, asked: list[str]) -> list[bytes]:
        found = list(map(self.pattern.findall, asked))
        merged = iter(self.merged.values([piece for pieces in found for piece in pieces]))
        return [b"".join(islice(merged, len(pieces))) for pieces in found]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        for ids in self.chunks.encode(texts):
            yield np.frombuffer(ids, dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))

    def decimal(self, ids: np.ndarray) -> bytes:
        return ",".join(map(self.numbers.__getitem__, ids.tolist())).encode()


@lru_cache(maxsize=2)
def byte_bpe(path: str, pattern: str) -> ByteBpe:
    return ByteBpe(path, pattern)


def encode_texts(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key, ids` (array of int) of each whole text, without special tokens; null counts as empty."""

    def run(texts: list[str]) -> list:
        bpe = byte_bpe(path, pattern)
        return [[ids.astype(np.int32) for ids in bpe.encode(texts)]]

    return map_texts(docs, key, text, run, "ids array<int>")


def decode_ids(
    encoded: DataFrame, path: str, pattern: str, key: str = "doc_id", ids: str = "ids"
) -> DataFrame:
    """`key, bytes` of id arrays; null counts as empty, an id that the file lacks is an error."""
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path, pattern)
        for batch in batches:
            decoded = [bpe.decode(np.array(i or [], dtype=np.int64)) for i in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(decoded, pa.binary())], names=[key, "bytes"]
            )

    return encoded.select(key, ids).mapInArrow(run, schema=f"`{key}` {kind}, bytes binary")


def roundtrip_digests(
    docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """`key, n_tokens, ids_sha256, decoded_sha256` of each row: encoded, then decoded from the ids.

    The digests are of the decimal ids joined by commas and of the decoded bytes; only they leave
    the task. A null or empty text has no ids. Repeated rows and null keys are answered each.
    """

    def run(texts: list[str]) -> list:
        bpe = byte_bpe(path, pattern)
        sizes, encoded, decoded = [], [], []
        for ids in bpe.encode(texts):
            sizes.append(len(ids))
            encoded.append(hashlib.sha256(bpe.decimal(ids)).hexdigest())
            decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
        return [sizes, encoded, decoded]

    return map_texts(
        docs, key, text, run, "n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
