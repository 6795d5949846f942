"""Best-fit packing planned on a histogram of lengths; documents then take the planned slots."""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from condensa.llm.common import parallelism
from condensa.llm.pieces import SpacedChunks, as_bytes, load_tokenizer, merge_ranks, special_pattern
from condensa.session import materialize

CAPACITY = 2048
END_ID = 0


class SpacedEncoder:
    """Ids, as little-endian 32-bit bytes, of a byte-level tokenizer file that keeps spaces.

    Where the ids of the file are the order of its merges, new chunks are merged by tiktoken from the
    file's own vocabulary, which gives the ids of the tokenizers library at a third of its time;
    otherwise by the library itself. Texts that hold a special token always go to the library.
    """

    def __init__(self, path: str, pattern: str):
        self.path = path
        self.special = special_pattern(path)
        ranks = merge_ranks(path)
        if ranks:
            merges = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            self.chunks = SpacedChunks(
                lambda asked: [as_bytes(merges.encode_ordinary(c)) for c in asked]
            )
        else:
            self.chunks = SpacedChunks(self._ids)

    @cached_property
    def tokenizer(self):
        """The library's tokenizer, which many tasks never need."""
        return load_tokenizer(self.path)

    def _ids(self, asked: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
        return [as_bytes(f.ids) for f in found]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; texts that hold a special token go to the library whole."""
        marked = [bool(self.special and self.special.search(t)) for t in texts]
        plain = self.chunks.encode([t for t, m in zip(texts, marked) if not m])
        for text, mark in zip(texts, marked):
            yield self._ids([text])[0] if mark else next(plain)


@lru_cache(maxsize=2)
def spaced_encoder(path: str, pattern: str) -> SpacedEncoder:
    return SpacedEncoder(path, pattern)


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of `n` ids: the first one takes what is over."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    whole = [(s, capacity) for s in range(first, n, capacity)]
    return ([(0, first)] if first else []) + whole


def token_pieces(
    docs: DataFrame, tokenizer: str, pattern: str, key: str, text: str, capacity: int, end_id: int
) -> DataFrame:
    """`key, piece, start, length, ids_crc32`: no ids leave the tasks."""
    kind = docs.schema[key].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()
    names = ["piece", "start", "length", "ids_crc32"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = spaced_encoder(tokenizer, pattern).encode
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for place, ids in enumerate(encode(texts)):
                ids += end
                for piece, (start, length) in enumerate(cut_points(len(ids) // 4, capacity)):
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    rows.append((place, piece, start, length, crc))
            places, *columns = zip(*rows) if rows else [()] * 5
            keys = batch.column(0).take(pa.array(places, pa.int64()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            values = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([keys, *values], names=[key, *names])

    rows = docs.select(key, F.col(text).cast("string").alias("_text"))
    schema = f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long"
    return rows.mapInArrow(cut, schema=schema)


def plan_slots(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts.

    Rows (length, first rank, ranks, first sequence, per sequence, offset): of that length, the
    documents of these ranks go to consecutive sequences, so many to each, from the offset on.
    Open sequences are runs of equal ones, so the work and the plan depend on the number of
    lengths, not of documents.
    """
    plan = []
    runs: list[tuple[int, int, int]] = []  # (free, first sequence, sequences), sorted
    opened = 0

    def put(free: int, first: int, many: int) -> None:
        if free > 0 and many > 0:
            insort(runs, (free, first, many))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(runs, (length, -1, -1))
            if at < len(runs):
                free, first, many = runs.pop(at)
            else:
                each = capacity // length
                free, first, many = capacity, opened, -(-left // each)
                opened += many
            each = free // length
            full = min(many, left // each)
            used = capacity - free
            if full:
                plan.append((length, rank, full * each, first, each, used))
                put(free - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if left and full < many:
                plan.append((length, rank, left, first + full, left, used))
                put(free - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            if full < many:
                put(free, first + full, many - full)
    return plan


PLAN_SCHEMA = (
    "length long, first_rank long, ranks long, first_sequence long, per_sequence long, at long"
)


def _ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """`_rank` from 0 within each length, without bringing a length to one task.

    Rows of a length are dealt to buckets by hash; the rank in the bucket adds to the number of
    rows in the buckets before. Only counts, a row per length and bucket, meet per length.
    """
    buckets = parallelism(pieces)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = dealt.groupBy("length", "_bucket").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        "length", "_bucket", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    own = Window.partitionBy("length", "_bucket").orderBy(*order)
    ranked = dealt.withColumn("_own", F.row_number().over(own) - 1)
    return ranked.join(offsets, ["length", "_bucket"]).select(
        *pieces.columns, (F.col("_before") + F.col("_own")).alias("_rank")
    )


def pack(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """One row per piece: `key, piece, start, length, ids_crc32, sequence_id, offset`.

    A document is its ids and the end id; a null text counts as empty. The histogram (at most
    `capacity` rows) is planned on the driver, and the plan, whose size follows the number of
    lengths, is broadcast. Rows that repeat a document are packed each; equal pieces are told apart
    by their rank only. Null keys are packed too. Other columns are not read.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer, pattern, key, text, capacity, end_id), "pieces")
    counted = pieces.groupBy("length").count().collect()
    plan = plan_slots({r["length"]: r["count"] for r in counted}, capacity)
    return place(spark, pieces, plan, [key, "piece", "start", "ids_crc32"])


def place(spark: SparkSession, pieces: DataFrame, plan: list[tuple], order: list[str]) -> DataFrame:
    """Joins ranked pieces with the slots of their length."""
    slots = spark.createDataFrame(plan, PLAN_SCHEMA).withColumnRenamed("length", "_length")
    within = F.col("_rank") - F.col("first_rank")
    met = _ranked(pieces, order).join(
        F.broadcast(slots),
        (F.col("length") == F.col("_length")) & (within >= 0) & (within < F.col("ranks")),
    )
    return met.select(
        *pieces.columns,
        (F.col("first_sequence") + F.floor(within / F.col("per_sequence"))).alias("sequence_id"),
        (F.col("at") + within % F.col("per_sequence") * F.col("length")).alias("offset"),
    )
