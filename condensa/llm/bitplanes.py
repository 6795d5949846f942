"""Token ids in files of compressed bit planes.

A file is Parquet, so that Spark's committer makes writing safe on any shared store. A row is a
chunk: whole documents in key order, cut into blocks of a fixed number of ids. Each block is
transposed to bit planes (plane b holds bit b of every id; the last block is filled with zeros), and
each plane is compressed with zstandard, so a block can be read without the others. The columns
besides the planes are the chunk index: shard, chunk, first and last key, ids before it in the shard,
number of ids, and per document its key and number of ids.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from condensa.llm.common import parallelism
from condensa.llm.pieces import (
    WORD_END,
    ChunkCache,
    as_bytes,
    load_tokenizer,
    merge_ranks,
    special_strings,
)

#: Bytes of texts that are encoded together, a longer text by itself.
GROUP_BYTES = 8 << 20
#: Characters of a text that the borders between rows of one key are made of.
BORDER_CHARS = 64
BLOCK_IDS = 65_536  # a multiple of 8
CHUNK_IDS = 1 << 20
LEVEL = 3


#: Below this character, and but for the one exception, lower case is the same everywhere.
PLAIN, EXCEPT = "\u0250", "\u0130"


class UnspacedEncoder:
    """Ids, as little-endian 32-bit bytes, of a tokenizer that drops white space.

    A chunk between spaces has the same ids everywhere. New chunks of plain letters are cut by the
    file's own pattern in lower case, so that each word is encoded once, whatever its case and the
    marks next to it; other chunks, and texts that hold a special token, go to the tokenizers library.
    Where the ids of the file are the order of its merges, words are merged by tiktoken from the file's
    own vocabulary, which gives the library's ids at a small part of its time; a word that is a token
    by itself is asked from the library, as the two take different ways to it.
    """

    def __init__(self, path: str):
        self.tokenizer = load_tokenizer(path)
        self.special = special_strings(path)
        self.cache = ChunkCache(self._chunks)
        ranks = merge_ranks(path)
        if ranks:
            merges = tiktoken.Encoding("file", pat_str=".", mergeable_ranks=ranks, special_tokens={})
            self.merge = merges._core_bpe.encode_single_piece
        self.words = ChunkCache(self._merged if ranks else self._ids)
        with open(path, encoding="utf-8") as file:
            steps = json.load(file)
        splits = steps["pre_tokenizer"]["pretokenizers"]
        self.pattern = regex.compile(splits[0]["pattern"]["Regex"])

    def _ids(self, asked: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(asked, add_special_tokens=False)
        return [as_bytes(f.ids) for f in found]

    def _merged(self, asked: list[str]) -> list[bytes]:
        found = [self.merge(word.encode() + WORD_END) for word in asked]
        single = iter(self._ids([word for word, ids in zip(asked, found) if len(ids) == 1]))
        return [as_bytes(ids) if len(ids) > 1 else next(single) for ids in found]

    def _chunks(self, asked: list[str]) -> list[bytes]:
        plain = [
            c.isascii() or (max(c) < PLAIN and EXCEPT not in c and is_normalized("NFC", c))
            for c in asked
        ]
        words = [self.pattern.findall(c.lower()) if p else [] for c, p in zip(asked, plain)]
        known = iter(self.words.values([w for found in words for w in found]))
        others = iter(self._ids([c for c, p in zip(asked, plain) if not p]))
        return [
            b"".join(islice(known, len(found))) if p else next(others)
            for found, p in zip(words, plain)
        ]

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The numbers of ids of neighbouring texts, and their ids one behind the other.

        Chunks are told apart and put together again by Arrow; only distinct ones are looked up. Texts that
        hold a special token go to the library whole.
        """
        for start, end in _bounded(texts):
            group = texts[start:end]
            marked = np.zeros(len(group), dtype=bool)
            for string in self.special:
                marked |= pc.match_substring(group, string).to_numpy(zero_copy_only=False).astype(bool)
            for first, after in _stretches(marked):
                part = group[first:after]
                if marked[first]:
                    ids = self._ids(part.to_pylist())
                    yield np.array([len(i) // 4 for i in ids]), np.frombuffer(b"".join(ids), "<u4")
                else:
                    yield self._chunked(part)

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        coded = parts.flatten().dictionary_encode()
        known = self.cache.values(coded.dictionary.to_pylist())
        ends = np.cumsum([0, *map(len, known)]) // 4
        lists = pa.ListArray.from_arrays(
            pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(known), "<u4"))
        )
        before = np.concatenate([[0], np.cumsum(np.diff(ends)[coded.indices.to_numpy()])])
        offsets = parts.offsets.to_numpy()
        return np.diff(before[offsets - offsets[0]]), lists.take(coded.indices).flatten().to_numpy()


def _bounded(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of neighbouring texts of `GROUP_BYTES` together at most, or of one text."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, before + GROUP_BYTES, side="right")))
        yield start, end
        start = end


def _stretches(marked: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of neighbours that are all marked or all not."""
    changes = np.flatnonzero(marked[1:] != marked[:-1]) + 1
    bounds = [0, *changes.tolist(), len(marked)]
    return list(zip(bounds, bounds[1:]))


@lru_cache(maxsize=2)
def unspaced_encoder(path: str) -> UnspacedEncoder:
    return UnspacedEncoder(path)


def _bit_transpose(octets: np.ndarray) -> np.ndarray:
    """Each run of 8 bytes as an 8 x 8 bit matrix, transposed (three swaps of off-diagonal parts)."""
    x = octets.view("<u8")
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        moved = (x ^ (x >> np.uint64(shift))) & np.uint64(mask)
        x = x ^ moved ^ (moved << np.uint64(shift))
    return x.view(np.uint8)


def to_planes(ids: np.ndarray, width: int, block: int = BLOCK_IDS) -> list[bytes]:
    """Compressed bit planes of the ids: `width` of each block, lowest bit first, block by block."""
    compress = zstandard.ZstdCompressor(level=LEVEL).compress
    planes = []
    for start in range(0, len(ids), block):
        padded = np.zeros(block, dtype="<u4")
        part = ids[start : start + block]
        padded[: len(part)] = part
        octets = padded.view(np.uint8).reshape(-1, 4)
        for byte in range(-(-width // 8)):
            turned = _bit_transpose(np.ascontiguousarray(octets[:, byte])).reshape(-1, 8)
            bits = range(min(8, width - 8 * byte))
            planes += [compress(np.ascontiguousarray(turned[:, b])) for b in bits]
    return planes


def from_planes(planes: list[bytes], n_ids: int, width: int, block: int = BLOCK_IDS) -> np.ndarray:
    """The ids that `to_planes` was given."""
    decompress = zstandard.ZstdDecompressor().decompress
    found = []
    for start in range(0, len(planes), width):
        octets = np.zeros((block, 4), dtype=np.uint8)
        for byte in range(-(-width // 8)):
            turned = np.zeros((block // 8, 8), dtype=np.uint8)
            for b in range(min(8, width - 8 * byte)):
                turned[:, b] = np.frombuffer(decompress(planes[start + 8 * byte + b]), dtype=np.uint8)
            octets[:, byte] = _bit_transpose(turned.reshape(-1))
        found.append(octets.reshape(-1).view("<u4"))
    return np.concatenate(found)[:n_ids] if found else np.zeros(0, dtype="<u4")


KINDS = (pa.int32(), pa.int64(), pa.int32())


def _with_ends(sizes: np.ndarray, ids: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The sizes and ids of texts with `end_id` behind each."""
    ends = np.cumsum(sizes + 1) - 1
    found = np.empty(len(ids) + len(sizes), dtype="<u4")
    inside = np.ones(len(found), dtype=bool)
    inside[ends] = False
    found[inside], found[ends] = ids, end_id
    return sizes + 1, found


def _one_list(values: pa.Array) -> pa.Array:
    """A column of one row that holds the values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


CHUNK_SCHEMA = (
    "shard int, chunk int, first_key {kind}, last_key {kind}, ids_before long, n_ids long,"
    " width int, block_ids int, doc_keys array<{kind}>, doc_ids array<long>, planes array<binary>"
)


def write_ids(
    docs: DataFrame,
    tokenizer: str,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    end_id: int = 1,
    width: int = 16,
    block_ids: int = BLOCK_IDS,
    chunk_ids: int = CHUNK_IDS,
) -> None:
    """Writes the ids of every whole text, each with `end_id` behind, in ascending key order.

    Texts are dealt by ranges, one shard a range, and encoded after that: the texts move once and
    ids never do. A chunk is closed when it has `chunk_ids` ids, so a task holds one chunk and one
    group of documents. Null texts count as empty; a null key sorts first; rows of equal keys follow the first
    characters and a hash of their texts, and may lie in several shards. Other columns are not read, an empty
    table gives no chunks, a long text is encoded whole. `width` bits must hold every id, else writing fails.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumns(
        {
            "_start": F.substring("_text", 1, BORDER_CHARS),
            "_hash": F.xxhash64("_text"),
            "_tie": F.monotonically_increasing_id(),
        }
    )
    order = ["_key", "_start", "_hash", "_tie"]
    dealt = rows.repartitionByRange(parallelism(docs), *order).sortWithinPartitions(*order)
    dealt = dealt.select("_key", "_text")

    schema = CHUNK_SCHEMA.format(kind=kind)
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = unspaced_encoder(tokenizer).encode
        shard = TaskContext.get().partitionId()
        sizes: list[np.ndarray] = []
        parts: list[np.ndarray] = []
        keys: list[pa.Array] = []
        chunk = before = held = 0

        def closed() -> pa.RecordBatch:
            ids = np.concatenate(parts)
            if int(ids.max()) >> width:
                raise ValueError(f"an id does not fit into {width} bits")
            own = pa.concat_arrays(keys)
            numbers = [shard, chunk], [before, len(ids)], [width, block_ids]
            small, large, fixed = ([pa.array([n], k) for n in ns] for ns, k in zip(numbers, KINDS))
            lists = [_one_list(own), _one_list(pa.array(np.concatenate(sizes), pa.int64()))]
            planes = _one_list(pa.array(to_planes(ids, width, block_ids), pa.binary()))
            columns = [*small, own[:1], own[-1:], *large, *fixed, *lists, planes]
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in batches:
            place = 0
            for lengths, ids in encode(batch.column(1)):
                lengths, ids = _with_ends(lengths, ids, end_id)
                ends = np.cumsum(lengths)
                first = 0
                while first < len(lengths):
                    done = ends[first - 1] if first else 0
                    after = int(np.searchsorted(ends, done + chunk_ids - held)) + 1
                    full, after = after <= len(lengths), min(after, len(lengths))
                    sizes.append(lengths[first:after])
                    parts.append(ids[done : ends[after - 1]])
                    keys.append(batch.column(0)[place + first : place + after])
                    held += int(ends[after - 1] - done)
                    first = after
                    if full:
                        yield closed()
                        chunk, before, held = chunk + 1, before + held, 0
                        keys, sizes, parts = [], [], []
                place += len(lengths)
        if parts:
            yield closed()

    dealt.mapInArrow(run, schema=schema).write.option("compression", "uncompressed").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index with `start`: the ids of all chunks before, over all shards.

    Only shard totals, one row a shard, meet in one task.
    """
    index = spark.read.parquet(path).drop("planes", "doc_keys", "doc_ids")
    totals = index.groupBy("shard").agg(F.sum("n_ids").alias("_total"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("shard", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_start"))
    return index.join(starts, "shard").withColumn("start", F.col("_start") + F.col("ids_before")).drop("_start")


def _read_chunks(batch: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, pa.Array]]:
    """Of each chunk its index entries, ids and document keys."""
    for place in range(batch.num_rows):
        one = batch.slice(place, 1)
        keys = one.column("doc_keys").flatten()
        row = one.drop_columns(["doc_keys"]).to_pylist()[0]
        yield row, from_planes(row["planes"], row["n_ids"], row["width"], row["block_ids"]), keys


def read_documents(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """`key, start, n_tokens, ids_crc32` of every document, from the planes in the files."""
    chunks = spark.read.parquet(path)
    kind = chunks.schema["first_key"].dataType.simpleString()
    starts = read_index(spark, path).select("shard", "chunk", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, keys in _read_chunks(batch):
                sizes = np.array(row["doc_ids"], dtype=np.int64)
                ends = np.cumsum(sizes)
                crc = [zlib.crc32(ids[e - n : e].tobytes()) for n, e in zip(sizes, ends)]
                place = [np.full(len(sizes), row[c], dtype=np.int32) for c in ("shard", "chunk")]
                columns = [pa.array(c) for c in (*place, ends - sizes, sizes, crc)]
                yield pa.RecordBatch.from_arrays([keys, *columns], names=names)

    names = [key, "_shard", "_chunk", "_at", "n_tokens", "ids_crc32"]
    schema = f"`{key}` {kind}, _shard int, _chunk int, _at long, n_tokens long, ids_crc32 long"
    read = chunks.select("shard", "chunk", "n_ids", "width", "block_ids", "doc_keys", "doc_ids", "planes")
    docs = read.mapInArrow(run, schema=schema)
    place = (F.col("_shard") == F.col("shard")) & (F.col("_chunk") == F.col("chunk"))
    return docs.join(starts, place).select(
        key, (F.col("start") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_ids(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """`key, ids`: the ids themselves, one row per document."""
    kind = spark.read.parquet(path).schema["first_key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, ids, keys in _read_chunks(batch):
                ends = np.cumsum([0, *row["doc_ids"]]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([keys, lists], names=[key, "ids"])

    read = spark.read.parquet(path).select("n_ids", "width", "block_ids", "doc_keys", "doc_ids", "planes")
    return read.mapInArrow(run, schema=f"`{key}` {kind}, ids array<int>")
