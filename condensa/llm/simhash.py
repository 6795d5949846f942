"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from condensa.llm.common import fresh, map_texts
from condensa.llm.graph import CHUNK, components, per_unit, shared_units, stars
from condensa.session import materialize

BITS = 64
SEED = 42
SHINGLE = 4
DISTANCE = 4
BLOCKS = 7


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> list[int]:
    """XXH64 of each run of `shingle` words, or of all words if they are fewer; none without words.

    A-Z are lower-cased; `bytes.split` cuts at just 0x20 and 0x09-0x0D. A shingle of the text
    whose words are joined by one space is a slice of it. Memory is a few words per shingle.
    """
    parts = text.lower().split()
    if not parts:
        return []
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= shingle:
        return [digest(joined, SEED)]
    starts, ends, at = [], [], 0
    for part in parts:
        starts.append(at)
        at += len(part)
        ends.append(at)
        at += 1
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :])]


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64 bits: each is 1 where over half of the shingles' XXH64 have it; 0 without words."""
    hashes = shingle_hashes(text, shingle)
    if not hashes:
        return 0
    octets = np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8)
    set_bits = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(octets), 65_536):
        part = octets[start : start + 65_536]
        set_bits += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    packed = np.packbits(2 * set_bits > len(hashes), bitorder="little")
    return int.from_bytes(packed.tobytes(), "little")


def _fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`key, _bits` (the fingerprint as a signed long); a null text counts as empty."""
    return map_texts(docs, key, text, _fingerprints, "_bits long", binary=True)


def block_masks(distance: int = DISTANCE, blocks: int = BLOCKS) -> list[int]:
    """Masks of `blocks - distance` blocks: bits that a pair within `distance` shares for one.

    `distance` differing bits touch at most so many blocks, and the others agree. Keys of several
    blocks are what keeps chance meetings rare when there are many fingerprints.
    """
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    single = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:])]
    return [sum(chosen) for chosen in combinations(single, blocks - distance)]


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def hex_digits(bits: Column) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def _linked(distance: int):
    def edges(unit: dict[str, np.ndarray], crossed: bool) -> tuple[np.ndarray, ...] | None:
        bits = unit["_bits"]
        own = bits.view(np.uint64)
        close = np.bitwise_count(own[:, None] ^ own[None, :]) <= distance
        if crossed:
            close &= unit["side"][:, None] < unit["side"][None, :]
        left, right = np.nonzero(close if crossed else np.triu(close, 1))
        return stars(bits, left, right) if len(left) else None

    return edges


def fingerprint_links(
    distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS
) -> DataFrame:
    """Edges `a, b` between fingerprints (`_bits`, distinct) that connect all within `distance`.

    One row per fingerprint and block combination meets its bucket, which is a hash of both: buckets that
    share one are searched together. Pairs are checked in arrays within units of bounded size
    (`graph.shared_units`), and each unit gives at most one edge per member, not its pairs.
    """
    masks = [_signed(m) for m in block_masks(distance, blocks)]
    keyed = distinct.select(
        "_bits", F.posexplode(F.array(*[F.lit(m).cast("long") for m in masks])).alias("_table", "_m")
    ).select("_bits", F.struct("_table", F.col("_bits").bitwiseAND(F.col("_m")).alias("_key")).alias("_bucket"))
    keyed = keyed.select("_bits", F.xxhash64("_bucket").alias("_bucket"))
    units = shared_units(keyed, "_bucket", "_bits", CHUNK)
    return per_unit(units, ["_bucket"], _linked(distance), "a long, b long").distinct()


def simhash_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """`key, fingerprint, component_id` for every row of `docs`.

    Rows link when their fingerprints differ in at most `distance` bits; `component_id` is the
    smallest key reachable. Exact: blocks miss no pair, and no bucket is capped. Texts without
    words (null, empty) have fingerprint zero and link like any other. Copies share a fingerprint
    and go as one; rows that repeat a key are answered each. A null key gets a row, and a component
    in which every key is null has a null id. Other columns are not read.
    """
    prints, grouped = _grouped(docs, key, text, distance, blocks)
    least = grouped.groupBy("_group").agg(F.min("_least").alias("component_id"))
    by_bits = grouped.join(least, "_group").select("_bits", "component_id")
    return prints.join(by_bits, "_bits").select(
        key, hex_digits(F.col("_bits")).alias("fingerprint"), "component_id"
    )


def _grouped(
    docs: DataFrame, key: str, text: str, distance: int = DISTANCE, blocks: int = BLOCKS
) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and `_bits, _least, _group` of each distinct one with its smallest key."""
    prints = materialize(fingerprints(docs, key, text), "fingerprints")
    distinct = prints.groupBy("_bits").agg(F.min(key).alias("_least"))
    distinct = materialize(distinct, "distinct-fingerprints")
    label = components(fingerprint_links(distinct.select("_bits"), distance, blocks))
    label = label.withColumnRenamed("node", "_bits")
    group = F.coalesce("component", "_bits").alias("_group")
    grouped = materialize(distinct.join(label, "_bits", "left").select("_bits", "_least", group), "groups")
    return prints, grouped


def keep_one_per_group(
    docs: DataFrame, key: str = "doc_id", text: str = "text", **settings: int
) -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their group (the smallest key).

    Rows that repeat the smallest key within one group count as one document: one stays, of the
    smallest fingerprint. A key whose rows are in several groups is answered in each. Rows with a null
    key stay, as nothing says what they repeat.
    """
    _, groups = _grouped(docs, key, text, **settings)
    return first_rows(docs, key, text, groups, _fingerprints)


def first_rows(
    docs: DataFrame, key: str, text: str, groups: DataFrame, prints: Callable[[list[bytes]], list]
) -> DataFrame:
    """One row of each group, of its smallest key and then print, and the rows with a null key.

    `groups` (`_bits, _least, _group`) has every print of `docs` with its smallest key, and `prints`
    gives the prints of texts. A key of one row has one print, so only rows of repeated keys are
    read for it.
    """
    least = F.when(F.col("_least").isNotNull(), F.struct("_least", "_bits"))
    first = groups.groupBy("_group").agg(F.min(least).alias("_first")).where("_first IS NOT NULL")
    first = first.select(F.col("_first._least").alias(key), F.col("_first._bits").alias("_bits"))
    rest = [c for c in docs.columns if c != key]
    named = docs.where(F.col(key).isNotNull())
    once = named.join(first.select(key).distinct(), key, "left_semi")
    mark = fresh("_copies", docs.columns)
    repeated = materialize(
        named.groupBy(key).agg(F.count("*").alias(mark)).where(f"{mark} > 1").select(key),
        "repeated-keys",
    )
    if not repeated.isEmpty():
        single = once.join(repeated, key, "left_anti")
        own = fresh("_print", docs.columns)
        twice = with_prints(once.join(repeated, key, "left_semi"), text, prints, own)
        twice = twice.join(first.withColumnRenamed("_bits", own), [key, own], "left_semi")
        one = twice.groupBy(key, own).agg(F.min(F.struct(*rest)).alias(mark))
        one = one.select(key, *[F.col(f"{mark}.`{c}`").alias(c) for c in rest])
        once = single.select(*docs.columns).unionByName(one.select(*docs.columns))
    return once.select(*docs.columns).unionByName(docs.where(F.col(key).isNull()))


def with_prints(
    docs: DataFrame, text: str, prints: Callable[[list[bytes]], list], name: str
) -> DataFrame:
    """`docs` with the prints of its texts (a null one counts as empty) as the column `name`."""
    place = docs.columns.index(text)
    schema = StructType([*docs.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(place).to_pylist()]
            columns = [*batch.columns, pa.array(prints(texts)[0])]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.mapInArrow(run, schema=schema)
