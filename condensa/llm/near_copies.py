"""Near copies by Jaccard of word shingles: wide SimHash for candidates, exact check, components."""

from __future__ import annotations

from collections.abc import Iterator
from math import acos, ceil, log, log2, pi

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from condensa.llm.common import map_texts
from condensa.llm.graph import components, counted_units, per_unit, stars
from condensa.llm.simhash import first_rows, shingle_hashes
from condensa.session import materialize

SHINGLE = 5
JACCARD = 0.8
#: Expected share of the pairs right at the threshold that meet in some table; closer ones meet more.
RECALL = 0.99
#: Bits of a fingerprint, and how many of them go with a table's rows.
BITS, CARRIED = 512, 128
#: Differing bits, at most, of `CARRIED` and of `BITS`: over four deviations above those at the threshold.
CARRIED_DISTANCE, DISTANCE = 36, 128
#: Members that a bucket has by chance, about; it makes tables few and their bits follow the rows.
BY_CHANCE = 128
#: Members on either side of a unit, for fingerprints and for shingle sets.
CHUNK, SET_CHUNK = 512, 256
#: The number of a table stands above the bits of its keys, which follow the sets up to 10 ** 15 of them.
TABLE_SHIFT = 44
SEED = 42
_SEEDS = np.random.default_rng(SEED).integers(1 << 63, size=BITS // 64, dtype=np.uint64)
_MIX_A, _MIX_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def shingle_set(text: bytes) -> np.ndarray:
    """The distinct hashes of the text's shingles, in order; empty without words."""
    return np.unique(np.array(shingle_hashes(text, SHINGLE), dtype=np.uint64))


def set_id(hashes: np.ndarray) -> int:
    """A signed long that equal sets share; 0 for the empty one."""
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes(), SEED)).view(np.int64)) if len(hashes) else 0


def wide_fingerprint(hashes: np.ndarray) -> bytes:
    """SimHash of `BITS` bits over a set, so that Jaccard bounds the share of bits that differ."""
    counts = np.zeros(BITS, dtype=np.int64)
    for start in range(0, len(hashes), 4080):
        mixed = hashes[start : start + 4080, None] ^ _SEEDS
        mixed ^= mixed >> np.uint64(30)
        mixed *= _MIX_A
        mixed ^= mixed >> np.uint64(27)
        mixed *= _MIX_B
        mixed ^= mixed >> np.uint64(31)
        bits = np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little")
        for part in range(0, len(bits), 255):  # so that a byte holds the sum
            counts += bits[part : part + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").tobytes()


def _prints(texts: list[bytes]) -> list:
    sets = [shingle_set(t) for t in texts]
    ids = np.array([set_id(s) for s in sets], dtype=np.int64)
    return [ids, [wide_fingerprint(s) for s in sets]]


def _ids(texts: list[bytes]) -> list:
    return [np.array([set_id(shingle_set(t)) for t in texts], dtype=np.int64)]


def _sets(texts: list[bytes]) -> list:
    sets = [shingle_set(t) for t in texts]
    ids = np.array([set_id(s) for s in sets], dtype=np.int64)
    return [ids, [wide_fingerprint(s) for s in sets], [s.tobytes() for s in sets]]


def table_layout(n_sets: int, jaccard: float = JACCARD, recall: float = RECALL) -> tuple[int, int]:
    """(bits of a table, tables): bits follow the number of sets, tables the recall.

    Sets of a Jaccard have a cosine of 2J / (1 + J) at least, and a bit differs with probability
    angle / pi.
    """
    bits = max(4, min(TABLE_SHIFT - 1, ceil(log2(max(1, n_sets) / BY_CHANCE))))
    meet = (1 - acos(2 * jaccard / (1 + jaccard)) / pi) ** bits
    return bits, ceil(log(1 - recall) / log(1 - meet))


def table_bits(bits: int, tables: int) -> np.ndarray:
    """The places of each table's bits; tables share none until all `BITS` are taken."""
    random, per = np.random.default_rng(SEED), BITS // bits
    runs = [random.permutation(BITS)[: per * bits].reshape(per, bits) for _ in range(ceil(tables / per))]
    return np.concatenate(runs)[:tables]


def table_keys(wide: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A row of keys, one of each table, for each row of `wide` (octets); the table is in the key."""
    bits = np.unpackbits(wide, axis=1, bitorder="little")
    powers = 1 << np.arange(places.shape[1], dtype=np.int64)
    return bits[:, places] @ powers + (np.arange(len(places), dtype=np.int64) << TABLE_SHIFT)


def _keyed(distinct: DataFrame, places: np.ndarray) -> DataFrame:
    """`_bits, _bucket` and the carried bits `_a, _b`: a row of each set and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                wide = np.frombuffer(b"".join(part.column(1).to_pylist()), dtype=np.uint8)
                wide = wide.reshape(part.num_rows, -1)
                carried = np.ascontiguousarray(wide[:, : CARRIED // 8]).view(np.int64)
                columns = [part.column(0).to_numpy(), *carried.T]
                columns = [np.repeat(c, len(places)) for c in columns]
                columns.insert(1, table_keys(wide, places).ravel())
                names = ["_bits", "_bucket", "_a", "_b"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

    schema = "_bits long, _bucket long, _a long, _b long"
    return distinct.select("_bits", "_wide").mapInArrow(run, schema=schema)


def _candidates(unit: dict[str, np.ndarray], crossed: bool) -> tuple[np.ndarray, ...] | None:
    a, b = unit["_a"].view(np.uint64), unit["_b"].view(np.uint64)
    differ = np.bitwise_count(a[:, None] ^ a) + np.bitwise_count(b[:, None] ^ b)
    close = differ <= CARRIED_DISTANCE
    if crossed:
        close &= unit["side"][:, None] < unit["side"]
    left, right = np.nonzero(close if crossed else np.triu(close, 1))
    return stars(unit["_bits"], left, right) if len(left) else None


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    shared = int((both[1:] == both[:-1]).sum())
    return shared + 1e-9 >= JACCARD * (len(both) - shared)


def _verified(unit: dict[str, np.ndarray], crossed: bool) -> tuple[np.ndarray, ...] | None:
    """Edges that connect what pairs of `JACCARD` do; pairs that are connected are not looked at."""
    wide = np.frombuffer(b"".join(unit["_wide"]), dtype=np.uint64).reshape(len(unit["_wide"]), -1)
    sets = [np.frombuffer(s, dtype=np.uint64) for s in unit["_set"]]
    sizes, side = np.array([len(s) for s in sets]), unit["side"]
    label, left, right = np.arange(len(sets)), [], []
    for i in range(len(sets)):
        later = np.flatnonzero(side > side[i]) if crossed else np.arange(i + 1, len(sets))
        later = later[label[later] != label[i]]
        least, most = np.minimum(sizes[later], sizes[i]), np.maximum(sizes[later], sizes[i])
        later = later[least + 1e-9 >= JACCARD * most]
        later = later[np.bitwise_count(wide[later] ^ wide[i]).sum(axis=1) <= DISTANCE]
        for j in later.tolist():
            if label[i] != label[j] and _similar(sets[i], sets[j]):
                label[label == label[j]] = label[i]
                left.append(i)
                right.append(j)
    return stars(unit["_bits"], np.array(left), np.array(right)) if left else None


def _member_sets(docs: DataFrame, key: str, text: str, members: DataFrame) -> DataFrame:
    """`_bits, _wide, _set, component` of `members` (`_bits, _least, component`), from the texts again."""
    named = members.where("_least IS NOT NULL").select(F.col("_least").alias(key)).distinct()
    found = docs.select(key, text).join(named, key, "left_semi")
    if not members.where("_least IS NULL").isEmpty():
        found = found.unionByName(docs.where(F.col(key).isNull()).select(key, text))
    sets = map_texts(found, key, text, _sets, "_bits long, _wide binary, _set binary", binary=True)
    met = sets.drop(key).join(members.select("_bits", "component"), "_bits")
    return materialize(met.dropDuplicates(["_bits"]), "shingle-sets")


def links(docs: DataFrame, distinct: DataFrame, key: str, text: str) -> DataFrame:
    """Edges `a, b` between sets that connect the pairs of `JACCARD` and more that are candidates.

    Sets that agree in all bits of a table and differ in few carried bits are put into one group.
    Within a group every pair whose fingerprints differ in a quarter of the bits at most is
    checked on the shingle sets themselves, in units of bounded size; no pair is emitted.
    """
    keyed = materialize(_keyed(distinct, table_bits(*table_layout(distinct.count()))), "table-keys")
    units = counted_units(keyed, "_bucket", "_bits", CHUNK)
    near = per_unit(units, ["_bucket"], _candidates, "a long, b long").distinct()
    group = materialize(components(near).withColumnRenamed("node", "_bits"), "candidate-groups")
    members = materialize(distinct.join(group, "_bits").select("_bits", "_least", "component"), "members")
    sets = _member_sets(docs, key, text, members)
    units = counted_units(sets, "component", "_bits", SET_CHUNK)
    return per_unit(units, ["component"], _verified, "a long, b long").distinct()


def near_copy_groups(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """`_bits, _least, _group` of each distinct shingle set: its smallest key, and its group.

    Texts with equal sets go as one, and sets of a Jaccard of `JACCARD` or more link; hashes of 64 bits
    stand for shingles and for sets. Pairs are found with probability `RECALL` right at the
    threshold, and never linked below it. Texts without words (null, empty) are copies of each other.
    """
    prints = map_texts(docs, key, text, _prints, "_bits long, _wide binary", binary=True)
    distinct = prints.groupBy("_bits").agg(F.min(key).alias("_least"), F.first("_wide").alias("_wide"))
    distinct = materialize(distinct, "distinct-sets")
    label = components(links(docs, distinct, key, text)).withColumnRenamed("node", "_bits")
    group = F.coalesce("component", "_bits").alias("_group")
    return materialize(distinct.join(label, "_bits", "left").select("_bits", "_least", group), "groups")


def keep_one_per_group(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, that are the first of their group (the smallest key).

    Rows that repeat the smallest key within one group count as one document: one stays, of the
    smallest set id. A key whose rows are in several groups is answered in each. Rows with a null key
    stay, as nothing says what they repeat.
    """
    groups = near_copy_groups(docs, key, text)
    return first_rows(docs, key, text, groups, _ids)
