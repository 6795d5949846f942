"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, exact rerank.

Codes are signs of centred vectors under rotations that ITQ learned, so their bits are balanced whatever
direction the vectors share. A table is a substring of the code; a vector is filed under its own key and
under the one in which its least certain bit is turned. Vectors of a bucket are compared by their whole
codes, and only those near another by Hamming distance get their vectors, which decide. How many tables and
which distance it takes is measured on pairs that are planted around the sample, at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log2

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from condensa.llm.common import parallelism
from condensa.llm.graph import components, counted_units, per_unit, stars
from condensa.session import materialize

COSINE = 0.9
#: Vectors of the sample, taken by a hash of the id, and of those that each rotation is learned on.
SAMPLE, ROTATION_SAMPLE = 20_000, 4096
#: Share of the planted pairs that have to be found; they lie right at the threshold.
RECALL = 0.97
#: Pairs that are planted, and tables at most.
PLANTED, MOST_TABLES = 2000, 512
ROUNDS = 20
SEED = 7
#: Vectors that a bucket has by chance, about, and vectors of either side of a unit.
BY_CHANCE, CHUNK = 64, 1024
#: Bits of the whole code, and the share of planted pairs that may differ in more of them than is allowed.
CODE_BITS, CODE_MISSES = 128, 0.003
#: The number of a table stands above the bits of its keys.
TABLE_SHIFT = 48


def learn_rotations(
    sample: np.ndarray, many: int, first: int = 0, rounds: int = ROUNDS, seed: int = SEED
) -> list[np.ndarray]:
    """`many` orthogonal matrices (d x d) for centred vectors, each by ITQ, from number `first` on.

    A rotation and the binary codes are improved in turn: codes are the signs of the rotated vectors,
    and the rotation is the one that brings the vectors nearest to the codes (a Procrustes problem). The
    first one starts from the principal directions, the others from those turned at random.
    """
    d = sample.shape[1]
    sample = sample[:ROTATION_SAMPLE]
    principal = np.linalg.svd(sample.T @ sample)[0] if len(sample) else np.eye(d)
    found = []
    for number in range(first, first + many):
        random = np.random.default_rng([seed, number])
        turned = np.linalg.qr(random.standard_normal((d, d)))[0]
        rotation = principal @ turned if number else principal
        for _ in range(rounds if len(sample) else 0):
            codes = np.where(sample @ rotation >= 0, 1.0, -1.0)
            left, _, right = np.linalg.svd(sample.T @ codes)
            rotation = left @ right
        found.append(rotation)
    return found


def key_bits(n_vectors: int, dimension: int) -> int:
    """Bits of a table's keys: they follow the number of vectors, so that buckets do not."""
    return min(dimension, max(4, min(30, ceil(log2(max(1, n_vectors) / BY_CHANCE)))))


class Codes:
    """Codes of vectors: signs of the centred, rotated vectors, and tables of runs of them."""

    def __init__(self, mean: np.ndarray, planes: np.ndarray, bits: int, tables: int, distance: int):
        self.mean, self.planes = mean, planes
        self.bits, self.tables, self.distance = bits, tables, distance
        self.places = 1 << np.arange(bits, dtype=np.int64)

    def _sides(self, vectors: np.ndarray) -> np.ndarray:
        return (vectors - self.mean) @ self.planes

    def keys(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each vector (a row) its own key and the probed one in each table; the table is in the key."""
        sides = self._sides(vectors)[:, : self.bits * self.tables]
        sides = sides.reshape(len(vectors), self.tables, self.bits)
        own = (sides >= 0) @ self.places + (np.arange(self.tables, dtype=np.int64) << TABLE_SHIFT)
        return own, own ^ self.places[np.abs(sides).argmin(axis=2)]

    def whole(self, vectors: np.ndarray) -> np.ndarray:
        """The first `CODE_BITS` bits, as rows of 64-bit words."""
        signs = self._sides(vectors)[:, :CODE_BITS] >= 0
        return np.packbits(signs, axis=1).view(np.uint64)


def code_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def shared_keys(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Of pairs (rows) the least key that both are filed under in each table; the largest long for none."""
    none = np.iinfo(np.int64).max
    found = np.full(a[0].shape, none)
    for one in a:
        for other in b:
            found = np.where(one == other, np.minimum(found, one), found)
    return found


def planted_pairs(sample: np.ndarray, cosine: float, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors of the sample and a partner of each at that cosine, in a random direction."""
    random = np.random.default_rng(seed)
    chosen = sample[random.permutation(len(sample))[:PLANTED]]
    across = random.standard_normal(chosen.shape)
    across -= (across * chosen).sum(axis=1, keepdims=True) * chosen
    across /= np.maximum(np.linalg.norm(across, axis=1, keepdims=True), 1e-12)
    return chosen, cosine * chosen + np.sqrt(1 - cosine**2) * across


def learn_codes(sample: np.ndarray, n_vectors: int, cosine: float, recall: float) -> Codes:
    """Codes whose tables and distance find `recall` of the pairs planted around the sample.

    Without a sample, or in one dimension, all vectors go to one bucket a sign.
    """
    d = sample.shape[1]
    mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
    bits = key_bits(n_vectors, d)
    per = d // bits
    some = max(ceil(CODE_BITS / (per * bits)), 1)
    tables = some * per
    rotations = learn_rotations(sample - mean, some)
    pairs = planted_pairs(sample, cosine) if len(sample) else (sample, sample)
    while True:
        planes = np.concatenate([r[:, : per * bits] for r in rotations], axis=1)
        codes = Codes(mean, planes, bits, min(tables, MOST_TABLES), 0)
        apart = code_distance(*(codes.whole(p) for p in pairs))
        codes.distance = int(np.quantile(apart, 1 - CODE_MISSES)) + 1 if len(apart) else CODE_BITS
        met = shared_keys(*(codes.keys(p) for p in pairs)) < np.iinfo(np.int64).max
        found = (np.logical_or.accumulate(met, axis=1) & (apart <= codes.distance)[:, None]).mean(axis=0)
        if not len(apart) or found[-1] >= recall or codes.tables >= MOST_TABLES:
            enough = int(np.argmax(found >= recall)) + 1 if len(apart) and found[-1] >= recall else codes.tables
            codes.tables = enough
            codes.planes = planes[:, : max(enough * bits, min(CODE_BITS, planes.shape[1]))]
            return codes
        rotations += learn_rotations(sample - mean, len(rotations), len(rotations))
        tables = len(rotations) * per


def _normed(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; divided by the largest component first, against overflow in squares."""
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit vectors of a list column without nulls."""
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _normed(values.reshape(len(column), -1))


def usable(vector: str) -> Column:
    """Whether a vector has components that are all finite numbers and not all zero."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = F.col(vector).isNotNull() & ~bad & F.exists(vector, lambda v: v != 0)
    return F.coalesce(good, F.lit(False))


def _near_codes(codes: Codes):
    def near(unit: dict[str, np.ndarray], crossed: bool) -> tuple[np.ndarray, ...] | None:
        """The members of a unit that are near another by their whole codes."""
        whole = np.frombuffer(b"".join(unit["_code"]), dtype=np.uint64).reshape(len(unit["_code"]), -1)
        close = np.zeros((len(whole), len(whole)), dtype=np.int64)
        for word in whole.T:
            close += np.bitwise_count(word[:, None] ^ word)
        close = close <= codes.distance
        if crossed:
            close &= unit["side"][:, None] != unit["side"][None, :]
        np.fill_diagonal(close, False)
        some = close.any(axis=1)
        if not some.any():
            return None
        return tuple(unit[c][some] for c in ("_class", "_bucket", "unit_a", "unit_b", "side"))

    return near


def _unit_arrays(frame: pd.DataFrame) -> dict[str, np.ndarray]:
    vectors = _normed(np.stack(frame["_vector"].to_numpy()).astype(np.float64))
    others = {c: frame[c].to_numpy() for c in ("_class", "_bucket", "_size", "side")}
    return others | {"vectors": vectors}


def _linked(codes: Codes, cosine: float):
    def links(unit: dict[str, np.ndarray], crossed: bool) -> tuple[np.ndarray, ...] | None:
        vectors, nodes, sizes = unit["vectors"], unit["_class"], unit["_size"]
        close = vectors @ vectors.T >= cosine
        if crossed:
            close &= unit["side"][:, None] < unit["side"][None, :]
        left, right = np.nonzero(close if crossed else np.triu(close, 1))
        if len(left):
            # a pair counts in the first bucket that it meets in; parts bound the memory
            keys, bucket, first = codes.keys(vectors), unit["_bucket"][0], []
            for start in range(0, len(left), 16_384):
                a, b = left[start : start + 16_384], right[start : start + 16_384]
                shared = shared_keys(tuple(k[a] for k in keys), tuple(k[b] for k in keys))
                first.append(shared.min(axis=1) == bucket)
            first = np.concatenate(first)
            left, right = left[first], right[first]
        if not len(left):
            return None
        met = np.bincount(left, weights=sizes[right], minlength=len(nodes))
        met += np.bincount(right, weights=sizes[left], minlength=len(nodes))
        a, b = stars(nodes, left, right)
        some = met > 0
        return (
            np.concatenate([nodes[some], a]),
            np.concatenate([nodes[some], b]),
            np.concatenate([met[some].astype(np.int64), np.zeros(len(a), dtype=np.int64)]),
        )

    return links


def near_vectors(
    table: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    cosine: float = COSINE,
    recall: float = RECALL,
) -> DataFrame:
    """`key, n_links, component_id, kept` of every row; keys are whole numbers.

    Pairs that meet in a table of binary codes and are near by their whole codes are compared by their
    vectors in double precision and link at `cosine` or more. Equal vectors go as one class (each links with
    the others), so copies cost nothing. Buckets are not capped: large ones are cut into units
    (`graph.counted_units`), and a unit gives counts and connecting edges, not pairs. Codes are learned on a
    bounded sample; all vectors are indexed. An empty table gives an empty one; other columns are not read. `component_id` is the smallest key reachable, and `kept` says that it is
    the row's own. Vectors that are null, empty, zero or hold something that is no finite number link
    with nothing, nor do rows with a null key (no component, not kept). Vectors of different lengths
    are an error. Rows that repeat a key, with one vector or several, are vectors of their own.
    """
    rows = table.select(key, F.col(vector).alias("_vector"))
    rows = rows.withColumn("_good", usable("_vector") & F.col(key).isNotNull())
    good = rows.where("_good").select(key, "_vector")
    grouped = good.groupBy("_vector").agg(F.min(key).alias("_least"), F.count("*").alias("_size"))
    # a class is named by its smallest key; further classes of that key by a hash of it
    same_key = Window.partitionBy("_least").orderBy("_vector")
    further = F.xxhash64("_least", "_nth").bitwiseOR(F.lit(1 << 62))
    named = F.when(F.col("_nth") == 1, F.col("_least")).otherwise(further).cast("long")
    classes = materialize(
        grouped.withColumn("_nth", F.row_number().over(same_key))
        .withColumn("_class", named)
        .select("_class", "_least", "_size", "_vector"),
        "vector-classes",
    )
    rest = rows.where("NOT _good").select(
        key,
        F.lit(0).cast("long").alias("n_links"),
        F.col(key).alias("component_id"),
        F.col(key).isNotNull().alias("kept"),
    )
    n = classes.count()
    if not n:
        return rest
    few = F.pmod(F.xxhash64("_class"), F.lit(1 << 30)) < int(min(1.0, 1.2 * SAMPLE / n) * (1 << 30))
    drawn = classes.where(few).orderBy(F.xxhash64("_class")).limit(SAMPLE).select("_vector")
    dimension = classes.select(F.size("_vector").alias("d")).first()["d"]
    values = drawn.toArrow().column(0).combine_chunks()
    sample = _matrix(values) if len(values) else np.zeros((0, dimension))
    codes = learn_codes(sample, n, cosine, recall)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch.column(1))
                keys = np.concatenate(codes.keys(vectors), axis=1)
                times = keys.shape[1]
                nodes = np.repeat(batch.column(0).to_numpy(), times)
                whole = [w.tobytes() for w in codes.whole(vectors)]
                whole = pa.array(whole, pa.binary()).take(pa.array(np.repeat(np.arange(len(keys)), times)))
                columns = [pa.array(nodes), pa.array(keys.reshape(-1)), whole]
                yield pa.RecordBatch.from_arrays(columns, names=["_class", "_bucket", "_code"])

    spread = classes.select("_class", "_vector").repartition(parallelism(table), "_class")
    met = materialize(spread.mapInArrow(keyed, schema="_class long, _bucket long, _code binary"), "table-keys")
    near = per_unit(
        counted_units(met, "_bucket", "_class", CHUNK),
        ["_bucket"],
        _near_codes(codes),
        "_class long, _bucket long, unit_a int, unit_b int, side int",
    )
    near = materialize(near, "near-codes")
    found = per_unit(
        near.join(classes.select("_class", "_size", "_vector"), "_class"),
        ["_bucket"],
        _linked(codes, cosine),
        "a long, b long, links long",
        _unit_arrays,
    )
    found = materialize(found, "vector-links")
    links = found.groupBy(F.col("a").alias("_class")).agg(F.sum("links").alias("_links"))
    label = components(found.select("a", "b")).withColumnRenamed("node", "_class")
    known = materialize(
        classes.join(links, "_class", "left")
        .join(label, "_class", "left")
        .select(
            "_vector",
            "_least",
            (F.coalesce("_links", F.lit(0)) + F.col("_size") - 1).alias("n_links"),
            F.coalesce("component", "_class").alias("_group"),
        ),
        "linked-classes",
    )
    least = known.groupBy("_group").agg(F.min("_least").alias("component_id"))
    named_groups = known.join(least, "_group").select("_vector", "n_links", "component_id")
    linked = good.join(named_groups, "_vector").select(
        key, "n_links", "component_id", (F.col(key) == F.col("component_id")).alias("kept")
    )
    return linked.unionByName(rest)
