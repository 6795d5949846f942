"""Ordered positions, batches, head cuts and repeatable samples.

Positions follow any orderable columns that are unique per row. Rows are dealt to ranges, the ranges
are counted, and a row's position is the rows of the ranges before it plus its place in its own. No
step sorts or counts the whole data in one task, at any size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from condensa.session import materialize


def ranges(df: DataFrame) -> int:
    """Ranges for the rows of `df`: as many partitions as its session's shuffles have."""
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ordered_index(
    df: DataFrame, *order: str | Column, name: str = "idx", parts: int | None = None
) -> DataFrame:
    """`df` with the 0-based position of every row in the given order.

    The dealt rows are written to the shared folder and counted there: the borders of the ranges come from a
    sample, and counts and places have to see the same ones. `df` is read for the sample and for the
    rows, so a derived one should be written before.
    """
    part, row, offset = "_part", "_row", "_offset"
    dealt = df.repartitionByRange(parts or ranges(df), *order)
    cut = materialize(dealt.withColumn(part, F.spark_partition_id()), "ranges")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # one row per range: the window without partitions sees no more than that
    offsets = (
        cut.groupBy(part)
        .agg(F.count("*").alias("_n"))
        .select(part, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias(offset))
    )
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return (
        cut.withColumn(row, inside)
        .join(F.broadcast(offsets), part)
        .withColumn(name, (F.col(offset) + F.col(row) - 1).cast("long"))
        .drop(part, row, offset)
    )


def batches(df: DataFrame, key: str, batch_size: int) -> DataFrame:
    """Consecutive batches in key order: `idx`, `batch_id`, `row_in_batch`."""
    size = F.lit(batch_size)
    return (
        ordered_index(df, key)
        .withColumn("batch_id", F.floor(F.col("idx") / size))
        .withColumn("row_in_batch", F.col("idx") % size)
    )


# The rounds of the permutation, its prime, and what a round multiplies by.
ROUNDS, PRIME = 4, (1 << 31) - 1
MULTIPLIERS = (1_103_515_245, 1_664_525_013, 1_566_083_941, 1_284_865_837)


def round_keys(seed: int, epoch: int) -> list[int]:
    """What each round of the permutation adds, by seed and epoch."""
    return [(seed * 7_919 + epoch * 104_729 + r * 1_299_709) % PRIME for r in range(ROUNDS)]


def half_bits(n: int) -> int:
    """Bits of either half of the numbers that the permutation works on: the fewest that hold `n` of them."""
    return max(1, math.ceil(math.log2(max(2, n)) / 2))


def permuted(idx: Column, n: int, seed: int, epoch: int) -> Column:
    """The place of row `idx` in the order of an epoch: a permutation of 0 to n - 1, without a sort.

    A Feistel network permutes all numbers of its width; a number beyond the rows walks on through it until it
    is one of theirs. The width holds less than four times the rows, so few steps are taken on average.
    """
    bits = half_bits(n)
    keys, mask = round_keys(seed, epoch), (1 << bits) - 1

    def mixed(value: Column) -> Column:
        left, right = F.shiftright(value, bits), value.bitwiseAND(F.lit(mask))
        for key, multiplier in zip(keys, MULTIPLIERS):
            drawn = ((right + F.lit(key)) % PRIME * F.lit(multiplier) % PRIME).bitwiseAND(F.lit(mask))
            left, right = right, left.bitwiseXOR(drawn)
        return F.shiftleft(left, bits).bitwiseOR(right)

    def walk(value: Column, _: Column) -> Column:
        return F.when(value < n, value).otherwise(mixed(value))

    # a walk this long does not occur: each step ends it with a quarter at least
    steps = F.sequence(F.lit(1), F.lit(200))
    return F.aggregate(steps, mixed(idx.cast("long")), walk)


def epoch_batches(df: DataFrame, key: str, batch_size: int, seed: int, epoch: int) -> DataFrame:
    """Batches of an epoch: all rows in an order of its own, `place`, `batch_id`, `row_in_batch`.

    The rows are put in key order once and counted; every epoch permutes their numbers where they are.
    """
    placed = materialize(ordered_index(df, key), "indexed")
    size, place = F.lit(batch_size), permuted(F.col("idx"), placed.count(), seed, epoch)
    return (
        placed.withColumn("place", place)
        .withColumn("batch_id", F.floor(F.col("place") / size))
        .withColumn("row_in_batch", F.col("place") % size)
        .drop("idx")
    )


def ordered_keys(df: DataFrame, key: str) -> DataFrame:
    """`key, idx` of all rows, from keys that are written once, whatever `df` is derived from."""
    return ordered_index(materialize(df.select(key), "keys"), key)


def _up_to(df: DataFrame, key: str, keys: DataFrame, n: int) -> DataFrame:
    """The rows of `df` up to the n-th key; only that key reaches the driver, as a filter of the scan."""
    if n <= 0:
        return df.where(F.lit(False))
    last = keys.where(F.col("idx") == n - 1).first()
    return df if last is None else df.where(F.col(key) <= F.lit(last[key]))


def kth_key(df: DataFrame, key: str, k: int):
    """The k-th smallest key (from 1), exactly."""
    found = ordered_keys(df, key).where(F.col("idx") == k - 1).first()
    return found[key] if found else None


def head_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first `n` rows in key order."""
    return _up_to(df, key, ordered_keys(df, key), n)


def head_fraction(df: DataFrame, key: str, proportion: float = 1.0) -> DataFrame:
    """The first `ceil(proportion * n)` rows in key order."""
    if proportion >= 1.0:
        return df
    keys = ordered_keys(df, key)
    return _up_to(df, key, keys, math.ceil(proportion * keys.count()))


def evaluated_rows(
    df: DataFrame, key: str, batch_size: int, total_batches: int | None, samples: int
) -> DataFrame:
    """The first `total_batches * batch_size` rows, after checking the sizes.

    Without `total_batches` as many whole batches as leave a row over.
    """
    keys = ordered_keys(df, key)
    n = keys.count()
    if total_batches is None:
        total_batches = max(0, n - 1) // batch_size
    wanted = total_batches * batch_size
    if samples >= wanted:
        raise ValueError(f"{samples} samples do not fit in {wanted} evaluated rows")
    if n <= wanted:
        raise ValueError(f"the data must have more than {wanted} rows")
    return _up_to(df, key, keys, wanted)


def random_sample(df: DataFrame, key: str, k: int, seed: int) -> DataFrame:
    """`k` keys drawn without replacement; the same ones on every run with that seed."""
    draw = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.select(key).orderBy(draw, key).limit(k)
