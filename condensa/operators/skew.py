"""Joins by a key that one value may dominate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from condensa.operators.sample import ordered_index
from condensa.session import materialize

HEAD_ROWS = 50_000
#: Rows that a table may have to be broadcast; they are counted first.
BROADCAST_ROWS = 1_000_000
#: Rows that are put in order by one task; they are counted first.
ONE_TASK_ROWS = 200_000


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, to be broadcast if it has at most `most` rows; else a join shuffles it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _least_weight(rows: DataFrame, weight: str, k: int) -> tuple | None:
    """The k-th largest weight, or the least one, and how many rows weigh as much or more.

    From the histogram of weights, which are whole numbers: it has one row for each that occurs, and of
    counts that add up to N no more than the root of 2 N differ.
    """
    histogram = rows.groupBy(F.col(weight).alias("w")).agg(F.count("*").alias("n"))
    so_far = histogram.withColumn("before", F.sum("n").over(Window.orderBy(F.desc("w"))) - F.col("n"))
    last = so_far.where(F.col("before") < k).orderBy("w").first()
    return last and (last["w"], last["before"] + last["n"])


def heaviest(rows: DataFrame, weight: str, key: str, k: int) -> DataFrame:
    """The `k` rows of largest `weight` (a whole number), ties by `key`, with their place `idx`.

    A plain top-k sends `k` rows of every partition to one task, and a total order moves all rows. Here
    `rows` is written once, its histogram tells the least weight that counts, and only rows of that
    weight or more are put in order: in one task where they are few, by ranges of weight and key where
    ties make them many.
    """
    written = materialize(rows, "weights")
    found = _least_weight(written, weight, k)
    if found is None:
        return written.select("*", F.lit(0).cast("long").alias("idx")).where(F.lit(False))
    least, n = found
    heavy = written.where(F.col(weight) >= F.lit(least)) if least is not None else written
    order = [F.desc(weight), F.col(key)]
    if n > ONE_TASK_ROWS:
        return ordered_index(heavy, *order).where(F.col("idx") < k)
    place = (F.row_number().over(Window.orderBy(*order)) - 1).cast("long")
    return heavy.withColumn("idx", place).where(F.col("idx") < k)


def attach_by_key(
    left: DataFrame,
    right: DataFrame,
    key: str,
    value: str,
    heavy: DataFrame | None = None,
    head_rows: int = HEAD_ROWS,
) -> DataFrame:
    """Left join of one `value` per string `key`, safe for frequent keys.

    `heavy` (`key, weight`) says how often the keys occur in `left`; without it the value
    itself does, as for counts. The `head_rows` heaviest keys are broadcast, which bounds the
    broadcast, whether `right` has them or not. Their rows, and those without a key, are settled
    there and stay where they are; only the others are shuffled, and no key among them is frequent.
    `right` and the shuffled rows are written to the shared folder. `left` is read twice: pass a written table, or one that
    ends in a shuffle, which both readings share.
    """
    right = materialize(right.select(key, value), "by-key")
    if heavy is None:
        head = heaviest(right, value, key, head_rows).select(key, value)
    else:
        top = heaviest(heavy.select(key, "weight"), "weight", key, head_rows).select(key)
        top = materialize(top, "frequent-keys")
        found = right.join(F.broadcast(top), key, "left_semi")
        head = top.join(found, key, "left")
    head = materialize(head.withColumn("_settled", F.lit(True)), "head-keys")
    met = left.join(F.broadcast(head), key, "left")
    is_open = F.col("_settled").isNull() & F.col(key).isNotNull()
    settled = met.where(~is_open).drop("_settled")
    waiting = met.where(is_open).drop("_settled", value)
    rest = waiting.join(right, key, "left").select(*settled.columns)
    return settled.unionByName(materialize(rest, "rare-keys"))
