"""Which source words the words of a target come from: alignment by expectation-maximisation.

A table of probabilities of a target id given a source id is improved round by round over all examples:
each target word is shared out among the words of its source, and the shares, added up over the corpus, are the
next table. The state is written each round, so a lost executor costs no earlier one.

Where the table has few cells, as the largest ids tell, every task receives it and adds up the shares of its examples
as arrays; only the sums are shuffled. For more cells the pairs of ids of each example meet the table in a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from condensa.functions.ids import EOS, PAD, UNK
from condensa.operators.skew import broadcast_if_small
from condensa.session import materialize

#: Cells, at most, of a table that every task receives.
CELLS = 8_000_000
#: Examples that a task has as arrays at once.
BATCH_ROWS = 500
SIDES = "xs array<int>, nx array<int>, ys array<int>, ny array<int>, size int"


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and value of each element of a list column; a null list has none."""
    column = column.fill_null([])
    sizes = np.diff(column.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), column.flatten().to_numpy(zero_copy_only=False)


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            yield batch.slice(start, BATCH_ROWS)


def _counted(column: pa.Array, vocab_size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and count of the distinct ids of each row, pads and ends left out."""
    row, ids = _flat(column)
    ids = np.where(ids >= vocab_size, UNK, ids).astype(np.int64)
    real = (ids != PAD) & (ids != EOS)
    keys, n = np.unique((row[real].astype(np.int64) << 32) | ids[real], return_counts=True)
    return keys >> 32, keys & 0xFFFFFFFF, n


def _listed(row: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    offsets = np.append(0, np.cumsum(np.bincount(row, minlength=n)))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def id_pairs(rows: DataFrame, vocab_size: int) -> DataFrame:
    """`_row, xs, nx, ys, ny, size`: the distinct ids of source and target of each example, with their counts.

    They stand for all pairs of both sides, at most as many as both widths of an example multiplied.
    Ids beyond the vocabulary count as the unknown one; `size` is the number of source words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, columns = batch.num_rows, [batch.column("_row")]
            for side in ("x", "y"):
                row, ids, counts = _counted(batch.column(side), vocab_size)
                columns += [_listed(row, ids, n), _listed(row, counts, n)]
                if side == "x":
                    size = np.bincount(row, counts, minlength=n)
            columns.append(pa.array(size, pa.float64()).cast(pa.int32()))
            yield pa.RecordBatch.from_arrays(columns, names=["_row", "xs", "nx", "ys", "ny", "size"])

    sides = [F.col(c).cast("array<int>").alias(c) for c in ("x", "y")]
    return rows.select("_row", *sides).mapInArrow(run, f"_row bigint, {SIDES}")


def _exploded(pairs: DataFrame) -> DataFrame:
    """`_row, x, nx, y, ny, size`: each source id of an example next to each target id."""
    sources = pairs.select("_row", "ys", "ny", "size", F.explode(F.arrays_zip("xs", "nx")).alias("e"))
    targets = F.explode(F.arrays_zip("ys", "ny"))
    both = sources.select("_row", "size", F.col("e.xs").alias("x"), F.col("e.nx").alias("nx"), targets.alias("e"))
    return both.select("_row", "x", "nx", F.col("e.ys").alias("y"), F.col("e.ny").alias("ny"), "size")


def _shape(pairs: DataFrame) -> tuple[int, int] | None:
    """Rows and columns of the table as an array; null where it has too many cells."""
    top = pairs.agg(*[F.max(F.array_max(c)).alias(c) for c in ("xs", "ys")]).first()
    shape = ((top["xs"] or 0) + 1, (top["ys"] or 0) + 1)
    return shape if shape[0] * shape[1] <= CELLS else None


def _sent(table: DataFrame | None, shape: tuple[int, int], spark):  # noqa: ANN202
    """The table, broadcast as an array; ones before the first round."""
    if table is None:
        return spark.sparkContext.broadcast(None)
    found = table.select("x", "y", "p").toArrow()
    cells = np.zeros(shape[0] * shape[1])
    x, y, p = (found.column(c).to_numpy() for c in ("x", "y", "p"))
    cells[x.astype(np.int64) * shape[1] + y] = p
    return spark.sparkContext.broadcast(cells)


def _dealt(
    x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], n: int, width: int, cells: np.ndarray | None
) -> tuple[np.ndarray, ...]:
    """Of all pairs of a batch: place in `x`, in `y`, the cell and the share; and the total of each in `y`."""
    per_row = np.bincount(x[0], minlength=n)
    starts = (np.cumsum(per_row) - per_row)[y[0]]
    sizes = per_row[y[0]]
    of_y = np.repeat(np.arange(len(y[0])), sizes)
    of_x = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
    cell = x[1][of_x] * width + y[1][of_y]
    w = x[2][of_x].astype(np.float64)
    if cells is not None:
        w *= cells[cell]
    total = np.bincount(of_y, w, minlength=len(y[0]))
    return of_x, of_y, cell, w / total[of_y], total


def _round(pairs: DataFrame, table: DataFrame | None, shape: tuple[int, int], n_targets: int) -> DataFrame:
    """`x, y, c`: the shares that each task adds up, and with null ids its part of the likelihood."""
    sent = _sent(table, shape, pairs.sparkSession)
    kinds = float(n_targets) if table is None else 1.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, added, value = sent.value, np.zeros(shape[0] * shape[1]), 0.0
        for batch in _small(batches):
            sides = []
            for side in ("x", "y"):
                row, ids = _flat(batch.column(f"{side}s"))
                sides.append((row, ids.astype(np.int64), _flat(batch.column(f"n{side}"))[1]))
            x, y = sides
            _, of_y, cell, share, total = _dealt(x, y, batch.num_rows, shape[1], cells)
            added += np.bincount(cell, y[2][of_y] * share, minlength=len(added))
            met, size = total > 0, batch.column("size").to_numpy()
            value += float((y[2][met] * np.log(total[met] / size[y[0][met]] / kinds)).sum())
        cell = np.flatnonzero(added)
        if len(cell):
            columns = [pa.array(cell // shape[1], pa.int32()), pa.array(cell % shape[1], pa.int32()), pa.array(added[cell])]
            summed = pa.RecordBatch.from_arrays(columns, names=["x", "y", "c"])
            for start in range(0, len(cell), 1 << 16):
                yield summed.slice(start, 1 << 16)
            none = pa.nulls(1, pa.int32())
            yield pa.RecordBatch.from_arrays([none, none, pa.array([value])], names=["x", "y", "c"])

    return pairs.drop("_row").mapInArrow(run, "x int, y int, c double")


def _shared_out(pairs: DataFrame, table: DataFrame | None) -> DataFrame:
    """`pairs` with `share`, what a source id takes of a target id of its example, and `total` before that."""
    if table is None:
        weighted = pairs.withColumn("w", F.col("nx").cast("double"))
    else:
        weighted = pairs.join(broadcast_if_small(table), ["x", "y"]).withColumn("w", F.col("nx") * F.col("p"))
    total = F.sum("w").over(Window.partitionBy("_row", "y"))
    return weighted.withColumn("total", total).withColumn("share", F.col("w") / F.col("total"))


def _round_joined(pairs: DataFrame, table: DataFrame | None, n_targets: int) -> DataFrame:
    """The same by a join."""
    shared = materialize(_shared_out(_exploded(pairs), table), "shares")
    # the shares of a target id add up to 1, so each adds its part of the logarithm
    chance = F.col("total") / F.col("size") / F.lit(float(n_targets) if table is None else 1.0)
    value = F.sum(F.col("ny") * F.col("share") * F.log(chance)).alias("c")
    none = F.lit(None).cast("int")
    likelihood = shared.agg(value).select(none.alias("x"), none.alias("y"), "c")
    return shared.groupBy("x", "y").agg(F.sum(F.col("ny") * F.col("share")).alias("c")).unionByName(likelihood)


def align(pairs: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """`x, y, p` (probability of target id y given source id x) and `round, log_likelihood`.

    `pairs` are `id_pairs`, written, as each round reads them. Before the first round all target ids are
    equally likely. The likelihood is that of the table a round begins with; it never falls.
    """
    table, course = None, []
    shape = _shape(pairs)
    both = pairs.where(F.size("xs") > 0)
    n_targets = both.select(F.explode("ys").alias("y")).distinct().count()
    for number in range(rounds):
        if shape:
            shared = materialize(_round(both, table, shape, n_targets), "shares")
        else:
            shared = materialize(_round_joined(both, table, n_targets), "sums")
        value = F.sum("c").alias("log_likelihood")
        course.append(shared.where("x IS NULL").agg(value).select(F.lit(number).alias("round"), "log_likelihood"))
        counts = shared.where("x IS NOT NULL").groupBy("x", "y").agg(F.sum("c").alias("c"))
        totals = Window.partitionBy("x")
        table = materialize(
            counts.select("x", "y", (F.col("c") / F.sum("c").over(totals)).alias("p")), "alignment"
        )
    likelihood = course[0] if course else None
    for row in course[1:]:
        likelihood = likelihood.unionByName(row)
    return table, likelihood


def numbered(examples: DataFrame) -> DataFrame:
    """`examples`, written, with a number `_row` of their own, so that rows of equal keys stay apart."""
    return materialize(examples.withColumn("_row", F.monotonically_increasing_id()), "numbered")


def aligned_weights(rows: DataFrame, pairs: DataFrame, table: DataFrame, vocab_size: int) -> DataFrame:
    """`rows` with `weights`: of each place of `x` the share of the own target's words that come from there.

    The weights of an example's real places add up to 1, and pads weigh 0. Without a source or target word
    all real places weigh the same.
    """
    shape = _shape(pairs)
    if shape is None:
        return _weights_joined(rows, pairs, table, vocab_size)
    sent = _sent(table, shape, rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = sent.value
        for batch in _small(batches):
            n = batch.num_rows
            x, y = (_counted(batch.column(f"_{side}"), vocab_size) for side in ("x", "y"))
            of_x, of_y, _, share, _ = _dealt(x, y, n, shape[1], cells)
            words = np.bincount(y[0], y[2], minlength=n)
            own = np.bincount(of_x, y[2][of_y] * share / x[2][of_x], minlength=len(x[0]))
            size = np.bincount(x[0], x[2], minlength=n)
            row, ids = _flat(batch.column("_x"))
            ids = np.where(ids >= vocab_size, UNK, ids).astype(np.int64)
            real = (ids != PAD) & (ids != EOS)
            at = np.searchsorted((x[0] << 32) | x[1], (row[real].astype(np.int64) << 32) | ids[real])
            weight, of = np.zeros(len(ids)), row[real]
            weight[real] = np.where(words[of] > 0, own[at] / np.maximum(words[of], 1), 1.0 / np.maximum(size[of], 1))
            lengths = np.bincount(row, minlength=n)
            offsets = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(weight), mask=batch.column("_x").is_null())
            kept = [c for c in batch.schema.names if c not in ("_x", "_y")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], lists], names=[*kept, "weights"])

    kept = rows.drop("_row")
    sides = [F.col(c).cast("array<int>").alias(f"_{c}") for c in ("x", "y")]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.select("*", *sides).mapInArrow(run, f"{kinds}, weights array<double>")


def _weights_joined(rows: DataFrame, pairs: DataFrame, table: DataFrame, vocab_size: int) -> DataFrame:
    pairs = _exploded(pairs)
    words = pairs.select("_row", "y", "ny").distinct().groupBy("_row").agg(F.sum("ny").alias("words"))
    shares = _shared_out(pairs, table).groupBy("_row", "x").agg(
        F.sum(F.col("ny") * F.col("share") / F.col("nx")).alias("w")
    )
    of_row = shares.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("x", "w"))).alias("_w"))
    met = rows.join(of_row.join(words, "_row"), "_row", "left")
    real = F.size(F.filter("x", lambda i: ~i.isin(PAD, EOS)))

    def weight(i: Column) -> Column:
        known = F.element_at("_w", F.when(i >= vocab_size, 3).otherwise(i)) / F.col("words")
        return F.when(i.isin(PAD, EOS), 0.0).otherwise(F.coalesce(known, 1.0 / real))

    return met.withColumn("weights", F.transform("x", weight)).drop("_w", "words", "_row")
