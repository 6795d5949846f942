"""Connected components of an edge table, and pairs within buckets that one group may fill."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from condensa.llm.common import parallelism, whole_groups
from condensa.session import materialize

#: Rows of a table that may be broadcast; its rows are counted first.
BROADCAST_ROWS = 100_000
#: Members of a bucket that one unit of work holds on either side.
CHUNK = 1024


def small_side(df: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has few rows; else a join shuffles it."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def components(edges: DataFrame) -> DataFrame:
    """`node, component` for every node of `edges` (`a, b`, longs): the smallest node reachable.

    Contraction: each node moves to its smallest neighbour (or stays), edges follow, loops and
    doubles go, until no edge is left. The smallest node of a component never moves, so it is the
    one that remains. Edges shrink by half a round at least; each round is written to the shared
    folder, so a lost executor costs no earlier round. Steps of a node are then followed from the
    last round back to the first.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    rounds = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        moved = both.groupBy("a").agg(F.min("b").alias("least"))
        moved = materialize(moved.select("a", F.least("a", "least").alias("to")), "moves")
        rounds.append(moved)
        step = small_side(moved)
        ends = edges.join(step, "a").select(F.col("to").alias("x"), F.col("b").alias("a"))
        ends = ends.join(step, "a").select("x", F.col("to").alias("y")).where("x <> y")
        smaller = ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        edges = materialize(smaller.distinct(), "edges")
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = rounds[-1].select(F.col("a").alias("node"), F.col("to").alias("component"))
    for earlier in reversed(rounds[:-1]):
        later = small_side(found.withColumnRenamed("node", "to"))
        found = materialize(
            earlier.join(later, "to", "left").select(
                F.col("a").alias("node"), F.coalesce("component", "to").alias("component")
            ),
            "components",
        )
    return found


def counted_units(members: DataFrame, bucket: str, node: str, chunk: int = CHUNK) -> DataFrame:
    """Members of buckets, dealt to units of work of bounded size.

    A bucket of more than `chunk` members is cut into chunks by a hash of the node, and a unit is
    a pair of chunks: `unit_a`, `unit_b`, and `side` (0 or 1) for the chunk a member came from;
    where both are the same chunk, `side` is 0. Every pair of members meets in exactly one unit.
    Counts are added up in the map tasks, and members are not shuffled for them, so no bucket passes a
    task whole; `members` is read twice. Buckets of one are a unit, too.
    """
    counts = members.groupBy(bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > chunk)
    large = small_side(materialize(counts, "large-buckets"))
    sized = members.join(large, bucket, "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
    return _paired_chunks(sized, node, chunk)


def shared_units(members: DataFrame, bucket: str, node: str, chunk: int = CHUNK) -> DataFrame:
    """The units of `counted_units` that have two members or more, where most have one."""
    own = Window.partitionBy(bucket, "unit_a", "unit_b")
    units = counted_units(members, bucket, node, chunk).withColumn("_n", F.count("*").over(own))
    return units.where("_n > 1").drop("_n")


def _paired_chunks(sized: DataFrame, node: str, chunk: int) -> DataFrame:
    cut = sized.withColumn("_chunks", F.ceil(F.col("_n") / chunk).cast("int")).withColumn(
        "_own", F.pmod(F.xxhash64(node), "_chunks").cast("int")
    )
    met = cut.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)))
    return met.withColumns(
        {
            "unit_a": F.least("_own", "_other"),
            "unit_b": F.greatest("_own", "_other"),
            "side": (F.col("_own") > F.col("_other")).cast("int"),
        }
    ).drop("_n", "_chunks", "_own", "_other")


def per_unit(
    units: DataFrame,
    bucket: list[str],
    function: Callable,
    schema: str,
    prepare: Callable | None = None,
) -> DataFrame:
    """`function(arrays, crossed)` for each unit; it returns the columns of `schema`, or None.

    `arrays` has the unit's part of every column, and of what `prepare(frame)` made of many units
    at once. `crossed` tells that pairs are between the sides, else they are within the unit.
    """
    keys = [*bucket, "unit_a", "unit_b"]
    names = [field.split()[0] for field in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, bounds in whole_groups(frames, keys):
            arrays = prepare(frame) if prepare else {c: frame[c].to_numpy() for c in frame.columns}
            crossed = (frame["unit_a"] != frame["unit_b"]).to_numpy()
            found = []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if end - start > 1:
                    part = {name: values[start:end] for name, values in arrays.items()}
                    found.append(function(part, crossed[start]))
            found = [columns for columns in found if columns is not None]
            if found:
                columns = [np.concatenate(parts) for parts in zip(*found)]
                yield pd.DataFrame(dict(zip(names, columns)))

    dealt = units.repartition(parallelism(units), *keys).sortWithinPartitions(*keys)
    return dealt.mapInPandas(run, schema=schema)


def stars(nodes: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (node, smallest node) that connect what the pairs `left, right` (places) connect."""
    label = np.arange(len(nodes))
    order = np.argsort(nodes, kind="stable")
    place = np.empty_like(order)
    place[order] = label
    label = place.copy()
    while True:
        before = label.copy()
        least = np.minimum(label[left], label[right])
        np.minimum.at(label, left, least)
        np.minimum.at(label, right, least)
        label = np.minimum(label, label[order[label]])
        if (label == before).all():
            break
    smallest = nodes[order[label]]
    moved = smallest != nodes
    return nodes[moved], smallest[moved]
