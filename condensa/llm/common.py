"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: The white space that separates words (a Java and a Python pattern).
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, mod `modulus`; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def known_labels(labels: DataFrame, key: str, label: str) -> DataFrame:
    """`key, _label`, one row per key; keys that are null, unlabelled or labelled both ways go."""
    one = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).groupBy(key)
    return (
        one.agg(F.min(label).alias("_label"), F.max(label).alias("_most"))
        .where("_label = _most")
        .select(key, F.col("_label").cast("int").alias("_label"))
    )


def parallelism(df: DataFrame) -> int:
    """Partitions of a shuffle that operators deal out themselves."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: Sequence[str]) -> str:
    """`name`, lengthened until no column is called so (Spark compares without case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name += "_"
    return name


def whole_groups(
    frames: Iterator[pd.DataFrame], keys: list[str]
) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Frames of sorted rows cut so that no group spans two, with the bounds of the groups.

    A group that reaches the end of a frame is kept back and joined to the next one.
    """
    kept: list[pd.DataFrame] = []

    def cut(frame: pd.DataFrame) -> np.ndarray:
        changed = np.zeros(len(frame), dtype=bool)
        changed[:1] = True
        for key in keys:
            values = frame[key].to_numpy()
            changed[1:] |= values[1:] != values[:-1]
        return np.append(np.flatnonzero(changed), len(frame))

    for frame in frames:
        if not len(frame):
            continue
        frame = pd.concat([*kept, frame], ignore_index=True) if kept else frame
        bounds = cut(frame)
        kept = [frame.iloc[bounds[-2] :]]
        if len(bounds) > 2:
            yield frame.iloc[: bounds[-2]], bounds[:-1]
    if kept:
        frame = pd.concat(kept, ignore_index=True)
        yield frame, cut(frame)


def map_texts(
    docs: DataFrame, key: str, text: str, function: Callable, schema: str, binary: bool = False
) -> DataFrame:
    """`key` and what `function` makes of the texts, batch by batch.

    `function(texts)` gets a list of str (bytes if `binary`; a null text is an empty one) and returns
    the other columns of `schema` as lists or arrays, one value per text. Keys pass through untouched,
    whatever their type. A batch is bounded by Spark's settings for Arrow batches (bytes and rows).
    """
    kind = docs.schema[key].dataType.simpleString()
    empty = b"" if binary else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or empty for t in batch.column(1).to_pylist()]
            columns = [pa.array(c) for c in function(texts)]
            names = [field.split()[0] for field in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=[key, *names])

    as_is = F.col(text).cast("binary" if binary else "string")
    return docs.select(key, as_is.alias("_text")).mapInArrow(run, schema=f"`{key}` {kind}, {schema}")
