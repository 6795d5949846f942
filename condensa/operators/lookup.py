"""Vocabulary lookups.

Up to `MAX_INLINE_WORDS` words the vocabulary is one row that every task receives: a hash
table (an array of small maps) for word -> id, a dense array for id -> word. Lookups then
happen inside a projection, and encoding or decoding a corpus needs no shuffle at all. The
row count is checked while the table is built. For larger vocabularies the keys that a row needs are
joined and come back to the row as a map (`attach_to_rows`); what is computed from them is the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from condensa.functions.ids import RESERVED_WORDS, UNK
from condensa.operators.skew import attach_by_key
from condensa.session import materialize

MAX_INLINE_WORDS = 200_000
BUCKETS = 1 << 14


def way(lookup: str, vocab_size: int) -> str:
    """`inline` or `join`, as asked for, or `auto` by the size of the vocabulary."""
    if lookup not in ("auto", "inline", "join"):
        raise ValueError("lookup is 'auto', 'inline' or 'join'")
    if lookup != "auto":
        return lookup
    return "inline" if vocab_size <= MAX_INLINE_WORDS else "join"


def explode_words(df: DataFrame, words: Column, *keep: str) -> DataFrame:
    """One row per array element, as column `word`.

    `explode` would let the optimizer add `size(words) > 0` below it and so tokenize every
    text a second and third time; `explode_outer` with a null filter does not.
    """
    return df.select(*keep, F.explode_outer(words).alias("word")).where("word IS NOT NULL")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _checked(rows: Column, limit: int, value: Column) -> Column:
    message = F.concat(F.lit(f"more than {limit} rows in a broadcast table: "), rows)
    return F.when(rows > limit, F.raise_error(message)).otherwise(value)


def word_table(
    vocab: DataFrame, limit: int = MAX_INLINE_WORDS, value: str = "id", kind: str = "int"
) -> Column:
    """Scalar column: `array<map<word, value>>`, indexed by the hash bucket of the word."""
    spark = vocab.sparkSession
    # no more than tells that there are too many is collected
    filled = vocab.limit(limit + 1).groupBy(_bucket(F.col("word")).alias("bucket")).agg(
        F.collect_list(F.struct("word", F.col(value).cast(kind).alias("value"))).alias("entries")
    )
    buckets = spark.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    rows = F.sum(F.coalesce(F.size("entries"), F.lit(0)))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "entries")))
    maps = F.transform(ordered, lambda b: F.map_from_entries(b["entries"]))
    return buckets.join(filled, "bucket", "left").agg(_checked(rows, limit, maps)).scalar()


def lookup_value(table: Column, word: Column) -> Column:
    """The value of `word`, or null."""
    return F.element_at(F.get(table, _bucket(word)), word)


def lookup_id(table: Column, word: Column) -> Column:
    """The id of `word`, or the unknown id."""
    return F.coalesce(lookup_value(table, word), F.lit(UNK))


def dense_table(
    rows: DataFrame,
    index: str,
    value: str,
    size: int,
    limit: int = MAX_INLINE_WORDS,
    shown: Callable[[Column], Column] = lambda v: v,
) -> Column:
    """Scalar column: array of length `size` holding `value`, as `shown`, at position `index`."""
    if size > limit:
        raise ValueError(f"{size} entries are more than the {limit} an inline table may hold")
    slots = rows.sparkSession.range(size).select(F.col("id").cast("int").alias("_slot"))
    placed = slots.join(
        rows.select(F.col(index).cast("int").alias("_slot"), F.col(value).alias("_value")),
        "_slot",
        "left",
    )
    ordered = F.array_sort(F.collect_list(F.struct("_slot", "_value")))
    values = F.transform(ordered, lambda s: shown(s["_value"]))
    return placed.agg(_checked(F.count("*"), limit, values)).scalar()


def id_table(vocab: DataFrame, vocab_size: int, limit: int = MAX_INLINE_WORDS) -> Column:
    """Scalar column: the word of every id, reserved ids included."""
    return dense_table(with_reserved(vocab), "id", "word", vocab_size, limit)


def with_reserved(vocab: DataFrame) -> DataFrame:
    """The vocabulary with the reserved ids 0..3 added."""
    reserved = vocab.sparkSession.createDataFrame(
        list(enumerate(RESERVED_WORDS)), "id int, word string"
    )
    return vocab.select("id", "word").unionByName(reserved)


def attach_to_rows(df: DataFrame, keys: Column, table: DataFrame) -> DataFrame:
    """`df` with a map `_found` of the row's `keys` (strings) that `table` (`key, value`) has.

    Rows are numbered and written first, so rows that are equal in everything stay apart. One (row,
    distinct key) meets the table, with the frequent keys settled without a shuffle
    (`skew.attach_by_key`), and what was found returns to the row by its number.
    """
    rows = materialize(df.withColumn("_row", F.monotonically_increasing_id()), "rows")
    wanted = rows.select("_row", F.explode_outer(F.array_distinct(keys)).alias("key"))
    wanted = materialize(wanted.where("key IS NOT NULL"), "row-keys")
    heavy = wanted.groupBy("key").agg(F.count("*").alias("weight"))
    met = attach_by_key(wanted, table, "key", "value", heavy).where("value IS NOT NULL")
    found = met.groupBy("_row").agg(
        F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("_found")
    )
    kind = f"map<string,{table.schema['value'].dataType.simpleString()}>"
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array()).cast(kind)
    return rows.join(found, "_row", "left").withColumn("_found", F.coalesce("_found", nothing)).drop("_row")
