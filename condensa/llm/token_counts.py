"""Token counts: pieces of each distinct pre-token once, joined to the pre-tokens of documents."""

from __future__ import annotations

from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from condensa.llm.common import parallelism
from condensa.llm.pieces import load_tokenizer, special_pattern

LIMIT = 512
#: Documents, at most, whose pre-tokens are gathered together (an Arrow batch, which Spark bounds by
#: bytes, may have fewer); their places fit into 16 bits.
BATCH_DOCS = 8192
#: Texts of a batch from which on a pre-token is dealt by the batch, so that what is in very many texts
#: spreads over all tasks.
FREQUENT = 32


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    return load_tokenizer(path), special_pattern(path)


def pretokens(text: str, pattern: regex.Pattern, special) -> list[str]:
    """The pre-tokens of a text; strings of special tokens stand by themselves."""
    if special is None or not special.search(text):
        return pattern.findall(text)
    found, at = [], 0
    for match in special.finditer(text):
        found += [*pattern.findall(text[at : match.start()]), match.group()]
        at = match.end()
    return found + pattern.findall(text[at:])


ROW_SCHEMA = "pretoken string, batch long, places binary, counts binary, place int, n_bytes long"


def _binary(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column whose rows have these numbers of the values, one behind the other."""
    offsets = np.concatenate([[0], np.cumsum(sizes * values.itemsize)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(values.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


def _posted(texts: list[str], pattern: regex.Pattern, special) -> tuple[list[str], pa.Array, pa.Array]:
    """The distinct pre-tokens of a batch, the places of the texts that hold each, and how often."""
    number: dict[str, int] = {}
    tokens, counts, held = array("I"), array("I"), []
    for text in texts:
        counter = Counter(pretokens(text, pattern, special))
        tokens.extend([number.setdefault(t, len(number)) for t in counter])
        counts.extend(counter.values())
        held.append(len(counter))
    of_token = np.frombuffer(tokens, dtype=np.uint32)
    order = np.argsort(of_token, kind="stable")
    sizes = np.bincount(of_token, minlength=len(number))
    places = np.repeat(np.arange(len(texts), dtype="<u2"), held)[order]
    counted = np.frombuffer(counts, dtype=np.uint32).astype("<u4")[order]
    return list(number), _binary(places, sizes), _narrow(counted, sizes)


def _narrow(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """As `_binary`, with one octet a value in the rows whose values all fit, else four."""
    if not len(sizes):
        return pa.array([], pa.binary())
    starts = np.cumsum(sizes) - sizes
    widths = np.where(np.maximum.reduceat(values, starts) < 256, 1, 4)
    each = np.repeat(widths, sizes)
    at = np.cumsum(each) - each
    octets = np.zeros(int(each.sum()), dtype=np.uint8)
    octets[at] = values & 0xFF
    wide = each == 4
    for k in (1, 2, 3):
        octets[at[wide] + k] = values[wide] >> (8 * k) & 0xFF
    offsets = np.concatenate([[0], np.cumsum(sizes * widths)]).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(octets.tobytes())]
    return pa.Array.from_buffers(pa.binary(), len(sizes), buffers)


def _widened(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """The values of `_narrow`, one behind the other; `sizes` are the numbers of values."""
    octets, lengths = _flat(column, "u1")
    each = np.repeat(lengths // np.maximum(sizes, 1), sizes)
    at = np.cumsum(each) - each
    values = octets[at].astype(np.int64)
    wide = each == 4
    for k in (1, 2, 3):
        values[wide] |= octets[at[wide] + k].astype(np.int64) << (8 * k)
    return values


def document_pretokens(
    docs: DataFrame, tokenizer: str, pattern: str, key: str, text: str
) -> DataFrame:
    """`pretoken, batch, places, counts`, and for each document a row that names its key.

    A batch is consecutive documents of one partition. A document's row has a null pre-token, the
    key in `key`, the place in `place` and the bytes of the text in `n_bytes`.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [field.split()[0] for field in ROW_SCHEMA.split(", ")] + ["key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, special = _tokenizer(tokenizer)
        find = regex.compile(pattern)
        name = TaskContext.get().partitionId() << 32
        for arrived in batches:
            for rows in _bounded(arrived):
                keys, texts = rows.column(0), [t or "" for t in rows.column(1).to_pylist()]
                tokens, places, counts = _posted(texts, find, special)
                n, d = len(tokens), len(texts)
                columns = [
                    pa.array(tokens, pa.string()), pa.array(np.full(n, name)), places, counts,
                    pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, keys.type),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                sizes = pa.array([len(t.encode()) for t in texts], pa.int64())
                columns = [
                    pa.nulls(d, pa.string()), pa.array(np.full(d, name)), pa.nulls(d, pa.binary()),
                    pa.nulls(d, pa.binary()), pa.array(range(d), pa.int32()), sizes, keys,
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                name += 1

    rows = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return rows.mapInArrow(run, schema=f"{ROW_SCHEMA}, key {kind}")


def _bounded(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for start in range(0, rows.num_rows, BATCH_DOCS):
        yield rows.slice(start, BATCH_DOCS)


def _flat(column: pa.ChunkedArray | pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column one behind the other, and how many each row has."""
    width = np.dtype(kind).itemsize
    rows = column.cast(pa.large_binary())
    offsets = np.frombuffer(rows.buffers()[1], dtype=np.int64)[rows.offset : rows.offset + len(rows) + 1]
    octets = np.frombuffer(rows.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
    return octets.copy().view(kind), np.diff(offsets) // width


def sum_pieces(dealt: DataFrame, tokenizer: str, key_kind: str) -> DataFrame:
    """`batch, place, pieces, n_bytes, key` of rows that are sorted by pre-token.

    Rows of a pre-token lie together, so the library counts each distinct one once, and its pieces
    join to all documents that hold it right there. Of an Arrow batch, the pieces of a document are
    summed before they leave. Rows of documents pass through.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, _ = _tokenizer(tokenizer)
        last: tuple[str | None, int] = (None, 0)
        for rows in batches:
            named = rows.filter(pc.is_null(rows.column("pretoken")))
            if named.num_rows:
                zero = pa.array(np.zeros(named.num_rows, dtype=np.int64))
                fields = [named.column(c) for c in ("batch", "place", "n_bytes", "key")]
                yield _result([fields[0], fields[1], zero, *fields[2:]])
            rows = rows.filter(pc.is_valid(rows.column("pretoken")))
            if not rows.num_rows:
                continue
            token = rows.column("pretoken").dictionary_encode()
            distinct = token.dictionary.to_pylist()
            fresh = [t for t in distinct if t != last[0]]
            found = encoder.encode_batch_fast(fresh, add_special_tokens=False)
            known = dict(zip(fresh, map(len, found)))
            known.setdefault(*last)
            pieces = np.array([known[t] for t in distinct], dtype=np.int64)[token.indices.to_numpy()]
            last = (rows.column("pretoken")[-1].as_py(), int(pieces[-1]))
            places, sizes = _flat(rows.column("places"), "<u2")
            counts = _widened(rows.column("counts"), sizes)
            names, batch = np.unique(rows.column("batch").to_numpy(), return_inverse=True)
            spots, at = np.unique(np.repeat(batch, sizes) << 16 | places, return_inverse=True)
            total = np.zeros(len(spots), dtype=np.int64)
            np.add.at(total, at, np.repeat(pieces, sizes) * counts)
            n, key_type = len(spots), rows.column("key").type
            yield _result(
                [
                    pa.array(names[spots >> 16]),
                    pa.array((spots & 0xFFFF).astype(np.int32)),
                    pa.array(total),
                    pa.nulls(n, pa.int64()),
                    pa.nulls(n, key_type),
                ]
            )

    schema = f"batch long, place int, pieces long, n_bytes long, key {key_kind}"
    return dealt.mapInArrow(run, schema=schema)


def _result(columns: list[pa.Array]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=["batch", "place", "pieces", "n_bytes", "key"])


def dealt_pretokens(
    docs: DataFrame, tokenizer: str, pattern: str, key: str, text: str, parts: int
) -> DataFrame:
    """`document_pretokens` dealt by pre-token, frequent ones by batch."""
    gathered = document_pretokens(docs, tokenizer, pattern, key, text)
    frequent = F.octet_length("places") >= 2 * FREQUENT
    # a document's own row is dealt by batch and place, so that they spread
    # frequent ones of a batch stay together, so that their sums return as one a document
    dealt_by = F.when(frequent, F.concat_ws(":", F.lit("frequent"), "batch")).otherwise(
        F.coalesce("pretoken", F.concat_ws(":", "batch", "place"))
    )
    return gathered.repartition(parts, dealt_by)


def token_counts(
    docs: DataFrame,
    tokenizer: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    limit: int = LIMIT,
) -> DataFrame:
    """`key, n_bytes, n_tokens, over_limit` of each row; no ids are made for documents.

    Pre-tokens of up to `BATCH_DOCS` documents are gathered to one row per distinct pre-token with
    its documents and counts, so a frequent pre-token is one row a batch. Those rows are dealt by
    pre-token, the only shuffle of them; there each is counted by the library once and joined to its
    documents (`sum_pieces`). Pre-tokens of `FREQUENT` texts of a batch or more are dealt by batch, so no task
    has all rows of one that every text holds; they are few, and each task that has some of them counts them
    once. What returns is sums per document. A null text counts as empty; repeated rows and
    null keys are answered each; other columns are not read; long texts are read whole; an empty table gives an
    empty one. The input has to give the same rows in the same order when a task runs again, as files do:
    documents are named by batch and place until the end.
    """
    dealt = dealt_pretokens(docs, tokenizer, pattern, key, text, parallelism(docs))
    dealt = dealt.sortWithinPartitions("pretoken")
    summed = sum_pieces(dealt, tokenizer, docs.schema[key].dataType.simpleString())
    total = summed.groupBy("batch", "place").agg(
        F.max("key").alias(key), F.max("n_bytes").alias("n_bytes"), F.sum("pieces").alias("n_tokens")
    )
    return total.select(key, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
