"""Operator 8: sum-of-squares packing of token pieces into sequences of a fixed size.

``pieces`` encodes whole texts, appends an end id, and cuts only documents longer than ``size``: all pieces but the
first have exactly ``size`` ids.  ``pack`` places every piece where the sum of the squared counts of open sequences per
remaining gap becomes smallest (ties: the fullest sequence, a new one last).  Pieces are dealt by hash into groups
of about ``PER_GROUP`` documents and come longest first, so a group has little left over and a task holds only the
counts per gap and the open sequences of the group it is in, however large the group is.  ``sequences`` joins the ids
of packed pieces into the sequences themselves.

Null and empty texts are the end id alone.  Rows without a length, or with length 0, keep null places; one longer than ``size``
fails the job.  Repeated rows are separate pieces.  An empty table gives an empty result.  Other columns of
``pack``'s input stay; those named ``sequence_id``, ``offset`` or beginning with ``_pack`` are replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import ENCODE_BYTES, in_arrow, passes, tasks
from millrace.llm.tokenizing import encoding, share

SIZE = 2048
PER_GROUP = 8192
GROUP_SPAN = 1 << 32


def pieces(docs: DataFrame, vocabulary_path: str, end: int = 0, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids): ids are little-endian unsigned 32-bit integers."""
    vocabulary = share(docs.sparkSession, vocabulary_path)
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batch: pa.RecordBatch, encode: Callable[[pa.Array, int], tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        ids, at = encode(batch.column("text"), end)
        lengths = np.diff(at)
        count = -(-lengths // size)
        row = np.repeat(np.arange(len(lengths)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        head = (lengths - 1) % size + 1
        start = np.where(piece > 0, head[row] + (piece - 1) * size, 0)
        length = np.where(piece > 0, size, head[row])
        bounds = np.append(at[row] + start, at[-1])
        body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds * 4), pa.py_buffer(ids.astype("<u4"))])
        return pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), body.cast(pa.binary())],
            ["doc_id", "piece", "start", "length", "ids"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(vocabulary) as told:
            yield from map(lambda batch: cut(batch, told.encode), passes(batches, most=ENCODE_BYTES))  # no batch is held while the next is read

    return in_arrow(source, run, "doc_id bigint, piece int, start bigint, length bigint, ids binary")


class Sequences:
    """Open sequences of one group by gap; ``place`` gives (number of the sequence, offset)."""

    def __init__(self, size: int):
        self.size, self.made = size, 0
        self.count = np.zeros(size + 1, np.int64)
        self.open: dict[int, list[int]] = {}

    def place(self, length: int) -> tuple[int, int]:
        size, count = self.size, self.count
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} ids does not fit a sequence of {size}")
        at, gap = None, size
        if length < size:
            # Change of the sum of squares when a sequence of gap g takes the piece; gap 0 is closed, not counted.
            here = count[length:size]
            change = 2 * (count[: size - length] - here) + 2
            change[0] = 1 - 2 * here[0]
            change[here == 0] = 1 << 60
            k = int(change.argmin())
            if change[k] <= 2 * count[size - length] + 1:
                gap = length + k
                at = self.open[gap].pop()
                count[gap] -= 1
        if at is None:
            at, self.made = self.made, self.made + 1
        left = gap - length
        if left:
            self.open.setdefault(left, []).append(at)
            count[left] += 1
        return at, size - gap


def pack(rows: DataFrame, groups: int, size: int = SIZE, keys: tuple[str, ...] = ("doc_id", "piece"), length_col: str = "length") -> DataFrame:
    """Add ``sequence_id`` and ``offset``; ``groups`` sequences sets are packed apart, see ``groups_for``."""
    rows = rows.drop("sequence_id", "offset", *[c for c in rows.columns if c.startswith("_pack")])
    length = F.coalesce(F.col(length_col).cast("bigint"), F.lit(0))
    dealt = rows.withColumns({"_pack_group": F.pmod(F.xxhash64(*keys, length_col), F.lit(groups)), "_pack_length": length})
    placed = dealt.repartition(min(groups, tasks(rows.sparkSession)), "_pack_group").sortWithinPartitions("_pack_group", F.col("_pack_length").desc(), *keys)
    kept = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, None
        for batch in batches:
            ids, offsets = [], []
            for g, n in zip(batch.column("_pack_group").to_pylist(), batch.column("_pack_length").to_pylist()):
                if g != group:
                    group, state = g, Sequences(size)
                if n:
                    at, offset = state.place(n)
                    ids.append(g * GROUP_SPAN + at)
                    offsets.append(offset)
                else:
                    ids.append(None)
                    offsets.append(None)
            keep = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.int64()), pa.array(offsets, pa.int64())], [*kept, "sequence_id", "offset"])

    return in_arrow(placed, run, schema)


def groups_for(documents: int, per_group: int = PER_GROUP) -> int:
    return max(1, -(-documents // per_group))


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the ids of every sequence in place order; a sequence has at most ``size`` pieces."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids", "length")))
    whole = packed.where(F.col("sequence_id").isNotNull()).groupBy("sequence_id").agg(parts.alias("_parts"))
    join = F.aggregate("_parts", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.select("sequence_id", F.aggregate("_parts", F.lit(0).cast("bigint"), lambda a, x: a + x["length"]).alias("length"), join.alias("ids"))
