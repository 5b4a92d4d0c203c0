"""Helpers shared by the operators: written intermediate tables, Arrow batches and words as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import shared_folder

#: Bytes of text that one numpy pass works on, and one that encodes tokens; only a single longer text makes a larger pass.
PASS_BYTES, ENCODE_BYTES = 2 << 20, 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


#: Tables written inside ``scratch`` blocks, innermost last.
_MADE: list[list[str]] = []


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage and outlives lost executors."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession, name)
    for made in _MADE:
        made.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete tables that are not read any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``stored`` writes inside the block, which writes what is to stay by other means."""
    made: list[str] = []
    _MADE.append(made)
    try:
        yield
    finally:
        _MADE.remove(made)
        remove(spark, *made)
        let_go(spark)


def let_go(spark: SparkSession) -> None:
    """Give memory of the driver back after a stage of many jobs: its plans, the shuffles they hold on executors, and what numpy and Arrow keep."""
    gc.collect()
    spark._jvm.java.lang.System.gc()
    give_back()


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only where the C library has it
    if trim is not None:
        trim(0)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whose workers give memory back after every task: they live on, and what they keep adds to the next stage's needs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return df.mapInArrow(task, schema)


# Sets of keys as bits -------------------------------------------------------------------------

#: Bits per key of a set, and at most so many in all (32 MB): beyond, more keys are taken for members, and the exact join that follows costs more.
KEY_BITS, MOST_BITS = 8, 1 << 28


def key_bits(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """A set of non-null 64-bit keys as bitmaps (bucket, bits), and the number of places that keys are hashed to.

    Bitmaps of 4 KB are built by map-side aggregation; all together they hold ``KEY_BITS`` bits a key, up to ``MOST_BITS``.
    """
    n = keys.select(key).count()
    places = min(MOST_BITS, 1 << max(15, (KEY_BITS * n - 1).bit_length()))
    at = _place(F.col(key), places)
    return keys.where(F.col(key).isNotNull()).select(F.bitmap_bucket_number(at).alias("bucket"), F.bitmap_bit_position(at).alias("bit")).groupBy("bucket").agg(
        F.bitmap_construct_agg("bit").alias("bits")), places


def _place(key: Column, places: int) -> Column:
    return F.pmod(F.xxhash64(key.cast("bigint")), F.lit(places)).cast("bigint") + 1  # places begin at 1


def by_bits(df: DataFrame, key: Column, bits: DataFrame, places: int) -> DataFrame:
    """Adds ``_maybe``: false only where the key is null or not in the set.  The bitmaps are broadcast: 32 MB at most."""
    at = _place(key, places)
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = df.withColumn("_bucket", F.bitmap_bucket_number(at)).join(
        F.broadcast(bits.select(F.col("bucket").alias("_bucket"), F.col("bits").alias("_bits"))), "_bucket", "left")
    return told.withColumn("_maybe", F.coalesce(key.isNotNull() & (F.getbit(byte, (place % 8).cast("int")) == 1), F.lit(False))).drop("_bucket", "_bits")


def tasks(spark: SparkSession) -> int:
    """Partitions that the session wants for a shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null is the empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return body[at[0] : at[-1]], at - at[0]


def passes(batches: Iterator[pa.RecordBatch], text: str | Callable[[pa.RecordBatch], pa.Array] = "text", most: int = PASS_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of each stay near ``most`` bytes; ``text`` names their column or finds it."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = utf8(text(batch) if callable(text) else batch.column(text))
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
        del batch, at  # before the next batch is read
    # A worker lives on after its task; what Arrow keeps for later would add to the next stage's needs.
    pa.default_memory_pool().release_unused()


def strings(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """String array over bytes that lie one after the other."""
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def encoded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Code of every value, and the distinct values in order of first appearance."""
    if not len(values):
        return np.zeros(0, np.int64), values
    d = values.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def words(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all rows, and where the words of each row begin (rows + 1)."""
    n = len(data)
    if not n:
        return strings(data, np.zeros(1, np.int64)), np.zeros(len(at), np.int64)
    inside = ~SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    offsets = np.concatenate([[0], np.cumsum(end - begin)])
    return strings(data[inside], offsets), np.searchsorted(begin, at)


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[s:s+n]`` for every (s, n), one after the other."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(total)]


def row_sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of ``values[at[i]:at[i+1]]``; empty stretches give 0."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), np.float64), np.cumsum(values, 0, dtype=np.float64)])
    return total[at[1:]] - total[at[:-1]]
