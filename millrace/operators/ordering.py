"""Running totals, dense row numbers and seeded orders that never gather a group in one task.

``Window.partitionBy(source)`` - or no partition at all - puts everything of a source on one
task.  The operators here work in two levels: rows are split into fixed blocks that follow the
order (``order_col div block``, or the leading digits of a hash), each block is numbered on its
own, and block totals - one row per block - are summed and joined back.  Rows are partitioned by group
and block on purpose (an input that happens to be partitioned by the group alone would keep a big
group in one task); the join back uses the same keys, so the rows are shuffled once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.md5 import md5_numbers, md5_prefixes
from millrace.functions.seeded import seeded_md5

DEFAULT_BLOCK = 1 << 16
#: Leading digits of an md5 that make a block: 65,536 blocks, whose totals meet in one task; 1e12 rows give 1.5e7 a block.
HASH_DIGITS = 4
PLAN_ROWS = 100_000
EXPAND_CHUNK = 1 << 16
#: Rows that a block of ``hash_order_counts`` holds at most, on average, and numbers that it hashes and rows that it returns at once.
TASK_ROWS, HASH_CHUNK, PLACED_ROWS = 1 << 21, 1_000_000, 1 << 16


def plan_table(df: DataFrame, max_rows: int = PLAN_ROWS) -> DataFrame:
    """Fix a planning table (sources, jobs, weights, lengths) so that Spark knows its size.

    At most ``max_rows + 1`` rows are fetched.  A table within the bound becomes a local relation, which
    joins by broadcast only if its real size is below Spark's threshold; a larger one is returned as
    it was and joins by shuffle.
    """
    rows = df.limit(max_rows + 1).toArrow()
    return df if rows.num_rows > max_rows else df.sparkSession.createDataFrame(rows, df.schema)


def expand_counts(df: DataFrame, count: str, out: str, chunk: int = EXPAND_CHUNK, by: Sequence[str] | None = None) -> DataFrame:
    """``count`` rows numbered from 0 for every input row.

    Chunk numbers are exploded and spread first, so a row that stands for billions is expanded by
    many tasks.  ``by`` names the columns that are hashed for it, where rows hold more than their keys.
    """
    keep = [c for c in df.columns if c != count]
    rows = F.col(count).cast("bigint")
    chunks = df.where(rows > 0).select(
        *keep, rows.alias("_rows"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((rows - 1) / F.lit(chunk)))).alias("_chunk")
    )
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col("_rows")) - 1
    return chunks.repartition(*(keep if by is None else by), "_chunk").select(*keep, F.explode(F.sequence(first, last)).alias(out))


def block_width(df: DataFrame, order: str, rows_per_block: int = DEFAULT_BLOCK) -> int:
    """Key width of blocks that hold ``rows_per_block`` rows on average, whatever the spread of the keys.

    Reads the minimum, maximum and count of one column; use it where keys are not dense.
    """
    low, high, n = df.agg(F.min(order), F.max(order), F.count(F.lit(1))).first()
    if not n:
        return rows_per_block
    blocks = max(1, -(-n // rows_per_block))
    return max(1, -(-(int(high) - int(low) + 1) // blocks))


def _block_starts(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sum of all earlier blocks; one row per block, so the window is over a small table."""
    w = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return totals.select(
        *[F.col(c) for c in by], "_block", (F.sum("_total").over(w) - F.col("_total")).alias("_before")
    )


def _attach(df: DataFrame, starts: DataFrame, by: Sequence[str], out: str) -> DataFrame:
    """Join the block starts back on plain equality, so the window's partitioning is reused.

    A null group key finds no partner and fails the job instead of losing its place.
    """
    missing = F.raise_error(F.lit("group keys of a running order must not be null"))
    return (
        df.join(starts, [*by, "_block"], "left")
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_before"), missing))
        .drop("_block", "_local", "_before")
    )


def running_offset(
    df: DataFrame,
    by: Sequence[str],
    order: str,
    size: str,
    out: str = "start",
    block: int | None = DEFAULT_BLOCK,
) -> DataFrame:
    """Total ``size`` of all earlier rows of the group, in the order of ``order``.

    ``order`` must be unique within a group.  With ``block`` (an order-key width) the sum is
    two-level; ``block=None`` says that every group is known to be small.
    """
    by = list(by)
    if block is None:
        w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(out, (F.sum(size).over(w) - F.col(size)).cast("bigint"))
    blocked = df.withColumn("_block", F.floor(F.col(order) / F.lit(block)).cast("bigint"))
    totals = blocked.groupBy(*by, "_block").agg(F.sum(size).cast("bigint").alias("_total"))
    w = Window.partitionBy(*by, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.repartition(*by, "_block").withColumn("_local", (F.sum(size).over(w) - F.col(size)).cast("bigint"))
    return _attach(local, _block_starts(totals, by), by, out)


def dense_index(
    df: DataFrame, block: Column, order: Sequence[Column], by: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """0-based rank per group.  ``block`` must follow ``order``: no row of a later block sorts earlier."""
    by = list(by)
    blocked = df.withColumn("_block", block)
    totals = blocked.groupBy(*by, "_block").agg(F.count(F.lit(1)).alias("_total"))
    w = Window.partitionBy(*by, "_block").orderBy(*order)
    local = blocked.repartition(*by, "_block").withColumn("_local", F.row_number().over(w).cast("bigint") - 1)
    return _attach(local, _block_starts(totals, by), by, out)


def global_row_index(
    df: DataFrame, order: str, by: Sequence[str] = (), out: str = "pos", block: int = DEFAULT_BLOCK
) -> DataFrame:
    """0-based index in the order of a unique numeric column."""
    return dense_index(df, F.floor(F.col(order) / F.lit(block)).cast("bigint"), [F.col(order)], by, out)


def hash_order(
    df: DataFrame, seed, keys: Sequence[str], by: Sequence[str] = (), out: str = "pos",
    rank_by: Column | None = None, name: Column | None = None, digits: int = HASH_DIGITS,
) -> DataFrame:
    """0-based place of every row in a random order fixed by ``seed``.

    ``keys`` identify a row.  ``rank_by`` (an integer) sorts before the hash, which is how separate
    stretches are shuffled apart; ``name`` is mixed into the hash.
    """
    hashed = df.withColumn("_md5", seeded_md5(seed, *([name] if name is not None else []), *[F.col(k) for k in keys]))
    prefix = F.substring("_md5", 1, digits)
    order = [F.col("_md5"), *[F.col(k) for k in keys]]
    if rank_by is not None:
        hashed = hashed.withColumn("_rank", rank_by.cast("bigint"))
        block = F.concat(F.lpad(F.col("_rank").cast("string"), 20, "0"), F.lit(":"), prefix)
        return dense_index(hashed, block, [F.col("_rank"), *order], by, out).drop("_md5", "_rank")
    return dense_index(hashed, prefix, order, by, out).drop("_md5")


def hash_order_counts(df: DataFrame, count: str, item: str, total: int, seed, out: str = "pos") -> DataFrame:
    """``hash_order(expand_counts(df, count, item), seed, [keys, item])``, where ``total`` is the sum of the counts.

    Only numbers are shuffled, two to three bytes a row: a task hashes a chunk of numbers and deals their places to blocks of hashes;
    behind the shuffle hashes are computed again, and a block, whose rows are bounded on average, is sorted by itself.
    """
    keys = [c for c in df.columns if c != count]
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // (TASK_ROWS << 2)))
    bits = min(4 * HASH_DIGITS, max(6, ((total - 1) // TASK_ROWS).bit_length()))
    chunk = HASH_CHUNK if bits <= 12 else 10 * HASH_CHUNK
    rows = F.col(count).cast("bigint")
    head = F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys], F.lit(""))
    chunks = df.where(rows > 0).select(*keys, head.alias("_head"), rows.alias("_rows"), F.explode(
        F.sequence(F.lit(0).cast("bigint"), F.floor((rows - 1) / F.lit(chunk)))).alias("_chunk")).repartition(n, *keys, "_chunk")
    own = [df.schema[k] for k in keys]
    fields = lambda kinds: [T.StructField(k, kind) for k, kind in kinds.items()]
    dealt = T.StructType([*own, *fields({"_head": T.StringType(), "_chunk": T.LongType(), "_block": T.IntegerType(), "_high": T.BinaryType(), "_low": T.BinaryType()})])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (at, rows, head) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_chunk", "_rows", "_head")))):
                numbers = np.arange(at * chunk, min((at + 1) * chunk, rows))
                block = md5_prefixes(head.encode(), numbers, bits)
                place = np.argsort(block, kind="stable")
                held = np.bincount(block, minlength=1 << bits)
                full = np.flatnonzero(held)
                ends = np.append(0, np.cumsum(held[full]))
                binary = lambda x: pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(ends * x.itemsize), pa.py_buffer(x)]).cast(pa.binary())
                same = batch.take(pa.array(np.full(len(full), i)))
                yield pa.RecordBatch.from_arrays(
                    [*(same.column(k) for k in keys), same.column("_head"), same.column("_chunk"), pa.array(full.astype(np.int32)), binary((place >> 16).astype(np.uint8)), binary(place.astype("<u2"))],
                    dealt.names)

    def count_held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_block"), pc.cast(pc.binary_length(batch.column("_high")), pa.int64())], ["_block", "_total"])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blocks in batch.column("_totals").to_pylist():
                at = np.array([(x["_block"], x["_total"]) for x in blocks], np.int64).reshape(-1, 2)
                at = at[np.argsort(at[:, 0])]
                yield pa.RecordBatch.from_arrays([pa.array(at[:, 0].astype(np.int32)), pa.array(np.cumsum(at[:, 1]) - at[:, 1])], ["_block", "_before"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, []
        for batch in batches:
            blocks = batch.column("_block").to_numpy()
            cut = np.concatenate([[0], np.flatnonzero(np.diff(blocks)) + 1, [len(blocks)]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if a == b:
                    continue
                if blocks[a] != block:
                    yield from _places(parts, keys, chunk, placed)
                    block, parts = blocks[a], []
                parts.append(batch.slice(a, b - a))
        yield from _places(parts, keys, chunk, placed)

    placed = T.StructType([*own, *fields({item: T.LongType(), out: T.LongType()})])
    # Both that read ``held`` read all its columns, so that it is shuffled once.
    held = chunks.mapInArrow(deal, dealt).repartition(n, "_block")
    totals = held.mapInArrow(count_held, "_block int, _total bigint").groupBy("_block").agg(F.sum("_total").alias("_total"))
    starts = totals.agg(F.collect_list(F.struct("_block", "_total")).alias("_totals")).mapInArrow(sums, "_block int, _before bigint")
    return held.join(F.broadcast(starts), "_block", "left").sortWithinPartitions("_block", "_head", "_chunk").mapInArrow(place, placed)


def _places(parts: list[pa.RecordBatch], keys: list[str], chunk: int, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    """Rows of one block in the order of their hashes, keys and number."""
    if not parts:
        return
    rows = pa.Table.from_batches(parts).combine_chunks()
    flat = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), kind)
    n = pc.binary_length(rows.column("_high")).to_numpy()
    low, high = flat("_low", "<u2"), flat("_high", np.uint8)
    numbers = np.repeat(rows.column("_chunk").to_numpy() * chunk, n) + (high.astype(np.int64) << 16 | low)
    ends = np.append(0, np.cumsum(n))
    heads = rows.column("_head").to_pylist()
    edges = [0, *(i for i in range(1, len(heads)) if heads[i] != heads[i - 1]), len(heads)]
    first = np.concatenate([md5_numbers(heads[a].encode(), numbers[ends[a] : ends[b]]) for a, b in zip(edges[:-1], edges[1:])])
    order = np.argsort(first)
    own = np.repeat(np.arange(len(heads), dtype=np.int32), n)
    even = np.flatnonzero(first[order[1:]] == first[order[:-1]])
    if len(even):
        # Rows whose first 64 bits are those of another one stand together; the rest of the hash decides, then the keys, then the number.
        at = np.union1d(even, even + 1)
        alike = order[at]
        last, head = np.empty(len(at), np.uint64), np.asarray(np.cumsum([i > 0 and heads[i] != heads[i - 1] for i in range(len(heads))]))[own[alike]]
        for h in np.unique(head).tolist():
            last[head == h] = md5_numbers(heads[edges[h]].encode(), numbers[alike[head == h]], last=True)
        held = [tuple((v is not None, v) for v in r) for r in zip(*(rows.column(k).to_pylist() for k in keys))] or [()] * len(heads)
        rank = {r: i for i, r in enumerate(sorted(set(held)))}
        ranks = np.array([rank[r] for r in held])[own[alike]]
        order[at] = alike[np.lexsort((numbers[alike], ranks, last, first[alike]))]
    before = rows.column("_before")[0].as_py()
    told = rows.select(keys)
    for a in range(0, len(order), PLACED_ROWS):
        here = order[a : a + PLACED_ROWS]
        same = told.take(pa.array(own[here])).combine_chunks()
        yield pa.RecordBatch.from_arrays(
            [*(same.column(k).chunk(0) for k in keys), pa.array(numbers[here]), pa.array(np.arange(before + a, before + a + len(here)))], schema.names)


def order_by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Total order of a result by its keys."""
    return df.orderBy(*keys)


def limit_rows(df: DataFrame, k: int, *order: str) -> DataFrame:
    """The first ``k`` rows in order (Spark keeps ``k`` rows per task, then merges)."""
    return df.orderBy(*order).limit(k)


def restore_order(results: DataFrame, requests: DataFrame, key: str, place: str) -> DataFrame:
    """Results in the order their requests were made."""
    return results.join(requests.select(key, place), key).orderBy(place)


def repeat_epochs(df: DataFrame, epochs: int, out: str = "epoch", last: Column | None = None) -> DataFrame:
    """Every row once per epoch; with ``last`` the last epoch has only the rows for which it is true."""
    numbers = F.sequence(F.lit(0), F.lit(epochs - 1))
    if last is not None:
        numbers = F.when(last, numbers).otherwise(F.sequence(F.lit(0), F.lit(epochs - 2)) if epochs > 1 else F.array().cast("array<int>"))
    return df.withColumn(out, F.explode(numbers))


def union_sources(*frames: DataFrame) -> DataFrame:
    first, *rest = frames
    for frame in rest:
        first = first.unionByName(frame)
    return first


def keys_missing(wanted: DataFrame, held: DataFrame, *keys: str) -> DataFrame:
    return wanted.select(*keys).distinct().join(held.select(*keys).distinct(), list(keys), "left_anti")


def keys_equal(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Keys held by one side only, with the side; no rows means the key sets are equal."""
    left = keys_missing(a, b, *keys).withColumn("side", F.lit("left"))
    return left.unionByName(keys_missing(b, a, *keys).withColumn("side", F.lit("right")))
