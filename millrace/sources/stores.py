"""Writers and readers of token tables, flat token files, manifests and results."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.ordering import plan_table
from millrace.sources.flat_tokens import FORMAT, RANGE_BYTES, FlatTokens, little_endian, qualified

BLOCK_DOCS = 1 << 16


def write_tokens(tok: DataFrame, path: str, order: str = "doc_id", block: int = BLOCK_DOCS, mode: str = "overwrite",
                 by: Sequence[str] = ("source", "shard"), replace_shards: bool = False) -> None:
    """Token table partitioned by (source, shard).

    Rows are spread by (source, shard, block of documents), so a big shard is written by many tasks,
    each with its documents in order; there are at most as many files as blocks.  With ``replace_shards`` only the shards that ``tok``
    holds are replaced, all at once when the job commits.
    """
    blocked = tok.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    writer = blocked.repartition(*by, "_block").sortWithinPartitions(*by, order).drop("_block").write.mode(mode)
    writer.option("partitionOverwriteMode", "dynamic" if replace_shards else "static").partitionBy(*by).parquet(path)


def read_tokens(spark: SparkSession, path: str, sources: Sequence[str] | None = None) -> DataFrame:
    """Token table; the wanted sources are picked by partition pruning."""
    tok = spark.read.parquet(path)
    return tok if sources is None else tok.where(F.col("source").isin(list(sources)))


def token_bytes(df: DataFrame, width: int, ids_col: str = "ids", out: str = "payload") -> DataFrame:
    """Token array as little-endian bytes."""
    dtype = little_endian(width)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index(ids_col))
            data = ids.flatten().to_numpy(zero_copy_only=False).astype(dtype).view(np.uint8)
            ends = pc.multiply(pc.subtract(ids.offsets, ids.offsets[0]).cast(pa.int64()), width).cast(pa.int32())
            valid = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            bits = None if valid.all() else pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
            body = pa.Array.from_buffers(pa.binary(), len(ids), [bits, ends.buffers()[1], pa.py_buffer(data.tobytes())])
            kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
            yield pa.RecordBatch.from_arrays([*kept, body], [*names, out])

    names = [c for c in df.columns if c != out]
    return df.mapInArrow(pack, T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.BinaryType())]))


def write_token_bytes(tok: DataFrame, path: str, width: int = 4, rows_per_file: int = BLOCK_DOCS,
                      order: str = "doc_id", mode: str = "append") -> None:
    """Flat little-endian token files per shard: ``<path>/<source>_p<shard>/part-<block>.ds``.

    A shard's stream is the concatenation of its parts by name.  Every block of documents is one file of one task; files get
    their names when the whole job commits, so a failed or repeated task shows nothing.  A block is as many times ``rows_per_file`` keys wide
    as the shard has one of so many, so that a file holds about ``rows_per_file`` rows, however many shards the keys are dealt to.
    """
    spark = tok.sparkSession
    spark.dataSource.register(FlatTokens)
    key, rows = F.col(order), F.lit(rows_per_file)
    shards = tok.groupBy(F.col("source").alias("_s"), F.col("shard").alias("_p")).agg(
        F.floor(F.min(key) / rows).alias("_low"), F.floor(F.max(key) / rows).alias("_high"), F.ceil(F.count(key) / rows).alias("_files"))
    wide = plan_table(shards.select("_s", "_p", "_low", F.ceil((F.col("_high") - F.col("_low") + 1) / F.greatest("_files", F.lit(1))).alias("_wide")))
    each = F.floor(key / rows)
    # Named by its first block: a later write of later keys takes none of these names.
    first = F.col("_low") + F.floor((each - F.col("_low")) / F.col("_wide")) * F.col("_wide")
    blocked = tok.join(wide, tok["source"].eqNullSafe(wide["_s"]) & tok["shard"].eqNullSafe(wide["_p"])).withColumn("block", first.cast("bigint"))
    (
        blocked.select("source", "shard", "block", order, "ids").repartition("source", "shard", "block")
        .sortWithinPartitions("source", "shard", "block", order).select("source", "shard", "block", "ids")
        .write.format(FORMAT).mode(mode).option("width", width).save(qualified(spark, path))
    )


def read_token_bytes(spark: SparkSession, path: str, L: int, width: int = 4, range_bytes: int = RANGE_BYTES,
                     skip: int = 0, most: int | None = None) -> DataFrame:
    """Windows (folder, win, ids) of ``L + 1`` ids of the streams of flat token files; a stream's open tail is left out.

    The stream of a folder is its files one after the other, by name, without its first ``skip`` ids and up to ``most`` from there.  It is cut into
    ranges of whole windows, and a task reads its range from as many files as hold a part of it, so neither many small files nor a huge
    one lose a window or hold up a task.
    """
    spark.dataSource.register(FlatTokens)
    reader = spark.read.format(FORMAT).option("width", width).option("length", L).option("range_bytes", range_bytes).option("skip", skip)
    return (reader if most is None else reader.option("most", most)).load(qualified(spark, path))


def write_manifest(info: DataFrame, jobs: DataFrame, path: str, by: Sequence[str] = ("source", "shard")) -> None:
    """One manifest row per planned shard: its record and its sampling weight; published by the commit protocol.

    A planned shard without a record, or without tokens, fails the job before anything is published.
    """
    rows = jobs.select(*by, "name", "weight", "max_doc_tokens").join(info, list(by), "left")
    missing = F.raise_error(F.concat(F.lit("no tokens for planned shard "), F.col("name")))
    rows = rows.withColumn("tokens", F.when(F.coalesce("tokens", F.lit(0)) > 0, F.col("tokens")).otherwise(missing.cast("bigint")))
    rows.coalesce(1).write.mode("overwrite").json(path)


MANIFEST_SCHEMA = (
    "source string, shard int, name string, tokens bigint, docs bigint, dropped_too_long bigint, budget bigint, "
    "max_doc_tokens int, tokenizer string, weight double"
)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


def append_run_log(df: DataFrame, path: str) -> None:
    """Append rows to a CSV log with header; every task writes its own file, so writers never collide."""
    df.write.mode("append").option("header", True).csv(path)


def read_run_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_graded(graded: DataFrame, summary: DataFrame, path: str) -> None:
    graded.write.mode("overwrite").json(f"{path}/graded")
    summary.coalesce(1).write.mode("overwrite").json(f"{path}/summary")
