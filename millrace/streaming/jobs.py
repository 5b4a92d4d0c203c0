"""Structured Streaming jobs.  Each equals its batch operator on the same rows."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from millrace.functions import text as X
from millrace.operators.ordering import keys_equal
from millrace.operators.tokens import drop_short_text, flag_long, tokenize
from millrace.sources.corpora import synthetic_columns


def prepare_rows(docs: DataFrame, max_doc_tokens: int = 0, chat: bool = False, min_chars: int = X.MIN_CHARS) -> DataFrame:
    """Stateless part of preparation: short-text filter, tokens, length gate."""
    tok = tokenize(drop_short_text(docs, min_chars))
    return flag_long(tok, max_doc_tokens, F.lit(chat)).where(~F.col("dropped")).drop("dropped")


#: What a stream does when it is not told otherwise: all that is there, in micro-batches, then it ends.
ALL_NOW = {"availableNow": True}


def stream_prepare(src: DataFrame, path: str, checkpoint: str, max_doc_tokens: int = 0, chat: bool = False, trigger: dict | None = None) -> StreamingQuery:
    """Tokenize arriving documents into an append-only table; packing stays a batch job."""
    return (
        prepare_rows(src, max_doc_tokens, chat)
        .writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger or ALL_NOW).start()
    )


def check_settings(spark: SparkSession, settings: dict[str, object], path: str) -> None:
    """Keep the settings of a run that starts in ``path``; fail if it was begun with others."""
    rows = spark.createDataFrame([(k, json.dumps(settings[k], sort_keys=True)) for k in sorted(settings)], "name string, value string")
    try:
        held = spark.read.schema(rows.schema).json(path)
        other = keys_equal(rows, held, "name", "value").select("name").distinct().collect()  # as many as settings
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        rows.coalesce(1).write.json(path)
        return
    if other:
        raise ValueError(f"{path} was begun with other values of {', '.join(sorted(r['name'] for r in other))}; use another folder")


def stream_samples(src: DataFrame, path: str, checkpoint: str, key: str = "key", settings: dict[str, object] | None = None,
                   trigger: dict | None = None) -> StreamingQuery:
    """Append finished samples once each: of the rows of a key the first that arrives is stored, whenever others come.

    The keys met so far are the stream's state, spread over the state store's partitions by key; no batch reads what earlier
    ones wrote.  A restarted run goes on from the checkpoint.  ``settings`` decide what a sample is: a run that is
    resumed with others fails before it starts.
    """
    if settings is not None:
        check_settings(src.sparkSession, settings, f"{checkpoint}-settings")
    return (
        src.dropDuplicates([key]).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(**trigger or ALL_NOW).start()
    )


def running_summary(src: DataFrame) -> DataFrame:
    """Accuracy, samples, mean tokens and truncation per benchmark (batch or stream)."""
    n = F.count(F.lit(1))
    return src.groupBy("bench").agg(
        n.alias("samples"), (F.lit(100.0) * F.sum(F.col("correct").cast("int")) / n).alias("accuracy"),
        (F.sum("tokens") / n).alias("mean_tokens"),
        (F.lit(100.0) * F.sum(F.col("truncated").cast("int")) / n).alias("truncated"),
    )


def running_consumption(src: DataFrame) -> DataFrame:
    """Tokens per stage and source (batch or stream); a new stage starts at zero."""
    return src.groupBy("stage", "source").agg(F.sum("tokens").cast("bigint").alias("tokens"))


def changed_rows(agg: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Write of every micro-batch the groups it changed, as ``path/batch=<number>``.

    A batch that is repeated after a failure replaces its own folder, so nothing is counted twice; ``latest_rows`` reads the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return (
        agg.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(**trigger or ALL_NOW).start()
    )


def latest_rows(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Latest version of every group that ``changed_rows`` has written."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(*keys, *[F.col(f"_last.{c}").alias(c) for c in rest])


def stream_summary(src: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return changed_rows(running_summary(src), path, checkpoint, trigger)


def stream_consumption(src: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    return changed_rows(running_consumption(src), path, checkpoint, trigger)


def stream_synthetic(spark: SparkSession, rate: int, L: int, vocab: int, seed: int = 0) -> DataFrame:
    """Endless synthetic batches: ``rate`` rows per second."""
    rows = spark.readStream.format("rate").option("rowsPerSecond", rate).load()
    return rows.select(F.col("value").alias("row"), *synthetic_columns(F.col("value"), L, vocab, seed, False))


def run_to_end(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception():
        raise query.exception()


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet", per_trigger: int = 1,
                prepare: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Files of a folder as a stream, a few per micro-batch."""
    src = spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", per_trigger).load(path)
    return prepare(src) if prepare else src
