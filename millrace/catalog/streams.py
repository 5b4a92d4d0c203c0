"""Streaming jobs run to their end over files of the given tables; results equal the batch operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import GRADED, digest, graded_of, new_folder, register, PIECES_SQL
from millrace.catalog.running import STAGES, _log
from millrace.session import table
from millrace.streaming import jobs


def _as_stream(spark, sf, df, name: str, batches: int = 4):
    """The rows as files that arrive in four micro-batches; as many files as the texts have splits, so none grows with the table."""
    folder = new_folder(spark, name)
    files = max(batches, table(spark, sf, "documents").rdd.getNumPartitions())
    df.repartition(files).write.parquet(folder)
    return jobs.file_stream(spark, folder, df.schema, per_trigger=-(-files // batches))


@register("stream_prepare", f"""
SELECT doc_id, len({PIECES_SQL})::BIGINT AS n_tokens, md5(array_to_string({PIECES_SQL}, ' ')) AS content
FROM documents WHERE length(text) >= 50 AND len({PIECES_SQL}) < 900""")
def stream_prepare(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    src = _as_stream(spark, sf, docs, "docs")
    out = new_folder(spark, "prepared")
    jobs.run_to_end(jobs.stream_prepare(src, out, new_folder(spark, "state"), 900, True))
    return spark.read.parquet(out).select("doc_id", "n_tokens", digest("ids").alias("content"))


@register("stream_samples", "SELECT 'k' || doc_id AS key, n_chars AS tokens FROM documents")
def stream_samples(spark, sf):
    """Every sample arrives twice; each is stored once."""
    rows = table(spark, sf, "documents").select(F.concat(F.lit("k"), F.col("doc_id")).alias("key"), F.col("n_chars").alias("tokens"))
    src = _as_stream(spark, sf, rows.unionByName(rows), "arriving")
    out = new_folder(spark, "samples")
    jobs.run_to_end(jobs.stream_samples(src, out, new_folder(spark, "state"), settings={"key": "key"}))
    return spark.read.parquet(out).select("key", "tokens")


@register("stream_summary", f"""WITH {GRADED}
SELECT bench, count(*) AS samples, round(100.0 * sum(correct::INT) / count(*), 6) AS accuracy, round(sum(tokens) / count(*), 6) AS mean_tokens,
       round(100.0 * sum(truncated::INT) / count(*), 6) AS truncated FROM graded GROUP BY bench""")
def stream_summary(spark, sf):
    graded = graded_of(spark, sf)
    src = _as_stream(spark, sf, graded, "graded")
    out = new_folder(spark, "summary")
    jobs.run_to_end(jobs.stream_summary(src, out, new_folder(spark, "state")))
    return jobs.latest_rows(spark, out, "bench").select(
        "bench", "samples", *[F.round(c, 6).alias(c) for c in ("accuracy", "mean_tokens", "truncated")])


@register("stream_consumption", f"WITH {STAGES} SELECT stage, source, tokens FROM consumed")
def stream_consumption(spark, sf):
    log = _log(spark, sf)
    src = _as_stream(spark, sf, log, "log")
    out = new_folder(spark, "consumed")
    jobs.run_to_end(jobs.stream_consumption(src, out, new_folder(spark, "state")))
    return jobs.latest_rows(spark, out, "stage", "source")
