"""The registry and the inputs and SQL fragments its queries share."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import mixture
from millrace.operators.ordering import DEFAULT_BLOCK, plan_table
from millrace.plans import prepare
from millrace.session import shared_folder, spread, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path for a query that writes; nothing is reused or overwritten."""
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


def joined(col: str | Column) -> Column:
    """Array as one string, so both engines compare plain values."""
    col = F.col(col) if isinstance(col, str) else col
    return F.array_join(F.transform(col, lambda x: x.cast("string")), " ")


def digest(col: str | Column) -> Column:
    return F.md5(joined(col))


# Inputs ---------------------------------------------------------------------------------------

CHAT_SOURCES = ("src0", "src1", "src2")
GATE = 600
WINDOW = 256
EOS = "<eos>"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents for work on their texts."""
    return spread(table(spark, sf, "documents"), "doc_id")


def recipe_of(docs: DataFrame) -> DataFrame:
    """A recipe from the documents themselves: budget by number of rows, shards and weight by name."""
    number = F.substr("source", F.lit(4)).cast("int")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("_n")).select(
        "source", (F.col("_n") * 400).alias("budget_tokens"), (F.lit(1) + number % 3).cast("int").alias("shards"),
        (F.lit(1) + number % 2).cast("double").alias("sampling_weight"), F.lit(GATE).alias("max_doc_tokens"),
    )


def jobs_of(docs: DataFrame) -> DataFrame:
    return plan_table(mixture.plan_shards(recipe_of(docs)))


def kept_of(spark: SparkSession, sf: str, block: int = DEFAULT_BLOCK) -> DataFrame:
    jobs = jobs_of(table(spark, sf, "documents"))
    return prepare.budgeted(documents(spark, sf).select("doc_id", "source", "text"), jobs, CHAT_SOURCES, block=block)


def placed_of(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Places of the documents inside their budget, and the ids of all."""
    return prepare.placed(documents(spark, sf).select("doc_id", "source", "text"), jobs_of(table(spark, sf, "documents")), CHAT_SOURCES)


def graded_of(spark: SparkSession, sf: str) -> DataFrame:
    """Graded answers: a document is an answer, its language the benchmark, its source the question."""
    docs, labels = documents(spark, sf), table(spark, sf, "labels")
    rows = docs.join(labels, "doc_id").select(
        "doc_id", F.col("lang").alias("bench"), F.col("source").alias("id"), (F.col("quality") == 1).alias("correct"),
        F.size(X.pieces(F.col("text"))).cast("bigint").alias("tokens"),
    )
    return rows.withColumn("truncated", F.col("tokens") >= 512)


def sources_of(docs: DataFrame) -> DataFrame:
    """(source, ds, docs): sources numbered by name."""
    counts = docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    return plan_table(counts.withColumn("ds", F.row_number().over(Window.orderBy("source")) - 1))


def langs_of(docs: DataFrame) -> DataFrame:
    """(lang, ds, docs, weight): languages numbered by name, weight = tenths of the rows, at least 1."""
    counts = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    total = F.sum("docs").over(Window.partitionBy())
    return plan_table(counts.withColumn("ds", F.row_number().over(Window.orderBy("lang")) - 1).withColumn(
        "weight", F.greatest(F.expr("1L"), F.floor(F.col("docs") * 10 / total)).cast("bigint")
    ))


# SQL fragments --------------------------------------------------------------------------------

PIECES_SQL = r"regexp_extract_all(text, '[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]')"


def hash_sql(*parts: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8))::BIGINT"


TOK = f"""tok AS (
  SELECT doc_id, source, lang, {PIECES_SQL} AS ids, len(ids)::BIGINT AS n
  FROM documents WHERE length(text) >= 50)"""

RECIPE = f"""recipe AS (
  SELECT source, count(*) * 400 AS budget_tokens, 1 + substr(source, 4)::INT % 3 AS shards,
         (1 + substr(source, 4)::INT % 2)::DOUBLE AS sampling_weight, {GATE} AS max_doc_tokens
  FROM documents GROUP BY source)"""

JOBS = RECIPE + """,
jobs AS (
  SELECT source, shard, CASE WHEN shards = 1 THEN source ELSE source || '_p' || shard END AS name,
         budget_tokens // shards AS budget, sampling_weight / shards AS weight, max_doc_tokens
  FROM (SELECT *, unnest(range(shards)) AS shard FROM recipe))"""

KEPT = f"""{TOK},
{JOBS},
sharded AS (
  SELECT t.*, {hash_sql("0", "doc_id")} % r.shards AS shard,
         source IN ('src0', 'src1', 'src2') AND n >= {GATE} AS dropped
  FROM tok t JOIN recipe r USING (source)),
sized AS (SELECT *, CASE WHEN dropped THEN 0 ELSE n + 1 END AS size FROM sharded),
placed AS (
  SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY doc_id) - size)::BIGINT AS start FROM sized),
kept AS (
  SELECT p.*, j.budget, least(size, budget - start)::BIGINT AS take
  FROM placed p JOIN jobs j USING (source, shard) WHERE start < budget)"""

# One row per token of the kept stream, with its place.
STREAM = KEPT + f""",
stream AS (
  SELECT source, shard, doc_id, unnest(list_slice(list_append(ids, '{EOS}'), 1, take)) AS tok,
         start + generate_subscripts(list_slice(list_append(ids, '{EOS}'), 1, take), 1) - 1 AS place
  FROM kept WHERE NOT dropped)"""

GRADED = f"""graded AS (
  SELECT doc_id, lang AS bench, source AS id, quality = 1 AS correct, len({PIECES_SQL})::BIGINT AS tokens,
         tokens >= 512 AS truncated
  FROM documents JOIN labels USING (doc_id))"""

SOURCES = """sources AS (
  SELECT source, (row_number() OVER (ORDER BY source) - 1)::INT AS ds, count(*) AS docs FROM documents GROUP BY source)"""

LANGS = """langs AS (
  SELECT lang, (row_number() OVER (ORDER BY lang) - 1)::INT AS ds, count(*) AS docs,
         greatest(1, (count(*) * 10) // (SELECT count(*) FROM documents))::BIGINT AS weight
  FROM documents GROUP BY lang)"""
