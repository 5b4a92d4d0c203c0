"""A corpus pipeline: language, quality rules, near duplicates, mixture, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again for the next
stage.  All but the last return the columns of documents.  Null and empty texts are rejected by the first stage (no
letter, so no language); empty tables pass through as empty tables; repeated rows are one group of near duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, near_dedup, packing, quality_rules
from millrace.llm.common import stored
from millrace.llm.queries import vocabulary
from millrace.session import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model tells with calibrated confidence; it learns from the documents' own labels."""
    return language_id.keep_known(docs, language_id.train(docs))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the table of rules."""
    return quality_rules.keep_good(docs)


def first_of_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group at 80 % of shared five-word shingles."""
    return near_dedup.keep_first(docs, 80, 5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them; a document that a source's target cuts keeps its first words."""
    return mixing.expand(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 ids."""
    rows = packing.pieces(docs, vocabulary("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(rows, packing.groups_for(docs.count()), keys=("doc_id", "piece", "ids_crc32"))


STAGES = [
    ("language_id", known_language),
    ("quality_rules", good_quality),
    ("near_dedup", first_of_group),
    ("mixing", mixed),
    ("packing", packed),
]

#: The first stage is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
