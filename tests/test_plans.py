"""Plans: pushed filters, no gathering of rows in one task, no cross joins, no repeated UDF."""

from __future__ import annotations

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from millrace.catalog import QUERIES
from millrace.operators import ordering, pack, ranking
from millrace.plans import prepare
from millrace.session import table


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


DATA_PLANS = ["budget_tokens", "pack_windows", "shift_labels", "running_offset", "global_row_index", "hash_order", "doc_order",
              "shuffle_windows", "mix_fractions", "sample_index", "sample_text", "blend_fetch", "chunk_batch", "sft_encode",
              "fim_sample", "grade", "topk_per_group", "topp_per_group", "block_spans"]


@pytest.mark.parametrize("name", DATA_PLANS)
def test_no_single_partition_and_no_cross_join(spark, sf, name):
    text = plan(QUERIES[name](spark, sf))
    for inputs in re.findall(r"Exchange\s*\nInput \[\d+\]: \[(.*)\]\nArguments: SinglePartition", text):
        # Only block totals (one row per block) may meet in one task.
        assert {c.split("#")[0] for c in inputs.split(", ")} == {"_block", "_total"}, inputs
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_short_text_filter_reaches_the_scan(spark, sf):
    tok = prepare.tokenized(table(spark, sf, "documents").select("doc_id", "text")).groupBy("n_tokens").count()
    text = plan(tok)
    assert re.search(r"ReadSchema: struct<text:string>", text)


def test_planning_tables_are_local(spark):
    small = ordering.plan_table(spark.range(5).withColumn("x", F.col("id") * 2))
    assert "LocalTableScan" in plan(small)
    big = ordering.plan_table(spark.range(50), max_rows=10)
    assert "LocalTableScan" not in plan(big) and big.count() == 50


def test_hot_group_is_spread(spark):
    """An input partitioned by the group alone is partitioned again by group and block."""
    df = spark.range(1000).select(F.lit("hot").alias("g"), F.col("id").alias("k"), F.lit(1).alias("size")).repartition(4, "g")
    out = ordering.running_offset(df, ["g"], "k", "size", block=10)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        used = out.withColumn("p", F.spark_partition_id()).groupBy("p").count().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert used > 1


def test_topk_is_limited_before_the_shuffle(spark, sf):
    df = table(spark, sf, "embeddings").select(F.col("label").alias("g"), F.col("vec_id").alias("id"), F.element_at("embedding", 1).alias("s"))
    assert "WindowGroupLimit" in plan(ranking.topk_per_group(df, ["g"], "s", 3))


def test_windows_carry_ids_once(spark):
    docs = spark.createDataFrame([("s", 0, [1, 2, 3], 0)], "source string, shard int, ids array<int>, start bigint")
    out = pack.pack_windows(docs, 4)
    assert plan(out).count("Exchange (") <= 2
    # The document is cut in the same generated code that repeats it, so no row carries it twice.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        made = io.StringIO()
        with contextlib.redirect_stdout(made):
            pack.pack_windows(docs, 4).explain()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    lines = made.getvalue().splitlines()
    at = next(i for i, line in enumerate(lines) if "Generate explode" in line)
    stage = re.search(r"\*\((\d+)\) Generate explode", lines[at])
    assert stage and f"*({stage.group(1)}) Project" in lines[at - 1] and "slice(" in lines[at - 1], made.getvalue()
