"""Streams equal the batch operator on the same rows, also after a restart."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from millrace.session import table
from millrace.streaming import jobs


def test_samples_survive_a_restart(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.range(50).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("tokens"))
    rows.where("tokens < 30").repartition(3).write.parquet(src)
    run = lambda: jobs.run_to_end(jobs.stream_samples(jobs.file_stream(spark, src, rows.schema), out, state))
    run()
    assert spark.read.parquet(out).count() == 30
    rows.where("tokens >= 20").repartition(2).write.mode("append").parquet(src)
    run()
    got = spark.read.parquet(out)
    assert got.count() == 50 and got.select("key").distinct().count() == 50
    run()
    assert spark.read.parquet(out).count() == 50


def test_a_key_of_an_earlier_run_is_not_stored_again(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "key string, tokens int")
    again = spark.createDataFrame([("b", 20), ("c", 4), (None, 30), ("c", 4)], "key string, tokens int")
    run = lambda: jobs.run_to_end(jobs.stream_samples(jobs.file_stream(spark, src, rows.schema), out, state))
    rows.coalesce(1).write.parquet(src)
    run()
    files = set(os.listdir(out))
    again.coalesce(1).write.mode("append").parquet(src)
    run()
    got = {r.key: r.tokens for r in spark.read.parquet(out).collect()}
    assert got == {"a": 1, "b": 2, None: 3, "c": 4} and spark.read.parquet(out).count() == 4
    assert files < set(os.listdir(out))  # earlier output stands as it was written


def test_samples_of_other_settings_are_refused(spark, tmp_path):
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows = spark.createDataFrame([("a", 1)], "key string, tokens int")
    rows.write.parquet(src)
    run = lambda **s: jobs.run_to_end(jobs.stream_samples(jobs.file_stream(spark, src, rows.schema), out, state, settings=s))
    run(model="m", temperature=0.6)
    run(temperature=0.6, model="m")
    for other in ({"model": "m", "temperature": 0.7}, {"model": "m"}, {"model": "m", "temperature": 0.6, "top_p": 1}):
        with pytest.raises(ValueError, match="other values"):
            run(**other)
    assert spark.read.parquet(out).count() == 1


def test_summary_after_a_restart_and_a_repeated_batch(spark, tmp_path):
    rows = spark.range(90).select(F.concat(F.lit("b"), F.col("id") % 5).alias("bench"), (F.col("id") % 4 == 0).alias("correct"),
                                  F.col("id").alias("tokens"), (F.col("id") > 30).alias("truncated"))
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    run = lambda: jobs.run_to_end(jobs.stream_summary(jobs.file_stream(spark, src, rows.schema), out, state))
    rows.where("tokens < 40").repartition(3).write.parquet(src)
    run()
    last = max(os.listdir(f"{state}/commits"), key=lambda f: int(f) if f.isdigit() else -1)
    os.remove(f"{state}/commits/{last}")  # the last batch was written, but its end was not recorded
    crc = f"{state}/commits/.{last}.crc"
    if os.path.exists(crc):
        os.remove(crc)
    rows.where("tokens >= 40 AND bench <> 'b0'").repartition(2).write.mode("append").parquet(src)
    run()
    want = jobs.running_summary(rows.where("tokens < 40 OR bench <> 'b0'"))
    got = jobs.latest_rows(spark, out, "bench")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    batches = sorted(int(f.split("=")[1]) for f in os.listdir(out) if f.startswith("batch="))
    assert len(batches) >= 5
    assert spark.read.parquet(f"{out}/batch={batches[-1]}").where("bench = 'b0'").isEmpty()  # only what changed


def test_prepare_equals_batch(spark, sf, tmp_path):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    docs.repartition(3).write.parquet(src)
    jobs.run_to_end(jobs.stream_prepare(jobs.file_stream(spark, src, docs.schema), out, state, 500, True))
    got, want = spark.read.parquet(out), jobs.prepare_rows(docs, 500, True)
    assert got.count() == want.count() and got.select("doc_id", "ids").exceptAll(want.select("doc_id", "ids")).isEmpty()


def test_summary_grows_to_batch(spark, tmp_path):
    rows = spark.range(40).select(F.concat(F.lit("b"), F.col("id") % 3).alias("bench"), (F.col("id") % 4 == 0).alias("correct"),
                                  F.col("id").alias("tokens"), (F.col("id") > 30).alias("truncated"))
    src, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    rows.repartition(4).write.parquet(src)
    jobs.run_to_end(jobs.stream_summary(jobs.file_stream(spark, src, rows.schema), out, state))
    want = {tuple(r) for r in jobs.running_summary(rows).collect()}
    assert {tuple(r) for r in jobs.latest_rows(spark, out, "bench").collect()} == want


def test_synthetic_stream(spark):
    df = jobs.stream_synthetic(spark, 50, 8, 100)
    assert df.isStreaming and df.schema["ids"].dataType.simpleString() == "array<int>"
    query = df.writeStream.format("memory").queryName("synthetic_rows").trigger(once=True).start()
    query.awaitTermination(60)
    query.stop()
    assert spark.sql("select * from synthetic_rows where size(ids) != 9").isEmpty()
