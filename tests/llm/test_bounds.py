"""Samples stay bounded when ids repeat; edges of a mixture, clashing names, and decisions on groups."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import language_id, mixing, near_dedup, packing, quality_model, toxicity
from millrace.llm.common import by_bits, fresh_folder, key_bits, scratch, stored
from millrace.llm.queries import vocabulary
from millrace.llm.sampling import bounded_by, texts_of


def test_samples_of_repeated_ids_stay_bounded(spark):
    docs = spark.range(4000).select(F.lit(7).cast("bigint").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    copies = docs.unionByName(docs.withColumn("text", F.lit("the same"))).unionByName(spark.createDataFrame([(8, "other")], "doc_id bigint, text string"))
    chosen = spark.createDataFrame([(7, 0), (7, 1), (8, 0)], "doc_id bigint, kind int")
    got = texts_of(copies, chosen, 300)
    assert 50 < got.count() <= 600 and got.distinct().count() == got.count()
    assert texts_of(copies.where("doc_id = 8"), chosen, 300).count() == 1
    model = quality_model.train(docs, docs.select("doc_id"), 50, 50)
    assert model is None or quality_model.predict(docs.limit(10), model).count() == 10
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic"))
    assert toxicity.predict(docs.limit(10), toxicity.train(docs, labels, 50, 50)).count() == 10


def test_rare_languages_are_learned(spark):
    common = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("en").alias("lang"), F.concat(F.lit("the house is old and the road is long "), F.col("id")).alias("text"))
    rare = spark.range(20).select((F.col("id") + 10_000).alias("doc_id"), F.lit("xx").alias("lang"), F.concat(F.lit("qzu wqaj zzuq vuuq jaqz xuqz "), F.col("id")).alias("text"))
    rows = common.unionByName(rare)
    took = {r.lang: r["count"] for r in bounded_by(rows, 100, "lang", "doc_id").groupBy("lang").count().collect()}
    assert took["xx"] == 20 and 20 <= took["en"] <= 100
    model = language_id.train(rows, 100)
    assert {r.lang_pred for r in language_id.predict(rare.select("text"), model).collect()} == {"xx"}


def test_key_bits_lose_no_key(spark):
    keys = spark.range(3000).select((F.col("id") * 7919 - 1000).alias("k"))
    told = by_bits(spark.range(30_000).select((F.col("id") * 7919 - 1000).alias("k"), F.lit(1).alias("x")), F.col("k"), *key_bits(keys, "k"))
    assert told.where("_maybe").join(keys, "k", "left_semi").count() == 3000 and told.where("_maybe").count() < 8000
    assert by_bits(keys, F.lit(None).cast("bigint"), *key_bits(keys, "k")).where("_maybe").count() == 0
    assert by_bits(keys, F.col("k"), *key_bits(keys.limit(0), "k")).where("_maybe").count() == 0


def broadcast_parts(df):
    """The plan's parts that are broadcast, a text each."""
    lines, parts = df._jdf.queryExecution().executedPlan().toString().splitlines(), []
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            end = next((j for j in range(i + 1, len(lines)) if depth(lines[j]) <= depth(line)), len(lines))
            parts.append("\n".join(lines[i:end]))
    return parts


def test_no_exploded_rows_are_broadcast(spark):
    classes = stored(spark.range(50).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda k: F.xxhash64(k, F.col("id") % 30)).alias("bands")), "classes")
    members = near_dedup.in_shared_buckets(classes)
    assert not [p for p in broadcast_parts(members) if "Generate" in p]
    assert sorted({r.id for r in members.collect()}) == [*range(20), *range(30, 50)] and members.count() == 40 * 32
    docs = spark.createDataFrame([(None, "one two three", "a", "en")] * 50 + [(i, "four five", "b", "en") for i in range(30)], "doc_id long, text string, source string, lang string")
    mixed = mixing.expand(docs)
    assert not [p for p in broadcast_parts(mixed) if "Generate" in p]
    taken = {r.source: r.t for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert {r.source: r.t for r in mixed.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("t")).collect()} == taken


def test_scratch_tables_are_deleted(spark):
    with scratch(spark):
        inner = stored(spark.range(3), "inner").inputFiles()
        assert inner
    with pytest.raises(Exception):
        spark.read.parquet(inner[0]).count()
    assert fresh_folder(spark, "x") != fresh_folder(spark, "x")


CLASH = "doc_id long, text string, source string, lang string, _size int, _taken int, _k string, _gone int, _twice int, _maybe string, _bucket int, _bits int, key string, row string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, s, "en", 1, 2, "k", 3, 4, "m", 5, 6, "key", "row") for i, t, s in rows], CLASH)


def test_edges_of_a_mixture_with_equal_rows_and_clashing_names(spark):
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    rows = [(i, words(5 + i % 7), "a") for i in range(60)] + [(None, words(9), "b")] * 90 + [(500, words(40), None)] + [(501, None, "a"), (502, "", "b")]
    docs = clashing(spark, rows).repartition(5)
    got = mixing.expand(docs)
    assert got.columns == docs.columns
    taken = {r.source: r.t for r in mixing.mix(docs).groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    target = {r.source: int(r.target + 0.5) for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    found = {r.source: r.n for r in got.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert found == taken == target
    cut = [r for r in got.collect() if len(r.text.split()) not in (9, 40, *range(5, 12))]
    assert len(cut) <= 3
    by_id = Counter(r.doc_id for r in got.where("source = 'a'").collect())
    assert max(by_id.values()) - min(by_id.values()) <= 1 or len(by_id) < 60
    assert {r._k for r in got.collect()} == {"k"} and {r.key for r in got.collect()} == {"key"}


def test_mixture_with_maps(spark):
    docs = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("one two three four").alias("text"), F.when(F.col("id") < 20, "a").otherwise("b").alias("source"),
                                  F.create_map(F.lit("k"), F.col("id")).alias("extra"))
    got = mixing.expand(docs)
    assert got.columns == docs.columns and got.agg(F.sum(mixing.n_words(F.col("text")))).first()[0] == mixing.mix(docs).agg(F.sum("taken")).first()[0]


def test_first_of_group_with_clashing_names_and_repeated_ids(spark):
    body = " ".join(f"word{k}" for k in range(60))
    rows = [(1, body, "a"), (2, body + " more", "a"), (3, body, "b"), (3, body, "b"), (4, "something else " * 30, "a"), (4, "something else " * 30, "a"), (None, body, "a"), (5, None, "a"), (6, "", None)]
    docs = clashing(spark, rows).repartition(3)
    got = near_dedup.keep_first(docs)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter([1, 4, None, 5, 6])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" not in plan


def test_workers_forget_after_a_task(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words of text number "), F.col("id")).alias("text")).coalesce(1)
    path = vocabulary("byte_bpe_50k.json")
    assert packing.pieces(docs, path).count() == 40

    def kept(batches):
        from millrace.llm import tokenizing

        for batch in batches:
            yield pa.RecordBatch.from_pydict({"loaded": [len(tokenizing._LOADED)], "known": [sum(len(e.known) for e in tokenizing._LOADED.values())]})

    found = spark.range(0, 64, 1, 64).mapInArrow(kept, "loaded long, known long").collect()
    assert any(r.loaded for r in found) and not any(r.known for r in found)


def test_a_text_is_sent_to_the_language_model_once(spark):
    docs = spark.createDataFrame([(1, "the house is old"), (2, None), (3, "das haus ist alt")], "doc_id long, text string").withColumn("lang", F.when(F.col("doc_id") < 3, "en").otherwise("de"))
    model = language_id.train(docs)
    got = language_id.keep_known(docs, model)
    want = {r.doc_id for r in language_id.predict(docs, model).where("not rejected").collect()}
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in docs.collect() if r.doc_id in want} and want == {1, 3}
    assert {r.doc_id for r in language_id.keep_known(docs, model, "TEXT").collect()} == want
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan
