"""Passes, shuffles and files that stay bounded, on rows of the tests' own."""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.catalog import streams
from millrace.functions.arrays import packed, unpacked
from millrace.functions.md5 import md5_numbers, md5_prefixes
from millrace.operators import fim, mixture, ordering, pack, tokens
from millrace.sources import flat_tokens, stores


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_passes_are_cut_by_values_and_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * 40, ["b" * 400], [], None, ["c"] * 90])], ["ids"])
    parts = list(tokens._passes([batch, batch.slice(1, 3)], "ids", 100))
    assert [p.num_rows for p in parts] == [1, 1, 3, 1, 2] or max(p.num_rows for p in parts) < 5
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist() + batch.column(0).to_pylist()[1:4]


def test_bytes_of_small_passes_read_back(spark, monkeypatch):
    """The decoder and the encoder work on a few values at a time and give the same rows."""
    df = spark.createDataFrame([(1, ["the", "zebra", "é", "the"]), (2, []), (3, ["x" * 300]), (4, None)], "doc_id bigint, ids array<string>")
    vocab = spark.createDataFrame([("the", tokens.FIRST_PIECE_ID)], "token string, id int")
    for most in (10, 0):
        coded = tokens.encode_ids(df, vocab, max_broadcast=most, byte_fallback=True)
        back = {r.doc_id: r.pieces for r in tokens.pieces_of(coded, vocab, max_broadcast=most).collect()}
        assert back == {1: ["the", "zebra", "é", "the"], 2: [], 3: ["x" * 300], 4: []}


def test_joined_vocabulary_shuffles_distinct_pieces(spark):
    df = spark.createDataFrame([(1, ["a", "b"] * 1000), (1, ["a", "b"] * 1000), (2, ["c"])], "doc_id bigint, ids array<string>")
    vocab = spark.createDataFrame([("a", 300), ("c", 301)], "token string, id int")
    coded = tokens.encode_ids_by_join(df, vocab, "ids", "ids")
    assert "posexplode" not in plan_of(coded)
    assert sorted((r.doc_id, len(r.ids), r.ids[:2]) for r in coded.collect()) == [(1, 2000, [300, 1]), (1, 2000, [300, 1]), (2, 1, [301])]


def test_packed_arrays_come_back(spark):
    rows = [(["a", "b"],), ([],), (None,), ([""],), (["", ""],), (["a b", "c"],), (["x", None],)]
    df = spark.createDataFrame(rows, "ids array<string>")
    assert [r[0] for r in df.select(unpacked(packed(F.col("ids")))).collect()] == [r[0] for r in rows]
    stream = spark.createDataFrame([("s", 0, ["a b", "c"], 0), ("s", 0, ["d", "e"], 2)], "source string, shard int, ids array<string>, start bigint")
    windows = pack.assemble_windows(stream, 3, 3)
    assert "array_join" in plan_of(windows)
    assert sorted(r.ids for r in windows.collect()) == [["a b", "c", "d"], ["e"]]


def test_counts_in_hash_order_without_shuffling_hashes(spark):
    lens = spark.createDataFrame([(0, 70_000), (1, 0), (2, 300)], "ds int, len bigint")
    got = ordering.hash_order_counts(lens, "len", "sample", 70_300, 5)
    want = ordering.hash_order(ordering.expand_counts(lens, "len", "sample"), 5, ["ds", "sample"])
    assert sorted(map(tuple, got.select("ds", "sample", "pos").collect())) == sorted(map(tuple, want.select("ds", "sample", "pos").collect()))
    order = mixture.epoch_index(spark, None, lens, 70_400, 5)
    assert "collect_list" in plan_of(order)


def test_many_numbers_are_hashed_together():
    numbers = np.array([0, 9, 10, 999_999, 1_000_000, 123_456_789, 10**12 + 7, 10**17 + 3])
    for head in (b"", b"11:2:", b"x" * 52 + b":", b"x" * 60 + b":", b"y" * 200, "5:\u00e4:".encode()):
        want = [int(hashlib.md5(head + str(k).encode()).hexdigest(), 16) for k in numbers.tolist()]
        assert md5_numbers(head, numbers).tolist() == [w >> 64 for w in want]
        assert md5_numbers(head, numbers, last=True).tolist() == [w & (1 << 64) - 1 for w in want]
        assert md5_prefixes(head, numbers, 9).tolist() == [w >> 119 for w in want]


def test_counts_in_hash_order_with_repeated_and_null_keys(spark):
    lens = spark.createDataFrame([(0, "a", 1200), (0, "a", 1200), (None, "a", 700), (7, None, 30), (None, "7", 40), (3, "b", None), (4, "b", -5)], "ds int, name string, len bigint")
    got = ordering.hash_order_counts(lens, "len", "sample", 3170, 5)
    want = ordering.hash_order(ordering.expand_counts(lens, "len", "sample"), 5, ["ds", "name", "sample"])
    rows = lambda df: sorted(map(repr, df.select("ds", "name", "sample", "pos").collect()))
    assert rows(got) == rows(want) and got.schema["ds"].dataType == lens.schema["ds"].dataType
    got.collect()
    plan = plan_of(got)
    assert "ReusedExchange" in plan and "md5(" not in plan  # hashed once before the shuffle, in Python
    assert ordering.hash_order_counts(lens.limit(0), "len", "sample", 0, 5).count() == 0


def test_the_last_epoch_is_cut_before_rows_are_repeated(spark):
    lens = spark.createDataFrame([(0, 30), (1, 12)], "ds int, len bigint")
    for n in (0, 5, 42, 43, 84, 100):
        order = mixture.epoch_index(spark, None, lens, n, 5)
        assert sorted(r.pos for r in order.collect()) == [*range(n)]
    df = spark.range(10)
    assert Counter(r.id for r in ordering.repeat_epochs(df, 3, last=F.col("id") < 4).collect()) == {i: 3 if i < 4 else 2 for i in range(10)}
    assert ordering.repeat_epochs(df, 1, last=F.col("id") < 4).count() == 4


def test_salt_of_a_source_is_not_hashed_in_rounds(spark):
    places = spark.createDataFrame([("a", 0), ("b", 1)], "source string, place bigint")
    lens = spark.createDataFrame([("a", 5), ("b", 9)], "source string, len bigint")
    assert "md5" not in plan_of(mixture.windows_at(places, lens, 3))


def test_a_cut_is_hashed_once(spark):
    df = spark.createDataFrame([(1, "one two three")], "doc_id bigint, text string")
    text = F.col("text")
    plan = plan_of(df.select(fim.permuted(text, fim.Fim(1.0, 0.0, 1).encode(text), fim.Fim(1.0, 0.0, 1), 1.0, F.col("doc_id")).alias("x")))
    assert plan.count("cut0") == plan.count("cut1") == 1


def test_short_ranges_share_tasks():
    files = [(f"/d/a_p0/part-{i:03d}.ds", 1000) for i in range(1000)]
    found = flat_tokens.ranges(files, 40, 4, 80, 0, None)
    dealt = flat_tokens.by_task(found)
    assert [r for t in dealt for r in t.held] == found
    assert 1 < len(dealt) <= 2 * flat_tokens.TASKS < len(found)


def test_files_hold_rows_of_their_shard(spark, tmp_path):
    """Ids dealt to many shards make files of as many rows, and later ids none of the same names."""
    def rows(low, high):
        return spark.range(low, high).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 8).cast("int").alias("shard"),
                                             F.array(F.col("id").cast("int")).alias("ids"))
    path = str(tmp_path / "flat")
    stores.write_token_bytes(rows(0, 800), path, 4, 50)
    assert len(flat_tokens._listed(path)) == 16
    stores.write_token_bytes(rows(800, 2400), path, 4, 50)
    got = [i for r in stores.read_token_bytes(spark, path, 1, 4).where("folder like '%s_p3'").orderBy("win").collect() for i in r.ids]
    assert got == list(range(3, 2400, 8))


def test_stream_files_grow_in_number(spark, tmp_path, monkeypatch):
    """Files hold a split's rows, not a quarter of the table."""
    folder = str(tmp_path / "sf")
    spark.range(64).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text")).repartition(16).write.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(streams, "new_folder", lambda *_: str(tmp_path / "arriving"))
    held = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
        streams._as_stream(spark, folder, spark.read.parquet(f"{folder}/documents.parquet"), "docs")
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", held)
    assert len(list((tmp_path / "arriving").glob("*.parquet"))) >= 16
