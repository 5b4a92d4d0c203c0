"""Flat token files as a data source: round trips, stretches of streams, commits and failures."""

from __future__ import annotations

import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.sources import flat_tokens, stores

SCHEMA = "source string, shard int, doc_id bigint, ids array<int>"


def rows_of(n, seed, shards=2):
    rng = random.Random(seed)
    return [("s", i % shards, i, None if i % 11 == 5 else [rng.randrange(60000) for _ in range(rng.randrange(0, 40))]) for i in range(n)]


def streams(rows):
    out = {}
    for source, shard, _, ids in sorted(rows, key=lambda r: r[2]):
        out.setdefault(f"{source}_p{shard}", []).extend(ids or [])
    return out


def files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path) for f in names)


def read(spark, path, *args, **more):
    return {(r.folder.split("/")[-1], r.win): r.ids for r in stores.read_token_bytes(spark, path, *args, **more).collect()}


@pytest.mark.parametrize("skip,most", [(0, None), (7, None), (0, 95), (33, 400), (10**6, 5)])
def test_stretches_of_streams(spark, tmp_path, skip, most):
    rows, path = rows_of(300, 1), str(tmp_path / "t")
    stores.write_token_bytes(spark.createDataFrame(rows, SCHEMA), path, 2, 16)
    want = {}
    for folder, flat in streams(rows).items():
        flat = flat[skip:][:most]
        want |= {(folder, w): flat[w * 10 : w * 10 + 10] for w in range(len(flat) // 10)}
    assert read(spark, path, 9, 2, 130, skip, most) == want


def test_256_documents_a_part_and_plain_options(spark, tmp_path):
    rows, path = rows_of(1500, 2, 1), str(tmp_path / "t")
    stores.write_token_bytes(spark.createDataFrame(rows, SCHEMA).repartition(5), path, 4, 256)
    assert len(files(path)) == 6 and all(f.endswith(".ds") for f in files(path))
    flat = np.concatenate([np.fromfile(f, "<u4") for f in files(path)])
    assert flat.tolist() == streams(rows)["s_p0"]
    df = spark.read.format("flat_tokens").option("length", 99).load(f"file://{path}")
    assert df.count() == len(flat) // 100
    with pytest.raises(Exception, match="option length"):
        spark.read.format("flat_tokens").load(f"file://{path}").count()


def test_a_failed_job_shows_and_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(rows_of(400, 3), SCHEMA).repartition(4)
    bad = df.withColumn("ids", F.when(F.col("doc_id") == 399, F.raise_error(F.lit("torn")).cast("array<int>")).otherwise(F.col("ids")))
    with pytest.raises(Exception, match="torn"):
        stores.write_token_bytes(bad, path, 4, 16)
    assert not [f for f in files(path) if f.endswith(".ds")] and read(spark, path, 9) == {}
    stores.write_token_bytes(df, path, 4, 16)
    whole = read(spark, path, 9)
    with pytest.raises(Exception, match="torn"):
        stores.write_token_bytes(bad, path, 4, 16)
    assert read(spark, path, 9) == whole  # an earlier table stands


def test_writing_again_replaces_parts_and_overwriting_all(spark, tmp_path):
    path, rows = str(tmp_path / "t"), rows_of(64, 4, 1)
    stores.write_token_bytes(spark.createDataFrame(rows, SCHEMA), path, 4, 16)
    again = [(s, k, i, [1] * 20) for s, k, i, _ in rows[:16]]
    stores.write_token_bytes(spark.createDataFrame(again, SCHEMA), path, 4, 16)
    flat = streams([*again, *rows[16:]])["s_p0"]
    assert read(spark, path, 4) == {("s_p0", w): flat[w * 5 : w * 5 + 5] for w in range(len(flat) // 5)}
    stores.write_token_bytes(spark.createDataFrame(again, SCHEMA), path, 4, 16, mode="overwrite")
    assert len(files(path)) == 1 and read(spark, path, 319) == {("s_p0", 0): [1] * 320}


def test_no_rows_and_paths_without_a_scheme(spark, tmp_path):
    path = str(tmp_path / "t")
    stores.write_token_bytes(spark.createDataFrame([], SCHEMA), path)
    assert read(spark, path, 4) == {}
    assert flat_tokens.qualified(spark, "/shared/x") == "file:/shared/x"
    assert flat_tokens.qualified(spark, "file:///shared/x") in ("file:/shared/x", "file:///shared/x")


def test_bytes_of_null_and_empty_lists(spark):
    df = spark.createDataFrame([(0, [1, 258]), (1, None), (2, []), (3, [65535])], "k int, ids array<int>").coalesce(1)
    got = stores.token_bytes(df, 2).orderBy("k").collect()
    assert [r.payload and bytes(r.payload) for r in got] == [b"\x01\x00\x02\x01", None, b"", b"\xff\xff"]
