"""Permutations with direct access, quantiles by counts, bootstrap by partial sums, carried boundaries, and digests as a tree."""

from __future__ import annotations

import os
import random
from bisect import bisect_right

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions.permutation import number_at, place_of
from millrace.functions.seeded import seeded_unit
from millrace.operators import evals, joins, mixture, pack, quality
from millrace.plans import stored_plans


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000, 4096])
def test_permutations_and_their_inverse(spark, n):
    df = spark.range(n).select("id", place_of(F.col("id"), n, 5).alias("p"), place_of(F.col("id"), n, 6).alias("q"), place_of(F.col("id"), n, 5, F.lit(77)).alias("s"))
    rows = df.withColumn("back", number_at(F.col("p"), n, 5)).collect()
    assert sorted(r.p for r in rows) == sorted(r.q for r in rows) == sorted(r.s for r in rows) == list(range(n))
    assert all(r.back == r.id for r in rows)
    if n >= 97:
        assert len({tuple(r[c] for r in rows) for c in ("id", "p", "q", "s")}) == 4


def test_permutations_of_large_ranges_spread_evenly(spark):
    n = 10**15 + 37
    rows = spark.range(10**15, 10**15 + 20_000 // 1000).select("id").unionByName(spark.range(20_000)).select("id", place_of(F.col("id"), n, 3).alias("p"))
    got = rows.withColumn("back", number_at(F.col("p"), n, 3)).collect()
    assert all(0 <= r.p < n and r.back == r.id for r in got) and len({r.p for r in got}) == len(got)
    counts, _ = np.histogram([r.p / n for r in got], 16, (0, 1))
    assert counts.min() > 0.85 * len(got) / 16 and counts.max() < 1.15 * len(got) / 16
    # Neighbours don't stay near each other.
    near = sum(abs(a.p - b.p) < n / 100 for a, b in zip(got, got[1:]))
    assert near < 0.05 * len(got)


def test_orders_need_no_exchange_and_resume_anywhere(spark):
    n, k = 5000, 3700
    placed = mixture.sample_places(spark.range(n).withColumnRenamed("id", "sample"), n, k, 8)
    assert "Exchange" not in plan(placed)
    pos = {r["sample"]: r["pos"] for r in placed.collect()}
    assert sorted(pos.values()) == list(range(n)) and all((p < k) == (s < k) for s, p in pos.items())
    part = mixture.samples_at(spark.range(4000, 4100).withColumnRenamed("id", "pos"), n, k, 8)
    assert "Exchange" not in plan(part) and all(pos[r["sample"]] == r["pos"] for r in part.collect())
    whole = {r.pos: (r.epoch, r.step, r["sample"]) for r in mixture.batch_samples(spark, 300, 0, 900, 4, 16).collect()}
    rest = mixture.batch_samples(spark, 300, 450, 900, 4, 16)
    assert "Exchange" not in plan(rest) and {r.pos: (r.epoch, r.step, r["sample"]) for r in rest.collect()} == {p: v for p, v in whole.items() if p >= 450}
    epochs = [[whole[p][2] for p in range(e * 300, e * 300 + 300)] for e in range(3)]
    assert all(sorted(e) == list(range(300)) for e in epochs) and epochs[0] != epochs[1] != epochs[2]


def test_window_orders_by_source(spark):
    lens = spark.createDataFrame([("a", 50), ("b", 50), ("c", 1)], "source string, len bigint")
    win = lens.select("source", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("len") - 1)).alias("win"))
    got = mixture.windows_at(mixture.window_places(win, lens, 1).drop("win"), lens, 1).collect()
    by = {s: [r.win for r in sorted(got, key=lambda r: r.place) if r.source == s] for s in "abc"}
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and by["a"] != by["b"]


# Quantiles ------------------------------------------------------------------------------------


@pytest.mark.parametrize("block", [None, 3])
def test_quantiles_by_counts(spark, block):
    rng = random.Random(2)
    rows = [(rng.choice(["x", "y", None]), rng.choice([None, *range(-20, 40)]), rng.random() < 0.3) for _ in range(2000)] + [("z", None, True), ("w", 7, None)]
    df = spark.createDataFrame(rows, "g string, v int, t boolean").repartition(5)
    wanted = {"q10": ("interpolated", 1, 10), "median": ("interpolated", 1, 2), "p90": ("nearest", 9, 10), "top": ("nearest", 1, 1)}
    got = evals.value_quantiles(df, "v", wanted, "g", shares={"share": F.col("t").cast("int")}, block=block)
    out = {r.g: r for r in got.collect()}
    assert set(out) == {"x", "y", "z", "w", None}
    for g, r in out.items():
        values = sorted(v for k, v, _ in rows if k == g and v is not None)
        flags = [t for k, _, t in rows if k == g and t is not None]
        assert r.share == (pytest.approx(sum(flags) / len(flags)) if flags else None)
        if not values:
            assert (r.q10, r.median, r.p90, r.top) == (None,) * 4
            continue
        assert r.q10 == pytest.approx(np.quantile(values, 0.1)) and r.median == np.median(values)
        assert (r.p90, r.top) == (values[-(-9 * len(values) // 10) - 1], values[-1])
    everything = evals.value_quantiles(df, "v", {"m": ("interpolated", 1, 2)}).collect()
    assert [r.m for r in everything] == [np.median([v for _, v, _ in rows if v is not None])]
    assert evals.value_quantiles(df.limit(0), "v", {"m": ("nearest", 1, 2)}, "g").count() == 0


def test_no_buffer_holds_the_values_of_a_group(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("bench"), F.col("id").alias("tokens"), F.lit(True).alias("truncated"))
    text = plan(evals.token_quantiles(df, "bench"))
    assert not any(f in text for f in ("percentile(", "median(", "collect_list(", "percentile_disc("))


def test_sketches_stay_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 7).alias("part"), F.expr("id * 7919 % 200003").alias("v"))
    one = evals.merged_sketches(evals.quantile_sketches(df, "v", "part"))
    values = np.sort([r.v for r in df.select("v").collect()])
    for share in (0.001, 0.1, 0.5, 0.9, 0.99):
        value = one.select(evals.sketched_quantile(share)).first()[0]
        rank = np.searchsorted(values, value, "right") / len(values)
        assert abs(rank - share) < 2 * evals.SKETCH_ERROR
    assert len(one.first().sketch) < 20_000


# Bootstrap ------------------------------------------------------------------------------------


def test_replicate_sums_against_the_definition(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(f"b{k % 3}", f"q{k}", rng.choice([None, -1.0, 0.0, 0.25])) for k in range(200)]
    df = spark.createDataFrame(rows, "bench string, id string, d double").repartition(4)
    got = evals.replicate_sums(df, 20, 9)
    assert "Generate" not in plan(got)
    u = spark.createDataFrame([(r, b, i, d) for b, i, d in rows if d is not None for r in range(20)], "r int, bench string, id string, d double")
    weights = {}
    for r in u.select("*", seeded_unit(9, F.col("r"), F.col("bench"), F.col("id")).alias("u")).collect():
        w = sum(r.u >= c for c in evals.POISSON_CDF)
        a, b = weights.get((r.bench, r.r), (0, 0.0))
        weights[r.bench, r.r] = a + w, b + w * r.d
    found = {(r.bench, r.replicate): (r.weights, r.weighted) for r in got.collect()}
    assert set(found) == set(weights) and all(found[k] == pytest.approx(weights[k]) for k in found)


# Carried boundaries ---------------------------------------------------------------------------


@pytest.mark.parametrize("rows", [7, 100, 1 << 16])
def test_carried_boundaries_against_search(spark, rows):
    rng = random.Random(4)
    # One range holds nine tenths of the points.
    bounds = [("s", 0, "first"), ("s", 50, "huge"), ("s", 950, "last"), ("t", 300, "only"), (None, 0, "none"), ("s", None, "nowhere")]
    points = [("s", rng.randrange(-5, 1000), i) for i in range(900)] + [("t", rng.randrange(0, 1000), i) for i in range(60)]
    points += [(None, 5, -1), ("s", None, -2), ("u", 5, -3)]
    p = spark.createDataFrame(points, "source string, pos bigint, id int").repartition(3)
    b = spark.createDataFrame(bounds, "source string, start int, name string")
    got = {(r.source, r.id): (r.name, r.start) for r in joins.carry_join(p, b, "pos", "start", ["source"], rows).collect()}
    want = {}
    for source, pos, i in points:
        own = sorted((s, name) for k, s, name in bounds if k == source and s is not None and source is not None)
        if pos is None or not own or source is None:
            continue
        k = bisect_right([s for s, _ in own], pos)
        if k:
            want[source, i] = own[k - 1][1], own[k - 1][0]
    assert got == want


def test_steps_and_windows_by_blocks_and_by_cells_agree(spark):
    steps = spark.range(0, 3000).select(F.col("id").alias("step"))
    stages = spark.createDataFrame([("a", 10), ("b", 40), ("c", 2900)], "name string, start_step bigint")
    same = lambda x, y: x.exceptAll(y).isEmpty() and y.exceptAll(x).isEmpty()
    assert same(joins.stage_for_step(steps, stages), joins.stage_for_step(steps, stages, 100).select("step", "name", "start_step"))
    lens = spark.createDataFrame([("s", "a", 5), ("s", "b", 0), ("s", "c", 1990), ("t", "a", 3)], "source string, file string, len bigint")
    pos = spark.createDataFrame([(s, p) for s in "stu" for p in range(-2, 2000, 3)], "source string, pos bigint")
    cols = ["source", "pos", "file", "inner_pos"]
    assert same(joins.locate_window(pos, lens).select(*cols), joins.locate_window(pos, lens, width=64).select(*cols))


# Digests --------------------------------------------------------------------------------------


def test_changed_blocks_are_named_exactly(spark):
    rows = [(f"s{i % 3}", i % 2, i, [i, i + 1], None if i % 5 else "x") for i in range(600)]
    schema = "source string, shard int, doc_id bigint, ids array<int>, note string"
    a = spark.createDataFrame(rows, schema)
    leaves = lambda df: quality.block_digests(df, "doc_id", 50)
    assert quality.changed_blocks(leaves(a), leaves(a.orderBy(F.rand(1)).repartition(7))).count() == 0
    changed = [r if r[2] != 123 else (*r[:3], [0], r[4]) for r in rows if r[2] != 400] + [("s0", 0, 999, [1], None), ("s9", 0, 1, [], None)]
    changed = [r if r[2] != 222 else (*r[:4], "") for r in changed]  # null to empty
    got = quality.changed_blocks(leaves(a), leaves(spark.createDataFrame(changed, schema)))
    assert {tuple(r) for r in got.collect()} == {
        ("s0", 1, 2, "changed"), ("s1", 0, 8, "changed"), ("s0", 0, 4, "changed"), ("s0", 0, 19, "added"), ("s9", 0, 0, "added")}
    tops = [quality.table_digest(quality.shard_digests(leaves(t))).first() for t in (a, a.repartition(3))]
    assert tops[0] == tops[1] and tops[0]["rows"] == 600
    assert quality.changed_blocks(leaves(a), leaves(a.limit(0))).where("change = 'removed'").count() == leaves(a).count()


# Stored plans ---------------------------------------------------------------------------------


def test_plans_are_built_once_per_parameters_and_input(spark, tmp_path):
    folder = str(tmp_path / "plans")
    docs = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 17 + 1).alias("size"))
    run = lambda d=docs, seed=1, L=16: stored_plans.stored_sample_index(spark, folder, d, 2, seed, L)
    names = lambda: sorted(os.listdir(folder))
    first = run()
    made = names()
    times = {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in made}
    again = run(docs.repartition(7))
    assert names() == made and {n: os.stat(f"{folder}/{n}").st_mtime_ns for n in made} == times
    assert "Exchange" not in plan(again) and again.exceptAll(first).isEmpty()
    want = pack.sample_index(mixture.doc_order(docs, 2, 1, False), 16)
    assert want.exceptAll(again).isEmpty() and again.exceptAll(want).isEmpty()
    run(L=8)
    assert len(names()) == len(made) + 1  # the order is shared
    run(seed=2)
    run(docs.withColumn("size", F.col("size") + 1))
    assert len(names()) == len(made) + 5
    assert not [n for n in names() if n.startswith("_")]
    lens = spark.createDataFrame([(0, 40), (1, 25)], "ds int, len bigint")
    assert stored_plans.stored_epoch_index(spark, folder, None, lens, 65, 3).count() == stored_plans.stored_epoch_index(spark, folder, None, lens, 65, 3).count() == 65
