"""Small examples with results worked out by hand."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.operators import evals, joins, mixture, pack, quality, runs, sft, tokens
from millrace.operators.ordering import running_offset


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return row.select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text, want", [
    (r"a \boxed{1} b \boxed{\frac{1}{2}} c", r"\frac{1}{2}"),
    (r"\boxed{1", None),
    ("no box", None),
    ("", None),
    (r"\boxed x {y} z}", "y"),
    (r"\boxed{}", ""),
    (r"\boxed{a} \boxed", None),
    (r"\boxed{{a}{b}} }", "{a}{b}"),
])
def test_last_boxed(spark, text, want):
    assert one(spark, X.last_boxed(F.col("t")), t=text) == want


def test_pred_answer_falls_back(spark):
    assert one(spark, X.pred_answer(F.col("t")), t=r"\boxed{7}</think>") == "7"
    assert one(spark, X.pred_answer(F.col("t")), t=r"\boxed{7}</think> \boxed{}") == ""
    assert one(spark, X.pred_answer(F.col("t")), t=r"\boxed{7}</think> \boxed{8}") == "8"


def test_grades(spark):
    check = lambda p, g: one(spark, X.math_correct(F.lit(p), F.lit(g)))
    assert check("1,234", "1234") and check(r"\frac{1}{2}", "0.5") and check("2/4", "0.5") and check(r"\dfrac12", r"\frac12")
    assert not check("1/0", "0") and not check("x", "y") and not check(None, "1") and not check("", "")
    assert one(spark, X.choice_correct(F.lit("The answer is B"), F.lit("A"))) is False
    assert one(spark, X.choice_correct(F.lit("(C) because"), F.lit("C"))) is True
    assert one(spark, X.choice_correct(F.lit(None).cast("string"), F.lit("C"))) is False


def test_gold_and_names(spark):
    assert one(spark, X.gold_after_marker(F.lit("steps #### 1,234"))) == "1234"
    assert one(spark, X.slug(F.lit("Org/Some-4B-Base/"))) == "some_4b_base"
    assert one(spark, X.slug(F.lit("/c/models--Org--A-Name/snapshots/0f3"))) == "a_name"
    label = lambda n: one(spark, X.short_number(F.lit(n)))
    assert [label(n) for n in (1572864000, 0, 999, 999_600, 1000, 0.5, -2_340_000)] == [
        "1.57B", "0", "999", "1M", "1K", "0.5", "-2.34M"]


def test_roles(spark):
    df = spark.createDataFrame([(1, [("human", "a"), ("gpt", "b")])], "id int, messages array<struct<role:string,content:string>>")
    assert [m.role for m in tokens.normalize_roles(df).first().messages] == ["user", "assistant"]
    bad = spark.createDataFrame([(1, [("robot", "a")])], df.schema)
    with pytest.raises(Exception, match="unknown role"):
        tokens.normalize_roles(bad).collect()


def test_plan_shards(spark):
    rec = spark.createDataFrame(
        [("a", 3_200_000_000, 8, 2.0, 15000), ("b", 600_000_000, 1, 1.0, 0)], mixture.RECIPE_SCHEMA)
    jobs = mixture.plan_shards(rec).orderBy("name").collect()
    assert len(jobs) == 9
    assert {(j.budget, j.weight) for j in jobs[:8]} == {(400_000_000, 0.25)}
    assert (jobs[8].name, jobs[8].budget, jobs[8].weight) == ("b", 600_000_000, 1.0)
    bad = spark.createDataFrame([("c", 1, 2, 1.0, 0), ("d", 5, 0, 1.0, 0), ("e", 5, 1, 1.0, -1)], mixture.RECIPE_SCHEMA)
    assert mixture.recipe_faults(bad).count() == 3 and mixture.plan_shards(bad).count() == 0


def budget(spark, lengths, limit, dropped=()):
    rows = [("s", 0, i, n, i in dropped) for i, n in enumerate(lengths)]
    tok = spark.createDataFrame(rows, "source string, shard int, doc_id bigint, n_tokens bigint, dropped boolean")
    cap = spark.createDataFrame([("s", 0, limit)], "source string, shard int, budget bigint")
    return pack.budget_tokens(tok, cap, block=2)


def test_budget(spark):
    kept = budget(spark, [8, 8], 24)
    info = quality.shard_info(kept, "t").first()
    assert (info.tokens, info.docs) == (18, 2)
    assert [r["take"] for r in budget(spark, [8, 8], 12).orderBy("doc_id").collect()] == [9, 3]
    # a long document before the fill counts as dropped, one after it is never read
    info = quality.shard_info(budget(spark, [4, 99, 4, 99, 4], 10, {1, 3}), "t").first()
    assert (info.tokens, info.docs, info.dropped_too_long) == (10, 2, 1)


def test_weights(spark):
    specs = spark.createDataFrame([("a", None), ("b", 3.0), ("c", None), ("m", None)], "folder string, weight double")
    info = spark.createDataFrame([("a", 18)], "folder string, tokens bigint")
    man = spark.createDataFrame([("m", "m/p0", 175.0, "t"), ("m", "m/q", 700.0, "t")],
                                "root string, folder string, weight double, tokenizer string")
    got = {r.folder: r.weight for r in mixture.resolve_weights(specs, info, man, "t").collect()}
    assert got == {"a": 18.0, "b": 3.0, "c": 1.0, "m/p0": 175.0, "m/q": 700.0}
    with pytest.raises(Exception, match="tokenizer"):
        mixture.resolve_weights(specs, info, man, "other").collect()
    with pytest.raises(Exception, match="own weights"):
        mixture.resolve_weights(specs.na.fill(1.0), info, man, "t").collect()


def weights(spark, *w):
    return spark.createDataFrame(list(enumerate(w)), f"ds int, weight {'double' if isinstance(w[0], float) else 'bigint'}")


def test_quotas(spark):
    w = weights(spark, .5, .3, .2)
    assert [r.quota for r in mixture.largest_remainder(w, 13).orderBy("ds").collect()] == [6, 4, 3]
    assert [r.quota for r in mixture.padded_quota(w, 1000).orderBy("ds").collect()] == [503, 302, 201]


@pytest.mark.parametrize("w, ds, sample", [
    ((2, 1), [0, 1, 0, 0, 1, 0, 0, 1, 0], [0, 0, 1, 2, 1, 3, 4, 2, 5]),
    ((8, 2), [0, 1, 0, 0, 0, 0, 1, 0, 0, 0], [0, 0, 1, 2, 3, 4, 1, 5, 6, 7]),
])
def test_greedy_blend(spark, w, ds, sample):
    rows = mixture.blend_greedy(spark, weights(spark, *w), len(ds)).orderBy("pos").collect()
    assert [r.ds for r in rows] == ds and [r.sample for r in rows] == sample


def test_bins(spark):
    rows = mixture.bin_table(weights(spark, .5, .3, .2), 10).orderBy("bin").collect()
    assert [r.ds for r in rows] == [0, 0, 0, 0, 0, 1, 1, 1, 2, 2]
    assert [r.bias for r in rows] == [0, 1, 2, 3, 4, 0, 1, 2, 0, 1]
    with pytest.raises(Exception, match="every source needs a bin"):
        mixture.bin_table(weights(spark, .99, .005, .005), 10).collect()


def test_splits_and_epochs():
    assert mixture.split_bounds("969,30,1", 1000) == [0, 969, 999, 1000]
    assert mixture.split_bounds("8/1/1", 10) == [0, 8, 9, 10]
    assert mixture.split_bounds("1,1,1", 10) == [0, 4, 7, 10]
    assert mixture.split_bounds("1,1,1", 11) == [0, 3, 7, 11]
    assert mixture.num_epochs(10, 4, 5, 1) == 3
    with pytest.raises(ValueError):
        mixture.split_bounds("1,1", 10)


def test_windows_of_23_tokens(spark):
    docs = spark.createDataFrame([("s", 0, [*range(9)], 0), ("s", 0, [*range(9, 23)], 9)],
                                 "source string, shard int, ids array<int>, start bigint")
    rows = pack.pack_windows(docs, 4).orderBy("win").collect()
    assert [r.ids for r in rows] == [[*range(5 * i, 5 * i + 5)] for i in range(4)]


def test_chunks(spark):
    tok = spark.createDataFrame([(0, 0, [*range(8)]), (0, 1, [*range(8, 13)])], "batch int, pos int, ids array<int>")
    rows = pack.chunk_batch(tok, 4).orderBy("chunk").collect()
    assert [r.ids for r in rows] == [[*range(0, 5)], [*range(4, 9)], [*range(8, 13)]]
    assert pack.chunk_batch(tok, 4, drop_last=True).count() == 2


def test_positions_and_labels(spark):
    ids = [5, 6, 0, 7, 8, 9, 0, 0, 3]
    win = pack.positions_from_eos(spark.createDataFrame([(ids,)], "ids array<int>"), 0)
    assert win.first().positions == [0, 1, 2, 0, 1, 2, 3, 0, 0]
    row = pack.shift_labels(win, 8).first()
    assert row.input_ids == ids[:-1] and row.label_ids == ids[1:]
    assert row.position_ids == [0, 1, 2, 0, 1, 2, 3, 0]
    assert row.label_mask == [True, True, False, True, True, True, False, False]
    plain = pack.shift_labels(win, 8, doc_masking=False).first()
    assert plain.position_ids == [*range(8)] and all(plain.label_mask)
    with pytest.raises(Exception, match="expected 5 tokens"):
        pack.shift_labels(win, 4).collect()


def test_leftpad(spark):
    df = spark.createDataFrame([([9, 9, 1, 2],), ([1, 2, 3, 4],), ([9, 9, 9, 9],)], "ids array<int>")
    assert [r.positions for r in pack.leftpad_positions(df, 9).collect()] == [[0, 0, 0, 1], [0, 1, 2, 3], [0, 0, 0, 0]]


def test_sft(spark):
    df = spark.createDataFrame([(1, "a b c ", "d e"), (2, "a b c d e f g h i", "x")], "doc_id int, prompt string, completion string")
    rows = sft.sft_encode(df, 7).orderBy("doc_id").collect()
    assert rows[0].input_ids == ["a", "b", "c", "d", "e", "<eos>", "<pad>", "<pad>"]
    assert rows[0].position_ids == [0, 1, 2, 3, 4, 5, -1, -1]
    assert rows[0].label_mask == [False] * 3 + [True] * 3 + [False] * 2
    assert not any(rows[1].label_mask)
    assert [r.doc_id for r in sft.sft_keep(sft.sft_encode(df, 7)).collect()] == [1]
    report = sft.sft_report(sft.sft_encode(df, 7)).first()
    assert (report["rows"], report.prompt_too_long, report.filtered_share) == (2, 1, 0.5)
    batch = sft.sft_encode(df.withColumn("b", F.lit(0)).where("doc_id = 1"), 7, batch_col="b").first()
    assert len(batch.input_ids) == 6


def test_wilson(spark):
    rows = evals.wilson_interval(spark.createDataFrame([(146, 1319), (226, 1319)], "correct int, samples int")).collect()
    assert math.isclose(rows[0].ci_low, 0.0948751036, abs_tol=1e-9) and math.isclose(rows[0].ci_high, 0.1287658826, abs_tol=1e-9)
    assert math.isclose(rows[1].ci_low, 0.1519680747, abs_tol=1e-9) and math.isclose(rows[1].ci_high, 0.1926246566, abs_tol=1e-9)


def test_profile(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 4, 10)], "x double")
    row = quality.column_profile(df, ["x"]).first()
    assert row["mean"] == 4 and math.isclose(row["std"], 3.5355339, rel_tol=1e-7) and math.isclose(row.kurtosis, -1.21568, abs_tol=1e-5)
    empty = quality.column_profile(df.limit(0), ["x"]).first()
    assert (empty["mean"], empty["std"], empty.zero_frac, empty.kurtosis) == (0, 0, 1, 0)
    flat = quality.column_profile(spark.createDataFrame([(0.0,)] * 3, "x double"), ["x"]).first()
    assert (flat.zero_frac, flat.kurtosis) == (1, 0)


def test_masked_mean(spark):
    df = spark.createDataFrame([("a", 1.0, 1), ("a", 3.0, 0), ("b", 2.0, 0)], "g string, x double, m int")
    got = {r.g: r.masked_mean for r in runs.masked_mean(df, "x", "m", ["g"]).collect()}
    assert got["a"] == 1.0 and math.isnan(got["b"])


def test_flatten_results(spark):
    js = '{"results": {"custom|mmlu_cf:anatomy|0": {"acc": 0.5, "acc_stderr": 0.1}, "all": {"acc": 1}, "s|gsm8k|5": {"em": 0.25}}}'
    rows = {r.name: (r.dataset, r.subtask, r.value) for r in evals.flatten_results(spark.createDataFrame([(js,)], "json string")).collect()}
    assert rows == {"mmlu_cf/anatomy/acc": ("mmlu_cf", "anatomy", 0.5), "gsm8k/em": ("gsm8k", None, 0.25)}


def test_stages(spark):
    stages = spark.createDataFrame([("a", 1), ("b", 100), ("c", 250)], "name string, start_step bigint")
    left = lambda last: [r.remaining_steps for r in runs.stage_plan(stages, 400, last).orderBy("start_step").collect()]
    assert left(0) == [100, 151, 151]
    assert left(120) == [0, 0, 281]
    assert runs.stage_faults(stages).count() == 0
    steps = spark.createDataFrame([(1,), (99,), (100,), (1000,)], "step bigint")
    assert {r.step: r.name for r in joins.stage_for_step(steps, stages).collect()} == {1: "a", 99: "a", 100: "b", 1000: "c"}


def test_points_rule(spark):
    points = spark.createDataFrame([("s", 3000, 1.572864, "b", 30, 240, 8, 102, 42.5)],
        "series string, step bigint, tokens_b double, bench string, questions int, samples int, samples_per_question int, correct int, accuracy double")
    steps = spark.createDataFrame([("s", 3000)], "series string, step bigint")
    benches = spark.createDataFrame([("b", 30, 8)], "bench string, questions int, samples_per_question int")
    assert evals.validate_points(points, steps, benches).count() == 0
    assert evals.validate_points(points.withColumn("tokens_b", F.lit(1.5)), steps, benches).first().rule == "tokens"


def test_null_group_is_an_error(spark):
    df = spark.createDataFrame([("a", 1, 2), (None, 2, 3)], "g string, k bigint, size bigint")
    with pytest.raises(Exception, match="must not be null"):
        running_offset(df, ["g"], "k", "size").collect()
