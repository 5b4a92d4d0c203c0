"""Rules that must hold whatever the data: against literal loops, on skewed inputs, after resumes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from millrace.functions.arrays import split_before
from millrace.operators import batches, evals, fim, joins, mixture, ordering, pack, quality, ranking, spans, tokens
from millrace.plans import evaluation, prepare, training
from millrace.session import table
from millrace.sources import corpora, stores


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; keys have gaps."""
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", k * 3 + rng.randrange(3), rng.randrange(0, 9)) for k in range(3000)]
    return spark.createDataFrame(rows, "g string, k bigint, size bigint").cache()


@pytest.mark.parametrize("block", [1, 7, 1000, 1 << 20])
def test_running_offset_equals_one_window(spark, skewed, block):
    w = Window.partitionBy("g").orderBy("k").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = skewed.withColumn("start", F.sum("size").over(w) - F.col("size"))
    got = ordering.running_offset(skewed, ["g"], "k", "size", block=block)
    assert got.exceptAll(want.select(got.columns)).isEmpty() and got.count() == 3000


def test_block_width_follows_keys(spark):
    sparse = spark.range(1000).select((F.col("id") * 10**12).alias("k"))
    width = ordering.block_width(sparse, "k", 100)
    sizes = sparse.groupBy(F.floor(F.col("k") / width)).count().collect()
    assert len(sizes) <= 11 and max(r["count"] for r in sizes) <= 101


@pytest.mark.parametrize("digits", [1, 3])
def test_hash_order_is_a_permutation(spark, skewed, digits):
    rows = ordering.hash_order(skewed.select("g", "k"), 3, ["k"], ["g"], digits=digits).collect()
    for g in {r.g for r in rows}:
        assert sorted(r.pos for r in rows if r.g == g) == list(range(sum(r.g == g for r in rows)))
    again = {(r.k, r.pos) for r in ordering.hash_order(skewed.select("g", "k").repartition(7), 3, ["k"], ["g"]).collect()}
    assert {(r.k, r.pos) for r in rows} == again


def test_expand_counts(spark):
    df = spark.createDataFrame([("a", 10), ("b", 0), ("c", 33)], "g string, n bigint")
    got = ordering.expand_counts(df, "n", "i", chunk=4).groupBy("g").agg(F.count("*").alias("n"), F.max("i").alias("m"), F.countDistinct("i").alias("d"))
    assert {tuple(r) for r in got.collect()} == {("a", 10, 9, 10), ("c", 33, 32, 33)}


def greedy(ws, n):
    """The blend written as its definition, in exact integers."""
    total, taken, out = sum(ws), [0] * len(ws), []
    for i in range(n):
        errors = [w * max(i, 1) - t * total for w, t in zip(ws, taken)]
        d = errors.index(max(errors))
        out.append((d, taken[d]))
        taken[d] += 1
    return out


@pytest.mark.parametrize("ws", [[8, 2], [2, 1], [1] * 8 + [4], [5, 3, 2], [7, 11, 13, 29], [175] * 8 + [700], [1]])
def test_greedy_equals_definition(spark, ws):
    w = spark.createDataFrame(list(enumerate(ws)), "ds int, weight bigint")
    rows = mixture.blend_greedy(spark, w, 500).orderBy("pos").collect()
    assert [(r.ds, r["sample"]) for r in rows] == greedy(ws, 500)


def test_blend_shares(spark):
    w = spark.createDataFrame([(0, 8), (1, 2)], "ds int, weight bigint")
    lens = spark.createDataFrame([(0, 100), (1, 50)], "ds int, len bigint")
    for blend in (mixture.blend_greedy(spark, w, 1000), mixture.blend_bins(spark, w, lens, 1000)):
        for r in mixture.blend_report(blend, w).collect():
            assert abs(r.requested - r.achieved) < 0.05
    index = mixture.epoch_index(spark, w, lens, 400, 1).join(lens, "ds")
    assert index.count() == 400 and index.where("sample >= len or sample < 0").isEmpty()
    assert index.groupBy("pos").count().where("count > 1").isEmpty()


def starts(sizes, L, extra, drop_last):
    """Sample starts by walking the token stream."""
    flat = [(p, o) for p, n in enumerate(sizes) for o in range(n)]
    T = len(flat)
    n = (T - extra) // L if drop_last else -(-(T - extra) // L)
    out = [(0, 0, 0)]
    for i in range(1, n + 1):
        s = i * L
        if s > T - extra:
            out.append((i, len(sizes) - 1, sizes[-1] - extra))
        elif extra:
            out.append((i, *flat[s]))
        else:
            p, o = flat[s - 1]
            out.append((i, p, o + 1))
    return out


@pytest.mark.parametrize("extra", [0, 1])
@pytest.mark.parametrize("drop_last", [True, False])
@pytest.mark.parametrize("seed", range(3))
def test_sample_index_equals_walk(spark, extra, drop_last, seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 12) for _ in range(40)]
    L = rng.randrange(3, 9)
    df = spark.createDataFrame(list(enumerate(sizes)), "pos bigint, size bigint")
    rows = pack.sample_index(df, L, drop_last, extra, block=8).orderBy("sample").collect()
    assert [(r["sample"], r.pos, r.offset) for r in rows] == starts(sizes, L, extra, drop_last)


def test_token_conservation(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    tok = prepare.tokenized(docs).withColumn("shard", F.lit(0))
    budgets = tok.select("source", "shard").distinct().withColumn("budget", F.lit(2000).cast("bigint"))
    kept = pack.budget_tokens(tok, budgets, block=16)
    total = tok.groupBy("source").agg(F.sum(F.col("n_tokens") + 1).alias("t"))
    rows = pack.pack_summary(kept, 64, ["source"]).join(total, "source").collect()
    wins = {r.source: r["count"] for r in pack.pack_windows(pack.cut_to_take(kept, eos="<eos>"), 64).groupBy("source").count().collect()}
    for r in rows:
        assert r.tokens == min(r.t, 2000) and r.tokens == r.windows * 65 + r.remainder and wins.get(r.source, 0) == r.windows


def test_two_vocab_paths_agree(spark, sf):
    docs = table(spark, sf, "documents")
    vocab = tokens.build_vocab(docs, 300)
    tok = prepare.tokenized(docs.select("doc_id", "text")).drop("text")
    fast = tokens.encode_ids(tok, vocab).select("doc_id", "ids")
    slow = tokens.encode_ids(tok, vocab, max_broadcast=10).select("doc_id", "ids")
    assert fast.exceptAll(slow).isEmpty() and slow.exceptAll(fast).isEmpty()
    back = tokens.ids_to_tokens(fast, vocab).select("doc_id", "text")
    joined = tokens.ids_to_tokens(fast, vocab, max_broadcast=10).select("doc_id", "text")
    assert back.exceptAll(joined).isEmpty() and back.count() == joined.count() == fast.count()


def test_gate_spares_text_and_zero(spark):
    tok = spark.createDataFrame([(1, 10), (2, 9)], "doc_id int, n_tokens bigint")
    assert [r.doc_id for r in tokens.gate_long(tok, 10, F.lit(True)).collect()] == [2]
    assert tokens.gate_long(tok, 10, F.lit(False)).count() == 2 and tokens.gate_long(tok, 0, F.lit(True)).count() == 2


def test_resume_equals_full_run(spark):
    full = batches.batch_plan(spark, 1000, 0, 4, 2, 16)
    rest = batches.batch_plan(spark, 1000, 160, 4, 2, 16)
    shifted = full.where("step >= 10").withColumn("step", F.col("step") - 10)
    assert shifted.exceptAll(rest).isEmpty() and rest.exceptAll(shifted).isEmpty()
    a = quality.table_fingerprint(shifted).first().fingerprint
    assert a == quality.table_fingerprint(rest.repartition(3)).first().fingerprint


@pytest.mark.parametrize("plan", [batches.batch_plan_random, batches.batch_plan_cyclic])
def test_bucket_plans(spark, plan):
    rows = plan(spark, 103, 0, 4, 3, 24).collect()
    assert len({r["sample"] for r in rows}) == len(rows) == 96
    resumed = plan(spark, 103, 24, 4, 3, 24).collect()
    key = lambda r, skip=0: (r["rank"], r["micro"] - skip, r["slot"], r["sample"])
    assert {key(r) for r in resumed} == {key(r, 2) for r in rows if r["micro"] >= 2}
    with pytest.raises(ValueError):
        plan(spark, 103, 5, 4, 3, 24)
    with pytest.raises(ValueError):
        plan(spark, 103, 0, 4, 3, 25)


def test_rank_split_wraps(spark):
    df = spark.range(10).withColumnRenamed("id", "pos")
    assert batches.rank_split(df, 4, 10).count() == 8
    rows = batches.rank_split(df, 4, 10, drop_last=False).orderBy("slot").collect()
    assert [r.pos for r in rows] == [*range(10), 0, 1]
    assert batches.rank_split(df, 2, 10, loop_to=16).count() == 32


def test_interval_join_equals_scan(spark):
    rng = random.Random(1)
    cuts = sorted(rng.sample(range(1, 10_000), 40))
    lens = spark.createDataFrame([("s", i, b - a) for i, (a, b) in enumerate(zip([0, *cuts], [*cuts, 10_000]))], "source string, file int, len bigint")
    pos = spark.range(0, 10_000, 13).select(F.lit("s").alias("source"), F.col("id").alias("pos"))
    want = {p: int(np.searchsorted(cuts, p, side="right")) for p in range(0, 10_000, 13)}
    for width in (None, 3, 10**6):
        assert {r.pos: r.file for r in joins.locate_window(pos, lens, width=width).collect()} == want


def test_fim_keeps_tokens(spark):
    words = [f"w{i}" for i in range(30)]
    for k in (9, 19):
        words[k] = "<eos>"
    df = spark.createDataFrame([(i, words) for i in range(40)], "sample int, ids array<string>")
    never = fim.fim_sample(df, fim.Fim(0.0, 0.5, 1)).collect()
    assert all(r.ids == words for r in never)
    rows = fim.fim_sample(df, fim.Fim(1.0, 0.5, 1)).collect()
    assert all(len(r.ids) == 30 for r in rows) and any(r.ids[1] == "<suf>" for r in rows) and any(r.ids[1] != "<suf>" for r in rows)
    assert all(r.ids[0] == "<pre>" for r in rows)
    spared = fim.fim_sample(df, fim.Fim(1.0, 0.5, 1, no_fim_prefix="w")).collect()
    assert all(r.ids == words for r in spared)


def test_fim_fragments(spark):
    ids = "a b / c d / e f <eos> g h".split()
    df = spark.createDataFrame([(i, ids) for i in range(60)], "sample int, ids array<string>")
    still = fim.fim_fragments(df, fim.Fim(1.0, 0.0, 1), "/", 0.0).collect()
    for r in still:  # the segment with fragments is drawn but no fragment is permuted; the other one is
        assert r.ids[:9] == ids[:9] and r.ids[9] == "<pre>"
    half = fim.fim_fragments(df, fim.Fim(0.5, 0.0, 1), "/", 1.0).collect()
    changed = sum(r.ids[0] == "<pre>" for r in half)
    assert 10 < changed < 50 and all(len(r.ids) == len(ids) for r in half)


def test_split_before(spark):
    df = spark.createDataFrame([([0, 1, 0, 0, 2],), ([1],), ([0],)], "a array<int>")
    assert [r.s for r in df.select(split_before(F.col("a"), 0).alias("s")).collect()] == [[[], [1], [], [2]], [[1]], [[], []]]


def test_spans_cover_documents(spark, sf):
    sent = spans.sentences_table(table(spark, sf, "documents").select("doc_id", "text"))
    out = spans.sentence_spans(sent, 64, 2, 0.0, 1, 3)
    covered = out.groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).alias("n"), F.max("end").alias("e"), F.min("start").alias("s"))
    want = spans.document_bounds(sent).join(sent.groupBy("doc_id").agg(F.max("size").alias("m")), "doc_id").where("m <= 512 and items >= 2")
    both = covered.join(want, "doc_id", "full_outer")
    assert both.where("n is null or items is null or n != items or e != items or s != 0").isEmpty()
    assert spans.sentence_spans(sent, 64, 2, 0.0, 3, 3, max_samples=out.count() + 1).select("epoch").distinct().count() == 2


def test_topp_keeps_enough_mass(spark):
    rng = random.Random(2)
    rows = [(0 if rng.random() < .6 else g % 4, g, rng.gauss(0, 3)) for g in range(800)]
    df = spark.createDataFrame(rows, "item int, id int, score double")
    got = {}
    for r in ranking.topp_per_group(df, ["item"], "score", 0.8, 0.9, 3, step=0.3).collect():
        got.setdefault(r.item, set()).add(r.id)
    for item in {r[0] for r in rows}:
        part = sorted(((s, -i) for g, i, s in rows if g == item))
        p = np.exp((np.array([s for s, _ in part]) - part[-1][0]) / 0.9)
        keep = np.cumsum(p / p.sum()) > 0.2
        keep[-3:] = True
        assert got[item] == {-i for (_, i), k in zip(part, keep) if k}


def test_paired_difference_brackets_mean(spark):
    rows = [("b", f"q{i}", (i * 7) % 3 == 0) for i in range(200)]
    a = spark.createDataFrame(rows, "bench string, id string, correct boolean")
    b = a.withColumn("correct", F.lit(False))
    r = evals.paired_diff_ci(a, b, 300, 9).first()
    assert r.ci_low < r.difference < r.ci_high and r.ci_high - r.ci_low < 0.2


def test_manifest_rules(spark):
    cols = "name string, tokens bigint, docs bigint, dropped_too_long bigint, max_doc_tokens int, budget bigint, tokenizer string"
    m = spark.createDataFrame([(n, 5, 1, 0, 0, 9, "t", 1.0) for n in "abcd"], cols + ", weight double")
    s = spark.createDataFrame([("a", 5, 1, 0, 0, 9, "t", 20), ("b", 5, 2, 0, 0, 9, "t", 20), ("c", 5, 1, 0, 0, 9, "t", 19), ("e", 5, 1, 0, 0, 9, "t", 20)], cols + ", stored_bytes bigint")
    got = {r.name: r.reason for r in joins.check_manifest(m, s, "t").collect()}
    assert got == {"b": "changed", "c": "stored size differs", "d": "missing shard", "e": "not in manifest"}
    assert set(r.reason for r in joins.check_manifest(m, s, "u").collect()) >= {"other tokenizer"}


def test_split_names(spark):
    df = spark.range(3).withColumn("split", F.lit("train"))
    assert set(corpora.read_splits(df, "train")) == {"train"}
    with pytest.raises(ValueError):
        corpora.read_splits(df, ["dev"])
    with pytest.raises(ValueError):
        corpora.read_sources(spark, ["nope"], {})
    with pytest.raises(ValueError):
        evals.bench_items({}, ("nope",), 1)


def test_token_files_round_trip(spark, tmp_path):
    rng = random.Random(3)
    rows = [("s", i % 2, i, [rng.randrange(60000) for _ in range(rng.randrange(1, 40))]) for i in range(100)]
    df = spark.createDataFrame(rows, "source string, shard int, doc_id bigint, ids array<int>")
    for width in (2, 4):
        out = str(tmp_path / f"w{width}")
        stores.write_token_bytes(df, out, width, 7)  # many small parts: windows reach over them
        got = {(r.folder.split("/")[-1], r.win): r.ids for r in stores.read_token_bytes(spark, out, 9, width, range_bytes=200).collect()}
        for shard in (0, 1):
            flat = [t for s, k, i, ids in rows if k == shard for t in ids]
            want = {(f"s_p{shard}", w): flat[w * 10:w * 10 + 10] for w in range(len(flat) // 10)}
            assert {k: v for k, v in got.items() if k[0] == f"s_p{shard}"} == want


def test_training_plan_is_whole(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "text")
    tok = prepare.tokenized(docs).drop("text").withColumn("ids", F.concat("ids", F.array(F.lit("<eos>"))))
    stream = ordering.running_offset(tok.withColumn("_n", F.col("n_tokens") + 1), ["source"], "doc_id", "_n", "start", 32)
    names = [r.source for r in docs.select("source").distinct().orderBy("source").collect()]
    sources = spark.createDataFrame([(s, i, 1 + i % 3) for i, s in enumerate(names)], "source string, ds int, weight bigint")
    rows = training.training_samples(spark, stream, sources, 32, 128, "<eos>", 1, 4, 2, 16).collect()
    assert len(rows) == 128 and len({(r["step"], r["micro"], r["rank"], r["slot"]) for r in rows}) == 128
    assert all(len(r.input_ids) == len(r.label_ids) == len(r.label_mask) == 32 for r in rows)


def test_preparation_reads_only_what_budgets_need(spark, sf, tmp_path):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("source"),
        F.repeat(F.lit("word "), (F.col("id") % 40 + 12).cast("int")).alias("text"))
    recipe = spark.createDataFrame([("hot", 900, 2, 1.0, 0), ("cold", 10**7, 1, 1.0, 0)], mixture.RECIPE_SCHEMA)
    vocab = spark.createDataFrame([("word", 2)], "token string, id int")
    out = str(tmp_path / "corpus")
    manifest = {r.name: (r.tokens, r.docs) for r in prepare.prepare_corpus(spark, docs, recipe, out, "t", (), vocab, tokens_per_doc=300).collect()}
    read = {r.source: r["count"] for r in stores.read_tokens(spark, f"{out}/all_tokens").groupBy("source").count().collect()}
    assert read["hot"] < 400 and read["cold"] == docs.where("source = 'cold'").count()
    jobs = mixture.plan_shards(recipe)
    want = quality.shard_info(prepare.budgeted(docs, jobs, (), vocab, 512), "t").join(jobs.select("source", "shard", "name"), ["source", "shard"])
    assert manifest == {r.name: (r.tokens, r.docs) for r in want.collect()}
    ids = stores.read_tokens(spark, f"{out}/tokens").groupBy("source", "shard").agg(F.sum(F.size("ids")).alias("n"))
    assert {(r.source, r.shard): r.n for r in ids.collect()} == {(r.source, r.shard): r.tokens for r in want.collect()}


def test_evaluation_plan(spark):
    items = spark.createDataFrame([("amc23", "amc23/1", 0, "q", "7", 2), ("gpqa", "gpqa/1", 1, "q", "B", 1)],
                                  "bench string, id string, idx bigint, question string, answer string, n int")
    done = spark.createDataFrame([("amc23/1#0",)], "key string")
    assert {(r.key, r.seed) for r in evaluation.open_requests(items, done).collect()} == {("amc23/1#1", 1), ("gpqa/1#0", 1000)}
    gens = spark.createDataFrame(
        [("amc23", "amc23/1", "7", r"x</think>\boxed{7.0}", 5, False), ("amc23", "amc23/1", "7", r"\boxed{8}", 9, True), ("gpqa", "gpqa/1", "B", r"\boxed{B}", 3, False)],
        "bench string, id string, answer string, text string, tokens bigint, truncated boolean")
    tables = evaluation.summarize(gens)
    assert {r.bench: (r.accuracy, r.samples, r.mean_tokens, r.truncated) for r in tables["summary"].collect()} == {
        "amc23": (50.0, 2, 7, 50.0), "gpqa": (100.0, 1, 3, 0.0)}
    assert {r.bench: (r.questions, r.accuracy) for r in tables["avg_at_n"].collect()} == {"amc23": (1, 50.0), "gpqa": (1, 100.0)}
    assert {r.bench: r.median_tokens for r in tables["quantiles"].collect()} == {"amc23": 7.0, "gpqa": 3.0}


def test_encoding_paths_agree_on_repeated_ids(spark):
    rows = [(1, "a", ["x", "y"]), (1, "b", ["z", "x", "q"]), (1, "b", ["z", "x", "q"]), (2, "a", []), (None, "c", ["y"])]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, ids array<string>")
    vocab = spark.createDataFrame([("x", 2), ("y", 3), ("z", 4)], "token string, id int")
    fast, slow = tokens.encode_ids(df, vocab), tokens.encode_ids(df, vocab, max_broadcast=1)
    same = lambda f: sorted(map(str, f.collect()))
    assert same(fast.select("doc_id", "source", "ids")) == same(slow.select("doc_id", "source", "ids"))
    assert same(tokens.ids_to_tokens(fast, vocab)) == same(tokens.ids_to_tokens(fast, vocab, max_broadcast=1))


def test_unweighted_epoch_takes_every_sample_once(spark):
    lens = spark.createDataFrame([(0, 400_001), (1, 250_007)], "ds int, len bigint")
    n = 400_001 + 250_007
    order = mixture.epoch_index(spark, None, lens, n, 3)
    assert order.select("pos").distinct().count() == n and order.select("ds", "sample").distinct().count() == n
    assert order.agg(F.max("pos")).first()[0] == n - 1


def test_compare_runs_at_ratio(spark):
    points = spark.createDataFrame(
        [("a", "m", 10 * k, 50.0) for k in range(1, 31)] + [("b", "m", 11 * k, 40.0) for k in range(1, 31)], "series string, bench string, step int, accuracy double")
    assert joins.compare_runs(points, "a", "b", (11, 10)).count() == 30


def test_pieces_keep_letters_together(spark):
    df = spark.createDataFrame([("caf\u00e9 na\u00efve!",)], "text string")
    assert tokens.tokenize(df).first().ids == ["caf\u00e9", "na\u00efve", "!"]


def test_manifest_of_a_missing_shard_fails(spark, tmp_path):
    jobs = spark.createDataFrame([("s", 0, "s", 1.0, 0), ("t", 0, "t", 1.0, 0)], "source string, shard int, name string, weight double, max_doc_tokens int")
    info = spark.createDataFrame([("s", 0, 5)], "source string, shard int, tokens bigint")
    with pytest.raises(Exception, match="no tokens for planned shard t"):
        stores.write_manifest(info, jobs, str(tmp_path / "m"))
