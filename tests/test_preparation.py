"""Byte fallback, and the whole preparation job: reuse, refusal, rewriting, tokenizers and templates of one's own."""

from __future__ import annotations

import os
import shutil

import pytest
from pyspark.sql import functions as F

from millrace.operators import mixture, tokens
from millrace.plans import prepare
from millrace.sources import stores

VOCAB = {"the": 259, "cat": 260, "é": 261}
PIECES = [["the", "cat"], ["dog", "é", "caté", "the"], [], ["😀", "日本"], ["dog", "dog", "", "x"], ["the"] * 3, ["ab" * 5000, "cat"], ["dog", "é", "caté", "the"]]


def spelt(pieces):
    return [i for p in pieces for i in ([VOCAB[p]] if p in VOCAB else [*(2 + b for b in p.encode()), 258])]


@pytest.mark.parametrize("most", [100, 0])
def test_pieces_outside_the_vocabulary_become_bytes_and_come_back(spark, most):
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, id int")
    rows = [(i if i % 3 else None, "s", p) for i, p in enumerate(PIECES)]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, ids array<string>").repartition(3)
    coded = tokens.encode_ids(df, vocab, max_broadcast=most, byte_fallback=True)
    key = lambda r: (str(r[0]), r[-1])
    assert sorted([(r.doc_id, list(r.ids)) for r in coded.collect()], key=key) == sorted([(i, spelt(p)) for i, _, p in rows], key=key)
    back = tokens.pieces_of(coded, vocab, max_broadcast=most)
    got = sorted([(r.doc_id, [p for p in r.pieces if p]) for r in back.collect()], key=key)
    assert got == sorted([(i, [p for p in ps if p]) for i, _, ps in rows], key=key)


def test_ids_cut_inside_a_piece_and_special_ids(spark):
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, id int")
    rows = [(0, [259, 0, 2 + 0x64, 2 + 0x6F]), (1, [0, 1]), (2, [2 + 0xC3])]
    df = spark.createDataFrame(rows, "doc_id bigint, ids array<int>").coalesce(1)
    assert [r.pieces for r in tokens.pieces_of(df, vocab).orderBy("doc_id").collect()] == [["the", "do"], [], ["�"]]


def test_a_vocabulary_over_its_bytes_is_joined(spark):
    vocab = spark.createDataFrame(list(VOCAB.items()), "token string, id int")
    assert tokens._small_vocab(vocab, 10) is not None
    assert tokens._small_vocab(vocab, 10, max_bytes=3) is None and tokens._small_vocab(vocab, 2) is None


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names}


@pytest.fixture
def job(spark, tmp_path):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"),
        F.concat(F.repeat(F.lit("word und "), (F.col("id") % 9 + 7).cast("int")), F.lit("seltsam"), F.col("id")).alias("text"))
    message = F.array(F.struct(F.lit("user").alias("role"), F.repeat(F.lit("hello there "), 6).alias("content")))
    chats = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("chat").alias("source"), message.alias("messages"))

    def run(budgets, tokenizer="pieces", **more):
        rows = [(s, b, n, 1.0, 0) for s, b, n in budgets]
        recipe = spark.createDataFrame(rows, mixture.RECIPE_SCHEMA)
        out = prepare.prepare_corpus(spark, docs, recipe, str(tmp_path / "corpus"), tokenizer, vocab_size=3, chats=chats, **more)
        return {r["name"]: r for r in out.collect()}

    return run, str(tmp_path / "corpus")


PLAN = [("a", 900, 2), ("b", 700, 1), ("chat", 500, 1)]


def test_a_second_run_writes_nothing_and_a_changed_budget_rewrites_its_source(spark, job):
    run, path = job
    first = run(PLAN)
    assert set(first) == {"a_p0", "a_p1", "b", "chat"} and not any(r.reused for r in first.values())
    before = files(path)
    second = run(PLAN)
    assert files(path) == before and all(r.reused for r in second.values())
    assert {k: r.ids_digest for k, r in second.items()} == {k: r.ids_digest for k, r in first.items()}
    changed = [("a", 900, 2), ("b", 300, 1), ("chat", 500, 1)]
    with pytest.raises(ValueError, match="another mixture"):
        run(changed)
    assert files(path) == before
    third = run(changed, changed="rewrite")
    assert {k for k, r in third.items() if not r.reused} == {"b"} and third["b"].tokens == 300
    after = files(path)
    kept = {f: t for f, t in before.items() if "/tokens/source=a" in f or "/tokens/source=chat" in f}
    assert kept and all(after[f] == t for f, t in kept.items())
    assert not {f for f in before if "/tokens/source=b/" in f} & set(after)
    totals = prepare.read_totals(spark, path).first()
    assert (totals.total_tokens, totals["shards"], totals.tokenizer) == (900 + 300 + 500, 4, "pieces")
    ids = prepare.read_prepared(spark, path)
    assert ids.agg(F.sum(F.size("ids"))).first()[0] == 1700
    assert ids.where(F.exists("ids", lambda i: i == tokens.UNKNOWN_ID)).isEmpty()
    vocab = spark.read.parquet(f"{path}/vocab_3")
    whole = tokens.pieces_of(ids.where("take > 30"), vocab).where("source = 'b'").orderBy("doc_id").first()
    assert whole.pieces[:2] == ["word", "und"] and whole.pieces[-1] == f"seltsam{whole.doc_id}"


def test_a_source_taken_out_of_the_mixture_is_not_read(spark, job):
    run, path = job
    run(PLAN)
    run(PLAN[1:], changed="rewrite")
    assert {r.source for r in prepare.read_prepared(spark, path).select("source").distinct().collect()} == {"b", "chat"}
    with pytest.raises(ValueError, match="another mixture"):
        run(PLAN[1:])


def test_lost_token_files_and_other_inputs_are_made_anew(spark, job):
    run, path = job
    first = run(PLAN)
    shutil.rmtree(f"{path}/tokens/source=chat")
    second = run(PLAN)
    assert {k for k, r in second.items() if not r.reused} == {"chat"} and second["chat"].ids_digest == first["chat"].ids_digest
    with pytest.raises(ValueError):
        run(PLAN, version="2")
    assert not any(r.reused for r in run(PLAN, version="2", changed="rewrite").values())


def test_a_tokenizer_and_a_template_of_ones_own(spark, job):
    run, path = job
    letters = prepare.ColumnTokenizer("letters", lambda text: F.transform(F.split(text, ""), lambda c: F.ascii(c) + 1000))
    plain = lambda messages: F.array_join(F.transform(messages, lambda m: m["content"]), "|")
    made = run(PLAN, letters, template=plain)
    assert {r.tokenizer for r in made.values()} == {"letters"}
    row = prepare.read_prepared(spark, path).where("source = 'chat'").orderBy("doc_id").first()
    text = "hello there " * 6
    assert list(row.ids) == [1000 + ord(c) for c in text] + [tokens.EOS_ID]
    with pytest.raises(ValueError, match="another mixture"):
        run(PLAN, prepare.ColumnTokenizer("other", letters.ids))


def test_a_planned_shard_without_tokens_publishes_nothing(spark, job):
    run, path = job
    with pytest.raises(Exception, match="missing or empty"):
        run([*PLAN, ("empty", 10, 1)])
    assert not os.path.exists(f"{path}/manifest")
    assert stores.read_tokens(spark, f"{path}/tokens").count() > 0
    assert set(run(PLAN, changed="rewrite")) == {"a_p0", "a_p1", "b", "chat"}
