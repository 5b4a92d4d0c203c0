"""The pipeline stage by stage against loops, on documents with junk, copies and near copies."""

from __future__ import annotations

import os
import sys
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline
from millrace.llm import mixing
from millrace.llm.common import stored
from millrace.llm.queries import ORACLES, QUERIES
from test_operators import WORDS, counts, linked, sentences, shared

STOPS = {"en": ["the", "of", "and", "to"], "de": ["der", "und", "die"], "fr": ["le", "la", "et", "des"]}
SYLLABLES = {"en": ["tha", "sho", "ing", "er"], "de": ["sch", "ung", "keit", "zu"], "fr": ["que", "aux", "elle", "oi"]}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = np.random.default_rng(20)
    rows = []
    for i in range(240):
        lang = ["en", "de", "fr"][i % 3]
        ws = sentences(rng, SYLLABLES[lang], int(rng.integers(60, 160)))
        for k in range(0, len(ws), 4):
            ws[k] = str(rng.choice(STOPS[lang]))
        text = " ".join(ws)
        if i % 10 == 7:
            text = " ".join(w + "###" for w in ws)
        if i % 10 == 8 and i > 20:
            text = rows[i - 18][1] if i % 20 == 8 else " ".join([*rows[i - 18][1].split()[:-2], "newer", "words"])
        if i % 40 == 39:
            text = [None, "", "123 456 ###", "too short"][i // 40 % 4]
        rows.append((i, text, lang, None if i % 12 == 5 else f"s{i % 2}", len(text or "")))
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    return at


def test_stages_against_loops(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stored(stage(spark, docs, folder), "stage")
        after = [tuple(r) for r in docs.collect()]
        texts = {r[0]: r[1] for r in before}
        kept = {r[0] for r in after}
        if name != "packing":
            assert docs.columns == columns
        if name in ("language_id", "quality_rules", "near_dedup"):
            assert not Counter(map(repr, after)) - Counter(map(repr, before))
        if name == "language_id":
            assert {i for i, t in texts.items() if not t or not any(c.isalpha() for c in t)} <= set(texts) - kept
            assert len(kept) >= 0.97 * sum(bool(t) and len(t) > 40 for t in texts.values())
        if name == "quality_rules":
            for i, t in texts.items():
                n, _, symbols, _, repeated = counts(t)
                assert (i in kept) == (n >= 50 and 100 * repeated <= 50 * n and symbols <= 0.1 * n)
        if name == "near_dedup":
            label = linked([(i, t, None) for i, t in texts.items()], 5)
            assert kept == {i for i in texts if label[i][1] == i} and len(after) == len(kept) < len(texts)
        if name == "mixing":
            sizes, taken = Counter(), Counter()
            for r in before:
                sizes[r[3]] += len(WORDS.findall(r[1]))
            for r in after:
                taken[r[3]] += len(WORDS.findall(r[1]))
            want = shared(sizes)
            assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
        if name == "packing":
            copies = Counter(r[0] for r in before)
            assert copies == Counter(r[0] for r in docs.where("piece = 0").collect())
            for r in docs.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect():
                assert r.n == r.end <= 2048


def test_run_gives_the_same_rows_again(spark, folder):
    rows = lambda: Counter((r.doc_id, r.piece, r.ids_crc32) for r in corpus_pipeline.run(spark, folder).collect())
    assert rows() == rows()


def test_empty_tables_pass_through(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    assert corpus_pipeline.run(spark, at).count() == 0


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14)) and set(ORACLES) < set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_dedup", "mixing", "packing"]
    assert mixing.MAX_EPOCHS == 3
