"""The ten operators on small tables: brute force, exact round trips, and odd rows (nulls, empty, long, tied, repeated)."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import (
    language_id, mixing, near_dedup, nearest, packing, quality_model, quality_rules, token_files, toxicity, warc,
)
from millrace.llm.queries import vocabulary
from millrace.llm.tokenizing import Encoder

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, score double, kept string, size int, ids string"
LONG = " ".join(f"word{i % 977} and" for i in range(30_000))
ODD = [
    (1, "The quick brown fox. The quick brown fox!", "en"), (2, None, "en"), (3, "", None), (None, "no id here at all", "en"),
    (4, LONG, "en"), (5, "same words here", "fr"), (5, "same words here", "fr"), (6, " \t\n\x0b\x0c\r ", "de"),
    (7, "naïve café — 日本語 text with  odd blanks", None), (8, "$$$ ### 123 !!!", "en"), (9, "one", "es"),
]


def table_of(spark, rows, source=None):
    return spark.createDataFrame([(i, t, l, source(k) if source else (None if k % 4 == 0 else f"s{k % 3}"), 0.5, "x", 7, "y") for k, (i, t, l) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return table_of(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def same_rows(a, b):
    return Counter(map(repr, a)) == Counter(map(repr, b))


# 1 --------------------------------------------------------------------------------------------


def test_nearest_against_brute_force_with_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(900, 24)) + rng.integers(0, 6, 900)[:, None]
    v[100:400] = v[100]  # a third of all rows share one vector
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [(2000, None), (2010, [0.0] * 24), (2020, [float("nan")] * 24), (2030, [1.0, None] * 12), (2040, [1.0]), (None, [1.0] * 24), (2050, [float("inf")] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"score": F.lit(1), "body": F.lit("x"), "cluster": F.lit(0)})
    got = {}
    for r in nearest.nearest(df, F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.score, r.vec_id))
    hits = 0
    for q in range(0, 900, 10):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(900) if i != q)[:10]
        own = sorted(got[q])
        assert [r for r, _, _ in own] == list(range(1, 11)) and [(s, i) for _, s, i in own] == sorted((s, i) for _, s, i in own)
        assert all(abs(d[i] - s) < 1e-9 for _, s, i in own)
        hits += len({i for _, i in want} & {i for _, _, i in own})
    assert set(got) == set(range(0, 900, 10)) and hits >= 0.9 * 900


def test_nearest_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r["rank"], r.vec_id) for r in nearest.nearest(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 2)]
    assert nearest.nearest(df.limit(0), F.lit(True)).count() == 0
    assert nearest.nearest(df, F.lit(False)).count() == 0


def test_nearest_counts_repeated_rows_once(spark):
    rng = np.random.default_rng(14)
    v = rng.normal(size=(60, 8))
    v[30] = v[0]
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    rows += [rows[0]] * 11 + [rows[20]] + [rows[7]] * 11  # 0 and 7 twelve times, 20 twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = nearest.nearest(df, F.col("vec_id").isin(0, 20), probes=100).collect()
    for q in (0, 20):
        d = np.sqrt(((v - v[q]) ** 2).sum(1))
        want = [i for _, i in sorted((d[i], i) for i in range(60) if i != q)[:10]]
        own = sorted((r["rank"], r.vec_id) for r in got if r.query_id == q)
        assert own == list(enumerate(want, 1))


def test_estimates_stay_inside_their_bounds():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=64)
    rotation = np.linalg.qr(rng.normal(size=(64, 64)))[0]
    bits, length, own = nearest.coded(x, np.zeros(4000, int), np.zeros((1, 64)), rotation)
    asked = nearest.Asked(q[None], np.zeros(64), rotation, 10)
    asked.meet(np.arange(4000), x, nearest.words_of(bits), length, own)
    want = np.argsort(((x - q) ** 2).sum(1))[:10]
    assert len(set(want) & set(asked.best[0][1])) >= 9


def test_queries_are_sent_once_to_a_group_of_clusters(spark, monkeypatch):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(1500, 16)).astype("f4")
    v[:600] = v[0] + rng.normal(size=(600, 16)).astype("f4") * 0.01  # a cluster larger than a group
    rows = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(v)], "vec_id bigint, body binary")
    asked = rows.where("vec_id % 5 = 0").select(F.col("vec_id").alias("asked"), "body").repartition(3)
    index = nearest.build(rows, 16, "<f4")
    n = len(index.centroids)
    held = np.zeros(n, np.int64)
    for r in index.rows.groupBy("cluster").count().collect():
        held[r.cluster] = r["count"]
    groups = nearest.groups_of(held, 200)
    last = int((groups.begin + groups.parts).max())
    load = np.zeros(last)
    for c in range(n):
        load[groups.begin[c] : groups.begin[c] + groups.parts[c]] += held[c] / groups.parts[c]
    assert load.max() <= 200 and last < n and groups.parts.max() > 1
    sent = nearest.probed(asked, index, groups, n, 16)
    assert sent.count() == sent.select("x", "asked").distinct().count() == 300 * last < 300 * n
    monkeypatch.setattr(nearest, "LEAST_GROUP", 200)
    monkeypatch.setattr(nearest, "MOST_GROUP", 200)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", 64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>")
    w, hits = v.astype(float), 0
    got = nearest.nearest(df, F.col("vec_id") % 5 == 0, probes=n).collect()
    assert len(got) == 3000 and len({(r.query_id, r.vec_id) for r in got}) == 3000
    for q in range(0, 1500, 5):
        d = np.sqrt(((w - w[q]) ** 2).sum(1))
        hits += len({r.vec_id for r in got if r.query_id == q} & {i for _, i in sorted((d[i], i) for i in range(1500) if i != q)[:10]})
    assert hits >= 0.98 * 3000


# 2 --------------------------------------------------------------------------------------------


def counts(text):
    ws = WORDS.findall(text or "")
    n = Counter(zip(ws, ws[1:], ws[2:]))
    covered = {p for i in range(len(ws) - 2) if n[tuple(ws[i : i + 3])] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_against_loops(spark, odd, none):
    got = quality_rules.apply_rules(odd.drop("kept"))
    for r in got.collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts(r.text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)
    assert got.count() == len(ODD) and quality_rules.apply_rules(none).count() == 0
    assert dict(quality_rules.apply_rules(odd).dtypes)["kept"] == "boolean"


def test_quality_rules_are_expressions(odd):
    plan = quality_rules.apply_rules(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# 3 --------------------------------------------------------------------------------------------


def sentences(rng, syllables, n):
    return ["".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(n)]


def test_language_held_out_and_odd_rows(spark, odd, none):
    rng = np.random.default_rng(3)
    kinds = {"aa": ["tha", "sho", "ing", "er"], "bb": ["que", "ción", "ña", "os"], "cc": ["sch", "ung", "keit", "zu"]}
    rows = [(i, " ".join(sentences(rng, kinds[k], int(rng.integers(4, 60)))), k) for i, k in enumerate(list(kinds) * 60)]
    docs = table_of(spark, rows)
    model = language_id.train(docs.where("doc_id % 5 <> 0"))
    held = language_id.predict(docs.where("doc_id % 5 = 0"), model)
    assert held.where("lang <> lang_pred").count() == 0 and held.where("score < 0 or score > 1").count() == 0
    out = {r.doc_id: r for r in language_id.predict(odd, model).collect()}
    assert {i for i, r in out.items() if r.lang_pred == "und"} == {2, 3, 6, 8} and all(out[i].rejected and out[i].score == 0 for i in (2, 3, 6, 8))
    assert language_id.keep_known(docs, model).columns == docs.columns and language_id.keep_known(odd, model).where("doc_id in (2, 3, 6, 8)").count() == 0
    assert language_id.predict(none, model).count() == 0 and language_id.train(none) is None
    assert {r.lang_pred for r in language_id.predict(odd, None).collect()} == {"und"}


# 4 --------------------------------------------------------------------------------------------


def shared(sizes, most=3):
    """Targets by repeated sharing of the excess."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, out = sum(sizes.values()), set(names), {}
    while open_:
        w = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] >= most * sizes[s] * w]
        if not over:
            return out | {s: left * weight[s] / w for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.discard(s)
    return out


def test_mixing_reaches_targets_and_replays(spark, odd, none):
    rng = np.random.default_rng(4)
    rows = [(i, "w " * int(rng.integers(0, 60)), "en") for i in range(300)]
    docs = table_of(spark, rows, lambda k: "big" if k < 200 else [None, "a", "z", "tiny"][k % 4] if k < 290 else "s9")
    got = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    want = shared(sizes)
    assert all(abs(want[s] - taken[s]) <= 1 for s in sizes) and {(r.source, r.target) for r in got} == set(want.items())
    assert same_rows(got, mixing.mix(docs.repartition(7)).collect())
    words = {r.source: r.n for r in mixing.expand(docs).groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()}
    assert all(words.get(s, 0) == taken[s] for s in sizes)
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(none).count() == 0 and mixing.expand(none).columns == none.columns
    assert mixing.expand(odd).where("text is null").count() == 0


def test_first_words_keeps_the_text_as_it_stands(spark):
    df = spark.createDataFrame([("  a\tb \n c d",)], "t string")
    assert df.select(mixing.first_words(F.col("t"), F.lit(2)).alias("x")).first().x == "  a\tb"


def test_mixing_takes_whole_documents_without_ids(spark):
    rows = [(None, f"t{i} " + "w " * 99, "en") for i in range(200)] + [(7, f"u{i} " + "w " * 99, "en") for i in range(100)] + [(8, "same " * 100, "en")] * 20
    docs = table_of(spark, rows, lambda k: "ab"[k % 2])
    taken, sizes = Counter(), Counter()
    for r in mixing.mix(docs).collect():
        taken[r.source] += r.taken
        sizes[r.source] += r.size
    assert any(0 < n % sizes[s] for s, n in taken.items())
    got = mixing.expand(docs)
    out = got.select("doc_id", "source", mixing.n_words(F.col("text")).alias("n")).collect()
    for s in "ab":
        own = [r.n for r in out if r.source == s]
        assert sum(own) == taken[s] and sum(n < 100 for n in own) <= 1
    assert got.columns == docs.columns and same_rows(got.collect(), mixing.expand(docs.repartition(7)).collect())


# 5 --------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_stretches_give_the_ids_of_whole_texts(name):
    import pyarrow as pa
    from tokenizers import Tokenizer

    with open(vocabulary(name), encoding="utf-8") as f:
        body = f.read()
    texts = [t for _, t, _ in ODD if t != LONG] + [LONG[:5000], "(word) it's x-y <|endoftext|>a|b don't''ve ÀÉ ÿß ªº µm “q” a\nb\n\nc \n d", "x\x1c y\x85 z\r\n", "e ́x é İ ΑΣ Σ ǅ ĳ"]
    ids, at = Encoder(body).encode(pa.array(texts), 9)
    plain = Tokenizer.from_str(body)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == [*plain.encode(t or "", add_special_tokens=False).ids, 9]


def test_codes_round_trip_and_direct_access():
    rng = np.random.default_rng(5)
    ids = np.concatenate([rng.integers(0, 256, 700), rng.integers(0, 1 << 32, 900), [0, 255, 256, (1 << 32) - 1]]).astype(np.uint32)
    file = token_files.TokenFile(token_files.file_bytes(np.array([3]), np.array([True]), np.array([0, len(ids)]), ids))
    assert (file.ids() == ids).all() and [file.access(i) for i in range(len(ids))] == ids.tolist()
    with pytest.raises(IndexError):
        file.access(len(ids))


def test_token_files_round_trip(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    manifest = token_files.write_tokens(odd, vocabulary("word_bpe_49k.json"), ids_per_file=500)
    got = sorted(token_files.read_documents(manifest).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, 1, 2, 3, 4, 5, 5, 6, 7, 8, 9]
    texts, at, stream = {i: t for i, t, _ in ODD}, 0, []
    for r in got:
        want = [*plain.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 1]
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want
        at += len(want)
        stream += want
    asked = spark.createDataFrame([(p,) for p in (0, 7, at // 2, at - 1)], "place long")
    assert {r.place: r.id for r in token_files.ids_at(manifest, asked, width=1000).collect()} == {p: stream[p] for p in (0, 7, at // 2, at - 1)}
    empty = token_files.write_tokens(none, vocabulary("word_bpe_49k.json"))
    assert empty.count() == 0 and token_files.read_documents(empty).count() == 0


# 6 --------------------------------------------------------------------------------------------


def test_archives_round_trip_and_single_records(spark):
    body = "<p>" + "é" * 200 + "</p>"
    pages = [(3, "http://a/ x", body), (1, "http://b", body), (2, None, body), (None, "http://n", body), (4, "u\r\nv", "short"), (5, "u", "short"), (6, "u", None), (7, "u", "")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "path": F.lit("x"), "refers_to": F.lit(9)})
    index = warc.write_archives(df, file_bytes=900)
    assert index.select("path").distinct().count() > 1
    got = {r.page_id: r for r in warc.read_records(index).collect()}
    assert {i: (r.record_type, r.refers_to) for i, r in got.items()} == {
        1: ("response", None), 2: ("revisit", 1), 3: ("revisit", 1), None: ("revisit", 1), 4: ("response", None), 5: ("response", None), 6: ("response", None), 7: ("response", None)}
    size = len(body.encode())
    assert all(got[i].payload_bytes == size for i in (1, 2, 3, None)) and bytes(got[1].payload).decode() == body and got[2].payload is None
    assert bytes(got[4].payload) == b"short" and got[6].payload_bytes == 0 and got[3].url == "http://a/%20x" and got[2].url is None
    assert [r.page_id for r in warc.read_records(index.where("page_id = 4")).collect()] == [4]
    assert warc.read_records(warc.write_archives(df.limit(0))).count() == 0


# 7 --------------------------------------------------------------------------------------------


def linked(rows, width, percent=80):
    sets = {}
    for i, t, _ in rows:
        ws = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(ws[k : k + width]) for k in range(len(ws) - width + 1)} if len(ws) >= width else {tuple(ws)} if ws else set()
    label = {i: i for i in sets}
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {i: x if l == y else l for i, l in label.items()}
    return {i: (len(sets[i]), label[i]) for i in ids}


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_against_brute_force(spark, width):
    rng = np.random.default_rng(7)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    rows, grown = [], base
    for i in range(90):  # a drifting family, near the threshold all along
        grown = [w if rng.random() > 0.02 else f"x{rng.integers(9999)}" for w in (grown if i % 3 else base)]
        rows.append((1000 - i, " ".join(grown), "en"))
    rows += [(i, " ".join(f"v{x}" for x in rng.integers(0, 300, int(rng.integers(0, 40)))), "en") for i in range(60)]
    rows += [(200, "Only TWO", "en"), (201, "only two", "en"), (202, "word", "en"), (203, "word", "en"), (204, None, "en"), (205, "", "en"), (206, "  ", "en")]
    got = near_dedup.near_duplicates(table_of(spark, rows), 80, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == linked(rows, width)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark, odd, none):
    got = near_dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD) and {r.doc_id: r.n_shingles for r in got}[2] == 0 and [r.kept for r in got if r.doc_id is None] == [True]
    kept = near_dedup.keep_first(odd)
    assert kept.columns == odd.columns and kept.where("doc_id = 5").count() == 1 and kept.count() == len(ODD) - 1
    assert near_dedup.near_duplicates(none).count() == 0 and near_dedup.keep_first(none).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 130)] + [(7, 7)]
    got = near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.id: r.label for r in got} == {i: 0 for i in range(1, 41)} | {x: 100 for x in range(101, 130)}


# 8 --------------------------------------------------------------------------------------------


def test_packing_places_every_piece_once(spark, odd, none):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    rows = packing.pieces(odd, vocabulary("byte_bpe_50k.json"), size=64)
    got = packing.pack(rows, 2, 64).collect()
    texts = {i: t for i, t, _ in ODD}
    for i, text in texts.items():
        want = [*plain.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.piece)
        own = own[::2] if i == 5 else own
        assert [t for r in own for t in np.frombuffer(r.ids, "<u4").tolist()] == want
        assert len(want) > 64 or len(own) == 1
        assert all(r.length == 64 for r in own[1:]) and [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 64
    made = packing.sequences(packing.pack(rows, 2, 64))
    assert made.where("octet_length(ids) <> 4 * length").count() == 0 and made.count() == len(places)
    assert packing.pack(packing.pieces(none, vocabulary("byte_bpe_50k.json")), 1).count() == 0


def test_sum_of_squares_packs_tightly(spark):
    rng = np.random.default_rng(8)
    lengths = [int(x) for x in np.clip(rng.lognormal(5.5, 1.1, 4000), 1, 2048)]
    rows = spark.createDataFrame([(i, 0, n) for i, n in enumerate(lengths)] + [(-1, 0, None), (-2, 0, 0)], "doc_id long, piece int, length long")
    packed = packing.pack(rows, 1)
    assert packed.where("sequence_id is null").count() == 2
    assert packed.where("sequence_id is not null").select("sequence_id").distinct().count() <= math.ceil(sum(lengths) / 2048 * 1.01) + 1


# 9, 10 ----------------------------------------------------------------------------------------


def prose(rng, n):
    return " ".join(sentences(rng, ["tha", "sho", "ing", "er", "la", "mi", "do"], n))


def test_quality_model_tells_junk(spark, odd, none):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(600):
        text = prose(rng, int(rng.integers(40, 120)))
        if i % 6 == 5:
            text = " ".join(w + "###" for w in text.split()) if i % 12 == 5 else " ".join([text.split()[0]] * 80)
        rows.append((i, text, "en"))
    docs = table_of(spark, rows)
    model = quality_model.train(docs.where("doc_id % 3 <> 1"), docs.where("doc_id % 3 <> 1 and doc_id % 6 <> 5 and doc_id % 2 = 0"))
    assert 0.7 <= model.prior <= 0.99
    held = quality_model.predict(docs.where("doc_id % 6 in (1, 4)"), model)
    junk = quality_model.predict(docs.where("doc_id % 6 = 5"), model)
    assert held.where("predicted = 0").count() <= 0.05 * held.count() and junk.where("predicted = 1").count() <= 0.05 * junk.count()
    out = quality_model.predict(odd, model)
    assert out.count() == len(ODD) and out.where("score is null or score < 0 or score > 1").count() == 0
    assert quality_model.predict(none, model).count() == 0 and {r.score for r in quality_model.predict(odd, None).collect()} == {0.5}


def test_prior_of_known_scores():
    rng = np.random.default_rng(10)
    pos, neg = rng.normal(3, 1, 2000), rng.normal(-3, 1, 1000)
    assert abs(quality_model.class_prior(pos[:1000], np.concatenate([pos[1000:], neg])) - 0.5) < 0.06


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, left = [i, *row[1:]], row
        for j, y in enumerate(b, 1):
            row[j] = min(left[j] + 1, row[j - 1] + 1, left[j - 1] + (x != y))
    return row[-1]


def test_automaton_against_edit_distances():
    terms = ["idiot", "scum", "worthless", "moron", "trashes"]
    automaton = toxicity.Automaton(toxicity.Lexicon(terms, ["vequ"]))
    rng = np.random.default_rng(11)
    tried = [*terms, "vequabc", "vequ", "vexu", "", "idi0t", "idiott", "dioot", "wrthles", "wortless", "worhtless", "scumm", "morons", "z" * 50]
    for t in terms * 60:
        w = list(t)
        for _ in range(rng.integers(1, 4)):
            at, c = int(rng.integers(0, len(w) + 1)), "abcdeimorstu"[rng.integers(12)]
            w[at : at + int(rng.integers(0, 2))] = [c] * int(rng.integers(0, 2))
        tried.append("".join(w))
    term, edit = automaton.walk(tried)
    for w, t, e in zip(tried, term.tolist(), edit.tolist()):
        near = [edit_distance(w, x) for x in terms if edit_distance(w, x) <= toxicity.edits(x)]
        if w.startswith("vequ"):
            assert automaton.terms[t] == "vequ"
        else:
            assert (t >= 0) == bool(near) and (not near or e == min(near))


def test_toxicity_held_out_and_context(spark, odd, none):
    rng = np.random.default_rng(12)
    rows, marks = [], []
    for i in range(700):
        ws = prose(rng, int(rng.integers(10, 60))).split()
        bad = i % 7 == 0
        if bad:
            ws.insert(len(ws) // 2, ["idiot", "scumbag", "worthless"][i // 21 % 3])
        rows.append((i, " ".join(ws), "en"))
        marks.append((i, int(bad)))
    docs, labels = table_of(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id % 3 <> 1"))
    assert {"idiot", "scumbag", "worthless"} <= set(model.lexicon.words)
    wrong = toxicity.predict(docs, model).join(labels, "doc_id").where("predicted <> toxic").count()
    assert wrong <= 2
    texts = ["they are idi0t here", "he said idiot and left", 'the "idiot" of the title', "you idiot"]
    score = [r.score for r in toxicity.predict(table_of(spark, [(i, t, "en") for i, t in enumerate(texts)]), model).orderBy("doc_id").collect()]
    assert score[0] >= 0.7 and score[3] >= 0.7 and score[1] < 0.7 and score[2] < 0.7
    out = toxicity.predict(odd, model)
    assert out.count() == len(ODD) and out.where("score is null").count() == 0 and toxicity.predict(none, model).count() == 0
    assert toxicity.predict(odd, toxicity.train(none, labels)).where("predicted = 1").count() == 0


def test_terms_under_a_stem_keep_their_edits():
    rng = np.random.default_rng(13)
    toxic = [[*prose(rng, 30).split(), w] for k in range(6) for w in ("idiot", "idiots", "idiotic", "idiott", "idioot")]
    clean = [prose(rng, 30).split() for _ in range(60)]
    lexicon = toxicity.mine([sorted(set(t)) for t in toxic], [sorted(set(t)) for t in clean])
    assert "idiot".startswith(tuple(lexicon.stems))
    automaton = toxicity.Automaton(lexicon)
    tried = ["idiot", "idiotically", "idi0t", "1diot", "id1otic", "idi0ts", "tha", "shoer"]
    term, edit = automaton.walk(tried)
    assert {w: int(e) for w, t, e in zip(tried, term, edit) if t >= 0} == {"idiot": 0, "idiotically": 0, "idi0t": 1, "1diot": 1, "id1otic": 1, "idi0ts": 1}


def test_crc_of_tokens_is_unsigned(spark):
    body = np.array([1, 2, 70000], "<u4").tobytes()
    df = spark.createDataFrame([(bytearray(body),)], "ids binary")
    assert df.select(F.crc32("ids").alias("c")).first().c == zlib.crc32(body)
