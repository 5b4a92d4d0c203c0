"""Conversation repair, byte-pair encoding and periodic runs against brute force, on small tables with odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.llm import byte_pairs, conversation_repair as repair, periodic_runs
from millrace.llm.queries import QUERIES, damaged, repeated_tail, vocabulary

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
CHATS = "conv_id long, turn long, role string, text string, audit string, rows int, part string, seq double"

# 11 -------------------------------------------------------------------------------------------


def cheapest(kinds: str, most_inserts: int = 4):
    """Least (cost, audit) over all edits, tried one by one."""
    best = None

    def go(i, roles, cost, audit, inserts):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(kinds) and re.fullmatch("(s?(ua)+)?", roles) and (best is None or (cost, audit) < best):
            best = cost, audit
        if inserts < most_inserts:
            for role in "ua":
                go(i, roles + role, cost + 2, audit + "I", inserts + 1)
        if i < len(kinds):
            go(i + 1, roles, cost + 3, audit + "D", inserts)
            if kinds[i] != "d":
                cut = int(kinds[i].isupper())
                go(i + 1, roles + kinds[i].lower(), cost + cut, audit + "K", inserts)
                for role in "ua":
                    go(i + 1, roles + role, cost + 2 + cut, audit + "R", inserts)

    go(0, "", 0, "", 0)
    return best


def test_repairs_are_the_cheapest_of_all_edits():
    rng = random.Random(1)
    for _ in range(250):
        kinds = "".join(rng.choice("duaUAsSx") for _ in range(rng.randint(0, 5)))
        assert repair.best(repair.parsed(kinds)) == cheapest(kinds)


def test_every_split_of_a_span_gives_the_same_cell():
    rng = random.Random(2)
    for _ in range(40):
        kinds = "".join(rng.choice("duaUAsSx") for _ in range(9))
        cells = {(i, i + 1): repair.leaf(c) for i, c in enumerate(kinds)}
        for size in range(2, 10):
            for i in range(10 - size):
                found = [repair.joined(cells[i, m], cells[m, i + size]) for m in range(i + 1, i + size)]
                assert all(x == found[0] for x in found)
                cells[i, i + size] = found[0]
        assert repair.parsed(kinds) == cells[0, 9]


def expected(rows):
    """Result of one conversation: (turn, role, text) by turn, by loops and a parse of the whole."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    found = repair.faults([(r, x) for _, r, x in rows])
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit = repair.best(repair._halves("".join(repair.kind(r, f) for (_, r, _), f in zip(rows, found))))
    out = repair.edited([(r, x) for _, r, x in rows], audit)[0]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    body = "\n".join(f"{r}:{x}" for r, x in out)
    return (gaps, *(found.count(f) for f in repair.COUNTS), illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def chats(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", 0.5) for r in rows], CHATS)


def told(df):
    columns = ("gaps", *repair.COUNTS, "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[c] for c in columns) for r in df.collect()}


@pytest.mark.parametrize("most_rows", [1, 3, 1024])
def test_conversations_cut_into_segments_give_the_same_results(spark, most_rows):
    rng = random.Random(3)
    rows = []
    for conv in [None, *range(12)]:
        n = 300 if conv == 5 else rng.randint(1, 9)  # one holds most rows
        for turn in sorted(rng.sample(range(2 * n), n)):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", "", None]), rng.choice(["a.", "b", "b", "?", "", None, " \n", "ü!" * 3])))
    rows += [(20, None, "user", "x."), (20, None, "user", "x."), (21, None, None, None), (22, 2**62, "user", "a."), (22, -(2**62), "assistant", "b."), (23, 1, "system", "only.")]
    rng.shuffle(rows)
    found = repair.repair(chats(spark, rows), most_rows)
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0))
        want[conv] = expected(own)
    want[22] = ((-(2**63) + 1 - 2 + 2**63) % 2**64 - 2**63, *want[22][1:])  # wraps around
    got = told(repair.results(found))
    assert set(got) == set(want)
    assert {k: v for k, v in got.items() if v != want[k]} == {}
    assert (found.results.count() > 3) == (most_rows < 1024) or most_rows == 1024


def test_long_texts_and_no_conversations(spark):
    long = "word " * 200_000
    rows = [(1, 0, "user", long), (1, 1, "assistant", long + "."), (1, 2, "user", long), (1, 3, "assistant", "b.")]
    got = told(repair.results(repair.repair(chats(spark, rows), most_bytes=1000)))
    assert got == {1: expected([r[1:] for r in rows])}
    assert repair.results(repair.repair(chats(spark, []))).count() == 0


def test_damage_and_conversations_without_rows_left(spark, tmp_path):
    rows = [(c, t, r, x) for c in range(240) for t, (r, x) in enumerate([("user", "Hi there."), ("assistant", "Yes!"), (None, None)][: 1 + c % 3])]
    rows += [(None, 0, "user", "a."), (None, None, "user", None)]
    path = str(tmp_path)
    chats(spark, rows).write.parquet(f"{path}/conversations.parquet")
    want = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, t, role, text in rows:
            if c != conv:
                continue
            role, text = role or " ", text or " "
            h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
            row = (t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)
            own += [] if h == 0 else [row, row] if h == 3 else [row]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        want[conv] = expected(own) if own else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert ("" in {v[6] for v in want.values()}) and told(QUERIES["op11_conversation_repair"](spark, path)) == want


# 12 -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    from public_tokenizers import PATTERN

    with open(vocabulary("byte_bpe_50k.tiktoken")) as f:
        return byte_pairs.Codec(f.read(), PATTERN, True)


@pytest.fixture(scope="module")
def library(codec):
    import tiktoken
    from public_tokenizers import PATTERN

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=codec.ranks.ranks, special_tokens={})


PIECES = ["a", "b", "th", "e", "ing", " ", "  ", "\n", "'s", "'", "|", "<|endoftext|>", "é", "ß", "中", "😀", "́", "\x85", " ", " ", "1", "22", ".", "!!", "\t", "_"]


def texts():
    rng = random.Random(4)
    long = ["a" * 3001, " " * 2000 + "x", "ab" * 999, "=-" * 700, "日本語" * 300, " " * 500, "1234567890" * 90, "".join(rng.choice("abcdefghij") for _ in range(6000))]
    return ["", None, *long, *("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 150))) for _ in range(150))]


def test_ids_equal_those_of_the_library_and_decode_back(codec, library):
    rows = texts()
    flat, at = codec.encode(pa.array(rows))
    for k, text in enumerate(rows):
        ids = flat[at[k] : at[k + 1]]
        assert ids.tolist() == library.encode_ordinary(text or "")
        assert codec.decode(ids) == (text or "").encode()


def test_joins_and_long_merges_equal_merging_the_whole(codec):
    rng = random.Random(5)
    ranks = codec.ranks
    for _ in range(300):
        alphabet = rng.choice(["ab", "the ", "=-", "abcdefghijklmnopqrstuvwxyz", "0123456789", "\xc3\xa9\xe4"])
        body = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))).encode("latin-1")
        whole, cut = ranks.merge(body), rng.randint(0, len(body))
        assert ranks.join(ranks.merge(body[:cut]), ranks.merge(body[cut:])) == whole == ranks.merge_long(body) == ranks.tree(body)


def test_encoded_and_decoded_columns(spark, library):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "no id", "y", 2), (3, "again", None, 3), (3, "again", None, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, decoded int").repartition(3)
    from public_tokenizers import PATTERN

    path = vocabulary("byte_bpe_50k.tiktoken")
    for cut in (True, False):
        out = byte_pairs.decode(byte_pairs.encode(df, path, PATTERN, cut=cut), path)
        assert out.columns == ["doc_id", "text", "ids", "decoded"]
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert byte_pairs.decode(byte_pairs.encode(df.limit(0), path, PATTERN), path).count() == 0
    ids = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in byte_pairs.decode(ids, path).collect()] == [b"", b""]


def test_text_that_is_not_utf8_and_ids_of_no_token(spark, codec, library):
    with pytest.raises(ValueError):
        codec.decode(np.array([1, 60_000]))
    flat, _ = codec.encode(pa.array([b"ab\xff cd"]).view(pa.string()))
    assert flat.tolist() == library.encode_ordinary("ab� cd")


def test_query_of_ids_against_the_library(spark, sf, library):
    for r in QUERIES["op12_byte_pairs"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), "doc_id").collect():
        ids = library.encode_ordinary(r.text or "")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


def test_a_full_memory_forgets_and_goes_on(codec, library, monkeypatch):
    monkeypatch.setattr(byte_pairs, "REMEMBERED", 10)
    codec.forget()
    for text in ("one two three four five six seven", "eight nine ten eleven twelve one two", "two three"):
        assert codec.encode(pa.array([text]))[0].tolist() == library.encode_ordinary(text)


# 13 -------------------------------------------------------------------------------------------


def all_runs(ws):
    """Every lag over the whole text; of equal stretches the smallest lag."""
    found = {}
    for q in range(1, len(ws) // 4 + 1):
        i = q
        while i < len(ws):
            begin = i
            while i < len(ws) and ws[i] == ws[i - q]:
                i += 1
            if i > begin and i - begin + q >= max(6, 4 * q):
                found.setdefault((begin - q, i), q)
            i += 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def periodic(rng, blocks=6):
    ws = []
    for _ in range(rng.randint(0, blocks)):
        letters = rng.randint(1, 4)
        block = [rng.randint(1, letters) for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            block = block * rng.randint(2, 5) + [9]
        ws += (block * rng.randint(1, 8))[: rng.randint(1, 90)]
    return ws


def test_runs_against_all_lags():
    rng = random.Random(6)
    for _ in range(400):
        rows = [periodic(rng) for _ in range(rng.randint(1, 5))]
        at = np.cumsum([0, *map(len, rows)])
        found = periodic_runs.find(np.array([w for r in rows for w in r], np.int64), at)
        assert [found.get(k, []) for k in range(len(rows))] == [all_runs(r) for r in rows]


@pytest.mark.parametrize("ws", [[1] * 100_000, [1, 2] * 50_000, list(range(1000)) * 100, ([1] * 50 + [2]) * 2000, [1, 2, 1, 1, 2] * 20_000])
def test_long_runs_open_few_diagonals(ws):
    codes, at = np.array(ws), np.array([0, len(ws)])
    places, _ = periodic_runs.openings(codes, at)
    assert len(places) < 6 * len(ws)
    assert (0, len(ws)) in [(s, n) for s, n, _ in periodic_runs.find(codes, at)[0]]


def test_run_columns_with_odd_rows(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(f"w{w}" for w in periodic(rng)), i % 3) for i in range(60)]
    rows += [(100, None, 1), (101, "", 0), (102, " \n\x0b ", 5), (None, "a a a a a a", None), (103, "é " * 7, None), (103, "é " * 7, None), (104, "x y " * 30_000, None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, g int, runs string, n_words int").repartition(3)
    for tail in (None, ("g", repeated_tail)):
        out = periodic_runs.periodic_runs(df, tail=tail)
        assert out.columns == ["doc_id", "text", "g", "n_words", "runs", "collapsed"]
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            ws = WORDS.findall(r.text or "")
            if tail and r.g is not None and ws:
                a, p = repeated_tail(r.g, len(ws))
                ws = [w if i < a else ws[a + (i - a) % p] for i, w in enumerate(ws)]
            found = [tuple(x) for x in r.runs]
            assert r.n_words == len(ws)
            assert found == (all_runs(ws) if len(ws) < 5000 else [(0, 60_000, 2)])
            gone = {i for s, n, q in found for i in range(s + q, s + n)}
            assert bytes(r.collapsed).decode() == " ".join(w for i, w in enumerate(ws) if i not in gone)
    assert periodic_runs.periodic_runs(df.limit(0)).count() == 0
