"""Token ids of whole texts with the tokenizers library, one Arrow batch at a time.

The pre-tokenizers of the byte-level and word-end vocabularies never join characters over a blank that
follows a visible character, over a single line end, or between a letter and a punctuation mark; texts are cut
there and every distinct stretch is encoded once per task.  Where a cut might matter (blanks of other
kinds, apostrophes, bars of special tokens) none is made: a longer stretch only costs time.  Stretches of
Latin letters go straight to the vocabulary's merges, all others through the whole tokenizer.  Results
equal those of encoding the whole text.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import SparkSession

from millrace.llm.common import encoded, gather, strings, utf8

#: Stretches a task remembers; when full, it forgets all and goes on.
REMEMBERED = 1 << 18

_LOADED: dict[int, "Encoder"] = {}


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary file's text for all executors; only the driver needs to reach the path."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encoder(vocabulary: Broadcast) -> "Encoder":
    """One encoder per worker and vocabulary."""
    key = vocabulary._jbroadcast.id() if vocabulary._jbroadcast is not None else hash(vocabulary.value)
    if key not in _LOADED:
        _LOADED[key] = Encoder(vocabulary.value)
    return _LOADED[key]


@contextmanager
def encoding(vocabulary: Broadcast) -> Iterator["Encoder"]:
    """The worker's encoder for one task: the vocabulary stays loaded, the stretches met are forgotten at the end, as the worker lives on."""
    own = encoder(vocabulary)
    try:
        yield own
    finally:
        own.forget()


LETTER = np.zeros(256, bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
MARK = np.zeros(256, bool)
MARK[[b for b in range(0x21, 0x7F) if not chr(b).isalnum() and chr(b) not in "'|"]] = True


def stretches(data: np.ndarray, at: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Texts cut where no token can cross; where the stretches of each row begin (rows + 1)."""
    n = len(data)
    if not n:
        return strings(data, np.zeros(1, np.int64)), np.zeros(len(at), np.int64)
    back = lambda k: np.concatenate([np.zeros(min(k, n), np.uint8), data[: n - k] if n > k else data[:0]])
    one, two, three = back(1), back(2), back(3)
    seen = (one > 0x20) & (one < 0x7F)
    visible = seen | ((one >= 0x80) & (two != 0xC2) & ((three < 0xE1) | (three > 0xE3)))
    cut = ((data == 0x20) | (data == 0x0A)) & visible
    after = np.zeros(n, bool)
    after[1:] = (data[:-1] == 0x0A) & cut[:-1] & (data[1:] > 0x20) & (data[1:] < 0x7F)
    letter, before = LETTER[data], LETTER[one]
    cut |= after | (before & MARK[data]) | (MARK[one] & letter)
    cut[at[at < n]] = True
    begin = np.flatnonzero(cut)
    return strings(data, np.append(begin, n)), np.searchsorted(begin, at)


def byte_marks() -> list[str]:
    """Byte-level vocabularies write every byte as a visible character: itself, or one from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Encoder:
    """A tokenizer and the stretches it has met: number of each, and their ids one after the other."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        told = json.loads(vocabulary)
        kinds = {x["type"] for x in ((told["normalizer"] or {}).get("normalizers") or [])}
        self.marks = dict(enumerate(byte_marks()))
        self.blanks = not kinds  # a leading blank belongs to the word
        self.merges = self.tokenizer.model if told["model"]["type"] == "BPE" and kinds in (set(), {"NFC", "Replace", "Lowercase"}) else None
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids = np.zeros(0, np.uint32)
        self.at = np.zeros(1, np.int64)

    def latin(self, x: str) -> str | None:
        """The stretch as the merges expect it, if it is one run of Latin letters."""
        body = x[1:] if x[:1] == " " else x
        if self.merges is None or not body.isalpha() or not (body.isascii() or max(body) <= "\xff"):
            return None
        shown = x if self.blanks else body.lower()
        return shown.encode().decode("latin-1").translate(self.marks)

    def learn(self, unknown: list[str]) -> None:
        ids, sizes, rest = [], [], []
        for x in unknown:
            shown = self.latin(x)
            if shown is None:
                rest.append(x)
            else:
                own = [t.id for t in self.merges.tokenize(shown)]
                ids += own
                sizes.append(len(own))
                self.known[x] = len(self.known)
        if rest:
            e = self.tokenizer.encode(rest, is_pretokenized=True, add_special_tokens=False)
            ends = np.searchsorted(np.asarray(e.word_ids, np.int64), np.arange(len(rest) + 1))
            self.known.update(zip(rest, range(len(self.known), len(self.known) + len(rest))))
            ids += e.ids
            sizes += np.diff(ends).tolist()
        self.at = np.append(self.at, np.cumsum(sizes) + self.at[-1])
        self.ids = np.append(self.ids, np.asarray(ids, np.uint32))

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """Number of every stretch; new ones are encoded."""
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0)
        if len(new):
            if len(self.known) and len(self.known) + len(new) > REMEMBERED:
                self.forget()
                return self.numbers(distinct)
            names = [distinct[i] for i in new.tolist()]
            self.learn(names)
            at[new] = np.fromiter(map(self.known.get, names), np.int64, len(names))
        return at

    def encode(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows with ``end`` after each, and where each row begins (rows + 1)."""
        data, at = utf8(column)
        parts, rows = stretches(data, at)
        codes, distinct = encoded(parts)
        number = self.numbers(distinct.to_pylist())[codes]
        lengths = self.at[number + 1] - self.at[number]
        ids = gather(self.ids, self.at[number], lengths)
        upto = np.concatenate([[0], np.cumsum(lengths)])[rows]
        starts = upto + np.arange(len(upto))
        out = np.full(len(ids) + len(column), end, np.uint32)
        keep = np.ones(len(out), bool)
        keep[starts[1:] - 1] = False
        out[keep] = ids
        return out, starts
