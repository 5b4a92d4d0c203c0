"""Byte-level byte-pair encoding and decoding as reductions over a tree.

Encodings of byte strings form a monoid: ``encode(a + b)`` comes from ``encode(a)`` and ``encode(b)`` alone.  A match
of the pattern is cut into halves down to short leaves, whose pairs are merged lowest rank first (many leaves in one numpy pass), and
neighbours are joined up the tree.  A join encodes a window of tokens around the seam anew and widens it until its first and last tokens
are those that stood there before.  That proves the rest stable: a token sequence is an encoding if and only if each two
neighbours are the encoding of their own bytes, and then every pair of neighbours lies inside the left part, inside
the right part or inside the window.  Decoding concatenates the bytes of the ids up the same kind of tree.

Texts are first cut where no match of the pattern can cross (``tokenizing.stretches``), and a worker encodes a distinct
stretch once; what it remembers is bounded.

Defined results: a null or empty text has no ids, and null or empty ids decode to no bytes; bytes that are not UTF-8 are
read as U+FFFD, as a text library would hand them on; long texts are worked on whole, rows in passes of bounded size;
rows are encoded one by one, so ties and repeated rows give equal rows; empty tables give empty tables; a column with the
name of the result is replaced, all others pass through.  An id that is no token's raises ``ValueError``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import encoded, gather, passes, utf8
from millrace.llm.tokenizing import share, stretches

#: Bytes of a leaf of the tree, bytes that are merged without a heap, and ids whose bytes are gathered at once.
LEAF, SHORT, BLOCK = 16, 64, 1 << 18

#: Stands above every rank; leaves that one numpy pass merges.
NEVER, ROUND = 1 << 62, 1 << 14

#: Stretches and bytes of them that a worker remembers; when full, it forgets all and goes on.
REMEMBERED, REMEMBERED_BYTES = 1 << 18, 16 << 20

_LOADED: dict[tuple, "Codec"] = {}


class Ranks:
    """Merge ranks of byte strings; a token's rank is its id."""

    def __init__(self, lines: str):
        pairs = (line.split() for line in lines.splitlines() if line)
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.single = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        self.pairs = self.pair_table()

    def merge(self, body: bytes) -> list[int]:
        """Merge the neighbours of lowest rank, the leftmost among equals, until none has a rank."""
        if len(body) > SHORT:
            return self.merge_long(body)
        rank = self.ranks.get
        parts = [body[i : i + 1] for i in range(len(body))]
        pairs = [rank(body[i : i + 2], NEVER) for i in range(len(body) - 1)]
        while pairs and (best := min(pairs)) != NEVER:
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = rank(parts[i - 1] + parts[i], NEVER)
            if i < len(pairs):
                pairs[i] = rank(parts[i] + parts[i + 1], NEVER)
        return list(map(self.ranks.__getitem__, parts))

    def merge_long(self, body: bytes) -> list[int]:
        """The same with a heap of pairs, for the wide windows of runs that shift as a whole."""
        rank, n = self.ranks.get, len(body)
        after, before, ends = list(range(1, n + 1)), list(range(-1, n)), list(range(1, n + 1))

        def push(i: int) -> None:
            j = after[i]
            if j < n and (r := rank(body[i : ends[j]])) is not None:
                heapq.heappush(heap, (r, i, j, ends[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n - 1):
            push(i)
        while heap:
            _, i, j, end = heapq.heappop(heap)
            if ends[i] != j or ends[j] != end:
                continue  # one of the two has been merged since
            ends[i], ends[j], after[i] = end, 0, after[j]
            if after[i] < n:
                before[after[i]] = i
            push(i)
            if before[i] >= 0:
                push(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ranks[body[i : ends[i]]])
            i = ends[i]
        return out

    def bytes_of(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """Encoding of the bytes of both."""
        if not left or not right:
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(self.bytes_of(left[-a:] + right[:b]))
            left_holds = a == len(left) or window[0] == left[-a]
            right_holds = b == len(right) or window[-1] == right[b - 1]
            if left_holds and right_holds:
                return left[:-a] + window + right[b:]
            a, b = (a if left_holds else 2 * a), (b if right_holds else 2 * b)

    def tree(self, body: bytes) -> list[int]:
        if len(body) <= LEAF:
            return self.merge(body)
        half = len(body) // 2
        return self.join(self.tree(body[:half]), self.tree(body[half:]))

    def pair_table(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of all pairs of tokens whose bytes have a rank, and these ranks."""
        rank, found = self.ranks.get, {}
        for token, own in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = rank(token[:cut]), rank(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = own
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        return keys[order], np.fromiter(found.values(), np.int64, len(found))[order]

    def leaves(self, bodies: list[bytes]) -> np.ndarray:
        """Ids of many leaves, a row each, -1 behind its end: every round merges the least pair of every row."""
        width = LEAF + 1
        keys, values = self.pairs
        data = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in bodies), np.uint8).reshape(-1, width)
        at = np.arange(width)
        own = np.where(at < np.fromiter(map(len, bodies), np.int64, len(bodies))[:, None], self.single[data], -1)

        def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            key = np.where((a < 0) | (b < 0), -1, a << 32 | b)
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[place] == key, values[place], NEVER)

        if not len(keys):
            return own
        pairs = np.full(own.shape, NEVER)
        pairs[:, :-1] = ranks(own[:, :-1], own[:, 1:])
        rows = np.arange(len(own))
        while len(rows):
            least = np.argmin(pairs[rows], 1)
            found = pairs[rows, least]
            rows, least, found = rows[found < NEVER], least[found < NEVER], found[found < NEVER]
            take = at + (at > least[:, None])
            take[:, -1] = width - 1  # always behind the end
            own[rows] = np.take_along_axis(own[rows], take, 1)
            pairs[rows] = np.take_along_axis(pairs[rows], take, 1)
            own[rows, least] = found
            pairs[rows, least] = ranks(found, own[rows, least + 1])
            inner = least > 0
            r, i = rows[inner], least[inner]
            pairs[r, i - 1] = ranks(own[r, i - 1], own[r, i])
        return own

    def matches(self, bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many matches of the pattern one after the other, and the number of each; a match that is a token stays one."""
        whole = np.fromiter(map(self.ranks.get, bodies, repeat(-1)), np.int64, len(bodies))
        sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
        short = np.flatnonzero((whole < 0) & (sizes <= LEAF))
        trees = {k: self.tree(bodies[k]) for k in np.flatnonzero((whole < 0) & (sizes > LEAF)).tolist()}
        parts = [self.leaves([bodies[k] for k in short[i : i + ROUND].tolist()]) for i in range(0, len(short), ROUND)]
        leaves = np.concatenate(parts) if parts else np.zeros((0, LEAF + 1), np.int64)
        counts = np.ones(len(bodies), np.int64)
        counts[short] = (leaves >= 0).sum(1)
        counts[list(trees)] = list(map(len, trees.values()))
        starts = np.cumsum(counts) - counts
        ids = np.empty(counts.sum(), np.int32)
        ids[starts[whole >= 0]] = whole[whole >= 0]
        ids[(starts[short][:, None] + np.arange(LEAF + 1))[leaves >= 0]] = leaves[leaves >= 0]
        for k, found in trees.items():
            ids[starts[k] : starts[k] + counts[k]] = found
        return ids, counts


class Codec:
    """Ranks, the pattern, and the stretches that this worker has met."""

    def __init__(self, lines: str, pattern: str, cut: bool):
        self.ranks, self.pattern, self.cut = Ranks(lines), regex.compile(pattern), cut
        most = max(self.ranks.tokens, default=-1)
        table = [self.ranks.tokens.get(i, b"") for i in range(most + 1)]
        self.sizes = np.fromiter(map(len, table), np.int64, most + 1)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_bytes = 0
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def learn(self, unknown: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of stretches one after the other, and the number of each."""
        found = [[m[0].encode() for m in self.pattern.finditer(x.decode("utf-8", "replace"))] for x in unknown]
        ids, counts = self.ranks.matches([m for x in found for m in x])
        upto = np.concatenate([[0], np.cumsum(counts)])
        ends = np.cumsum([len(x) for x in found])
        return ids, np.diff(upto[ends], prepend=0)

    def numbers(self, distinct: list[bytes]) -> np.ndarray:
        """Number of every stretch; new ones are encoded."""
        at = np.fromiter(map(self.known.get, distinct, repeat(-1)), np.int64, len(distinct))
        new = np.flatnonzero(at < 0).tolist()
        size = sum(len(distinct[i]) for i in new)
        if self.known and (len(self.known) + len(new) > REMEMBERED or self.known_bytes + size > REMEMBERED_BYTES):
            self.forget()
            return self.numbers(distinct)
        if new:
            ids, counts = self.learn([distinct[i] for i in new])
            at[new] = np.arange(len(self.known), len(self.known) + len(new))
            self.known.update(zip((distinct[i] for i in new), at[new].tolist()))
            self.known_bytes += size
            self.at = np.append(self.at, np.cumsum(counts) + self.at[-1])
            self.ids = np.append(self.ids, ids)
        return at

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, and where each row begins (rows + 1)."""
        data, at = utf8(column)
        if self.cut:
            parts, rows = stretches(data, at)
        else:
            parts, rows = column.cast(pa.large_string()).fill_null(""), np.arange(len(at))
        codes, distinct = encoded(parts.cast(pa.large_binary()))
        number = self.numbers(distinct.to_pylist())[codes]
        lengths = self.at[number + 1] - self.at[number]
        return gather(self.ids, self.at[number], lengths), np.concatenate([[0], np.cumsum(lengths)])[rows]

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of ids: leaves are gathered, neighbours concatenated up the tree."""
        if len(ids) <= BLOCK:
            if len(ids) and (ids.min() < 0 or ids.max() >= len(self.sizes) or not self.sizes[ids].all()):
                raise ValueError("an id is not in the vocabulary")
            return gather(self.bytes, self.starts[ids], self.sizes[ids]).tobytes()
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec(lines: str, pattern: str, cut: bool) -> Codec:
    """One codec per worker, vocabulary and pattern."""
    key = hash(lines), pattern, cut
    if key not in _LOADED:
        _LOADED[key] = Codec(lines, pattern, cut)
    return _LOADED[key]


def _schema(df: DataFrame, keep: Sequence[str] | None, name: str, kind: T.DataType) -> tuple[list[str], T.StructType]:
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    return kept, T.StructType([df.schema[c] for c in kept] + [T.StructField(name, kind)])


def encode(
    df: DataFrame, ranks: str, pattern: str, text: str = "text", ids: str = "ids", keep: Sequence[str] | None = None, cut: bool = True
) -> DataFrame:
    """Columns ``keep`` (all of them if not given) and the ids of every text under the ranks of a vocabulary file.

    The file is read by the driver and broadcast: its size is that of the vocabulary.  Every match of ``pattern`` is encoded
    by itself.  ``cut=False`` is for patterns that may match over a line end, a single blank after a visible character, or the
    seam of a Latin letter and a punctuation mark.
    """
    shared = share(df.sparkSession, ranks)
    kept, schema = _schema(df, keep, ids, T.ArrayType(T.IntegerType(), False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, pattern, cut)
        for batch in passes(batches, text):
            flat, at = own.encode(batch.column(text))
            out = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), out], names=[*kept, ids])

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: str, ids: str = "ids", out: str = "decoded", keep: Sequence[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all of them if not given) and the bytes that the ids of every row stand for."""
    shared = share(df.sparkSession, ranks)
    kept, schema = _schema(df, keep, out, T.BinaryType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(shared.value, "", True)
        for batch in batches:
            column = batch.column(ids)
            found = [own.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.binary())], names=[*kept, out])

    return df.select(*dict.fromkeys([*kept, ids])).mapInArrow(run, schema)
