"""Cheapest repair of the role structure of conversations, by weighted interval parsing.

The rows of a conversation, by turn, are parsed with a repair grammar in Chomsky normal form.  Its symbols are pairs of
states of the role pattern ``(s?(ua)+)?``: ``(p, q)`` derives rows whose edits lead from p to q.  A row alone is derived by one of its
edits, between insertions in any number (the insertion closure); a longer span by ``(p, q) -> (p, r) (r, q)``.  The cell of a symbol
and a span holds the least (cost, audit), where the audit is the initials of the edits in order.  Candidates of one cell and equal cost
have one initial other than ``I`` per row and as many ``I``, so none is a prefix of another, and the least pair of a span is put together
from least pairs of its parts.  As every symbol is a pair of states, each split of a span gives the same cell; so not all spans are
filled but those of a balanced tree, bottom-up by length: work is in proportion to the rows.

Spark deals rows out by ranges of (conversation, turn, role, hash of the text) and sorts them; the task of a range cuts
conversations into segments of bounded rows and bytes.  A conversation that lies inside one segment is finished there.  The
others (cut by a range, or long) go on as segments: texts seen in earlier segments are found by aggregation, cells are filled
per segment, joined up a tree per conversation without texts, and each segment gets its piece of the audit.

Faults of a row, the first of which counts: ``blank`` (no character but blanks), ``duplicate`` (role and text seen earlier in its conversation),
``truncated`` (its last character that is no blank is none of ``. ! ?``).  Edits: Keep (0), Rerole to user or assistant (2), Delete
(3; the only one for blank and duplicate rows), Insert an empty user or assistant text anywhere (2); undeleted truncated rows add 1.

Defined results: a null role or text is one blank; rows come by turn, null turns first, rows of equal turn by role and hash of the
text; a null conversation id is a conversation of its own; repeated rows are duplicates; very long texts and conversations are worked on
whole; an empty table has no conversations; columns other than the four named are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm.common import stored, tasks

BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
#: Costs of the edits, and of a truncated row that stays.
INSERT, REROLE, DELETE, CUT = 2, 2, 3, 1

#: States of the role pattern: nothing yet, after a system row, after a user row, after an assistant row (or a pair).
STATES = range(4)
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
FINAL = (0, 3)
ROLES = {"u": "user", "a": "assistant"}

#: Rows and bytes of text of a segment at most; a single larger row is a segment of its own.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 4 << 20

#: Spans up to this many rows are remembered by the kinds of their rows.
SHORT = 16

Cells = dict[tuple[int, int], tuple[int, str]]


def least(found: Iterable[tuple[tuple[int, int], tuple[int, str]]]) -> Cells:
    out: Cells = {}
    for symbol, cell in found:
        if symbol not in out or cell < out[symbol]:
            out[symbol] = cell
    return out


def joined(left: Cells, right: Cells) -> Cells:
    """Cells of a span from those of its two parts."""
    return least(
        ((p, q), (a + b, x + y)) for (p, r), (a, x) in left.items() for (r2, q), (b, y) in right.items() if r == r2
    )


def closure() -> Cells:
    """Insertions in any number that lead from one state to another."""
    one = least([*(((p, p), (0, "")) for p in STATES), *(((p, q), (INSERT, "I")) for (p, role), q in STEP.items() if role in ROLES)])
    cells = one
    while (more := joined(cells, one)) != cells:
        cells = more
    return cells


INSERTED = closure()


def kind(role: str, fault: str | None) -> str:
    """Letter of a row's choices: ``d`` where it must go, else its role's initial, upper case if truncated."""
    if fault in ("blank", "duplicate"):
        return "d"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


@lru_cache(maxsize=None)
def leaf(letter: str) -> Cells:
    """Cells of one row: each of its edits, between insertions."""
    found = [((p, p), (DELETE, "D")) for p in STATES]
    if letter != "d":
        extra = CUT if letter.isupper() else 0
        for (p, role), q in STEP.items():
            if role == letter.lower():
                found.append(((p, q), (extra, "K")))
            if role in ROLES:
                found.append(((p, q), (REROLE + extra, "R")))
    return joined(joined(INSERTED, least(found)), INSERTED)


def parsed(kinds: str) -> Cells:
    """Cells of a whole span, its halves first."""
    return _short(kinds) if len(kinds) <= SHORT else _halves(kinds)


def _halves(kinds: str) -> Cells:
    if len(kinds) < 2:
        return leaf(kinds) if kinds else INSERTED
    half = len(kinds) // 2
    return joined(parsed(kinds[:half]), parsed(kinds[half:]))


_short = lru_cache(maxsize=1 << 15)(_halves)


def best(cells: Cells) -> tuple[int, str]:
    return min(cells[0, q] for q in FINAL if (0, q) in cells)


def edited(rows: Sequence[tuple[str, str]], audit: str, state: int = 0) -> tuple[list[tuple[str, str]], int]:
    """Rows (role, text) after the edits, and the state they lead to."""
    out, left = [], iter(rows)
    for letter in audit:
        role, text = next(left) if letter != "I" else ("", "")
        if letter == "D":
            continue
        initial = role[0] if letter == "K" else "a" if state == 2 else "u"
        state = STEP[state, initial]
        out.append((role if letter == "K" else ROLES[initial], text))
    return out, state


def faults(rows: Sequence[tuple[str, str]], first: Sequence[bool] | None = None) -> list[str | None]:
    """First fault of every row; ``first`` tells which rows are the first of their role and text, if others came earlier."""
    seen, out = set(), []
    for k, (role, text) in enumerate(rows):
        fresh = (role, text) not in seen if first is None else first[k]
        seen.add((role, text))
        end = text.rstrip(BLANKS)[-1:]
        out.append("blank" if not end else "duplicate" if not fresh else None if end in STOPS else "truncated")
    return out


def illegal_pairs(initials: Sequence[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def as_long(x: int) -> int:
    """Wraps around as 64-bit arithmetic does."""
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


class Segment:
    """Consecutive rows of one conversation."""

    def __init__(self, conv):
        self.conv, self.turns, self.rows, self.bytes = conv, [], [], 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        self.turns.append(turn)
        self.rows.append((role, text))
        self.bytes += len(role) + len(text)

    def full(self, text: str, most_rows: int, most_bytes: int) -> bool:
        return len(self.rows) >= most_rows or self.bytes + len(text) > most_bytes

    def told(self, first: Sequence[bool] | None = None) -> dict:
        """Counts and cells; turns ascend, nulls first."""
        found = faults(self.rows, first)
        turns = [t for t in self.turns if t is not None]
        initials = [role[:1] for role, _ in self.rows]
        return {
            "n_rows": len(self.rows), **{f: found.count(f) for f in COUNTS}, "illegal": illegal_pairs(initials), "head": initials[0],
            "tail": initials[-1], "low": turns[0] if turns else None, "high": turns[-1] if turns else None, "turns": len(set(turns)),
            "cells": parsed("".join(kind(role, f) for (role, _), f in zip(self.rows, found))),
        }


def added(left: dict, right: dict) -> dict:
    """What is told of two neighbouring stretches of one conversation."""
    out = {k: left[k] + right[k] for k in ("n_rows", *COUNTS, "illegal", "turns")}
    out["illegal"] += illegal_pairs([left["tail"], right["head"]])
    out["turns"] -= left["high"] is not None and left["high"] == right["low"]
    low = right["low"] if left["low"] is None else left["low"]
    high = left["high"] if right["high"] is None else right["high"]
    return out | {"head": left["head"], "tail": right["tail"], "low": low, "high": high, "cells": joined(left["cells"], right["cells"])}


def up_the_tree(stack: list[tuple[int, dict]], more: dict | None = None) -> None:
    """Neighbours of equal rank are joined as they come; without ``more``, all that is left."""
    if more is not None:
        stack.append((0, more))
    while len(stack) > 1 and (more is None or stack[-1][0] == stack[-2][0]):
        (_, right), (rank, left) = stack.pop(), stack.pop()
        stack.append((rank + 1, added(left, right)))


def summary(told: dict) -> dict:
    cost, audit = best(told["cells"])
    gaps = 0 if told["low"] is None else as_long(told["high"] - told["low"] + 1 - told["turns"])
    return {"gaps": gaps, **{k: told[k] for k in (*COUNTS, "illegal")}, "cost": cost, "audit": audit}


COUNTS = ("blank", "duplicate", "truncated")
LONGS = ("gaps", *COUNTS, "illegal", "cost")
ROW = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def fields(**kinds: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, t) for n, t in kinds.items()]


CELL = T.StructType(fields(p=T.LongType(), q=T.LongType(), cost=T.LongType(), audit=T.StringType()))


def batch_of(rows: list[dict], schema: T.StructType) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, to_arrow_schema(schema))


#: Rows that one Arrow batch of segments holds at most, and their bytes.
OUT_ROWS, OUT_BYTES = 2000, 4 << 20


class Out:
    """Rows gathered to batches of bounded size."""

    def __init__(self, schema: T.StructType):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: dict, size: int = 0) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        self.bytes += size
        if len(self.rows) >= OUT_ROWS or self.bytes >= OUT_BYTES:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield batch_of(self.rows, self.schema)
        self.rows, self.bytes = [], 0


def segments(df: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Segments of all conversations; the result and the repaired rows of those that lie inside one, rows and turns of the others."""
    conv = df.schema["conv_id"].dataType
    schema = T.StructType(
        fields(conv_id=conv, seq=T.LongType(), whole=T.BooleanType(), **dict.fromkeys(LONGS, T.LongType()), audit=T.StringType())
        + fields(rows=T.ArrayType(ROW), turns=T.ArrayType(T.LongType()))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, own, number, opened = Out(schema), None, 0, True

        def close(whole: bool) -> Iterator[pa.RecordBatch]:
            nonlocal number
            row = {"conv_id": own.conv, "seq": (part << 40) + number, "whole": whole}
            if whole:
                found = summary(own.told())
                row |= {**found, "rows": [dict(zip(ROW.names, r)) for r in edited(own.rows, found["audit"])[0]]}
            else:
                row |= {"rows": [dict(zip(ROW.names, r)) for r in own.rows], "turns": own.turns}
            number += 1
            yield from out.add(row, own.bytes)

        for batch in batches:
            parts = batch.column("part").to_pylist()
            for part, *key, turn, role, text in zip(parts, *(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text"))):
                if own is not None and own.conv != key[0]:
                    # The first conversation of a range may have begun in the range before.
                    yield from close(not opened)
                    own, opened = None, False
                elif own is not None and own.full(text, most_rows, most_bytes):
                    opened = True
                    yield from close(False)
                    own = None
                if own is None:
                    own = Segment(key[0])
                own.add(turn, role, text)
        if own is not None:
            yield from close(False)  # the last one may go on in the next range
        yield from out.rest()

    rows = df.select(
        "conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text")
    ).withColumn("hash", F.xxhash64("text"))
    keys = ["conv_id", "turn", "role", "hash"]
    dealt = rows.repartitionByRange(tasks(df.sparkSession), *keys).sortWithinPartitions(*keys)
    return dealt.select("conv_id", "turn", "role", "text", F.spark_partition_id().cast("bigint").alias("part")).mapInArrow(run, schema)


def with_cells(opened: DataFrame) -> DataFrame:
    """Counts and cells of open segments, knowing what earlier segments of their conversations hold."""
    conv = opened.schema["conv_id"].dataType
    each = opened.select("conv_id", "seq", F.posexplode("rows").alias("place", "row"))
    firsts = (
        each.groupBy("conv_id", "row.role", F.sha2("row.text", 256).alias("digest")).agg(F.min(F.struct("seq", "place")).alias("at"))
        .groupBy("at.seq").agg(F.collect_list(F.col("at.place").cast("bigint")).alias("firsts"))  # at most the rows of a segment
    )
    schema = T.StructType(
        fields(conv_id=conv, seq=T.LongType(), **dict.fromkeys(("n_rows", *COUNTS, "illegal", "low", "high", "turns"), T.LongType()))
        + fields(head=T.StringType(), tail=T.StringType(), cells=T.ArrayType(CELL))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                own, first = Segment(row["conv_id"]), set(row["firsts"] or ())
                for turn, r in zip(row["turns"], row["rows"]):
                    own.add(turn, r["role"], r["text"])
                told = own.told([k in first for k in range(len(own.rows))])
                cells = [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in told["cells"].items()]
                found.append({"conv_id": row["conv_id"], "seq": row["seq"], **told, "cells": cells})
            yield batch_of(found, schema)

    return opened.select("conv_id", "seq", "rows", "turns").join(firsts, "seq", "left").select("conv_id", "seq", "rows", "turns", "firsts").mapInArrow(run, schema)


def whole_audits(told: DataFrame) -> DataFrame:
    """Result of every conversation that has open segments (``seq`` null), and the piece of its audit and the state before it for every segment.

    A task holds the cells of one conversation at a time, joined as they come: eleven audits, an initial a row, and no texts.
    """
    conv = told.schema["conv_id"].dataType
    schema = T.StructType(fields(conv_id=conv, seq=T.LongType(), **dict.fromkeys(LONGS, T.LongType()), audit=T.StringType(), state=T.LongType()))

    def finish(key, stack: list, places: list[tuple[int, int, str]]) -> Iterator[dict]:
        up_the_tree(stack)
        found = summary(stack[0][1])
        yield {"conv_id": key, "seq": None, **found}
        audit, at, written = found["audit"], 0, 0
        begins = (len(audit) - audit.count("D")) % 2  # an odd number of rows begins with a system row
        for k, (seq, n) in enumerate(places):
            end, left = at, n
            while left:
                left -= audit[end] != "I"
                end += 1
            end = len(audit) if k == len(places) - 1 else end
            pairs = written - begins
            state = 0 if not written else 1 if not pairs else 3 - pairs % 2
            yield {"conv_id": key, "seq": seq, "audit": audit[at:end], "state": state}
            written += end - at - audit.count("D", at, end)
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, stack, places = Out(schema), None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if places and row["conv_id"] != key:
                    for x in finish(key, stack, places):
                        yield from out.add(x, len(x["audit"]))
                    stack, places = [], []
                key = row["conv_id"]
                places.append((row["seq"], row["n_rows"]))
                up_the_tree(stack, row | {"cells": {(c["p"], c["q"]): (c["cost"], c["audit"]) for c in row["cells"]}})
        if places:
            for x in finish(key, stack, places):
                yield from out.add(x, len(x["audit"]))
        yield from out.rest()

    return told.repartition(tasks(told.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, schema)


def repaired_pieces(opened: DataFrame, audits: DataFrame) -> DataFrame:
    """Open segments with their rows after the edits."""
    schema = T.StructType([opened.schema["conv_id"], opened.schema["seq"], T.StructField("rows", T.ArrayType(ROW))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                rows, _ = edited([(r["role"], r["text"]) for r in row["rows"]], row["audit"], row["state"])
                found.append({"conv_id": row["conv_id"], "seq": row["seq"], "rows": [dict(zip(ROW.names, r)) for r in rows]})
            yield batch_of(found, schema)

    pieces = audits.where("seq is not null").select("seq", "audit", "state")
    return opened.select("conv_id", "seq", "rows").join(pieces, "seq").mapInArrow(run, schema)


class Repair(NamedTuple):
    """``whole``: conversations with their result and repaired ``rows`` (role, text) in order.

    The others, which span segments: ``results`` has a row each, ``pieces`` their repaired rows, segments in order of ``seq``.
    """

    whole: DataFrame
    results: DataFrame
    pieces: DataFrame


def repair(df: DataFrame, most_rows: int = SEGMENT_ROWS, most_bytes: int = SEGMENT_BYTES) -> Repair:
    """Repair the conversations of (conv_id, turn, role, text); the bounds are those of a segment and don't change results."""
    found = stored(segments(df, most_rows, most_bytes), "segments")
    opened = found.where("not whole")
    audits = stored(whole_audits(with_cells(opened)), "audits")
    result = ["conv_id", *LONGS, "audit"]
    return Repair(found.where("whole").select(*result, "rows"), audits.where("seq is null").select(*result), repaired_pieces(opened, audits))


def text_of(rows: str) -> F.Column:
    """``role:text`` of all rows, joined by line ends."""
    return F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")


def digests(pieces: DataFrame) -> DataFrame:
    """SHA-256 of the repaired text of every conversation in pieces; a digest reads its text in order, so one task streams it."""
    schema = T.StructType([pieces.schema["conv_id"], T.StructField("repaired_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, key, digest, begun = Out(schema), None, None, False
        for batch in batches:
            for conv, n, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "n", "body"))):
                if digest is None or conv != key:
                    if digest is not None:
                        yield from out.add({"conv_id": key, "repaired_sha256": digest.hexdigest()})
                    key, digest, begun = conv, hashlib.sha256(), False
                if n:
                    digest.update(("\n" + text if begun else text).encode())
                    begun = True
        if digest is not None:
            yield from out.add({"conv_id": key, "repaired_sha256": digest.hexdigest()})
        yield from out.rest()

    told = pieces.select("conv_id", "seq", F.size("rows").alias("n"), text_of("rows").alias("body"))
    return told.repartition(tasks(pieces.sparkSession), "conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(run, schema)


def results(found: Repair) -> DataFrame:
    """One row per conversation: counts, cost, audit and the digest of the repaired text."""
    columns = ["conv_id", *LONGS, "audit", "repaired_sha256"]
    whole = found.whole.withColumn("repaired_sha256", F.sha2(text_of("rows"), 256)).select(*columns)
    told = found.results.alias("r").join(digests(found.pieces).alias("d"), F.col("r.conv_id").eqNullSafe(F.col("d.conv_id")))
    return whole.unionAll(told.select("r.conv_id", *columns[1:]))
