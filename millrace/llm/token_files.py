"""Operator 5: token ids in files of directly addressable codes.

An id is split into 8-bit chunks, lowest first.  Level 0 holds the lowest chunk of every id, level 1 the next
chunk of those ids that go on, and so forth.  A bitmap per level marks the ids that go on, and a rank
directory counts the marks before every 512th place, so ``TokenFile.access(i)`` finds any id with one look
per level and decodes nothing else.

``write_tokens`` encodes whole texts, sorts documents by id (null first; equal ids by their tokens) into as
many ranges as the session has shuffle partitions, and writes files of at most ``ids_per_file`` ids (one
document is never split).  A file's name is unique to the task attempt and gets into the manifest only when the
attempt succeeds, so retried tasks leave nothing behind that is read.  ``read_documents`` returns the documents
of the files, ``ids_at`` single ids.  Null and empty texts are the end id alone; an empty table gives an empty
manifest; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import ENCODE_BYTES, fresh_folder, in_arrow, passes, stored, tasks
from millrace.llm.tokenizing import encoding, share
from millrace.operators.ordering import running_offset

MAGIC = b"MRDAC001"
CHUNK_BITS = 8
RANK_BITS = 512
IDS_PER_FILE = 1 << 23


# Codes ----------------------------------------------------------------------------------------


def to_levels(ids: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, packed bitmap, rank directory) of every level."""
    levels, rest = [], ids.astype(np.uint32)
    while True:
        more = rest >> CHUNK_BITS > 0
        marks = np.packbits(more, bitorder="little")
        per_block = np.add.reduceat(more, np.arange(0, len(more), RANK_BITS), dtype=np.int64) if len(more) else np.zeros(0, np.int64)
        ranks = np.concatenate([[0], np.cumsum(per_block)])[: max(1, len(per_block))].astype(np.uint64)
        levels.append(((rest & ((1 << CHUNK_BITS) - 1)).astype(np.uint8), marks, ranks))
        if not more.any():
            return levels
        rest = rest[more] >> CHUNK_BITS


def from_levels(levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> np.ndarray:
    """All ids."""
    ids = None
    for chunks, marks, _ in reversed(levels):
        own = chunks.astype(np.uint32)
        if ids is not None:
            more = np.unpackbits(marks, count=len(chunks), bitorder="little").astype(bool)
            own[more] |= ids << CHUNK_BITS
        ids = own
    return ids


def file_bytes(doc_ids: np.ndarray, known: np.ndarray, starts: np.ndarray, ids: np.ndarray) -> bytes:
    """Head (counts and section sizes), document directory, levels."""
    levels = to_levels(ids)
    parts = [doc_ids.astype("<i8").tobytes(), known.astype(np.uint8).tobytes(), starts.astype("<u8").tobytes()]
    for chunks, marks, ranks in levels:
        parts += [chunks.tobytes(), marks.tobytes(), ranks.astype("<u8").tobytes()]
    head = struct.pack("<8sQQQ", MAGIC, len(ids), len(doc_ids), len(levels)) + struct.pack(f"<{len(parts)}Q", *map(len, parts))
    return head + b"".join(parts)


class TokenFile:
    """A token file: ``access`` for single ids, ``ids`` for all, ``docs`` for the document directory."""

    def __init__(self, body: bytes):
        magic, self.n_ids, self.n_docs, n_levels = struct.unpack_from("<8sQQQ", body)
        if magic != MAGIC:
            raise ValueError("not a token file")
        sizes = struct.unpack_from(f"<{3 + 3 * n_levels}Q", body, 32)
        at = 32 + 8 * len(sizes)
        parts = []
        for size in sizes:
            parts.append(memoryview(body)[at : at + size])
            at += size
        self.doc_ids, self.known, self.starts = (np.frombuffer(p, t) for p, t in zip(parts[:3], ("<i8", np.uint8, "<u8")))
        self.levels = [
            (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8), np.frombuffer(c, "<u8"))
            for a, b, c in zip(parts[3::3], parts[4::3], parts[5::3])
        ]

    def ids(self) -> np.ndarray:
        return from_levels(self.levels)

    def access(self, i: int) -> int:
        """One id: a chunk per level, and a count of at most 512 marks to find its place on the next."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        value = 0
        for level, (chunks, marks, ranks) in enumerate(self.levels):
            value |= int(chunks[i]) << (CHUNK_BITS * level)
            if not marks[i >> 3] >> (i & 7) & 1:
                break
            first = i // RANK_BITS * (RANK_BITS // 8)
            whole = int(np.bitwise_count(marks[first : i >> 3]).sum())
            i = int(ranks[i // RANK_BITS]) + whole + (int(marks[i >> 3]) & ((1 << (i & 7)) - 1)).bit_count()
        return value


def read_bytes(path: str) -> bytes:
    system, at = fs.FileSystem.from_uri(path)
    with system.open_input_file(at) as f:
        return f.read()


# Writing --------------------------------------------------------------------------------------


def id_type(vocabulary: Broadcast, end: int) -> np.dtype:
    """Two bytes where every id fits, else four."""
    told = json.loads(vocabulary.value)
    most = max([end, *told["model"]["vocab"].values(), *(x["id"] for x in told["added_tokens"])])
    return np.dtype("<u2" if most < 1 << 16 else "<u4")


def encoded_documents(docs: DataFrame, vocabulary: Broadcast, end: int, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, doc_id, ids): little-endian ids of whole texts with the end id, and the range of the document's id.

    Ids take the bytes that the largest of the vocabulary needs, see ``id_type``.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = id_type(vocabulary, end)
    cuts = [(i + 1) / shards for i in range(shards - 1)]
    found = source.select(F.percentile_approx("doc_id", cuts, 10_000).alias("c")).first()["c"] if cuts else []
    bounds = np.unique(np.asarray(found or [], np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with encoding(vocabulary) as told:
            for batch in passes(batches, most=ENCODE_BYTES):
                ids, starts = told.encode(batch.column("text"), end)
                body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(starts * kind.itemsize), pa.py_buffer(ids.astype(kind))])
                number = batch.column("doc_id").fill_null(-(1 << 63)).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.searchsorted(bounds, number).astype(np.int32)), batch.column("doc_id"), body.cast(pa.binary())],
                    ["shard", "doc_id", "ids"],
                )

    return in_arrow(source, run, "shard int, doc_id bigint, ids binary")


def write_tokens(
    docs: DataFrame, vocabulary_path: str, folder: str | None = None, end: int = 1,
    ids_per_file: int = IDS_PER_FILE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Write the files; returns the manifest (shard, part, path, n_ids, n_docs), which is itself a stored table."""
    spark = docs.sparkSession
    folder = folder or fresh_folder(spark, "token-files")
    shards = tasks(spark)
    vocabulary = share(spark, vocabulary_path)
    kind = id_type(vocabulary, end)
    rows = encoded_documents(docs, vocabulary, end, shards, id_col, text_col)
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int | None, bytes]] = []
        size, part = 0, {}

        def flush() -> pa.RecordBatch:
            shard = held[0][0]
            known = np.asarray([d is not None for _, d, _ in held])
            numbers = np.asarray([d or 0 for _, d, _ in held], np.int64)
            starts = np.concatenate([[0], np.cumsum([len(b) // kind.itemsize for _, _, b in held])])
            ids = np.frombuffer(b"".join(b for _, _, b in held), kind)
            path = f"{folder}/{shard:08d}-{uuid4().hex}.dac"
            system, at = fs.FileSystem.from_uri(path)
            system.create_dir(at.rpartition("/")[0], recursive=True)
            with system.open_output_stream(at) as f:
                f.write(file_bytes(numbers, known, starts, ids))
            part[shard] = part.get(shard, -1) + 1
            row = [[shard], [part[shard]], [path], [len(ids)], [len(held)]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()))], ["shard", "part", "path", "n_ids", "n_docs"])

        for batch in batches:
            for shard, doc, ids in zip(*(c.to_pylist() for c in batch.columns)):
                if held and (held[0][0] != shard or size + len(ids) // kind.itemsize > ids_per_file):
                    yield flush()
                    held, size = [], 0
                held.append((shard, doc, ids))
                size += len(ids) // kind.itemsize
        if held:
            yield flush()

    placed = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("doc_id").asc_nulls_first(), "ids")
    return stored(placed.mapInArrow(run, "shard int, part int, path string, n_ids bigint, n_docs bigint"), "token-manifest")


# Reading --------------------------------------------------------------------------------------


def placed_files(manifest: DataFrame) -> DataFrame:
    """The manifest with ``first``, the number of ids in all earlier files."""
    order = manifest.withColumn("_place", F.col("shard").cast("bigint") * (1 << 20) + F.col("part"))
    return running_offset(order, [], "_place", "n_ids", "first", block=1 << 32).drop("_place")


def read_documents(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, ids) of every document, read back from the files; ``start`` counts all ids before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first in zip(batch.column("path").to_pylist(), batch.column("first").to_pylist()):
                file = TokenFile(read_bytes(path))
                ids, starts = file.ids().astype("<u4"), file.starts.astype(np.int64)
                step = 4096
                for a in range(0, file.n_docs, step):
                    at = starts[a : a + step + 1]
                    body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer((at - at[0]) * 4), pa.py_buffer(ids[at[0] : at[-1]])])
                    docs = pa.array(file.doc_ids[a : a + step], mask=file.known[a : a + step] == 0)
                    yield pa.RecordBatch.from_arrays([docs, pa.array(at[:-1] + first), body.cast(pa.binary())], ["doc_id", "start", "ids"])

    files = placed_files(manifest).select("path", "first").repartitionByRange(tasks(manifest.sparkSession), "path")
    return files.mapInArrow(run, "doc_id bigint, start bigint, ids binary")


def ids_at(manifest: DataFrame, places: DataFrame, place_col: str = "place", width: int = IDS_PER_FILE) -> DataFrame:
    """(place, id): single ids of the whole stream, each read by direct access in its file."""
    reach = F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("n_ids") - 1) / width))
    files = placed_files(manifest).select("path", "first", "n_ids", F.explode(reach).alias("_w"))
    asked = places.select(F.col(place_col).cast("bigint").alias("place")).withColumn("_w", F.floor(F.col("place") / width))
    found = asked.join(files, "_w").where((F.col("place") >= F.col("first")) & (F.col("place") < F.col("first") + F.col("n_ids")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            out = []
            for p, first, place in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "place"))):
                if p != path:
                    path, file = p, TokenFile(read_bytes(p))
                out.append(file.access(place - first))
            yield pa.RecordBatch.from_arrays([batch.column("place"), pa.array(out, pa.int64())], ["place", "id"])

    return found.select("path", "first", "place").repartition("path").sortWithinPartitions("path").mapInArrow(run, "place bigint, id bigint")
