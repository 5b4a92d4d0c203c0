"""Flat token files as a data source: ``spark.read.format("flat_tokens")`` and ``df.write.format("flat_tokens")``.

A folder ``<path>/<source>_p<shard>`` holds files ``part-<block>.ds`` of little-endian ids; its stream is their concatenation by name.

Writing takes (source, shard, block, ids) in the order of the stream, blocks not interleaved.  A task writes each block under a name
that readers don't see and reports it; only when all tasks have ended does the commit give the files their names, and a failed
job's files are removed.  A repeated task writes files of its own, of which the commit sees one set.

Reading gives windows (folder, win, ids) of ``length + 1`` ids.  Files are listed with their sizes when the read is planned (no
contents); the streams are cut into ranges of whole windows, each read from as many files as hold a part of it; a task reads one range, or several short ones.

Options: ``width`` (2, 4 or 8 bytes an id), and for reading ``length``, ``range_bytes``, ``skip`` and ``most`` (ids passed over at the beginning
of every folder's stream, and taken from there at most).
"""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "flat_tokens"
READ_BYTES = 4 << 20
RANGE_BYTES = 64 << 20
#: Tasks that short ranges are dealt to.
TASKS = 64
#: Files that a commit names, or removes, at a time.
RENAMES = 16

WINDOWS = "folder string, win bigint, ids array<int>"


def file_system(uri: str):
    """File system and path of a Spark path, usable inside tasks (local, hdfs, s3, gs)."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark gives it: a path without one lies on the cluster's default file system, not on a task's machine."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(hadoop).toString()


def little_endian(width: int) -> np.dtype:
    return np.dtype({2: "<u2", 4: "<u4", 8: "<u8"}[width])


@dataclass
class Written(WriterCommitMessage):
    """(hidden name, name) of the files of one task."""

    files: list[tuple[str, str]]


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, width: int, overwrite: bool):
        self.path, self.width, self.overwrite = path, width, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = file_system(self.path)
        dtype, files, stream, current = little_endian(self.width), [], None, None
        try:
            for batch in iterator:
                columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
                keys = list(zip(*(columns[c].to_pylist() for c in ("source", "shard", "block"))))
                lists = columns["ids"]
                values = lists.flatten().to_numpy(zero_copy_only=False).astype(dtype)  # without those of null lists
                ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))])
                at = 0
                for key, rows in groupby(keys):
                    n = sum(1 for _ in rows)
                    if key != current:
                        if stream is not None:
                            stream.close()
                        source, shard, block = key
                        folder = f"{root}/{source}_p{shard}"
                        system.create_dir(folder, recursive=True)
                        name = f"{folder}/part-{int(block):012d}.ds"
                        files.append((f"{folder}/_{uuid4().hex}.tmp", name))
                        stream, current = system.open_output_stream(files[-1][0]), key
                    stream.write(values[ends[at] : ends[at + n]].tobytes())
                    at += n
            if stream is not None:
                stream.close()
        except BaseException:
            if stream is not None:
                stream.close()
            _each(system.delete_file, [hidden for hidden, _ in files])
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = file_system(self.path)
        files = [pair for m in messages if m is not None for pair in m.files]
        if self.overwrite:
            _each(system.delete_file, {f for f, _ in _listed(self.path)} - {name for _, name in files})
        _each(lambda pair: system.move(*pair), files)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = file_system(self.path)
        _each(system.delete_file, [hidden for m in messages if m is not None for hidden, _ in m.files])


def _each(act, items) -> None:
    with ThreadPoolExecutor(RENAMES) as pool:
        list(pool.map(act, items))


def _listed(path: str) -> list[tuple[str, int]]:
    """Token files below a path and their sizes, by name."""
    from pyarrow import fs

    system, root = file_system(path)
    found = system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.is_file and f.path.endswith(".ds") and f.size)


@dataclass
class Range:
    """Windows from ``first`` on of one folder: (file, place in it, bytes) one after the other."""

    folder: str
    first: int
    spans: list[tuple[str, int, int]]


def ranges(files: list[tuple[str, int]], record: int, width: int, range_bytes: int, skip: int, most: int | None) -> list[Range]:
    """Ranges of whole windows (``record`` bytes) over the streams of all folders."""
    span, out = max(1, range_bytes // record) * record, []
    for folder, group in groupby(files, lambda f: f[0].rsplit("/", 1)[0]):
        own = list(group)
        begin = skip * width
        total = max(0, sum(n for _, n in own) - begin)
        total = (total if most is None else min(total, most * width)) // record * record
        starts = np.cumsum([0, *(n for _, n in own)])
        for low in range(0, total, span):
            a, b = begin + low, begin + min(low + span, total)
            k = int(np.searchsorted(starts, a, "right")) - 1
            spans = []
            while k < len(own) and starts[k] < b:
                at, end = max(a, int(starts[k])), min(b, int(starts[k + 1]))
                spans.append((own[k][0], at - int(starts[k]), end - at))
                k += 1
            out.append(Range(folder, low // record, spans))
    return out


@dataclass
class Ranges(InputPartition):
    """What one task reads, range by range."""

    held: list[Range]


def by_task(found: list[Range]) -> list[Ranges]:
    """Ranges dealt to tasks: about ``TASKS`` of them, and more only where a task would get over ``RANGE_BYTES``."""
    sizes = [sum(n for _, _, n in r.spans) for r in found]
    most, out, left = min(RANGE_BYTES, -(-sum(sizes) // TASKS)), [], 0
    for r, n in zip(found, sizes):
        if left < n or not out:
            out.append(Ranges([]))
            left = max(most, n)
        out[-1].held.append(r)
        left -= n
    return out


class Reader(DataSourceReader):
    def __init__(self, path: str, width: int, length: int, range_bytes: int, skip: int, most: int | None):
        self.path, self.width, self.length, self.range_bytes, self.skip, self.most = path, width, length, range_bytes, skip, most

    def partitions(self) -> list[Ranges]:
        record = (self.length + 1) * self.width
        return by_task(ranges(_listed(self.path), record, self.width, self.range_bytes, self.skip, self.most)) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        for part in partition.held:
            yield from self._windows(part)

    def _windows(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = file_system(self.path)
        dtype, n = little_endian(self.width), self.length + 1
        held, win, record = b"", partition.first, (self.length + 1) * self.width
        for name, at, left in partition.spans:
            with system.open_input_file(name) as f:
                while left:
                    body = f.read_at(min(READ_BYTES, left), at)
                    if not body:
                        raise OSError(f"{name} is shorter than it was when the read was planned")
                    at, left, held = at + len(body), left - len(body), held + body
                    k = len(held) // record
                    if k:
                        ids = pa.array(np.frombuffer(held, dtype, k * n).astype(np.int32))
                        places = pa.array(np.arange(0, (k + 1) * n, n, dtype=np.int32))
                        columns = [pa.array([partition.folder] * k), pa.array(np.arange(win, win + k)), pa.ListArray.from_arrays(places, ids)]
                        yield pa.RecordBatch.from_arrays(columns, ["folder", "win", "ids"])
                        held, win = held[k * record :], win + k


class FlatTokens(DataSource):
    """The format; give paths as ``qualified`` returns them."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return WINDOWS

    def _option(self, name: str, default=None):
        value = self.options.get(name)
        return default if value is None else int(value)

    def reader(self, schema: T.StructType) -> Reader:
        length = self._option("length")
        if length is None or length < 1:
            raise ValueError("reading flat tokens needs the option length")
        return Reader(self.options["path"], self._option("width", 4), length, self._option("range_bytes", RANGE_BYTES), self._option("skip", 0), self._option("most"))

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        missing = {"source", "shard", "block", "ids"} - set(schema.names)
        if missing:
            raise ValueError(f"writing flat tokens needs the columns {sorted(missing)}")
        return Writer(self.options["path"], self._option("width", 4), overwrite)
