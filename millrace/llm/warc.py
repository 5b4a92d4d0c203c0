"""Operator 6: WARC archives with an index.

``write_archives`` writes one record per page, each its own gzip member, and the index first class beside it: path, offset,
length, URL, payload digest, page id and type of every record, as a stored table.  Of pages with equal payloads of at
least ``least`` bytes the smallest page_id is the response and the others are revisits that refer to it.  Only digests
that occur more than once are joined to the pages, from a stored table whose size Spark knows.

``read_records`` takes any selection of index rows, sorts them by path and offset, joins ranges that lie close
together into one read of bounded size, and parses the records; nothing between far apart records is read.

File names are unique to a task attempt and enter the index only when the attempt succeeds.  A null html is an empty
payload.  A null URL is left out of the record; blanks and control characters in URLs are percent-encoded.  Null page ids
are read back as null; of equal payloads they never are the response unless all are null, which leaves all of
them responses.  Repeated rows of the smallest page_id are all responses.  An empty table gives an empty index; other
columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote
from uuid import uuid4

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import fresh_folder, stored, tasks

LEAST = 100
FILE_BYTES = 256 << 20
MAX_GAP = 64 << 10
MAX_READ = 8 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "path string, offset bigint, length bigint, url string, digest string, page_id bigint, record_type string"
RECORDS = "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint"


def labelled(pages: DataFrame, least: int = LEAST, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, refers_to): pages with the digest of their payload and the page they repeat."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("html"),
    ).withColumn("digest", F.sha2("html", 256))
    sizes = rows.where(F.octet_length("html") >= least).groupBy("digest")
    firsts = sizes.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").drop("n")
    known = stored(firsts, "warc-repeats")
    repeats = ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(known, "digest", "left").select("page_id", "url", "html", "digest", F.when(repeats, F.col("first")).alias("refers_to"))


def name_of(page_id: int | None) -> bytes:
    return b"<urn:page:%s>" % (b"none" if page_id is None else b"%d" % page_id)


def id_of(name: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(found[1]) if found else None


def clean(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: quote(m[0]), url)


def record(page_id: int | None, url: str | None, html: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record as a gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + name_of(page_id), b"WARC-Date: " + DATE.encode()]
    if url is not None:
        head.append(b"WARC-Target-URI: " + url.encode())
    head.append(b"WARC-Payload-Digest: sha256:" + digest.encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: " + name_of(refers_to), b"WARC-Profile: " + PROFILE.encode()]
    block = http if refers_to is not None else http + html
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block), b"", b""]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + block + b"\r\n\r\n") + packer.flush()


def parsed(member: bytes) -> tuple:
    """A row of RECORDS; a revisit has no payload, its full size stands in the HTTP head."""
    body = zlib.decompress(member, 31)
    head, _, rest = body.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = fields[b"WARC-Type"].decode()
    size = int(re.search(rb"\nContent-Length: (\d+)", http)[1])
    if kind == "response" and len(payload) != size:
        raise ValueError("a record is cut short")
    url = fields.get(b"WARC-Target-URI")
    return (
        id_of(fields[b"WARC-Record-ID"]), url.decode() if url is not None else None, kind, payload if kind == "response" else None, size,
        fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode(), id_of(fields.get(b"WARC-Refers-To")),
    )


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, **columns) -> DataFrame:
    """Write the archives and return their index; ``columns`` go to ``labelled``."""
    spark = pages.sparkSession
    folder = folder or fresh_folder(spark, "warc")
    if "://" not in folder and not folder.startswith("file:"):
        folder = "file://" + os.path.abspath(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, at = None, None, 0
        names = ["path", "offset", "length", "url", "digest", "page_id", "record_type"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
        try:
            for batch in batches:
                rows = []
                for i in range(batch.num_rows):
                    page_id, url, html, digest, refers_to = (c[i].as_py() for c in batch.columns)
                    url = clean(url) if url is not None else None
                    member = record(page_id, url, html, digest, refers_to)
                    if out is not None and at + len(member) > file_bytes:
                        out.close()
                        out = None
                    if out is None:
                        path, at = f"{folder}/{uuid4().hex}.warc.gz", 0
                        system, name = fs.FileSystem.from_uri(path)
                        system.create_dir(name.rpartition("/")[0], recursive=True)
                        out = system.open_output_stream(name, compression=None)
                    out.write(member)
                    rows.append((path, at, len(member), url, digest, page_id, "response" if refers_to is None else "revisit"))
                    at += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        finally:
            if out is not None:
                out.close()

    return stored(labelled(pages, **columns).mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame, max_gap: int = MAX_GAP, max_read: int = MAX_READ) -> DataFrame:
    """The records of the selected index rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def spans() -> Iterator[tuple[str, int, int, list[tuple[int, int]]]]:
            path, first, end, held = None, 0, 0, []
            for batch in batches:
                for p, offset, length in zip(*(c.to_pylist() for c in batch.columns)):
                    if held and (p != path or offset > end + max_gap or offset + length > first + max_read):
                        yield path, first, end, held
                        held = []
                    if not held:
                        path, first = p, offset
                    end = max(end if held else 0, offset + length)
                    held.append((offset, length))
            if held:
                yield path, first, end, held

        opened, file = None, None
        for path, first, end, held in spans():
            if path != opened:
                if file is not None:
                    file.close()
                system, name = fs.FileSystem.from_uri(path)
                opened, file = path, system.open_input_file(name)
            body = memoryview(file.read_at(end - first, first))
            rows = [parsed(body[o - first : o - first + n]) for o, n in held]
            types = [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()]
            names = ["page_id", "url", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
        if file is not None:
            file.close()

    places = index.select("path", "offset", "length")
    near = places.repartition(tasks(index.sparkSession), "path", F.floor(F.col("offset") / F.lit(4 * max_read)))
    return near.sortWithinPartitions("path", "offset").mapInArrow(run, RECORDS)
