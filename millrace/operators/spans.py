"""Sentence tables and spans of sentences."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.arrays import int_slice
from millrace.functions.seeded import seeded_number
from millrace.operators.ordering import hash_order, running_offset

LONG_SENTENCE = 512  # fixed value: documents with a longer sentence give no spans
SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"


def sentences(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(SENTENCE_PATTERN), F.lit(0))


def sentences_table(docs: DataFrame, splitter: Callable[[Column], Column] = sentences,
                    tokenizer: Callable[[Column], Column] = X.pieces) -> DataFrame:
    """Items of a corpus: (doc_id, sent_ord, size, ids).  Document boundaries are the doc_id."""
    rows = docs.select("doc_id", F.posexplode(splitter(F.col("text"))).alias("_at", "_s"))
    coded = rows.select("doc_id", F.col("_at").alias("_at"), tokenizer(F.col("_s")).alias("ids")).where(
        F.size("ids") > 0
    )
    return coded.select("doc_id", F.col("_at").alias("sent_ord"), F.size("ids").alias("size"), "ids")


def document_bounds(sent: DataFrame) -> DataFrame:
    """Items and tokens per document."""
    return sent.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("items"), F.sum("size").cast("bigint").alias("tokens")
    )


def merge_tables(a: DataFrame, b: DataFrame) -> DataFrame:
    """Append corpus ``b`` behind corpus ``a``: its document ids continue after the last of ``a``."""
    last = a.agg((F.max("doc_id") + 1).alias("_shift"))
    shift = F.coalesce(F.lit(0) + last.scalar(), F.lit(0))
    return a.unionByName(b.withColumn("doc_id", F.col("doc_id") + shift))


def item_slice(tok: DataFrame, doc_id: int | tuple[int, int] | None = None, offset: int = 0, length: int | None = None,
               ids_col: str = "ids") -> DataFrame:
    """Part ``[offset, offset + length)`` of an item, of a contiguous range of items, or of all."""
    if isinstance(doc_id, tuple):
        tok = tok.where((F.col("doc_id") >= doc_id[0]) & (F.col("doc_id") < doc_id[1]))
    elif doc_id is not None:
        tok = tok.where(F.col("doc_id") == doc_id)
    size = F.size(ids_col) if length is None else F.lit(length)
    return tok.withColumn(ids_col, int_slice(F.col(ids_col), offset, size))


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "end", "target")]))
ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "end", "target")]))


def cut_spans(sizes: list[int], closes: Callable[[int, int, int], bool], target: Callable[[int], int]) -> list[tuple[int, int, int]]:
    """Spans (start, end, target) of a document's sentences: a span of ``target(its number)`` tokens or more closes if
    ``closes(sentences, left)`` allows, and at the document's end."""
    out, start, length, aim, n = [], 0, 0, target(0), len(sizes)
    for done, size in enumerate(sizes, 1):
        length += size
        if done == n or (length >= aim and closes(done - start, n - done)):
            out.append((start, done, aim))
            start, length, aim = done, 0, target(len(out))
    return out


def sentence_sizes(docs: DataFrame, splitter: Callable[[Column], Column] = sentences,
                   tokenizer: Callable[[Column], Column] = X.pieces) -> DataFrame:
    """(doc_id, sizes): tokens of every sentence of a document in order, without a shuffle; empty sentences have no place."""
    sizes = F.transform(splitter(F.col("text")), lambda s: F.size(tokenizer(s)))
    return docs.select("doc_id", F.filter(sizes, lambda n: n > 0).alias("sizes")).where(F.size("sizes") > 0)


def _sizes_by_document(sent: DataFrame) -> DataFrame:
    """One row per document with its sentence sizes in order, from a table that has them or from one of sentences."""
    if "sizes" in sent.columns:
        return sent
    return sent.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.struct("sent_ord", "size"))).getField("size").alias("sizes")
    )


def _with_spans(docs: DataFrame, epochs: int, least: int, closes: Callable[[int, int], bool], target: Callable[[int, dict], Callable[[int], int]]) -> DataFrame:
    """(epoch, doc_id, spans) of documents with ``least`` sentences or more and none too long; numbers only go through Python."""
    schema = T.StructType([T.StructField("epoch", T.IntegerType(), False), docs.schema["doc_id"], T.StructField("spans", SPANS)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            rows, epoch, found = [], [], []
            for k, row in enumerate(batch.to_pylist()):
                sizes = row["sizes"]
                if len(sizes) < least or max(sizes, default=0) > LONG_SENTENCE:
                    continue
                for e in range(epochs):
                    rows.append(k)
                    epoch.append(e)
                    found.append([dict(zip(("start", "end", "target"), s)) for s in cut_spans(sizes, closes, target(e, row))])
            ids = batch.column(batch.schema.get_field_index("doc_id")).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(epoch, pa.int32()), ids, pa.array(found, ARROW_SPANS)], ["epoch", "doc_id", "spans"])

    return docs.mapInArrow(run, schema)


def _until_enough(spans: DataFrame, max_samples: int | None) -> DataFrame:
    """Whole epochs until ``max_samples`` are reached."""
    if max_samples is None:
        return spans
    per_epoch = spans.groupBy("epoch").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    wanted = per_epoch.withColumn("_before", F.sum("_n").over(w) - F.col("_n")).where(F.col("_before") < max_samples)
    return spans.join(wanted.select("epoch"), "epoch", "left_semi")


def sentence_spans(sent: DataFrame, max_len: int, min_sent: int = 2, short_prob: float = 0.0, epochs: int = 1,
                   seed: int = 1, max_samples: int | None = None) -> DataFrame:
    """Shuffled spans (epoch, doc_id, start, end, target) of consecutive sentences.

    A span closes at its target length when it has ``min_sent`` sentences and more than one is left,
    and at the document's end.  One target in ``1 / short_prob`` is shortened at random.
    """
    ratio = round(1 / short_prob) if short_prob > 0 else 0

    def target(epoch: int, row: dict) -> Callable[[int], int]:
        def of(k: int) -> int:
            draw = seeded_number(seed, epoch, row["doc_id"], k) if ratio else 1
            return 2 + draw % (max_len - 1) if ratio and draw % ratio == 0 else max_len

        return of

    docs = _sizes_by_document(sent).where(F.col("doc_id").isNotNull())
    cut = _with_spans(docs, epochs, min_sent, lambda held, left: left > 1 and held >= min_sent, target)
    spans = cut.select("epoch", "doc_id", F.explode("spans").alias("s"))
    return hash_order(
        _until_enough(spans.select("epoch", "doc_id", "s.start", "s.end", "s.target"), max_samples),
        seed, ["epoch", "doc_id", "start"],
    )


def block_spans(sent: DataFrame, titles: DataFrame, max_len: int, one_sent: bool = False, epochs: int = 1,
                seed: int = 1, max_samples: int | None = None) -> DataFrame:
    """Shuffled blocks (epoch, doc_id, start, end, block_id) with room for the document's title.

    ``titles`` has (doc_id, title_size).  ``block_id`` numbers the blocks of an epoch in document order.
    """
    least = 1 if one_sent else 2
    docs = _sizes_by_document(sent).join(titles.select("doc_id", "title_size"), "doc_id")
    cut = _with_spans(docs, epochs, least, lambda held, left: left >= least, lambda epoch, row: lambda k: max_len - row["title_size"])
    cut = cut.withColumn("_n", F.size("spans").cast("bigint"))
    placed = running_offset(cut, ["epoch"], "doc_id", "_n", "_first")
    spans = placed.select("epoch", "doc_id", "_first", F.posexplode("spans").alias("_k", "s")).select(
        "epoch", "doc_id", "s.start", "s.end", (F.col("_first") + F.col("_k")).alias("block_id")
    )
    return hash_order(_until_enough(spans, max_samples), seed, ["epoch", "doc_id", "start"])
