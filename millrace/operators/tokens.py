"""Tokenizing, vocabularies and the length gate."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.arrays import packed, unpacked

#: A vocabulary within both bounds is broadcast, a larger one joined.
BROADCAST_VOCAB_ROWS, BROADCAST_VOCAB_BYTES = 1_000_000, 64 << 20
UNKNOWN_ID = 1
EOS_ID = 0
FIRST_ID = 2
EOS_PIECE = "<eos>"
#: Values of a list column, and bytes of its pieces, that one Arrow pass works on; only a single longer row makes a larger pass.
PASS_VALUES = 1 << 19

#: With byte fallback the 256 bytes come before the pieces; an id behind the last byte of a piece keeps it apart from the next.
BYTE_ID = FIRST_ID
BYTES_END_ID = BYTE_ID + 256
FIRST_PIECE_ID = BYTES_END_ID + 1


def drop_short_text(df: DataFrame, min_chars: int = X.MIN_CHARS, text_col: str = "text") -> DataFrame:
    """Keep texts of at least ``min_chars`` characters; runs before tokenizing."""
    return df.where(F.length(text_col) >= min_chars)


def render_chat(
    df: DataFrame, messages_col: str = "messages", template: X.ChatTemplate = X.ChatTemplate(),
    add_prompt: bool = False, out: str = "text",
) -> DataFrame:
    return df.withColumn(out, X.chat_text(F.col(messages_col), template, add_prompt))


def normalize_roles(df: DataFrame, role_map: dict[str, str] = X.ROLE_MAP, messages_col: str = "messages") -> DataFrame:
    """Map the role of every message; unknown roles fail the job."""
    return df.withColumn(
        messages_col,
        F.transform(
            messages_col,
            lambda m: F.struct(X.mapped_role(m["role"], role_map).alias("role"), m["content"].alias("content")),
        ),
    )


def tokenize(
    df: DataFrame, text_col: str = "text", tokenizer: Callable[[Column], Column] | None = None,
    out: str = "ids", eos=None,
) -> DataFrame:
    """Add the token array and ``n_tokens`` (without the end-of-document token).

    The default is the JVM-side piece pattern; ``tokenizer`` is any column function, for instance
    a ``pandas_udf(text) -> array<int>`` (mark it ``asNondeterministic()`` so that a filter on its
    result does not evaluate it twice).
    """
    ids = (tokenizer or X.pieces)(F.col(text_col))
    df = df.withColumn(out, ids).withColumn("n_tokens", F.size(out).cast("bigint"))
    return df if eos is None else df.withColumn(out, F.concat(F.col(out), F.array(F.lit(eos))))


def piece_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.select(F.explode(X.pieces(F.col(text_col))).alias("token")).groupBy("token").agg(
        F.count(F.lit(1)).alias("n")
    )


def build_vocab(df: DataFrame, size: int, text_col: str = "text", first_id: int = FIRST_ID) -> DataFrame:
    """Id table of the ``size`` most frequent pieces, ties by the piece itself.

    Counting combines map-side; the top-k keeps ``size`` rows per task.  Only the ``size`` winners
    are numbered in one place.
    """
    top = piece_counts(df, text_col).orderBy(F.col("n").desc(), F.col("token")).limit(size)
    rank = F.row_number().over(Window.orderBy(F.col("n").desc(), F.col("token")))
    return top.select("token", (rank + F.lit(first_id - 1)).cast("int").alias("id"), "n")


def vocab_fits(vocab: DataFrame, model_vocab_size: int) -> DataFrame:
    """Rows that break the rule "no token id reaches the model's vocabulary size"."""
    return vocab.where(F.col("id") >= model_vocab_size)


def id_width(vocab_size: int) -> int:
    """Bytes per stored id: 2 while every id fits 16 bits, else 4."""
    return 2 if vocab_size < 65535 else 4


def _with_column(batch: pa.RecordBatch, drop: str, column: pa.Array, out: str) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in (drop, KNOWN)]
    return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), column], [*names, out])


#: Column of the vocabulary's rows that a row's values meet, where the vocabulary is joined.
KNOWN = "_known"

#: (tokens, ids) that the values of a batch are looked up in.
Lookup = Callable[[pa.RecordBatch], tuple[pa.Array, pa.Array]]


def _whole(vocab: Broadcast) -> Lookup:
    return lambda batch: vocab.value


def _met(batch: pa.RecordBatch) -> tuple[pa.Array, pa.Array]:
    """What a row meets holds for all rows of its batch."""
    tokens, ids = batch.column(batch.schema.get_field_index(KNOWN)).flatten().flatten()
    return tokens, ids


def _passes(batches: Iterable[pa.RecordBatch], col: str, most: int = PASS_VALUES) -> Iterable[pa.RecordBatch]:
    """The batches cut so that the values of a list column, and their bytes, stay near ``most``."""
    for batch in batches:
        lists = batch.column(batch.schema.get_field_index(col))
        at = lists.offsets.to_numpy().astype(np.int64)
        values = lists.values
        if pa.types.is_string(values.type) and len(values):
            at = at + np.frombuffer(values.buffers()[1], np.int32)[values.offset :][at]
        first = 0
        while first < batch.num_rows:
            last = int(np.searchsorted(at, at[first] + most, "right")) - 1
            last = min(max(last, first + 1), batch.num_rows)
            yield batch.slice(first, last - first)
            first = last
    # A worker lives on after its task; what Arrow keeps for later would add to the next stage's needs.
    pa.default_memory_pool().release_unused()


def _lookup_encoder(lookup: Lookup, pieces_col: str, out: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _passes(batches, pieces_col):
            tokens, ids = lookup(batch)
            offsets, values = _list_parts(batch.column(batch.schema.get_field_index(pieces_col)))
            found = pc.take(ids, pc.index_in(values, value_set=tokens))
            coded = pa.ListArray.from_arrays(offsets, pc.fill_null(found, pa.scalar(UNKNOWN_ID, pa.int32())))
            yield _with_column(batch, pieces_col, coded, out)

    return encode


def _bytes_encoder(lookup: Lookup, pieces_col: str, out: str):
    """Ids of pieces in the vocabulary; of the others their bytes and the id that ends them."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _passes(batches, pieces_col):
            tokens, ids = lookup(batch)
            offsets, values = _list_parts(batch.column(batch.schema.get_field_index(pieces_col)))
            found = pc.fill_null(pc.take(ids, pc.index_in(values, value_set=tokens)), -1).to_numpy(zero_copy_only=False)
            unknown = np.flatnonzero(found < 0)
            body = pc.fill_null(values.take(pa.array(unknown)), "").cast(pa.large_binary())
            sizes = pc.binary_length(body).to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.ones(len(found), np.int64)
            counts[unknown] = sizes + 1
            upto = np.concatenate([[0], np.cumsum(counts)])
            flat = np.full(upto[-1], BYTES_END_ID, np.int32)
            flat[upto[:-1][found >= 0]] = found[found >= 0]
            before = np.cumsum(sizes) - sizes
            places = np.repeat(upto[:-1][unknown] - before, sizes) + np.arange(sizes.sum())
            flat[places] = _body(body).astype(np.int32) + BYTE_ID
            coded = pa.ListArray.from_arrays(pa.array(upto[offsets.to_numpy()].astype(np.int32)), pa.array(flat))
            yield _with_column(batch, pieces_col, coded, out)

    return encode


def _body(column: pa.Array) -> np.ndarray:
    """All bytes of a large_binary column without nulls, one value after the other."""
    if not len(column):
        return np.zeros(0, np.uint8)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)


def encode_ids(
    df: DataFrame, vocab: DataFrame, pieces_col: str = "ids", out: str | None = None,
    max_broadcast: int = BROADCAST_VOCAB_ROWS, byte_fallback: bool = False,
) -> DataFrame:
    """Replace the array of pieces by an array of ids; unseen pieces get the unknown id.

    With ``byte_fallback`` an unseen piece becomes its UTF-8 bytes, as ids from ``BYTE_ID`` on, and ``BYTES_END_ID``: nothing is
    lost, and ``pieces_of`` gives every piece back.  The vocabulary's ids then start at ``FIRST_PIECE_ID``.

    A vocabulary of at most ``max_broadcast`` rows and ``BROADCAST_VOCAB_BYTES`` (measured first) is broadcast, a larger one
    joined to the distinct pieces of every row.  Both are looked up in Arrow, a bounded number of pieces at a time, and
    give the same rows.
    """
    out = out or pieces_col
    small = _small_vocab(vocab, max_broadcast)
    if small is None:
        return encode_ids_by_join(df, vocab, pieces_col, out, byte_fallback=byte_fallback)
    return _encoded(df, _whole(small), pieces_col, out, byte_fallback)


def _encoded(df: DataFrame, lookup: Lookup, pieces_col: str, out: str, byte_fallback: bool) -> DataFrame:
    schema = [f for f in df.schema.fields if f.name not in (pieces_col, KNOWN)]
    encoder = _bytes_encoder if byte_fallback else _lookup_encoder
    return df.mapInArrow(encoder(lookup, pieces_col, out), T.StructType([*schema, T.StructField(out, T.ArrayType(T.IntegerType()))]))


def _salted(vocab: DataFrame, salts: int) -> DataFrame:
    """Every vocabulary row once per salt."""
    return vocab.select("token", "id").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))


def _row_key(df: DataFrame) -> Column:
    """128 bits of all columns: rows that share it are equal, whatever their ids are."""
    return F.struct(F.xxhash64(*df.columns), F.xxhash64(*df.columns, F.lit(1)))


def _with_met(df: DataFrame, vocab: DataFrame, values: Column, key: str, salts: int | None = None) -> DataFrame:
    """Every row with ``KNOWN``: the rows (token, id) of the vocabulary whose ``key`` is among the row's distinct ``values``.

    A frequent value is in most rows, so the join is salted with the row's hash, by as many salts as there are shuffle partitions.
    Rows that share a hash share what they meet, which is right for either, as the vocabulary is the same for all.
    """
    salts = salts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn("_row", F.xxhash64(*df.columns))
    met = keyed.select("_row", F.explode(F.array_distinct(values)).alias(key)).withColumn("_salt", F.pmod("_row", F.lit(salts)).cast("int"))
    known = met.join(_salted(vocab, salts), [key, "_salt"]).groupBy("_row").agg(
        F.collect_set(F.struct("token", F.col("id").cast("int").alias("id"))).alias(KNOWN))
    lists = [f.name for f in df.schema.fields if f.dataType in (T.ArrayType(T.StringType()), T.ArrayType(T.StringType(), False))]
    rows = keyed.withColumns({c: packed(F.col(c)) for c in lists}).join(known, "_row", "left").drop("_row")
    return rows.withColumns({c: unpacked(F.col(c)) for c in lists})


def encode_ids_by_join(df: DataFrame, vocab: DataFrame, pieces_col: str, out: str, salts: int | None = None,
                       byte_fallback: bool = False) -> DataFrame:
    """Vocabulary of any size: a shuffle join on the distinct pieces of every row; pieces outside it are not shuffled again."""
    return _encoded(_with_met(df, vocab, F.col(pieces_col), "token", salts), _met, pieces_col, out, byte_fallback)


def _small_vocab(vocab: DataFrame, max_rows: int, max_bytes: int = BROADCAST_VOCAB_BYTES) -> Broadcast | None:
    """(tokens, ids) of a vocabulary within the bounds, broadcast; else None."""
    rows = vocab.select("token", "id")
    n, size = rows.limit(max_rows + 1).agg(F.count(F.lit(1)), F.sum(F.octet_length("token"))).first()
    if n > max_rows or (size or 0) > max_bytes:
        return None
    table = rows.toArrow().combine_chunks()
    columns = [table.column("token").cast(pa.string()), table.column("id").cast(pa.int32())]
    return vocab.sparkSession.sparkContext.broadcast(tuple(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns))


def _list_parts(col: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Offsets from zero and the values of a list column."""
    return pc.subtract(col.offsets, col.offsets[0]), col.flatten()


def _text_decoder(vocab: Broadcast, ids_col: str, keep: list[str]):
    def decode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        tokens, ids = vocab.value
        for batch in _passes(batches, ids_col):
            offsets, flat = _list_parts(batch.column(batch.schema.get_field_index(ids_col)))
            found = pc.take(tokens, pc.index_in(flat.cast(pa.int32()), value_set=ids))
            # Special ids have no text: cut them out and move the offsets accordingly.
            known = pc.is_valid(found).to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(known)])
            moved = pa.array(before[offsets.to_numpy()].astype(np.int32))
            joined = pc.binary_join(pa.ListArray.from_arrays(moved, found.drop_null()), " ")
            kept = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays([*kept, joined], [*keep, "text"])

    return decode


def ids_to_tokens(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", key: str = "doc_id",
                  max_broadcast: int = BROADCAST_VOCAB_ROWS) -> DataFrame:
    """Ids back to one text per row, pieces joined by a blank; special ids decode to nothing.

    Looked up batch-wise in Arrow while the vocabulary is within the bound, joined beyond it.
    """
    small = _small_vocab(vocab, max_broadcast)
    if small is not None:
        schema = T.StructType([df.schema[key], T.StructField("text", T.StringType())])
        return df.select(key, ids_col).mapInArrow(_text_decoder(small, ids_col, [key]), schema)
    return ids_to_tokens_by_join(df, vocab, ids_col, key)


def ids_to_tokens_by_join(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", key: str = "doc_id") -> DataFrame:
    """The same for a vocabulary of any size: one group per distinct row."""
    salts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(key, ids_col)
    keyed = rows.withColumn("_row", _row_key(rows))
    long = keyed.select("_row", F.posexplode(ids_col).alias("at", "id")).withColumn("_salt", F.pmod(F.col("at"), F.lit(salts)).cast("int"))
    texts = long.join(_salted(vocab, salts), ["id", "_salt"]).groupBy("_row").agg(
        F.sort_array(F.collect_set(F.struct("at", "token"))).alias("_p"))
    return keyed.drop(ids_col).join(texts, "_row", "left").select(key, F.coalesce(F.array_join(F.col("_p.token"), " "), F.lit("")).alias("text"))


def _is_byte(i: Column) -> Column:
    return (i >= BYTE_ID) & (i < BYTES_END_ID)


def _pieces_decoder(lookup: Lookup, ids_col: str, out: str):
    """Rows of ids back to rows of pieces: runs of bytes up to their end mark are one piece, special ids none."""

    def decode(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in _passes(batches, ids_col):
            tokens, ids = lookup(batch)
            offsets, flat = _list_parts(batch.column(batch.schema.get_field_index(ids_col)))
            number = flat.cast(pa.int32())
            values, at = number.to_numpy(zero_copy_only=False), offsets.to_numpy()
            byte = (values >= BYTE_ID) & (values < BYTES_END_ID)
            known = pc.take(tokens, pc.index_in(number, value_set=ids))
            # A piece ends at a known id, at an end mark, or where bytes are cut off by the row's end or an id that is no byte.
            ends = pc.is_valid(known).to_numpy(zero_copy_only=False) | (values == BYTES_END_ID)
            edge = np.ones(len(values) + 1, bool)
            edge[:-1] = ~byte & (values != BYTES_END_ID)
            edge[at] = True
            ends |= byte & edge[1:]
            upto = np.concatenate([[0], np.cumsum(byte)])
            place = np.flatnonzero(ends)
            spans = np.concatenate([[0], upto[place + 1]]) if len(place) else np.zeros(1, np.int64)
            body = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(place),
                [None, pa.py_buffer(np.ascontiguousarray(spans, np.int64)), pa.py_buffer((values[byte] - BYTE_ID).astype(np.uint8).tobytes())],
            )
            words = pc.coalesce(known.take(pa.array(place)), _utf8(body))
            before = np.concatenate([[0], np.cumsum(ends)])
            yield _with_column(batch, ids_col, pa.ListArray.from_arrays(pa.array(before[at].astype(np.int32)), words), out)

    return decode


def _utf8(body: pa.Array) -> pa.Array:
    """Bytes as text; those that are no UTF-8, cut off inside a letter, with marks in place of what is missing."""
    try:
        return body.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([x.decode("utf-8", "replace") for x in body.to_pylist()], pa.string())


def pieces_of(df: DataFrame, vocab: DataFrame, ids_col: str = "ids", out: str = "pieces", max_broadcast: int = BROADCAST_VOCAB_ROWS) -> DataFrame:
    """Ids made with ``byte_fallback`` back to the array of pieces; special ids stand for none.

    Looked up in Arrow while the vocabulary is within its bounds, joined beyond them.
    """
    small = _small_vocab(vocab, max_broadcast)
    if small is None:
        return pieces_of_by_join(df, vocab, ids_col, out)
    return _decoded(df, _whole(small), ids_col, out)


def _decoded(df: DataFrame, lookup: Lookup, ids_col: str, out: str) -> DataFrame:
    schema = [f for f in df.schema.fields if f.name not in (ids_col, KNOWN)]
    return df.mapInArrow(_pieces_decoder(lookup, ids_col, out), T.StructType([*schema, T.StructField(out, T.ArrayType(T.StringType()))]))


def pieces_of_by_join(df: DataFrame, vocab: DataFrame, ids_col: str, out: str) -> DataFrame:
    """The same for a vocabulary of any size: the distinct ids of every row that are no bytes are joined, bytes stay in their row."""
    known = F.filter(ids_col, lambda i: ~_is_byte(i) & (i != BYTES_END_ID))
    return _decoded(_with_met(df, vocab, known, "id"), _met, ids_col, out)


def flag_long(tok: DataFrame, max_doc_tokens: int | Column, is_chat: Column) -> DataFrame:
    """Mark chat documents whose length reaches the gate (0 switches it off); text is never gated."""
    gate = F.lit(max_doc_tokens) if isinstance(max_doc_tokens, int) else max_doc_tokens
    return tok.withColumn("dropped", is_chat & (gate > 0) & (F.col("n_tokens") >= gate))


def gate_long(tok: DataFrame, max_doc_tokens: int | Column, is_chat: Column) -> DataFrame:
    return flag_long(tok, max_doc_tokens, is_chat).where(~F.col("dropped")).drop("dropped")


def preview_text(samples: DataFrame, vocab: DataFrame, every: int, batch_col: str = "batch", chars: int = 400,
                 key: str = "sample", ids_col: str = "ids") -> DataFrame:
    """Start of the decoded text of the samples in every k-th batch."""
    picked = samples.where(F.pmod(F.col(batch_col), F.lit(every)) == 0)
    return ids_to_tokens(picked, vocab, ids_col, key).select(key, F.left("text", F.lit(chars)).alias("preview"))
