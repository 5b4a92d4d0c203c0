"""Token budgets, training windows, sample indexes and batch shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.arrays import PAD, counting, int_slice, packed, pad_to, restart_positions, unpacked
from millrace.operators.ordering import DEFAULT_BLOCK, running_offset

SHARD_KEYS = ("source", "shard")


def budget_tokens(
    tok: DataFrame, budgets: DataFrame, by: Sequence[str] = SHARD_KEYS, order: str = "doc_id",
    block: int | None = DEFAULT_BLOCK,
) -> DataFrame:
    """Take documents in order until the shard's token budget is full.

    ``tok`` has ``n_tokens`` and optionally ``dropped`` (too long; such rows use no budget).
    ``budgets`` has the keys and ``budget``.  Every kept row takes ``take`` tokens from ``start``
    on, its end-of-document token included; the last one is cut.  Rows after the fill are gone.
    """
    if "dropped" not in tok.columns:
        tok = tok.withColumn("dropped", F.lit(False))
    sized = tok.withColumn("_size", F.when(F.col("dropped"), 0).otherwise(F.col("n_tokens") + 1).cast("bigint"))
    placed = running_offset(sized, by, order, "_size", "start", block)
    return (
        placed.join(budgets.select(*by, "budget"), list(by))
        .where(F.col("start") < F.col("budget"))
        .withColumn("take", F.least(F.col("_size"), F.col("budget") - F.col("start")))
        .drop("_size")
    )


def cut_to_take(kept: DataFrame, ids_col: str = "ids", eos=None) -> DataFrame:
    """The kept tokens themselves: ids plus end-of-document token, cut to ``take``."""
    ids = F.col(ids_col) if eos is None else F.concat(F.col(ids_col), F.array(F.lit(eos)))
    return kept.where(~F.col("dropped")).withColumn(ids_col, int_slice(ids, 0, F.col("take")))


def assemble_windows(
    stream: DataFrame, stride: int, width: int, by: Sequence[str] = SHARD_KEYS, ids_col: str = "ids",
    start_col: str = "start",
) -> DataFrame:
    """Windows of ``width`` tokens every ``stride`` tokens over a stream of placed documents.

    A document is repeated once per window it touches and cut in the same generated code, so a shuffled
    row carries at most ``width`` tokens and cutting costs as much as the tokens taken (a slice inside
    an array lambda would copy the whole document for every window).  A group holds one window.
    """
    ids, start, win = F.col(ids_col), F.col(start_col), F.col("win")
    n = F.size(ids)
    first = F.greatest(F.floor((start - F.lit(width)) / F.lit(stride)) + 1, F.lit(0)).cast("bigint")
    last = F.greatest(first, F.floor((start + n - 1) / F.lit(stride)).cast("bigint"))
    touched = stream.select(*by, ids, start, F.explode(F.when(n > 0, F.sequence(first, last))).alias("win"))
    begin = win * stride
    part = int_slice(ids, F.greatest(begin - start, F.lit(0)), F.least(F.lit(width), width + begin - start))
    parts = touched.select(*by, "win", F.greatest(start - begin, F.lit(0)).cast("int").alias("at"), part.alias("part"))
    texts = isinstance(stream.schema[ids_col].dataType.elementType, T.StringType)
    if texts:
        parts = parts.withColumn("part", packed(F.col("part")))
    return (
        parts.repartition(*by, "win")
        .groupBy(*by, "win")
        .agg(F.sort_array(F.collect_list(F.struct("at", "part"))).alias("parts"))
        .select(*by, "win", F.flatten(F.transform("parts.part", unpacked) if texts else F.col("parts.part")).alias("ids"))
    )


def pack_windows(stream: DataFrame, L: int, by: Sequence[str] = SHARD_KEYS, ids_col: str = "ids") -> DataFrame:
    """Non-overlapping windows of ``L + 1`` tokens; the remainder of each stream is dropped."""
    return assemble_windows(stream, L + 1, L + 1, by, ids_col).where(F.size("ids") == L + 1)


def pack_summary(kept: DataFrame, L: int, by: Sequence[str] = SHARD_KEYS) -> DataFrame:
    """Tokens, documents, windows and remainder per stream, from lengths alone."""
    return kept.groupBy(*by).agg(
        F.sum("take").cast("bigint").alias("tokens"),
        F.count_if(~F.col("dropped")).alias("docs"),
        F.count_if(F.col("dropped")).alias("dropped_too_long"),
    ).withColumn("windows", F.floor(F.col("tokens") / (L + 1)).cast("bigint")).withColumn(
        "remainder", F.pmod(F.col("tokens"), F.lit(L + 1))
    )


# Overlapping samples --------------------------------------------------------------------------


def sample_index(doc_order: DataFrame, L: int, drop_last: bool = True, extra: int = 1,
                 block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """(sample, doc place, offset) where every sample of ``L`` (+ ``extra``) tokens starts.

    ``doc_order`` has ``pos`` (place in the epoch order) and ``size``.  Sample ``i`` starts at
    stream token ``i * L``.  A document emits the starts that fall on it, so neither a join nor
    a loop over samples is needed.  With ``extra = 0`` a start on a document edge belongs to the
    document before it (offset = its size).
    """
    placed = running_offset(doc_order.withColumn("_g", F.lit(0)), ["_g"], "pos", "size", "_start", block)
    end = F.col("_start") + F.col("size")
    if extra:
        low = F.ceil(F.col("_start") / F.lit(L))
        high = F.ceil(end / F.lit(L)) - 1
    else:
        low = F.when(F.col("_start") == 0, F.lit(0)).otherwise(F.floor(F.col("_start") / F.lit(L)) + 1)
        high = F.floor(end / F.lit(L))
    starts = (
        placed.where(F.col("size") > 0)
        .withColumn("_low", low.cast("bigint"))
        .withColumn("_high", high.cast("bigint"))
        .where(F.col("_low") <= F.col("_high"))
        .select("pos", F.col("_start"), F.explode(F.sequence("_low", "_high")).alias("sample"))
        .select("sample", "pos", (F.col("sample") * L - F.col("_start")).cast("bigint").alias("offset"))
    )
    if drop_last:
        return starts
    # The open end: one more boundary inside the last document when the stream is not a multiple.
    total = doc_order.agg(F.sum("size").cast("bigint").alias("t"), F.max(F.struct("pos", "size")).alias("last"))
    tail = total.where(F.pmod(F.col("t") - extra, F.lit(L)) != 0).select(
        F.ceil((F.col("t") - extra) / F.lit(L)).cast("bigint").alias("sample"),
        F.col("last.pos").alias("pos"),
        (F.col("last.size") - extra).cast("bigint").alias("offset"),
    )
    return starts.unionByName(tail)


def sample_text(placed: DataFrame, L: int, by: Sequence[str] = (), extra: int = 1, drop_last: bool = True,
                ids_col: str = "ids", start_col: str = "start") -> DataFrame:
    """Tokens of every sample across documents: ``L`` apart, ``L + extra`` wide.

    Without ``drop_last`` the last, shorter sample stays (see ``pad_sample``).
    """
    one = placed if by else placed.withColumn("_g", F.lit(0))
    keys = list(by) or ["_g"]
    out = assemble_windows(one, L, L + extra, keys, ids_col, start_col).withColumnRenamed("win", "sample")
    out = out.where(F.size("ids") == L + extra) if drop_last else out.where(F.size("ids") > extra)
    return out if by else out.drop("_g")


def pad_sample(df: DataFrame, width: int, pad=PAD, ids_col: str = "ids") -> DataFrame:
    return df.withColumn(ids_col, pad_to(F.col(ids_col), width, F.lit(pad)))


def chunk_batch(
    tok: DataFrame, L: int, batch_col: str = "batch", order: str = "pos", drop_last: bool = False,
    ids_col: str = "ids", block: int | None = None,
) -> DataFrame:
    """Concatenate the rows of a batch and cut chunks of ``L + 1`` with one token of overlap.

    ``drop_last`` keeps the historical count, which is one chunk short per batch.
    A batch has a fixed number of rows, so its running offset is a local window.
    """
    sized = tok.withColumn("_size", F.size(ids_col).cast("bigint"))
    texts = isinstance(tok.schema[ids_col].dataType.elementType, T.StringType)
    placed = running_offset(sized.withColumn(ids_col, packed(F.col(ids_col))) if texts else sized, [batch_col], order, "_size", "start", block)
    if texts:
        placed = placed.withColumn(ids_col, unpacked(F.col(ids_col)))
    chunks = sample_text(placed, L, [batch_col], 1, True, ids_col).withColumnRenamed("sample", "chunk")
    if not drop_last:
        return chunks
    totals = sized.groupBy(batch_col).agg(F.sum("_size").alias("_n"))
    return (
        chunks.join(totals, batch_col)
        .where(F.col("chunk") < F.floor((F.col("_n") - 1) / F.lit(L)) - 1)
        .drop("_n")
    )


# Shapes of one sample -------------------------------------------------------------------------


def positions_from_eos(win: DataFrame, eos, ids_col: str = "ids", out: str = "positions") -> DataFrame:
    """Positions that restart after each end-of-document token; plain 0..n-1 when ``eos`` is None."""
    col = counting(F.size(ids_col)) if eos is None else restart_positions(F.col(ids_col), eos)
    return win.withColumn(out, col)


def shift_labels(win: DataFrame, L: int, doc_masking: bool = True, ids_col: str = "ids",
                 positions_col: str = "positions") -> DataFrame:
    """Inputs, labels one ahead, positions and the loss mask of a window of ``L + 1`` tokens.

    The mask is false where the label starts a document.  Any other width fails the job.
    """
    width = F.size(ids_col)
    ids = F.when(width == L + 1, F.col(ids_col)).otherwise(
        F.raise_error(F.concat(F.lit(f"expected {L + 1} tokens, got "), width.cast("string")))
    )
    pos = F.col(positions_col) if doc_masking else counting(width)
    mask = (
        F.transform(int_slice(pos, 1, L), lambda p: p != 0) if doc_masking else F.array_repeat(F.lit(True), L)
    )
    return (
        win.withColumn("_ids", ids)
        .withColumn("input_ids", int_slice(F.col("_ids"), 0, L))
        .withColumn("label_ids", int_slice(F.col("_ids"), 1, L))
        .withColumn("position_ids", int_slice(pos, 0, L))
        .withColumn("label_mask", mask)
        .drop("_ids")
    )


def context_slices(samples: DataFrame, parts: int, L: int, global_positions: bool = True,
                   columns: Sequence[str] = ("input_ids", "label_ids", "label_mask"),
                   positions_col: str = "position_ids") -> DataFrame:
    """Split every sample into ``parts`` equal stretches; positions can stay whole."""
    if L % parts:
        raise ValueError(f"{parts} parts do not divide a length of {L}")
    step = L // parts
    out = samples.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    cut = list(columns) + ([] if global_positions else [positions_col])
    for c in cut:
        out = out.withColumn(c, int_slice(F.col(c), F.col("part") * step, step))
    return out


def leftpad_positions(df: DataFrame, pad, ids_col: str = "ids", out: str = "positions") -> DataFrame:
    """0 up to and including the last pad token, then 0, 1, 2, ..."""
    marks = F.filter(F.transform(ids_col, lambda x, i: F.when(x == F.lit(pad), i + 1)), lambda m: m.isNotNull())
    lead = F.coalesce(F.array_max(marks), F.lit(0))
    return df.withColumn(out, F.concat(F.array_repeat(F.lit(0), lead), counting(F.size(ids_col) - lead)))


def micro_batches(df: DataFrame, size: int, ranks: int, pos: str = "pos") -> DataFrame:
    """Chunks of at most ``size`` rows; chunk ``i`` goes to rank ``i mod ranks``."""
    chunk = F.floor(F.col(pos) / F.lit(size)).cast("bigint")
    return df.withColumn("chunk", chunk).withColumn("rank", F.pmod("chunk", F.lit(ranks)).cast("bigint"))
