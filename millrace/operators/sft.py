"""Supervised fine-tuning samples."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.arrays import PAD, counting, pad_to


def chat_pairs(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, prompt, completion): each user turn with the assistant turn right after it.

    A join on (conversation, turn) instead of a window: no conversation is gathered in one task.
    """
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("prompt"))
    given = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("completion")
    )
    return asked.join(given, ["conv_id", "turn"])


def sft_encode(
    df: DataFrame, L: int, tokenizer: Callable[[Column], Column] | None = None, eos="<eos>", pad="<pad>",
    batch_col: str | None = None,
) -> DataFrame:
    """Prompt + completion + end token, cut to ``L + 1`` and padded on the right.

    The mask is true on completion tokens only; positions count up and are -1 on padding.  Rows are
    padded to ``L + 1``, or to the longest row of their batch when ``batch_col`` is given.
    """
    tok = tokenizer or X.pieces
    ids = F.slice(F.concat(tok(F.concat("prompt", "completion")), F.array(F.lit(eos))), 1, L + 1)
    out = df.withColumn("input_ids", ids).withColumn("_n", F.size("input_ids"))
    if batch_col:
        width = F.max("_n").over(Window.partitionBy(batch_col))
    else:
        width = F.lit(L + 1)
    out = out.withColumn("_width", width).withColumn(
        "_prompt", F.least(F.size(tok(F.col("prompt"))), F.col("_width"))
    )
    mask = F.transform(counting(F.col("_width")), lambda i: (i >= F.col("_prompt")) & (i < F.col("_n")))
    return (
        out.withColumn("position_ids", pad_to(counting(F.col("_n")), F.col("_width"), F.lit(PAD)))
        .withColumn("label_mask", mask)
        .withColumn("input_ids", pad_to(F.col("input_ids"), F.col("_width"), F.lit(pad)))
        .withColumn("label_ids", F.col("input_ids"))
        .drop("_n", "_width", "_prompt")
    )


def sft_keep(df: DataFrame) -> DataFrame:
    """Rows with any real token and any token that counts for the loss."""
    return df.where(F.exists("position_ids", lambda p: p >= 0) & F.exists("label_mask", lambda m: m))


def sft_report(df: DataFrame) -> DataFrame:
    """Rows, rows whose prompt fills the sequence, and the share filtered out."""
    no_label = ~F.exists("label_mask", lambda m: m)
    empty = ~F.exists("position_ids", lambda p: p >= 0)
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(no_label).alias("prompt_too_long"),
        F.count_if(no_label | empty).alias("filtered"),
    ).withColumn("filtered_share", F.col("filtered") / F.nullif(F.col("rows"), F.lit(0)))


def debug_limit(df: DataFrame, k: int, order: str = "doc_id") -> DataFrame:
    """The first ``min(k, n)`` rows."""
    return df.orderBy(order).limit(k)
