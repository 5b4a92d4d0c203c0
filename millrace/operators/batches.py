"""Which rank gets which sample at which step: arithmetic on the sample index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.arrays import PAD
from millrace.operators.ordering import hash_order


def rank_split(df: DataFrame, ranks: int, total: int, drop_last: bool = True, loop_to: int | None = None,
               pos: str = "pos") -> DataFrame:
    """Row ``i`` to rank ``i mod ranks``, all ranks equally long.

    The tail is dropped, or the first rows are repeated behind it.  ``loop_to`` makes every rank a
    multiple of that batch size.
    """
    unit = ranks * (loop_to or 1)
    if drop_last and loop_to is None:
        kept = df.where(F.col(pos) < total - total % unit).withColumn("slot", F.col(pos))
    else:
        goal = -(-total // unit) * unit
        turns = F.expr(f"({goal} - 1 - {pos}) div {total}")
        kept = df.where(F.col(pos) < goal).withColumn("_turn", F.explode(F.sequence(F.lit(0), turns.cast("int"))))
        kept = kept.withColumn("slot", (F.col("_turn") * F.lit(total) + F.col(pos)).cast("bigint")).drop("_turn")
    return kept.withColumn("rank", F.pmod("slot", F.lit(ranks)).cast("int")).withColumn(
        "place", F.expr(f"slot div {ranks}")
    )


def _check(total: int, consumed: int, mb: int, dp: int, gb: int) -> None:
    if total <= 0 or not 0 <= consumed < total or mb <= 0 or dp <= 0:
        raise ValueError("need samples left to consume and positive sizes")
    if gb % (mb * dp):
        raise ValueError(f"a global batch of {gb} is not a multiple of {mb} x {dp}")


def batch_plan(spark: SparkSession, total: int, consumed: int, mb: int, dp: int, gb: int, drop_last: bool = True,
               pad: bool = False) -> DataFrame:
    """Sequential plan (step, micro, rank, slot, sample) from ``consumed`` on.

    The samples of one micro step are ``mb * dp`` neighbours, each rank takes ``mb`` of them.  The
    open tail is dropped, kept as it is, or padded with -1 up to the global batch.
    """
    _check(total, consumed, mb, dp, gb)
    group = mb * dp
    whole = consumed + (total - consumed) // group * group
    end = whole if drop_last else total
    if pad and not drop_last:
        end = consumed + -(-(total - consumed) // gb) * gb if end > whole else end
    at = F.col("id") - F.lit(consumed)
    return spark.range(consumed, end).select(
        F.expr(f"(id - {consumed}) div {gb}").alias("step"),
        F.expr(f"pmod(id - {consumed}, {gb}) div {group}").alias("micro"),
        F.expr(f"pmod(id - {consumed}, {group}) div {mb}").alias("rank"),
        F.pmod(at, F.lit(mb)).cast("bigint").alias("slot"),
        F.when(F.col("id") < total, F.col("id")).otherwise(F.lit(PAD)).cast("bigint").alias("sample"),
    )


def _bucket_plan(spark: SparkSession, total: int, consumed: int, mb: int, dp: int, gb: int, drop_last: bool,
                 shuffled: bool) -> DataFrame:
    _check(total, consumed % total, mb, dp, gb)
    group = mb * dp
    active = total - total % group
    epoch, inside = divmod(consumed, active)
    if inside % group:
        raise ValueError("a run can only resume at a whole micro batch")
    bucket = total // group * mb
    rows = spark.range(bucket * dp).select(
        F.expr(f"id div {bucket}").alias("rank"), F.pmod("id", F.lit(bucket)).cast("bigint").alias("x")
    )
    placed = hash_order(rows, epoch, ["x"], ["rank"], "place") if shuffled else rows.withColumn("place", F.col("x"))
    skip = inside // dp
    left = placed.where(F.col("place") >= skip).withColumn("_at", F.col("place") - skip)
    if drop_last:
        left = left.where(F.col("_at") < (bucket - skip) // mb * mb)
    return left.select(
        F.lit(epoch).cast("bigint").alias("epoch"), F.expr(f"_at div {mb}").alias("micro"),
        F.col("rank").cast("bigint").alias("rank"), F.pmod("_at", F.lit(mb)).cast("bigint").alias("slot"),
        (F.col("rank") * F.lit(bucket) + F.col("x")).cast("bigint").alias("sample"),
    )


def batch_plan_random(spark: SparkSession, total: int, consumed: int, mb: int, dp: int, gb: int,
                      drop_last: bool = True) -> DataFrame:
    """Each rank owns a contiguous bucket, read in an order fixed by the epoch (the same for all ranks)."""
    return _bucket_plan(spark, total, consumed, mb, dp, gb, drop_last, True)


def batch_plan_cyclic(spark: SparkSession, total: int, consumed: int, mb: int, dp: int, gb: int,
                      drop_last: bool = True) -> DataFrame:
    """The same buckets read in sequence."""
    return _bucket_plan(spark, total, consumed, mb, dp, gb, drop_last, False)


def resume_skip(plan: DataFrame, consumed: int, dp: int, place: str = "place") -> DataFrame:
    """Drop what every rank has already read: ``consumed div dp`` of its places."""
    return plan.where(F.col(place) >= consumed // dp)
