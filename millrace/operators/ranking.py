"""Best candidates per group: top-k, nucleus and argmax."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk_per_group(df: DataFrame, by: Sequence[str], score: str, k: int, temperature: float = 1.0,
                   key: str = "id") -> DataFrame:
    """The ``k`` best candidates of every group and their softmax.

    Spark limits every group to ``k`` rows before the shuffle (window group limit), so a hot group
    arrives as at most ``k`` rows per task.
    """
    best = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(key))
    group = Window.partitionBy(*by)
    top = df.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    weight = F.exp((F.col(score) - F.max(score).over(group)) / F.lit(temperature))
    return top.withColumn("_w", weight).withColumn("prob", F.col("_w") / F.sum("_w").over(group)).drop("_w")


def topp_per_group(df: DataFrame, by: Sequence[str], score: str, p: float, temperature: float = 1.0, keep: int = 1,
                   key: str = "id", step: float = 0.05) -> DataFrame:
    """Candidates whose ascending cumulative probability is above ``1 - p``, and the best ``keep``.

    Groups are cut into blocks of scores ``step`` wide.  One small table per (group, block) - mass and
    rows, from a map-side combined aggregate - gives the group's total mass and what lies below and
    above each block; rows are only ever sorted inside a block, so a big group is spread.
    """
    by = list(by)
    base = df.withColumn("_block", F.floor(F.col(score) / F.lit(step)).cast("bigint"))
    # Weights relative to the block's own lower edge stay between 1 and exp(step / temperature).
    weight = F.exp((F.col(score) - F.col("_block") * F.lit(step)) / F.lit(temperature))
    blocks = base.groupBy(*by, "_block").agg(F.sum(weight).alias("_mass"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy(*by)
    rising = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    falling = group.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scale = F.exp((F.col("_block") - F.max("_block").over(group)) * F.lit(step) / F.lit(temperature))
    table = (
        blocks.withColumn("_scale", scale)
        .withColumn("_total", F.sum(F.col("_mass") * F.col("_scale")).over(group))
        .withColumn("_share", F.col("_mass") * F.col("_scale") / F.col("_total"))
        .withColumn("_below", F.sum("_share").over(rising) - F.col("_share"))
        .withColumn("_above", F.sum("_rows").over(falling) - F.col("_rows"))
        .select(*by, "_block", (F.col("_scale") / F.col("_total")).alias("_factor"), "_below", "_above")
    )
    rows = base.withColumn("_weight", weight).repartition(*by, "_block").join(table, [*by, "_block"])
    inside = Window.partitionBy(*by, "_block")
    up = inside.orderBy(F.col(score), F.col(key).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    down = inside.orderBy(F.col(score).desc(), F.col(key))
    ranked = (
        rows.withColumn("prob", F.col("_weight") * F.col("_factor"))
        .withColumn("cumulative", F.col("_below") + F.sum("prob").over(up))
        .withColumn("_place", F.col("_above") + F.row_number().over(down))
    )
    return ranked.where((F.col("cumulative") > 1 - p) | (F.col("_place") <= keep)).drop(
        "_block", "_weight", "_factor", "_below", "_above", "_place"
    )


def best_per_group(df: DataFrame, by: Sequence[str], score: str, key: str = "id") -> DataFrame:
    """Highest score of every group, the smallest key on ties; combines before the shuffle."""
    order = F.struct(F.col(score), -F.col(key))
    return df.groupBy(*by).agg(F.max_by(F.col(key), order).alias(key), F.max(score).alias(score))
