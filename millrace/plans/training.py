"""Training samples of a mixture: windows, their order, the blend, masks and the batch plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import batches, joins, mixture, pack
from millrace.operators.ordering import plan_table


def source_lengths(stream: DataFrame, sources: DataFrame, L: int) -> DataFrame:
    """(source, ds, len): whole windows of every source, from token counts only."""
    counts = stream.groupBy("source").agg(F.sum(F.size("ids")).cast("bigint").alias("_tokens"))
    return plan_table(counts.join(sources.select("source", "ds"), "source").select(
        "source", F.col("ds").cast("int").alias("ds"), F.floor(F.col("_tokens") / (L + 1)).cast("bigint").alias("len")
    ))


def training_samples(
    spark: SparkSession, stream: DataFrame, sources: DataFrame, L: int, n: int, eos, seed: int, mb: int, dp: int,
    gb: int, greedy: bool = True, consumed: int = 0, bins: int = 100,
) -> DataFrame:
    """(step, micro, rank, slot, ids, masks ...) of ``n`` blended samples.

    ``stream`` holds placed documents per source; ``sources`` has (source, ds, weight).  Blend positions
    are matched with shuffled window numbers and batch slots first - numbers only - and then fetch their
    windows in one join on (ds, window), whose side of the windows needs no further shuffle.
    """
    sources = plan_table(sources)
    lens = source_lengths(stream, sources, L)
    weights = sources.select("ds", "weight")
    blend = (
        mixture.blend_greedy(spark, weights, n) if greedy else mixture.blend_bins(spark, weights, lens, n, bins)
    )
    order = mixture.window_order(lens, seed).join(lens.select("source", "ds"), "source").drop("source")
    wanted = joins.blend_fetch(blend, order, lens, row="place").select(F.col("pos").alias("sample"), "ds", "win")
    slots = batches.batch_plan(spark, n, consumed, mb, dp, gb).join(wanted, "sample")
    # Packed by (ds, win), which is also the key of the fetch: the windows stay where they were built.
    placed = stream.join(lens.select("source", "ds"), "source").drop("source")
    fetched = slots.join(pack.pack_windows(placed, L, ["ds"]), ["ds", "win"])
    shaped = pack.shift_labels(pack.positions_from_eos(fetched, eos), L)
    return shaped.select(
        "sample", "step", "micro", "rank", "slot", "ds", "input_ids", "position_ids", "label_ids", "label_mask"
    )
