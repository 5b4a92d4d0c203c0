"""Lookups expressed as equi joins: intervals, blends, pending work, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import DEFAULT_BLOCK, block_width, plan_table


def interval_join(
    points: DataFrame, ranges: DataFrame, point: str, start: str, end: str, keys: Sequence[str] = (),
    width: int | None = None, how: str = "inner",
) -> DataFrame:
    """Match each point with the ranges ``[start, end)`` that hold it.

    Every range is repeated once per cell of ``width`` it touches, so the match is an equality on
    the cell and the comparison only removes neighbours inside one cell.  By default the cell is as
    wide as the average range, which bounds the repeated ranges by twice their number.
    """
    ranges = ranges.where(F.col(start) < F.col(end))
    if width is None:
        cell = F.coalesce(ranges.agg(F.ceil(F.avg(F.col(end) - F.col(start)))).scalar(), F.lit(1))
    else:
        cell = F.lit(width)
    cells = ranges.withColumn(
        "_cell",
        F.explode(F.sequence(
            F.floor(F.col(start) / cell).cast("bigint"), F.floor((F.col(end) - 1) / cell).cast("bigint")
        )),
    )
    located = points.withColumn("_cell", F.floor(F.col(point) / cell).cast("bigint"))
    right = cells.select(
        F.col("_cell").alias("_r_cell"), *[F.col(k).alias(f"_k_{k}") for k in keys],
        *[c for c in ranges.columns if c not in keys],
    )
    cond = (F.col("_cell") == F.col("_r_cell")) & (F.col(point) >= F.col(start)) & (F.col(point) < F.col(end))
    for k in keys:
        cond = cond & (F.col(k) == F.col(f"_k_{k}"))
    return located.join(right, cond, how).drop("_cell", "_r_cell", *[f"_k_{k}" for k in keys])


def carry_join(points: DataFrame, bounds: DataFrame, at: str, start: str, keys: Sequence[str] = (), rows_per_block: int = DEFAULT_BLOCK) -> DataFrame:
    """Every point with the last boundary at or before it, of the same keys; points before the first boundary, or with a null, are left out.

    Points and boundaries stand in one order, cut into blocks of the position.  Inside a block the last boundary is carried
    along; the last one of all earlier blocks comes from a table of one row per block.  So a range over most
    points is as many blocks as it has points for, boundaries are not repeated, and no cell width has to be chosen.  Of boundaries at one
    place any is taken.
    """
    keys, points = list(keys), points.where(F.col(at).isNotNull())
    for k in keys:
        points = points.where(F.col(k).isNotNull())
    width = block_width(points.select(at), at, rows_per_block)
    carried = [c for c in bounds.columns if c not in keys]
    block = lambda c: F.floor(F.col(c) / F.lit(width)).cast("bigint").alias("_block")
    told = bounds.where(F.col(start).isNotNull()).select(
        *keys, block(start), F.col(start).cast("bigint").alias("_at"), F.lit(0).alias("_kind"), F.struct(*carried).alias("_bound"))
    point = F.struct(*points.columns)
    asked = points.select(*keys, block(at), F.col(at).cast("bigint").alias("_at"), F.lit(1).alias("_kind"), point.alias("_point"))
    rows = told.withColumn("_point", F.lit(None).cast(asked.schema["_point"].dataType)).unionByName(
        asked.withColumn("_bound", F.lit(None).cast(told.schema["_bound"].dataType)))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.repartition(*keys, "_block").withColumn("_last", F.last("_bound", ignorenulls=True).over(inside)).where("_kind = 1")
    # One row per block: its own last boundary, and the one that comes into it from before.
    last = told.groupBy(*keys, "_block").agg(F.max_by("_bound", "_at").alias("_own"))
    blocks = asked.select(*keys, "_block").distinct().join(last, [*keys, "_block"], "full")
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    into = blocks.select(*keys, "_block", F.last("_own", ignorenulls=True).over(before).alias("_into"))
    met = local.join(into, [*keys, "_block"]).withColumn("_bound", F.coalesce("_last", "_into")).where("_bound is not null")
    return met.select("_point.*", *[F.col(f"_bound.{c}").alias(c) for c in carried])


def cumulative_ranges(lens: DataFrame, by: Sequence[str], order: str, size: str = "len") -> DataFrame:
    """``[start, end)`` of every file of a source (a file table is small: one row per file)."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.sum(size).over(w).cast("bigint")
    return lens.withColumn("end", end).withColumn("start", F.col("end") - F.col(size))


def locate_window(pos: DataFrame, lens: DataFrame, by: Sequence[str] = ("source",), order: str = "file",
                  width: int | None = None) -> DataFrame:
    """File of every stream position and the position inside it.

    A file may hold most positions: they are told apart by blocks, not by file.  With ``width``, by cells of so many positions.
    """
    ranges = cumulative_ranges(plan_table(lens), by, order).select(*by, order, "start", "end").where("start < end")
    if width is None:
        found = carry_join(pos, ranges, "pos", "start", by).where((F.col("pos") >= 0) & (F.col("pos") < F.col("end")))
    else:
        found = interval_join(pos, ranges, "pos", "start", "end", by, width)
    return found.withColumn("inner_pos", F.col("pos") - F.col("start"))


def files_needed(files: DataFrame, need: DataFrame, by: str = "source", order: str = "file") -> DataFrame:
    """Files of each source that overlap the wanted range ``[now, until)``; one range per source."""
    ranges = cumulative_ranges(plan_table(files), [by], order)
    lo, hi = F.greatest("now", "start"), F.least("until", "end")
    return ranges.join(need, by).where(lo < hi).select(by, order, lo.alias("from_sample"), hi.alias("to_sample"))


def need_ranges(weights: DataFrame, consumed_samples: int, steps_left: int, batch: int) -> DataFrame:
    """Wanted range per source; ``weights`` has (source, share, offset)."""
    now = (F.floor(F.lit(consumed_samples) * F.col("share")) + F.col("offset")).cast("bigint")
    more = F.floor(F.lit(steps_left * batch) * F.col("share")).cast("bigint")
    return weights.select("source", now.alias("now"), (now + more).alias("until"))


def blend_fetch(blend: DataFrame, windows: DataFrame, lens: DataFrame, offsets: DataFrame | None = None,
                row: str = "win") -> DataFrame:
    """Attach to every blend position its window: sample + offset, wrapped by the source's length.

    ``windows`` is keyed by (ds, ``row``) with dense rows; the join key is close to unique, so a
    popular source does not make a hot key.
    """
    wide = blend.join(plan_table(lens.select("ds", "len")), "ds")
    shift: Column = F.lit(0)
    if offsets is not None:
        wide = wide.join(plan_table(offsets.select("ds", "offset")), "ds", "left")
        shift = F.coalesce("offset", F.lit(0))
    keyed = wide.withColumn(row, F.pmod(F.col("sample") + shift, F.col("len")).cast("bigint")).drop("offset", "len")
    return keyed.join(windows, ["ds", row])


def pending_samples(requests: DataFrame, done: DataFrame, key: str = "key") -> DataFrame:
    return requests.join(done.select(key), key, "left_anti")


def grade_items(gens: DataFrame, items: DataFrame) -> DataFrame:
    """Gold answers by item id."""
    return gens.join(items.select("id", F.col("answer").alias("gold")), "id")


def stage_for_step(steps: DataFrame, stages: DataFrame, width: int | None = None) -> DataFrame:
    """Latest stage starting at or before each step; the last stage reaches to the last step there is.

    With ``width``, found by cells of so many steps instead of carried along the steps.
    """
    if width is None:
        return carry_join(steps, plan_table(stages).select("name", "start_step"), "step", "start_step")
    w = Window.orderBy("start_step")
    open_end = F.coalesce(steps.agg(F.max("step") + 1).scalar(), F.lit(0))
    ranges = plan_table(stages).select(
        "name", "start_step",
        F.coalesce(F.lead("start_step").over(w), F.greatest(open_end, F.col("start_step") + 1)).alias("_end"),
    )
    return interval_join(steps, ranges, "step", "start_step", "_end", (), width).drop("_end")


def compare_runs(points: DataFrame, a: str, b: str, ratio: tuple[int, int] = (1, 1)) -> DataFrame:
    """Accuracy of series ``a`` minus ``b`` per benchmark where ``a.step * ratio[0] == b.step * ratio[1]``, in integers."""
    left = points.where(F.col("series") == a).select("bench", "step", F.col("accuracy").alias("accuracy_a"))
    right = points.where(F.col("series") == b).select(
        F.col("bench").alias("_bench"), (F.col("step").cast("bigint") * ratio[1]).alias("_at"), F.col("accuracy").alias("accuracy_b")
    )
    return (
        left.join(right, (F.col("bench") == F.col("_bench")) & (F.col("step").cast("bigint") * ratio[0] == F.col("_at")))
        .select("bench", "step", "accuracy_a", "accuracy_b",
                (F.col("accuracy_a") - F.col("accuracy_b")).alias("difference"))
    )


def check_manifest(manifest: DataFrame, shard_info: DataFrame, tokenizer: str) -> DataFrame:
    """Shards whose manifest row and own record disagree, with the reason; no rows means complete.

    Both sides have (name, tokens, docs, dropped_too_long, max_doc_tokens, budget, tokenizer); the
    manifest also has ``weight`` and the shard side ``stored_bytes``.
    """
    shared = ["tokens", "docs", "dropped_too_long", "max_doc_tokens", "budget", "tokenizer"]
    m = manifest.select("name", F.struct(*shared).alias("m"), F.col("weight"))
    s = shard_info.select(F.col("name"), F.struct(*shared).alias("s"), F.col("stored_bytes"))
    both = m.join(s, "name", "full_outer")
    reason = (
        F.when(F.col("s").isNull(), "missing shard")
        .when(F.col("m").isNull(), "not in manifest")
        .when(F.col("weight").isNull() | F.isnan("weight") | (F.col("weight") <= 0), "bad weight")
        .when(~F.col("m").eqNullSafe(F.col("s")), "changed")
        .when(~F.col("s.tokenizer").eqNullSafe(F.lit(tokenizer)), "other tokenizer")
        .when(F.coalesce("s.tokens", F.lit(0)) <= 0, "empty")
        .when(~F.col("stored_bytes").eqNullSafe(F.col("s.tokens") * 4), "stored size differs")
    )
    return both.select("name", reason.alias("reason")).where(F.col("reason").isNotNull())
