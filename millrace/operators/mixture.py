"""Mixture weights, quotas, blend orders, shuffles, splits and epochs."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions.permutation import PRIME, number_at, place_of
from millrace.functions.seeded import seeded_int
from millrace.functions.text import shard_name
from millrace.operators.ordering import (
    DEFAULT_BLOCK, expand_counts, global_row_index, hash_order, hash_order_counts, plan_table, repeat_epochs, running_offset,
)

QUOTA_MARGIN = 1.005  # fixed value: samples asked for beyond the exact share
LAST_EPOCH_SHARE = 0.80  # fixed value: a shorter last epoch is shuffled apart
NAME_TAIL = 16  # fixed value: characters of a source name that enter its shuffle
BLEND_STEP_LIMIT = 1 << 21


# Planning tables ------------------------------------------------------------------------------


def normalize_weights(w: DataFrame) -> DataFrame:
    """``share`` = weight / total; a total that is not positive fails the job."""
    total = F.sum("weight").over(Window.partitionBy())
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.lit("sum of weights must be positive")))
    return w.withColumn("share", F.col("weight") / checked)


RECIPE_SCHEMA = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("budget_tokens", T.LongType()),
    T.StructField("shards", T.IntegerType()), T.StructField("sampling_weight", T.DoubleType()),
    T.StructField("max_doc_tokens", T.IntegerType()),
])


def recipe_faults(rec: DataFrame) -> DataFrame:
    """Recipe rows that break a rule."""
    fault = (
        F.when(F.col("shards") < 1, "shards must be positive")
        .when(F.col("budget_tokens") < F.col("shards"), "budget below one token per shard")
        .when(F.col("max_doc_tokens") < 0, "negative length filter")
    )
    return rec.select("source", fault.alias("fault")).where(F.col("fault").isNotNull())


def plan_shards(rec: DataFrame) -> DataFrame:
    """One preparation job per shard: its part of the budget and of the sampling weight."""
    valid = (F.col("shards") >= 1) & (F.col("budget_tokens") >= F.col("shards")) & (F.col("max_doc_tokens") >= 0)
    rows = rec.where(valid).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1)))
    return rows.select(
        "source", F.col("shard").cast("int").alias("shard"),
        shard_name(F.col("source"), F.col("shard"), F.col("shards")).alias("name"),
        F.expr("budget_tokens div shards").alias("budget"),
        (F.col("sampling_weight") / F.col("shards")).alias("weight"),
        F.col("max_doc_tokens"),
    )


def resolve_weights(specs: DataFrame, shard_info: DataFrame, manifests: DataFrame | None = None,
                    tokenizer: str | None = None) -> DataFrame:
    """Sampling weight of every folder: given, else its token count, else 1.

    ``specs`` has (folder, weight); ``shard_info`` (folder, tokens).  A folder listed as a mixture root
    in ``manifests`` (root, folder, weight, tokenizer) expands to its shards with their saved weights;
    overriding those, or another tokenizer, fails the job.
    """
    plain = specs.join(shard_info.select("folder", "tokens"), "folder", "left")
    if manifests is None:
        return plain.select("folder", F.coalesce("weight", "tokens", F.lit(1)).cast("double").alias("weight"))
    roots = manifests.select(F.col("root").alias("folder")).distinct()
    own = plain.join(roots, "folder", "left_anti").select(
        "folder", F.coalesce("weight", "tokens", F.lit(1)).cast("double").alias("weight")
    )
    m = manifests.select(F.col("root"), F.col("folder").alias("shard_folder"), F.col("weight").alias("saved"),
                         F.col("tokenizer"))
    spread = specs.join(m, specs["folder"] == m["root"])
    weight = F.when(F.col("weight").isNotNull(), F.raise_error(F.lit("a mixture brings its own weights")).cast("double"))
    if tokenizer is not None:
        weight = weight.when(~F.col("tokenizer").eqNullSafe(F.lit(tokenizer)),
                             F.raise_error(F.lit("the mixture has another tokenizer")).cast("double"))
    expanded = spread.select(F.col("shard_folder").alias("folder"),
                             weight.otherwise(F.col("saved").cast("double")).alias("weight"))
    return own.unionByName(expanded)


def largest_remainder(w: DataFrame, n) -> DataFrame:
    """``n`` split by weight: floors, then one more for the largest fractions (later source first on ties)."""
    n = n if isinstance(n, Column) else F.lit(n)
    shares = normalize_weights(w).withColumn("_exact", F.col("share") * n)
    floors = shares.withColumn("_floor", F.floor("_exact").cast("bigint"))
    left = n - F.sum("_floor").over(Window.partitionBy())
    rank = F.row_number().over(Window.orderBy((F.col("_exact") - F.col("_floor")).desc(), F.col("ds").desc()))
    return floors.withColumn("quota", F.col("_floor") + F.when(rank <= left, 1).otherwise(0)).drop(
        "_exact", "_floor", "share"
    )


def padded_quota(w: DataFrame, n, out: str = "quota") -> DataFrame:
    """``ceil(n * share * 1.005)`` per source; ``n`` may be a (train, valid, test) tuple."""
    shares = normalize_weights(w)
    if isinstance(n, (tuple, list)):
        for part, k in zip(("train", "valid", "test"), n):
            shares = shares.withColumn(f"{out}_{part}", F.ceil(F.lit(k) * F.col("share") * QUOTA_MARGIN).cast("bigint"))
        return shares.drop("share")
    n = n if isinstance(n, Column) else F.lit(n)
    return shares.withColumn(out, F.ceil(n * F.col("share") * F.lit(QUOTA_MARGIN)).cast("bigint")).drop("share")


# Blend orders ---------------------------------------------------------------------------------


def blend_cycle(weights: Sequence[int], limit: int = BLEND_STEP_LIMIT) -> tuple[list[int], int]:
    """Source of each step of the greedy blend up to the end of its first cycle, and the cycle's start.

    The next choice depends only on the vector of integer errors ``weight * step - taken * total``,
    so the order repeats as soon as a vector repeats, and a vector can only repeat after whole
    multiples of total/gcd steps.
    """
    g = reduce(math.gcd, weights)
    ws = [w // g for w in weights]
    total = sum(ws)
    if 4 * total > limit:
        raise ValueError(f"a cycle of {total} steps is over the limit; round the weights or use blend_bins")
    taken = [0] * len(ws)
    order: list[int] = []
    seen: dict[tuple[int, ...], int] = {}
    step = 0
    while True:
        errors = tuple(w * step - t * total for w, t in zip(ws, taken))
        if step >= 1:
            if errors in seen:
                return order, seen[errors]
            seen[errors] = step
        if step > limit:
            raise ValueError("no cycle found within the limit; use blend_bins")
        at = max(step, 1)
        best = max(range(len(ws)), key=lambda d: (ws[d] * at - taken[d] * total, -d))
        taken[best] += 1
        order.append(best)
        step += 1


def blend_greedy(spark: SparkSession, w: DataFrame, n: int, limit: int = BLEND_STEP_LIMIT) -> DataFrame:
    """Blend order (pos, ds, sample): each position goes to the source furthest behind its share.

    ``w`` has (ds, weight) with ds = 0..k-1 and integer weights.  One cycle is found on the small
    weight table; positions come from ``spark.range`` and a join on the place in the cycle.
    """
    rows = sorted((r["ds"], r["weight"]) for r in w.select("ds", "weight").toLocalIterator())
    weights = [int(x) for _, x in rows]
    if any(int(x) != x or x <= 0 for _, x in rows) or [d for d, _ in rows] != list(range(len(rows))):
        raise ValueError("the greedy blend needs positive integer weights for ds = 0..k-1")
    order, loop_start = blend_cycle(weights, limit)
    period = len(order) - loop_start
    ds = np.array(order)
    first = np.empty(len(order), dtype=np.int64)
    for d in range(len(weights)):
        first[ds == d] = np.arange(np.count_nonzero(ds == d))
    per_cycle = np.bincount(ds[loop_start:], minlength=len(weights))[ds]
    cycle = spark.createDataFrame(pa.table({
        "place": np.arange(len(order)), "ds": ds.astype(np.int32), "first": first, "per_cycle": per_cycle,
    }))
    pos = F.col("pos")
    place = F.when(pos < loop_start, pos).otherwise(F.pmod(pos - loop_start, F.lit(period)) + loop_start)
    turns = F.when(pos < loop_start, F.lit(0)).otherwise(F.expr(f"(pos - {loop_start}) div {period}"))
    base = spark.range(n).withColumnRenamed("id", "pos").withColumn("place", place.cast("bigint")).withColumn(
        "turns", turns.cast("bigint")
    )
    # A local table of at most `limit` rows: Spark sees its size and broadcasts it if it is small.
    return base.join(cycle, "place").select(
        "pos", "ds", (F.col("first") + F.col("turns") * F.col("per_cycle")).cast("bigint").alias("sample")
    )


def epochs_for(n: int, epoch: int) -> int:
    return n // epoch + 1


def epoch_index(spark: SparkSession, w: DataFrame | None, lens: DataFrame, n: int, seed: int,
                limit: int = BLEND_STEP_LIMIT) -> DataFrame:
    """Shuffled epoch of the blend, repeated and cut to ``n`` positions.

    ``lens`` has (ds, len).  With weights the epoch is that of the greedy blend, and samples wrap at the source's
    length.  Without, every sample of every source is in the epoch once, whatever the lengths are.
    """
    epoch = lens.agg(F.sum("len").cast("bigint")).first()[0]
    lens = plan_table(lens.select("ds", "len"))
    if w is None:
        mixed = hash_order_counts(lens, "len", "sample", epoch or 0, seed)
    else:
        base = blend_greedy(spark, w, epoch, limit).join(lens, "ds")
        base = base.select(F.col("pos").alias("place"), "ds", F.pmod("sample", "len").cast("bigint").alias("sample"))
        mixed = hash_order(base, seed, ["place"]).drop("place")
    epochs = epochs_for(n, epoch)
    return repeat_epochs(mixed, epochs, last=F.col("pos") < n - (epochs - 1) * epoch).select(
        (F.col("epoch") * F.lit(epoch) + F.col("pos")).cast("bigint").alias("pos"), "ds", "sample"
    ).where(F.col("pos") < n)


def quota_index(w: DataFrame, n, seed: int) -> DataFrame:
    """Exact quotas in random order; every source is read in sequence."""
    slots = expand_counts(largest_remainder(w, n).select("ds", "quota"), "quota", "slot")
    placed = hash_order(slots, seed, ["ds", "slot"]).drop("slot")
    return global_row_index(placed, "pos", ["ds"], "sample")


def bin_table(w: DataFrame, bins: int) -> DataFrame:
    """(bin, ds, bias, bins_of_ds): whole bins by share, left-over bins to the last source."""
    shares = normalize_weights(w).withColumn("_n", F.floor(F.col("share") * F.lit(bins)).cast("int"))
    everything = Window.partitionBy()
    last = F.col("ds") == F.max("ds").over(everything)
    filled = shares.withColumn(
        "_n", F.when(last, F.lit(bins) - F.sum("_n").over(everything) + F.col("_n")).otherwise(F.col("_n")).cast("int")
    )
    checked = F.when(F.col("_n") > 0, F.col("_n")).otherwise(
        F.raise_error(F.lit("every source needs a bin: raise bins or its weight"))
    )
    starts = Window.orderBy("ds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = filled.withColumn("bins_of_ds", checked).withColumn(
        "_from", F.sum("bins_of_ds").over(starts) - F.col("bins_of_ds")
    )
    return sized.select(
        "ds", "bins_of_ds", "_from", F.explode(F.sequence(F.lit(0), F.col("bins_of_ds") - 1)).alias("bias")
    ).select((F.col("_from") + F.col("bias")).cast("bigint").alias("bin"), "ds",
             F.col("bias").cast("bigint").alias("bias"), F.col("bins_of_ds").cast("bigint").alias("bins_of_ds"))


def blend_bins(spark: SparkSession, w: DataFrame, lens: DataFrame, n: int, bins: int = 100) -> DataFrame:
    """Blend order by arithmetic on the position: no state, any length."""
    bins = min(bins, n)
    table = plan_table(bin_table(w, bins).join(lens.select("ds", "len"), "ds"))
    pos = spark.range(n).select(
        F.col("id").alias("pos"), F.pmod("id", F.lit(bins)).cast("bigint").alias("bin"),
        F.expr(f"id div {bins}").alias("_round"),
    )
    return pos.join(table, "bin").select(
        "pos", F.col("ds").cast("int").alias("ds"),
        F.pmod(F.col("bias") + F.col("_round") * F.col("bins_of_ds"), F.col("len")).cast("bigint").alias("sample"),
    )


def blend_report(blend: DataFrame, w: DataFrame) -> DataFrame:
    """Samples per source, with the wanted and the reached share."""
    counts = blend.groupBy("ds").agg(F.count(F.lit(1)).alias("samples"))
    total = F.sum("samples").over(Window.partitionBy())
    return normalize_weights(w).select("ds", F.col("share").alias("requested")).join(counts, "ds", "left").withColumn(
        "samples", F.coalesce("samples", F.lit(0))
    ).withColumn("achieved", F.col("samples") / total)


# Orders of windows, files, documents ----------------------------------------------------------


def window_order(lens: DataFrame, seed: int, by: str = "source") -> DataFrame:
    """(source, place, win): the order of ``shuffle_windows`` from window counts alone.

    Only numbers are shuffled; the windows themselves are fetched once, when a blend asks for them.
    """
    rows = expand_counts(lens.select(by, "len"), "len", "win")
    return hash_order(rows, seed, ["win"], [by], "place", name=F.right(F.col(by), F.lit(NAME_TAIL)))


def shuffle_windows(win: DataFrame, seed: int, by: str = "source", row: str = "win", out: str = "place") -> DataFrame:
    """Fixed random order of each source's windows, from the seed and the end of the source's name."""
    return hash_order(win, seed, [row], [by], out, name=F.right(F.col(by), F.lit(NAME_TAIL)))


def shuffle_files(files: DataFrame, seed: int, by: Sequence[str] = ("source",), key: str = "file",
                  size: str = "len") -> DataFrame:
    """Seeded order of each source's files with their place in the stream (one row per file)."""
    placed = hash_order(files, seed, [key], by, "place")
    return running_offset(placed, by, "place", size, "start", None)


def split_bounds(splits: str, size: int) -> list[int]:
    """Four row bounds of train, valid and test, their rounding error taken off every bound."""
    parts = [float(x) for x in splits.replace("/", ",").split(",")]
    if len(parts) != 3 or sum(parts) <= 0:
        raise ValueError(f"expected three parts, got {splits!r}")
    ends = [0]
    for part in parts:
        ends.append(ends[-1] + round(part / sum(parts) * float(size)))
    extra = ends[-1] - size
    return [0, *[e - extra for e in ends[1:]]]


def split_docs(docs: DataFrame, splits: str, order: str = "doc_id", block: int = DEFAULT_BLOCK) -> DataFrame:
    """Add ``split`` by the document's place; an empty split simply has no rows."""
    _, train, valid, _ = split_bounds(splits, docs.count())
    placed = global_row_index(docs, order, (), "pos", block)
    return placed.withColumn(
        "split", F.when(F.col("pos") < train, "train").when(F.col("pos") < valid, "valid").otherwise("test")
    )


def num_epochs(tokens: int, L: int, n: int, extra: int = 1) -> int:
    """Fewest passes over ``tokens`` that give ``n`` samples."""
    return max(1, -(-(n * L + extra) // tokens))


def num_epochs_col(tokens: Column, L: int, n: Column, extra: int = 1) -> Column:
    return F.greatest(F.lit(1), F.ceil((n * L + extra) / tokens)).cast("bigint")


def last_epoch_apart(tokens: int, L: int, n: int, epochs: int, extra: int = 1) -> tuple[bool, int]:
    """Whether the last epoch is shuffled apart, and the samples of the epochs before it."""
    before = ((epochs - 1) * tokens - extra) // L if epochs > 1 else 0
    per_epoch = (tokens - extra) // L
    return epochs > 1 and n - before < int(LAST_EPOCH_SHARE * per_epoch), before


def doc_order(docs: DataFrame, epochs: int, seed: int, split_last: bool, key: str = "doc_id") -> DataFrame:
    """All copies of all documents in one random order, the last epoch behind the others if asked."""
    copies = repeat_epochs(docs, epochs)
    rank = (F.col("epoch") == epochs - 1).cast("int") if split_last and epochs > 1 else None
    return hash_order(copies, seed, ["epoch", key], (), "pos", rank)


def doc_order_auto(docs: DataFrame, tokens: int, L: int, n: int, seed: int, key: str = "doc_id") -> DataFrame:
    """``doc_order`` with the epochs that ``n`` samples of ``L`` tokens need; a short last epoch is shuffled apart."""
    epochs = num_epochs(tokens, L, n)
    return doc_order(docs, epochs, seed, last_epoch_apart(tokens, L, n, epochs)[0], key)


def sample_order(spark: SparkSession, n: int, k: int, seed: int) -> DataFrame:
    """Random order of samples 0..n-1 with the first ``k`` shuffled apart from the rest."""
    rows = spark.range(n).withColumnRenamed("id", "sample")
    return hash_order(rows, seed, ["sample"], (), "pos", (F.col("sample") >= k).cast("int"))


# The same orders with direct access ------------------------------------------------------------


def _name_salt(by: str) -> Column:
    """31 bits of the end of a source's name."""
    return F.pmod(seeded_int(0, F.right(F.col(by), F.lit(NAME_TAIL))), F.lit(PRIME))


def sample_places(samples: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """Places of samples in a random order of 0..n-1 with the first ``k`` apart: a projection, for any part of the samples."""
    early = place_of(F.col("sample"), k, seed)
    late = F.lit(k) + place_of(F.col("sample") - k, n - k, seed)
    return samples.withColumn("pos", F.when(F.col("sample") < k, early).otherwise(late))


def samples_at(places: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """Samples that stand at places ``pos`` of that order; a resumed run asks for the places it still needs."""
    early = number_at(F.col("pos"), k, seed)
    late = F.lit(k) + number_at(F.col("pos") - k, n - k, seed)
    return places.withColumn("sample", F.when(F.col("pos") < k, early).otherwise(late))


def _lengths(lens: DataFrame, by: str) -> DataFrame:
    """Lengths with the salt of every source, computed here and not in each round of each row."""
    return plan_table(lens.select(by, F.col("len").alias("_len"), _name_salt(by).alias("_salt")))


def window_places(win: DataFrame, lens: DataFrame, seed: int, by: str = "source", row: str = "win", out: str = "place") -> DataFrame:
    """Fixed random order of each source's windows 0..len-1; ``lens`` (source, len) is a planning table."""
    rows = win.join(_lengths(lens, by), by)
    return rows.withColumn(out, place_of(F.col(row), F.col("_len"), seed, F.col("_salt"))).drop("_len", "_salt")


def windows_at(places: DataFrame, lens: DataFrame, seed: int, by: str = "source", place: str = "place", out: str = "win") -> DataFrame:
    """Windows at the places of each source's order, the inverse of ``window_places``."""
    rows = places.join(_lengths(lens, by), by)
    return rows.withColumn(out, number_at(F.col(place), F.col("_len"), seed, F.col("_salt"))).drop("_len", "_salt")


def batch_samples(spark: SparkSession, n: int, first: int, last: int, seed: int, batch: int) -> DataFrame:
    """(pos, epoch, step, sample) of places ``first`` to ``last - 1`` of an endless order that shuffles 0..n-1 anew in every epoch.

    Nothing before ``first`` is computed, so resuming costs nothing.
    """
    pos = spark.range(first, last).select(F.col("id").alias("pos"), F.expr(f"id div {n}").alias("epoch"), F.expr(f"id div {batch}").alias("step"))
    return pos.withColumn("sample", number_at(F.pmod("pos", F.lit(n)), n, seed, F.pmod("epoch", F.lit(PRIME))))


def mix_fractions(df: DataFrame, fractions: DataFrame, seed: int = 42, by: str = "source", key: str = "doc_id",
                  block: int = DEFAULT_BLOCK) -> DataFrame:
    """First ``int(fraction * rows)`` rows of every set, concatenated and shuffled."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).join(fractions.select(by, "fraction"), by)
    checked = F.when(F.col("fraction") >= 0, F.col("fraction")).otherwise(
        F.raise_error(F.lit("fractions must not be negative"))
    )
    limits = counts.select(by, F.floor(checked * F.col("_n")).cast("bigint").alias("_limit"))
    kept = global_row_index(df, key, [by], "_row", block).join(plan_table(limits), by).where(F.col("_row") < F.col("_limit"))
    return hash_order(kept.drop("_row", "_limit"), seed, [key], (), "pos")


def shard_source(df: DataFrame, n: int | Column, key: str = "doc_id", seed: int = 0) -> DataFrame:
    """Shard of every row; each row belongs to exactly one, whatever the source."""
    n = F.lit(n) if isinstance(n, int) else n
    return df.withColumn("shard", F.pmod(seeded_int(seed, F.col(key)), n).cast("int"))


def skip_limit_tokens(win: DataFrame, L: int, skip: int = 0, limit: int | None = None, by: Sequence[str] = ("source",),
                      order: str = "win") -> DataFrame:
    """Skip the windows of the first ``skip`` tokens, keep at most ``limit`` tokens, in whole windows.

    ``order`` is the dense window index of the stream.
    """
    first = -(-skip // L)
    out = win.where(F.col(order) >= first)
    return out if limit is None else out.where(F.col(order) < first + limit // L)


def capacity_check(lens: DataFrame, w: DataFrame, steps: int, batch: int, L: int) -> DataFrame:
    """Tokens needed against tokens held, and the largest number of steps each source allows."""
    both = normalize_weights(w).join(lens, "ds")
    need = (F.floor(F.lit(steps * batch) * F.col("share")) * L).cast("bigint")
    have = (F.col("len") * L).cast("bigint")
    return both.select(
        "ds", need.alias("needed_tokens"), have.alias("available_tokens"), (need <= have).alias("enough"),
        F.floor(F.col("len") / (F.col("share") * batch)).cast("bigint").alias("max_steps"),
    )
