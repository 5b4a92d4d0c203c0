"""Shard records, manifests, column profiles and fingerprints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import plan_table

ZERO = 1e-10  # fixed value: anything smaller counts as zero


def shard_info(kept: DataFrame, tokenizer: str, by: Sequence[str] = ("source", "shard")) -> DataFrame:
    """One record per shard from the rows ``budget_tokens`` keeps."""
    return kept.groupBy(*by).agg(
        F.sum("take").cast("bigint").alias("tokens"),
        F.count_if(~F.col("dropped")).alias("docs"),
        F.count_if(F.col("dropped")).alias("dropped_too_long"),
        F.max("budget").cast("bigint").alias("budget"),
    ).withColumn("tokenizer", F.lit(tokenizer))


def manifest_totals(info: DataFrame, jobs: DataFrame, by: Sequence[str] = ("source", "shard")) -> DataFrame:
    """Total tokens, shards and weight of a mixture; a planned shard without record or tokens fails the job."""
    both = jobs.select(*by, "weight").join(info.select(*by, "tokens"), list(by), "left")
    ok = F.when(F.coalesce("tokens", F.lit(0)) > 0, F.col("tokens")).otherwise(
        F.raise_error(F.lit("a planned shard is missing or empty")).cast("bigint")
    )
    return both.agg(
        F.sum(ok).cast("bigint").alias("total_tokens"), F.count(F.lit(1)).alias("shards"),
        F.sum("weight").alias("total_weight"),
    )


def reusable_shards(jobs: DataFrame, info: DataFrame, tokenizer: str, by: Sequence[str] = ("source", "shard")) -> DataFrame:
    """Planned shards whose stored record fits the plan and the tokenizer, with ``reuse``."""
    held = info.select(*by, F.col("budget").alias("_b"), F.col("max_doc_tokens").alias("_m"),
                       F.col("tokenizer").alias("_t"), F.col("tokens").alias("_n"))
    same = (
        F.col("_b").eqNullSafe(F.col("budget")) & F.col("_m").eqNullSafe(F.col("max_doc_tokens"))
        & F.col("_t").eqNullSafe(F.lit(tokenizer)) & (F.coalesce("_n", F.lit(0)) > 0)
    )
    return jobs.join(held, list(by), "left").withColumn("reuse", same).drop("_b", "_m", "_t", "_n")


def _profile_columns(x: Column, name: str) -> list[Column]:
    """One pass: Spark's kurtosis uses the population variance, rescaled here to n - 1."""
    n = F.count(x)
    shrink = (n - 1) / F.nullif(n, F.lit(0))
    kurt = (F.kurtosis(x) + 3) * shrink * shrink - 3
    zero = F.lit(0.0)
    return [
        n.alias(f"{name}__n"),
        F.coalesce(F.avg(x), zero).alias(f"{name}__mean"),
        F.when(n == 1, F.lit(float("nan"))).otherwise(F.coalesce(F.stddev_samp(x), zero)).alias(f"{name}__std"),
        F.coalesce(F.min(x), zero).alias(f"{name}__min"),
        F.coalesce(F.max(x), zero).alias(f"{name}__max"),
        F.coalesce(F.sum(F.abs(x)), zero).alias(f"{name}__norm_l1"),
        F.coalesce(F.sqrt(F.sum(x * x)), zero).alias(f"{name}__norm_l2"),
        F.coalesce(F.avg((F.abs(x) < ZERO).cast("int")), F.lit(1.0)).alias(f"{name}__zero_frac"),
        F.when(n == 1, F.lit(float("nan"))).when(F.min(x) == F.max(x), zero).otherwise(F.coalesce(kurt, zero)).alias(
            f"{name}__kurtosis"
        ),
    ]


STATS = ("n", "mean", "std", "min", "max", "norm_l1", "norm_l2", "zero_frac", "kurtosis")


def _long_profile(wide: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    entries = F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"{c}__{s}").alias(s) for s in STATS]) for c in cols
    ])
    return wide.select(*by, F.inline(entries))


def column_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, std, range, norms, near-zero share and excess kurtosis of numeric columns, in one scan."""
    aggs = [a for c in cols for a in _profile_columns(F.col(c).cast("double"), c)]
    return _long_profile(df.agg(*aggs), cols, ())


def column_profile_by(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """The same per group and rolled up; the groups of a roll-up row are NULL."""
    aggs = [a for c in cols for a in _profile_columns(F.col(c).cast("double"), c)]
    return _long_profile(df.rollup(*by).agg(*aggs), cols, by)


def table_fingerprint(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Fingerprint of a table's content that does not depend on row order.

    Row digests are folded by count, exclusive or and sum, which combine map-side.
    """
    cols = list(cols or df.columns)
    row = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in cols])
    digest = F.sha2(row, 256)
    word = F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")
    folded = df.select(word.alias("_w")).agg(
        F.count(F.lit(1)).alias("rows"), F.bit_xor("_w").alias("_x"), F.sum(F.col("_w").cast("decimal(38,0)")).alias("_s")
    )
    return folded.select(
        "rows",
        F.sha2(F.concat_ws(":", F.col("rows").cast("string"), F.col("_x").cast("string"), F.col("_s").cast("string")), 256)
        .alias("fingerprint"),
    )


# Digests as a tree ----------------------------------------------------------------------------


def _row_word(cols: Sequence[str]) -> Column:
    """60 bits of a digest of a row; nulls, arrays and numbers by their text."""
    parts = [F.coalesce(F.to_json(F.struct(F.col(c))), F.lit("")) for c in cols]
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *parts), 256), 1, 15), 16, 10).cast("bigint")


def _folded(words: DataFrame, by: Sequence[str], word: str, rows: Column) -> DataFrame:
    """Digest of a group of words in any order, and its rows; counts and sums combine map-side."""
    told = words.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_n"), F.bit_xor(word).alias("_x"), F.sum(F.col(word).cast("decimal(38,0)")).alias("_s"), rows.alias("_rows"))
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("_n", "_x", "_s")])
    return told.select(*by, F.coalesce("_rows", F.lit(0)).alias("rows"), F.sha2(text, 256).alias("digest"))


def block_digests(df: DataFrame, order: str, block: int, by: Sequence[str] = ("source", "shard"), cols: Sequence[str] | None = None) -> DataFrame:
    """Leaves of the tree: (by, block, rows, digest) of every ``block`` keys of a shard; rows of a block have no order."""
    cols = list(cols or [c for c in df.columns if c not in by])
    rows = df.select(*by, F.floor(F.col(order) / F.lit(block)).cast("bigint").alias("block"), _row_word(cols).alias("_w"))
    return _folded(rows, [*by, "block"], "_w", F.count(F.lit(1)))


def _above(nodes: DataFrame, by: Sequence[str], child: Sequence[str]) -> DataFrame:
    """Digests one level up, of the children's names and digests."""
    named = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in child], F.col("digest"))
    word = F.conv(F.substring(F.sha2(named, 256), 1, 15), 16, 10).cast("bigint")
    return _folded(nodes.select(*by, "rows", word.alias("_w")), by, "_w", F.sum("rows"))


def shard_digests(blocks: DataFrame, by: Sequence[str] = ("source", "shard")) -> DataFrame:
    """(by, digest, rows) from the digests of blocks."""
    return _above(blocks, by, ["block"])


def table_digest(shards: DataFrame, by: Sequence[str] = ("source", "shard")) -> DataFrame:
    """(digest, rows) of the whole table from the digests of shards."""
    return _above(shards, (), by)


def changed_blocks(a: DataFrame, b: DataFrame, by: Sequence[str] = ("source", "shard")) -> DataFrame:
    """Blocks whose digests differ between two trees of leaves, or that one lacks: (by, block, change).

    Equal tables are told by one row each; otherwise shards are compared, and blocks only of those that differ.
    """
    shards_a, shards_b = shard_digests(a, by), shard_digests(b, by)
    tops = [table_digest(x, by).select("digest").collect() for x in (shards_a, shards_b)]
    if tops[0] == tops[1]:
        return a.limit(0).select(*by, "block", F.lit("").alias("change"))
    key = lambda x, y, names: [F.col(f"{x}.{c}").eqNullSafe(F.col(f"{y}.{c}")) for c in names]
    other = shards_a.alias("a").join(shards_b.alias("b"), key("a", "b", by), "full").where(~F.col("a.digest").eqNullSafe(F.col("b.digest")))
    other = plan_table(other.select(*[F.coalesce(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in by])).alias("o")
    x, y = (t.alias("t").join(other, key("t", "o", by), "left_semi") for t in (a, b))
    names = [*by, "block"]
    met = x.alias("x").join(y.alias("y"), key("x", "y", names), "full").where(~F.col("x.digest").eqNullSafe(F.col("y.digest")))
    change = F.when(F.col("x.digest").isNull(), "added").when(F.col("y.digest").isNull(), "removed").otherwise("changed")
    return met.select(*[F.coalesce(F.col(f"x.{c}"), F.col(f"y.{c}")).alias(c) for c in names], change.alias("change"))
