"""Folds and bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.ordering import plan_table

HASH_SPAN = 1 << 20


def fold(id_col: str, folds: int) -> Column:
    """crc32(id as text) mod folds; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))


def bounded(rows: DataFrame, most: int, id_col: str = "doc_id", seed: int = 0) -> DataFrame:
    """About ``most`` rows, chosen by a hash of their id; never more than twice as many, however ids repeat."""
    rows = rows.where(F.col(id_col).isNotNull())
    n = rows.select(id_col).count()
    if n <= most:
        return rows
    share = max(1, round(HASH_SPAN * most / n))
    return rows.where(F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit(seed)), F.lit(HASH_SPAN)) < share).limit(2 * most)


def texts_of(docs: DataFrame, chosen: DataFrame, most: int, seed: int = 0) -> DataFrame:
    """Rows of docs (doc_id, text) whose id is among the distinct rows of ``chosen`` (doc_id, ...), which is of bounded size and broadcast.

    If ids repeat so that these are more than ``2 * most`` rows, about ``most`` different ones are taken by a hash of id and text.
    """
    ids = F.broadcast(chosen)
    n = docs.select("doc_id").join(ids, "doc_id").count()
    met = docs.join(ids, "doc_id")
    if n <= 2 * most:
        return met
    own = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)), F.lit(HASH_SPAN))
    return met.where(own < max(1, round(HASH_SPAN * most / n))).distinct().limit(2 * most)


def bounded_by(rows: DataFrame, most: int, label: str, *keys: str, seed: int = 0) -> DataFrame:
    """About ``most`` rows in all, chosen by a hash of ``keys``: an equal part of them for every label, or all rows of a label that has fewer.

    Rows of equal label and keys count as one in the result, so that it stays near the bound however they repeat.
    """
    counts = plan_table(rows.groupBy(label).agg(F.count(F.lit(1)).alias("_n")))
    labels = max(1, counts.count())
    chosen = counts.select(F.col(label).alias("_label"), F.greatest(F.lit(1.0), F.lit(HASH_SPAN) * max(1, most // labels) / F.col("_n")).alias("_share"))
    own = F.pmod(F.xxhash64(*[F.col(k) for k in keys], F.lit(seed)), F.lit(HASH_SPAN))
    met = rows.join(chosen, F.col(label).eqNullSafe(F.col("_label"))).where(own < F.col("_share")).drop("_label", "_share")
    return met.dropDuplicates([label, *keys])
