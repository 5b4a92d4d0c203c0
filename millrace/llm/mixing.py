"""Operator 4: mixing sources to target weights.

Every source gets a share of all words by weight; a share beyond ``max_epochs`` times the source is capped and the excess
goes to the others by weight until none is above.  A source's whole epochs come first; what is left of its target is
filled by Efraimidis-Spirakis order: documents sorted by an exponential key divided by their quality weight, sizes summed
along that order up to the budget, the document at the edge cut to what is left.  Keys are hashes of (seed, doc_id), so
reruns agree.

The order is kept in blocks of the key's logarithm, as many per source as its rows ask for, so the prefix sum of a
source that holds most rows is spread over tasks; only (source, block) totals meet.  The table of sources becomes a local
relation within a bound, beyond it joins by shuffle.

A null text has size 0.  Null is a source of its own, last in order.  Documents of size 0 take 0.  Equal keys fall
back on doc_id, then size; repeated rows share a key and are taken one after the other.  In ``expand`` ties beyond size go by a hash of the
row, so every row is decided on, with or without an id.  An empty table gives an empty result.  The text, id and source columns are named by parameters; all others are ignored (``mix``) or kept (``expand``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import let_go, stored
from millrace.operators.ordering import expand_counts, plan_table

WORD = r"[^\x20\x09-\x0D]+"
ROWS_PER_BLOCK = 1 << 12
MAX_EPOCHS = 3
SEED = "mix"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def quality_weight(size: Column, symbols: Column) -> Column:
    """Weight of a document: near 1 for prose, small where symbols outnumber words."""
    return F.when(size == 0, F.lit(1.0)).otherwise(size.cast("double") / (size + 4 * symbols).cast("double"))


def exponential_key(doc_id: Column, weight: Column, seed: str = SEED) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of an md5; small keys come first."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 13), 16, 10)
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0**52)) / weight


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, n_docs) with weights 1, 2, 3 repeating by code point: adds ``weight`` and ``target``.

    Sources sorted by cap over weight are capped up to some place and share the rest after it.
    """
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_epochs
    ranked = sizes.withColumn(
        "weight", (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1).cast("bigint") % 3 + 1
    ).withColumn("_cap", cap)
    order = everything.orderBy(F.col("_cap").cast("double") / F.col("weight"), "weight", F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(0, Window.unboundedFollowing)
    left = ranked.withColumns({
        "_at": F.row_number().over(order),
        "_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_weights": F.sum("weight").over(after),
    })
    free = F.col("_left") * F.col("weight") < F.col("_cap") * F.col("_weights")
    first = F.min(F.when(free, F.struct("_at", "_left", "_weights"))).over(everything)
    shared = left.withColumn("_first", first)
    target = F.when(
        F.col("_at") >= F.col("_first._at"),
        (F.col("_first._left") * F.col("weight")).cast("double") / F.col("_first._weights").cast("double"),
    ).otherwise(F.col("_cap").cast("double"))
    return shared.select(*sizes.columns, "weight", target.alias("target"))


def _symbols(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[^#*$%&|<>]+", "")).cast("bigint")


def placed(
    docs: DataFrame, max_epochs: int, seed: str, id_col: str, source_col: str, text_col: str, tie: Column | None = None
) -> DataFrame:
    """(doc_id, source, size, source_size, target, key, tie, epochs, rest, before): ``before`` words stand before a row in its source's order,
    of which ``rest`` are taken after the whole epochs.  ``tie`` orders rows of equal id and size."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), _symbols(F.col(text_col)).alias("symbols"),
        (F.lit(0).cast("bigint") if tie is None else tie).alias("tie"),
    )
    keyed = stored(rows.withColumn("key", exponential_key(F.col("doc_id"), quality_weight(F.col("size"), F.col("symbols")), seed)).drop("symbols"), "mix-keys")
    sizes = keyed.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    planned = plan_table(targets(sizes, max_epochs).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))))
    quota = F.floor(F.col("target") + F.lit(0.5))
    epochs = F.coalesce(F.floor(quota / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0))
    per_octave = F.ceil(F.col("n_docs") / F.lit(3 * ROWS_PER_BLOCK))
    joined = keyed.withColumnRenamed("source", "_source").join(planned, F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    # floor(octave * n) follows the order of the keys, as the logarithm never decreases.
    blocked = joined.withColumns({"epochs": epochs, "rest": quota - epochs * F.col("source_size"), "block": F.floor(F.log2("key") * per_octave)})
    totals = blocked.groupBy("rank", "block").agg(F.sum("size").alias("total"))
    by_block = Window.partitionBy("rank").orderBy("block")
    starts = totals.select("rank", "block", (F.sum("total").over(by_block) - F.col("total")).alias("start"))
    inside = Window.partitionBy("rank", "block").orderBy("key", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = blocked.repartition("rank", "block").withColumn("inside", F.sum("size").over(inside) - F.col("size"))
    return local.join(starts, ["rank", "block"]).select(
        "doc_id", "source", "size", "source_size", "target", "key", "tie", "epochs", "rest", (F.col("start") + F.col("inside")).alias("before"))


def mix(
    docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): ``taken`` words of every document, repeats counted."""
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    return placed(docs, max_epochs, seed, id_col, source_col, text_col).select(
        "doc_id", "source", "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("bigint").alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, as it stands."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"), 1, n), "")


def expand(docs: DataFrame, max_epochs: int = MAX_EPOCHS, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mixed documents themselves: a row per epoch, and the edge document of a source cut to its part.

    A source's order is known from one row, the last one taken: every document before it is taken once more than the whole
    epochs, every one after it only in these.  So texts stay where they are; only rows equal to a source's last one are gathered, as one row
    and their number.
    """
    columns = docs.columns
    # Maps and variants have no hash of their own.
    tie = F.xxhash64(*[F.to_json(F.struct(F.col(f"`{c}`"))) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes])
    order = ("key", "doc_id", "size", "tie")
    rows = placed(docs, max_epochs, seed, id_col, source_col, text_col, tie)
    # The last row taken in part or whole; of equal ones the first, which has the least before it.
    last = F.max(F.when((F.col("before") < F.col("rest")) & (F.col("size") > 0), F.struct(*order, (-F.col("before")).alias("before"))))
    edges = plan_table(rows.groupBy("source").agg(F.max("epochs").alias("epochs"), F.max("rest").alias("rest"), last.alias("last")))
    text = F.col(f"`{text_col}`")
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("own_source"), n_words(text).alias("size"), _symbols(text).alias("symbols"), tie.alias("tie"),
    ).where("size > 0")
    keyed = own.withColumn("key", exponential_key(F.col("doc_id"), quality_weight(F.col("size"), F.col("symbols")), seed))
    at = F.struct(*order)
    edge = F.struct(*[F.col(f"last.{c}").alias(c) for c in order])
    side = F.when(F.col("last").isNull() | (at > edge), 1).when(at < edge, -1).otherwise(0)
    met = keyed.join(edges, F.col("own_source").eqNullSafe(F.col("source"))).withColumn("side", side)
    copies = F.col("epochs") + F.when(F.col("side") < 0, 1).otherwise(0)
    whole = met.where("side <> 0").withColumn("n", copies).where("n > 0").select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), "n"))).select("row.*")
    # Rows equal to the edge share what is left: some whole, one in part.  Their hash finds them before any text is read through.
    near = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), text.cast("string").alias("text"), F.col(f"`{id_col}`").alias("doc_id"),
        F.col(f"`{source_col}`").alias("own_source"), tie.alias("tie"),
    ).join(edges, F.col("own_source").eqNullSafe(F.col("source"))).where(F.col("tie") == F.col("last.tie"))
    # Grouped with the edge as an aggregate, so that the exact test below is not made on rows whose hash differs.
    alike = near.groupBy("own_source", "doc_id", "text", "tie").agg(
        F.any_value("row").alias("row"), F.any_value("last").alias("last"), F.max("epochs").alias("epochs"), F.max("rest").alias("rest"), F.count(F.lit(1)).alias("n"))
    alike = alike.withColumns({"size": n_words(F.col("text")), "symbols": _symbols(F.col("text"))})
    alike = alike.withColumn("key", exponential_key(F.col("doc_id"), quality_weight(F.col("size"), F.col("symbols")), seed))
    equal = alike.where(at == edge).withColumn("left", F.col("rest") + F.col("last.before"))
    equal = equal.withColumn("left", F.least("left", F.col("n") * F.col("size")))
    parts = F.array(
        F.struct((F.col("n") * F.col("epochs") + F.expr("left div size")).alias("times"), F.col("size").alias("words")),
        F.struct(F.when(F.expr("left % size") > 0, F.lit(1)).otherwise(0).cast("bigint").alias("times"), F.expr("left % size").alias("words")),
    )
    cut = equal.select(F.col("own_source").alias("cut_source"), "row", "text", "size", F.inline(parts)).where("times > 0")
    part = F.when(F.col("words") < F.col("size"), first_words(F.col("text"), F.col("words").cast("int"))).otherwise(F.col("text"))
    cut = stored(cut.select("cut_source", "words", "times", "row", part.alias("part")), "mix-edges")  # two rows per source
    let_go(docs.sparkSession)
    # Rows come along with their numbers: a join with the exploded numbers would broadcast these, as Spark takes them for two rows per source.
    spread = expand_counts(cut, "times", "copy", by=["cut_source", "words"])
    kept = [F.col("part").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in columns]
    return whole.unionAll(spread.select(*kept))
