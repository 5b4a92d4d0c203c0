"""Corpus preparation: render -> filter -> tokenize -> gate -> budget -> tokens, records, manifest.

A prepared folder holds ``tokens`` (ids by source and shard), ``info`` (one record per shard) and ``manifest``.  Shards are
committed one by one: a shard's record says what made it (``digest`` of its part of the recipe, the tokenizer and the input's version), so
a later run makes only the shards whose record differs, is missing or doesn't fit what is stored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from millrace.functions import text as X
from millrace.operators import joins, mixture, pack, quality, tokens
from millrace.operators.ordering import DEFAULT_BLOCK, block_width, plan_table
from millrace.session import stored
from millrace.sources import stores

SHARD = ["source", "shard"]


@dataclass(frozen=True)
class ColumnTokenizer:
    """A tokenizer as a column function: text to ids, without the end of a document.

    ``name`` enters the records of shards, so it should change with the vocabulary.  Mark a ``pandas_udf`` ``asNondeterministic()``, so that
    filters on its result don't evaluate it twice.
    """

    name: str
    ids: Callable[[Column], Column]


def tokenized(docs: DataFrame, min_chars: int = X.MIN_CHARS) -> DataFrame:
    """(doc_id, source, ..., ids, n_tokens) of all documents long enough."""
    return tokens.tokenize(tokens.drop_short_text(docs, min_chars))


def encoded(docs: DataFrame, tokenizer: str | ColumnTokenizer, vocab: DataFrame | None) -> DataFrame:
    """Documents long enough with their ids in place of the text: a tokenizer's own, or pieces with bytes for those outside ``vocab``."""
    if isinstance(tokenizer, ColumnTokenizer):
        coded = tokens.tokenize(tokens.drop_short_text(docs), tokenizer=tokenizer.ids).drop("text")
    else:
        coded = tokens.encode_ids(tokenized(docs).drop("text"), vocab, byte_fallback=True)
    return coded.withColumn("n_tokens", F.size("ids").cast("bigint"))


def assign_shards(docs: DataFrame, jobs: DataFrame) -> DataFrame:
    """Shard of every document by its source's number of shards; sources without a job are left out."""
    counts = plan_table(jobs.groupBy("source").agg(
        F.count(F.lit(1)).alias("_shards"), F.max("max_doc_tokens").alias("max_doc_tokens")
    ))
    return mixture.shard_source(docs.join(counts, "source"), F.col("_shards")).drop("_shards")


def placed(docs: DataFrame, jobs: DataFrame, chat_sources: tuple[str, ...] = (), vocab: DataFrame | None = None,
           block: int | None = DEFAULT_BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents inside their shard's budget (``start``, ``take``, ``dropped``; no ids), and the ids of all documents.

    Texts are tokenized once, into a stored table; budgets are cut from its lengths.
    """
    tok = tokenized(assign_shards(docs, jobs)).drop("text")
    if vocab is not None:
        tok = tokens.encode_ids(tok, vocab)
    held = stored(tokens.flag_long(tok, F.col("max_doc_tokens"), F.col("source").isin(list(chat_sources))), "tokenized")
    kept = pack.budget_tokens(held.drop("ids"), plan_table(jobs.select(*SHARD, "budget")), block=block)
    return stored(kept, "placed"), held.select(*SHARD, "doc_id", "ids")


def budgeted(docs: DataFrame, jobs: DataFrame, chat_sources: tuple[str, ...] = (), vocab: DataFrame | None = None,
             block: int | None = DEFAULT_BLOCK) -> DataFrame:
    """Documents inside their shard's budget, with ids, ``start``, ``take`` and ``dropped``."""
    kept, ids = placed(docs, jobs, chat_sources, vocab, block)
    return kept.join(ids, [*SHARD, "doc_id"])


# The whole job --------------------------------------------------------------------------------


def all_texts(docs: DataFrame, chat_sources: tuple[str, ...], chats: DataFrame | None, template: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, source, text, chat): documents as they are, conversations (doc_id, source, messages) rendered."""
    rows = docs.select("doc_id", "source", "text", F.col("source").isin(list(chat_sources)).alias("chat"))
    if chats is None:
        return rows
    return rows.unionByName(chats.select("doc_id", "source", template(F.col("messages")).alias("text"), F.lit(True).alias("chat")))


def _id_ranges(docs: DataFrame, jobs: DataFrame) -> dict[str, dict]:
    """Per planned source: first id, end of its ids, rows, and budget (one row per source)."""
    spans = docs.groupBy("source").agg(
        F.min("doc_id").alias("first"), (F.max("doc_id") + 1).alias("end"), F.count(F.lit(1)).alias("rows")
    )
    wanted = jobs.groupBy("source").agg(F.sum("budget").alias("budget"))
    return {r["source"]: r.asDict() for r in spans.join(wanted, "source").collect()}


def _read_range(docs: DataFrame, bounds: dict[str, tuple[int, int]]) -> DataFrame:
    """Documents with ids in their source's range; the outer range and the names reach the scan."""
    spark = docs.sparkSession
    rows = spark.createDataFrame([(s, a, b) for s, (a, b) in bounds.items()], "source string, _a bigint, _b bigint")
    low, high = min(a for a, _ in bounds.values()), max(b for _, b in bounds.values())
    near = docs.where(
        F.col("source").isin(list(bounds)) & (F.col("doc_id") >= low) & (F.col("doc_id") < high)
    )
    return near.join(plan_table(rows), "source").where(
        (F.col("doc_id") >= F.col("_a")) & (F.col("doc_id") < F.col("_b"))
    ).drop("_a", "_b")


def tokens_until_full(
    docs: DataFrame, jobs: DataFrame, path: str, tokenizer: str | ColumnTokenizer, vocab: DataFrame | None,
    tokens_per_doc: float = 500.0,
) -> DataFrame:
    """Store tokens of as many documents, in id order, as the budgets need, and no more than about that.

    ``docs`` has (doc_id, source, text, chat), ``jobs`` the shards to make; documents of other shards of a source are not tokenized.
    Every round tokenizes the next range of ids of the sources that still have an unfilled shard; the
    range follows from the tokens found so far and grows until each shard is full or its source is at
    its end.  No document is read twice, and every document before the last one needed is there, so
    the budgets cut from the result are exact.  A round's tokens are counted from what that round stored.
    """
    spark = docs.sparkSession
    sources = _id_ranges(docs, jobs)
    done = {s: r["first"] for s, r in sources.items()}
    budgets = {(r["source"], r["shard"]): r["budget"] for r in jobs.collect()}  # as many as the recipe has shards
    held = dict.fromkeys(budgets, 0)

    def reach(source: str, share: float) -> int:
        """End of the first ``share`` of the source's ids; most of it is as good as all of it."""
        first, end = sources[source]["first"], sources[source]["end"]
        return end if share >= 0.75 else max(done[source] + 1, first + int((end - first) * share))

    goal = {s: reach(s, 1.25 * r["budget"] / (tokens_per_doc * r["rows"])) for s, r in sources.items()}
    number, mode = 0, "overwrite"
    wanted = plan_table(jobs.select(*SHARD, "shards", "max_doc_tokens"))
    while goal:
        part = _read_range(docs, {s: (done[s], goal[s]) for s in goal})
        sharded = mixture.shard_source(part.join(wanted.select("source", "shards").distinct(), "source"), F.col("shards")).drop("shards")
        mine = sharded.join(wanted.drop("shards"), SHARD)
        flagged = tokens.flag_long(encoded(mine, tokenizer, vocab), F.col("max_doc_tokens"), F.col("chat"))
        stores.write_tokens(flagged.withColumn("round", F.lit(number)), path, mode=mode, by=("round", *SHARD))
        found = stores.read_tokens(spark, path).where(F.col("round") == number).groupBy(*SHARD).agg(
            F.sum(F.when(F.col("dropped"), 0).otherwise(F.col("n_tokens") + 1)).alias("held"))
        for r in found.collect():
            held[r["source"], r["shard"]] += r["held"]
        number, mode = number + 1, "append"
        done.update(goal)
        least = {s: min(held[k] / b for k, b in budgets.items() if k[0] == s) for s in goal}
        goal = {}
        for s, share in least.items():
            span = sources[s]
            if share < 1 and done[s] < span["end"]:
                growth = min(8.0, max(1.3, 1.2 / share)) if share else 8.0
                goal[s] = reach(s, growth * (done[s] - span["first"]) / (span["end"] - span["first"]))
    return stores.read_tokens(spark, path).drop("round")


INFO_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("tokens", T.LongType()), T.StructField("docs", T.LongType()),
    T.StructField("dropped_too_long", T.LongType()), T.StructField("budget", T.LongType()), T.StructField("max_doc_tokens", T.IntegerType()),
    T.StructField("tokenizer", T.StringType()), T.StructField("digest", T.StringType()), T.StructField("ids_digest", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("shard", T.IntegerType()),
])


def read_info(spark: SparkSession, path: str) -> DataFrame | None:
    """Records of the shards of a prepared folder; None where nothing was prepared."""
    try:
        return plan_table(spark.read.schema(INFO_SCHEMA).parquet(f"{path}/info"))
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def _write_info(info: DataFrame, path: str) -> None:
    """Records of some shards; those of others stay."""
    rows = info.select(*[F.col(f.name).cast(f.dataType) for f in INFO_SCHEMA])
    plan_table(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SHARD).parquet(f"{path}/info")


def with_digests(jobs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """Jobs with their source's number of shards and a digest of all that decides what a shard holds."""
    counts = jobs.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("shards"))
    parts = ["source", "shard", "shards", "budget", "max_doc_tokens"]
    made = F.sha2(F.concat_ws("\x1f", *[F.col(c).cast("string") for c in parts], F.lit(X.MIN_CHARS), F.lit(tokenizer), F.lit(version)), 256)
    return plan_table(jobs.join(counts, "source").withColumn("digest", made))


def ids_digest(shards: DataFrame) -> DataFrame:
    """One digest per shard of its documents' stored ids, in any order."""
    row = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.array_join(F.col("ids").cast("array<string>"), " ")), 256)
    word = F.conv(F.substring(row, 1, 15), 16, 10).cast("bigint")
    return shards.groupBy(*SHARD).agg(F.lower(F.hex(F.bit_xor(word))).alias("ids_digest"))


def finished_shards(spark: SparkSession, jobs: DataFrame, held: DataFrame, path: str) -> DataFrame:
    """Planned shards that are held as planned: same digest, and as many tokens stored as recorded (only lengths are read)."""
    records = held.select(*SHARD, "tokens", F.col("digest").alias("made"))
    same = plan_table(jobs.join(records, SHARD).where((F.col("made") == F.col("digest")) & (F.col("tokens") > 0)))
    if same.isEmpty():
        return same.select(*SHARD)
    lengths = stores.read_tokens(spark, f"{path}/tokens").groupBy(*SHARD).agg(F.sum("take").alias("held"))
    return same.join(lengths, SHARD).where(F.col("held") == F.col("tokens")).select(*SHARD)


def refuse_changes(jobs: DataFrame, held: DataFrame, path: str) -> None:
    """Fail if the folder holds shards that this mixture or tokenizer would make otherwise, or not at all."""
    records = held.select(*SHARD, F.col("digest").alias("made")).where("made != ''")
    other = records.join(jobs, SHARD, "left").where(~F.col("made").eqNullSafe(F.col("digest"))).select(*SHARD).take(3)
    if other:
        raise ValueError(f"{path} holds shards of another mixture, tokenizer or input, such as {other[0]}; use another folder, or changed='rewrite'")


def make_shards(spark: SparkSession, texts: DataFrame, jobs: DataFrame, path: str, tokenizer: str | ColumnTokenizer,
                vocab: DataFrame | None, tokens_per_doc: float) -> None:
    """Make the shards of ``jobs`` and replace what the folder holds of them; other shards stay as they are.

    Their records are withdrawn first, so that a run that ends half-way leaves no record of ids it has replaced.
    """
    name = tokenizer.name if isinstance(tokenizer, ColumnTokenizer) else tokenizer
    _write_info(jobs.select(*SHARD, "name", F.lit("").alias("digest"), *[
        F.lit(None).alias(c) for c in ("tokens", "docs", "dropped_too_long", "budget", "max_doc_tokens", "tokenizer", "ids_digest")]), path)
    held = tokens_until_full(texts, jobs, f"{path}/all_tokens", tokenizer, vocab, tokens_per_doc)
    width = block_width(held, "doc_id")
    kept = pack.budget_tokens(held.drop("ids"), jobs.select(*SHARD, "budget"), block=width)
    kept.write.mode("overwrite").parquet(f"{path}/placements")
    kept = spark.read.parquet(f"{path}/placements")
    ids = held.select(*SHARD, "doc_id", "ids")
    cut = pack.cut_to_take(kept.join(ids, [*SHARD, "doc_id"]), eos=tokens.EOS_ID)
    stores.write_tokens(cut.select(*SHARD, "doc_id", "start", "take", "ids"), f"{path}/tokens", replace_shards=True)
    stored_ids = stores.read_tokens(spark, f"{path}/tokens").join(jobs.select(*SHARD), SHARD, "left_semi")
    info = quality.shard_info(kept, name).join(ids_digest(stored_ids), SHARD, "left")
    _write_info(info.join(jobs.select(*SHARD, "name", "max_doc_tokens", "digest"), SHARD), path)


def publish(spark: SparkSession, jobs: DataFrame, path: str, tokenizer: str, mixture_name: str, recipe_digest: str) -> None:
    """Write the manifest and its totals once every planned shard is there, with the tokens its record tells; else an earlier one stays."""
    info = read_info(spark, path).join(jobs.select(*SHARD), SHARD, "left_semi").drop("name", "max_doc_tokens", "digest")
    totals = plan_table(quality.manifest_totals(info, jobs))
    stores.write_manifest(info, jobs, f"{path}/manifest")
    manifest = stores.read_manifest(spark, f"{path}/manifest")
    lengths = stores.read_tokens(spark, f"{path}/tokens").groupBy(*SHARD).agg((F.sum("take") * 4).alias("stored_bytes"))
    faults = joins.check_manifest(manifest, manifest.join(lengths, SHARD), tokenizer).take(1)
    if faults:
        raise ValueError(f"prepared folder: {faults[0]}")
    totals = totals.select(
        F.lit(mixture_name).alias("mixture"), F.lit(tokenizer).alias("tokenizer"), F.lit(recipe_digest).alias("recipe_digest"),
        "total_tokens", "shards", "total_weight")
    totals.coalesce(1).write.mode("overwrite").json(f"{path}/totals")


TOTALS_SCHEMA = "mixture string, tokenizer string, recipe_digest string, total_tokens bigint, shards bigint, total_weight double"


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TOTALS_SCHEMA).json(f"{path}/totals")


def read_prepared(spark: SparkSession, path: str) -> DataFrame:
    """Ids of the shards that the manifest names."""
    named = stores.read_manifest(spark, f"{path}/manifest").select(*SHARD)
    return stores.read_tokens(spark, f"{path}/tokens").join(plan_table(named), SHARD, "left_semi")


def _vocabulary(spark: SparkSession, texts: DataFrame, vocab: DataFrame | None, size: int, path: str) -> DataFrame:
    """The given vocabulary, the one this folder was begun with, or a new one from the planned sources."""
    if vocab is not None:
        return vocab
    try:
        return spark.read.parquet(f"{path}/vocab_{size}")
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
    tokens.build_vocab(texts.select("text"), size, first_id=tokens.FIRST_PIECE_ID).write.parquet(f"{path}/vocab_{size}")
    return spark.read.parquet(f"{path}/vocab_{size}")


def prepare_corpus(
    spark: SparkSession, docs: DataFrame, recipe: DataFrame, path: str, tokenizer: str | ColumnTokenizer,
    chat_sources: tuple[str, ...] = (), vocab: DataFrame | None = None, vocab_size: int = 50_000, tokens_per_doc: float = 500.0,
    chats: DataFrame | None = None, template: Callable[[Column], Column] = X.chat_text, changed: str = "refuse",
    mixture_name: str = "mixture", version: str = "",
) -> DataFrame:
    """Write tokens, records and manifest below ``path``; return the manifest with ``ids_digest`` and ``reused``.

    ``docs`` has (doc_id, source, text); ``chats``, if given, (doc_id, source, messages), rendered by ``template``.  Conversations
    and documents of ``chat_sources`` are subject to the recipe's length gate.  ``tokenizer`` is a column function with a name, or the
    name of the pieces of ``vocab`` (columns token, id from ``FIRST_PIECE_ID`` on); without one, the ``vocab_size`` most frequent pieces of the
    planned sources are numbered once per folder.  Pieces outside it are stored as their bytes, so no text is lost.

    Text is read and tokenized once, as far as the budgets need it, into ``path/all_tokens``; budgets are then cut from the
    stored lengths (a few bytes per document), and only documents inside a budget are read again.  Shards held as planned are
    reused; if nothing is to be made, nothing is written.  What else the folder holds is refused, or made anew with
    ``changed="rewrite"``.  Inputs are not compared: give a changed input another ``version``.
    """
    if changed not in ("refuse", "rewrite"):
        raise ValueError("changed must be 'refuse' or 'rewrite'")
    recipe = plan_table(recipe)
    faults = mixture.recipe_faults(recipe).take(1)
    if faults:
        raise ValueError(f"recipe: {faults[0]}")
    jobs = plan_table(mixture.plan_shards(recipe))
    named = [r["source"] for r in recipe.select("source").collect()]
    texts = all_texts(docs, chat_sources, chats, template).where(F.col("source").isin(named))
    name, key = (tokenizer.name,) * 2 if isinstance(tokenizer, ColumnTokenizer) else (tokenizer, tokenizer)
    if not isinstance(tokenizer, ColumnTokenizer):
        vocab = _vocabulary(spark, texts, vocab, vocab_size, path)
        key = f"{tokenizer}:{quality.table_fingerprint(vocab, ['token', 'id']).first()['fingerprint']}"
    jobs = with_digests(jobs, key, version)
    recipe_digest = quality.table_fingerprint(jobs, ["name", "weight", "digest"]).first()["fingerprint"]
    held = read_info(spark, path)
    reused, todo = [], jobs
    if held is not None:
        if changed == "refuse":
            refuse_changes(jobs, held, path)
        reused = [tuple(r) for r in finished_shards(spark, jobs, held, path).collect()]  # at most the recipe's shards
    reused = spark.createDataFrame(reused, "source string, shard int")
    if held is not None:
        todo = plan_table(jobs.join(reused, SHARD, "left_anti"))
    sources = {r["source"] for r in todo.select("source").collect()}
    if sources:
        make_shards(spark, texts.where(F.col("source").isin(list(sources))), todo, path, tokenizer, vocab, tokens_per_doc)
    if sources or not _published(spark, path, recipe_digest):
        publish(spark, jobs, path, name, mixture_name, recipe_digest)
    made = read_info(spark, path).select(*SHARD, "ids_digest")
    flags = reused.withColumn("reused", F.lit(True))
    return stores.read_manifest(spark, f"{path}/manifest").join(made, SHARD).join(flags, SHARD, "left").withColumn(
        "reused", F.coalesce("reused", F.lit(False)))


def _published(spark: SparkSession, path: str, recipe_digest: str) -> bool:
    try:
        return not read_totals(spark, path).where(F.col("recipe_digest") == recipe_digest).isEmpty()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
