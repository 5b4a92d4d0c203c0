"""One query per operator on the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (
    byte_pairs, conversation_repair, language_id, mixing, near_dedup, nearest, packing, periodic_runs, quality_model, quality_rules, sql, token_files,
    toxicity, warc,
)
from millrace.llm.sampling import fold
from millrace.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path(name)


def with_crc(df: DataFrame, ids: str = "ids") -> DataFrame:
    """Replace little-endian ids by their number and CRC-32, both read from the bytes."""
    return df.withColumns({"n_tokens": (F.octet_length(ids) / 4).cast("bigint"), "ids_crc32": F.crc32(ids)}).drop(ids)


@register("op5_token_files")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's place, length and checksum, from the files that hold its ids."""
    manifest = token_files.write_tokens(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
    return with_crc(token_files.read_documents(manifest)).select("doc_id", "start", "n_tokens", "ids_crc32")


@register("op8_packing")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    """Place of every piece of every document in sequences of 2048 ids."""
    docs = table(spark, sf, "documents")
    rows = packing.pieces(docs, vocabulary("byte_bpe_50k.json")).withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(rows, packing.groups_for(docs.count())).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )


@register("op2_quality_rules", sql.QUALITY)
def op2(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and verdict of every document."""
    judged = quality_rules.apply_rules(table(spark, sf, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@register("op4_mixing", sql.MIXING)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@register("op6_warc", sql.WARC)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as its archive record tells it; sizes and digests of responses are taken from the payload read."""
    records = warc.read_records(warc.write_archives(table(spark, sf, "pages")))
    payload = F.col("payload")
    return records.select(
        "page_id", F.coalesce(F.octet_length(payload).cast("bigint"), F.col("payload_bytes")).alias("payload_bytes"),
        F.coalesce(F.sha2(payload, 256), F.col("payload_digest")).alias("payload_digest"), "record_type", "refers_to",
    )


@register("op7_near_dedup", sql.NEAR)
def op7(spark: SparkSession, sf: str) -> DataFrame:
    """Component of every document under links of 80 % of shared word pairs."""
    return near_dedup.near_duplicates(table(spark, sf, "documents"), 80, 2).select("doc_id", "n_shingles", "component_id", "kept")


def language_model(docs: DataFrame) -> language_id.Model | None:
    """Learned outside the held-out fifth of the documents."""
    return language_id.train(docs.where(fold("doc_id", 5) != 0))


@register("op3_language_id")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    found = language_id.predict(docs.select("doc_id", "text"), language_model(docs))
    return found.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score", "rejected")


@register("op10_toxicity")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    labels = table(spark, sf, "labels").where(fold("doc_id", 3) != 1)
    found = toxicity.predict(docs, toxicity.train(docs, labels))
    return found.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted", "matches")


@register("op9_quality_model")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    seen = fold("doc_id", 3) != 1
    model = quality_model.train(docs.where(seen), table(spark, sf, "labels").where(seen).where("quality = 1"))
    return quality_model.predict(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


@register("op1_nearest")
def op1(spark: SparkSession, sf: str) -> DataFrame:
    """Ten nearest vectors of every hundredth vector."""
    return nearest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 100 == 0, 10)


@register("op12_byte_pairs")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of what they decode to."""
    from public_tokenizers import PATTERN

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    ids = byte_pairs.encode(table(spark, sf, "documents").select("doc_id", "text"), ranks, PATTERN, keep=["doc_id"])
    back = byte_pairs.decode(ids, ranks)
    return back.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def repeated_tail(g: int, n: int) -> tuple[int, int]:
    """First word and period of the tail that a planted repetition takes in a text of n words."""
    first = g % n
    return first, 1 + (n - first) // (3 + g % 8)


@register("op13_periodic_runs", sql.RUNS)
def op13(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of every document, a tenth of which get a repeated tail first, and the text without the repetitions."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    docs = table(spark, sf, "documents").select("doc_id", "text", F.when(h % 10 == 0, F.floor(h / 10)).alias("g"))
    found = periodic_runs.periodic_runs(docs, tail=("g", repeated_tail), keep=["doc_id"])
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"), F.expr("1000 * best.length div -best.p").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with faults planted by a hash of conversation and turn; nulls are read as one blank."""
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in rows.columns}
    fault = F.pmod(F.crc32(F.concat_ws(":", text["conv_id"], text["turn"]).cast("binary")), F.lit(20))
    told = rows.select(
        "conv_id", "turn", F.when(fault == 4, "user").otherwise(text["role"]).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text["text"], "[.!?]", "")).otherwise(text["text"]).alias("text"), fault.alias("fault"),
    ).where("fault != 0")
    copies = F.when(F.col("fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return told.withColumn("copy", F.explode(copies)).drop("fault", "copy")


@register("op11_conversation_repair", sql.REPAIR)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    """Faults, cheapest edits and digest of the repaired text of every conversation, after planted damage."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    found = conversation_repair.results(conversation_repair.repair(damaged(rows))).alias("f")
    every = rows.select("conv_id").distinct().alias("e")
    told = every.join(found, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")), "left")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    return told.select(
        "e.conv_id", *(F.coalesce(f"f.{c}", F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("f.repaired_sha256", nothing).alias("repaired_sha256"),
    )
