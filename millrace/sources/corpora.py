"""Readers of chat and text corpora, splits, JSON lines and file lists."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.functions import text as X
from millrace.functions.seeded import seeded_below
from millrace.operators.ordering import hash_order
from millrace.operators.tokens import normalize_roles

MESSAGES = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("content", T.StringType())]))


def messages_from_turns(turns: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation with its messages in turn order; no messages, no row."""
    return turns.groupBy(conv_col).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))),
            lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")),
        ).alias("messages")
    )


def read_chat(
    spark: SparkSession, path: str, conv_col: str = "conv_id", role_map: dict[str, str] | None = X.ROLE_MAP,
    fmt: str = "parquet", messages_col: str | None = None, role_key: str = "role", content_key: str = "content",
) -> DataFrame:
    """Chat corpus as (conv_id, messages).

    Either a table of turns (conv, turn, role, text), or rows that already hold a list of messages in
    ``messages_col`` whose fields are ``role_key`` and ``content_key``; rows with an empty list are
    skipped.
    """
    if messages_col is None:
        turns = spark.read.format(fmt).load(path)
        docs = messages_from_turns(turns, conv_col)
    else:
        schema = T.StructType([
            T.StructField(conv_col, T.LongType()),
            T.StructField(messages_col, T.ArrayType(T.StructType([
                T.StructField(role_key, T.StringType()), T.StructField(content_key, T.StringType())]))),
        ])
        docs = spark.read.schema(schema).format(fmt).load(path).where(F.size(messages_col) > 0).select(
            conv_col,
            F.transform(
                messages_col,
                lambda m: F.struct(m[role_key].alias("role"), m[content_key].alias("content")),
            ).alias("messages"),
        )
    return docs if role_map is None else normalize_roles(docs, role_map)


def read_text(spark: SparkSession, path: str | Sequence[str], text_col: str = "text", glob: str | None = None,
              extra: Sequence[T.StructField] = ()) -> DataFrame:
    """JSON or JSON-lines files (plain, .gz, or .zst where the codec is installed) with one text column.

    The schema is given, so nothing is read to infer it; ``glob`` picks file names.
    """
    reader = spark.read.schema(T.StructType([*extra, T.StructField(text_col, T.StringType())]))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.json(list(path) if not isinstance(path, str) else path).withColumnRenamed(text_col, "text")


def read_sources(spark: SparkSession, wanted: Sequence[str],
                 readers: Mapping[str, Callable[[SparkSession], DataFrame]]) -> DataFrame:
    """Union of named sources, each by its own reader; an unknown name is an error."""
    unknown = [s for s in wanted if s not in readers]
    if unknown:
        raise ValueError(f"unknown sources {unknown}")
    out = None
    for name in wanted:
        part = readers[name](spark).withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def read_splits(df_or_dict: DataFrame | Mapping[str, DataFrame], splits: str | Sequence[str],
                split_col: str = "split") -> dict[str, DataFrame]:
    """Split name -> rows, from a partition column or from a dict; other names are errors."""
    names = [splits] if isinstance(splits, str) else list(splits)
    for name in names:
        if "train" not in name and "test" not in name:
            raise ValueError(f"split {name!r} is neither a train nor a test split")
    if isinstance(df_or_dict, Mapping):
        return {name: df_or_dict[name] for name in names}
    return {name: df_or_dict.where(F.col(split_col) == name).drop(split_col) for name in names}


def synthetic_tokens(spark: SparkSession, n: int, L: int, vocab: int, seed: int, positions: bool = False) -> DataFrame:
    """``n`` rows of ``L + 1`` token ids below ``vocab`` from hashes of (seed, row, place).

    With ``positions`` the first row's documents have lengths 4, 6 and the rest, all others are one
    document.
    """
    rows = spark.range(n).withColumnRenamed("id", "row")
    return rows.select("row", *synthetic_columns(F.col("row"), L, vocab, seed, positions))


def synthetic_columns(row: Column, L: int, vocab: int, seed: int, positions: bool) -> list[Column]:
    place = F.sequence(F.lit(0), F.lit(L))
    ids = F.transform(place, lambda i: seeded_below(F.lit(vocab), seed, row, i).cast("int"))
    if not positions:
        return [ids.alias("ids")]
    # Lengths of the first documents of the first row.
    cut = F.concat(F.sequence(F.lit(0), F.lit(3)), F.sequence(F.lit(0), F.lit(5)), F.sequence(F.lit(0), F.lit(L - 10)))
    return [ids.alias("ids"), F.when(row == 0, cut).otherwise(place).alias("positions")]


def list_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, length) of matching files in order; none at all is an error.  Contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    files = reader.load(path).select("path", "length")
    if files.isEmpty():
        raise FileNotFoundError(f"no files match {pattern or '*'} in {path}")
    return files.orderBy("path")


def read_partial_jsonl(spark: SparkSession, path: str, schema: T.StructType, key: str) -> DataFrame:
    """Append-only JSON lines: torn lines are left out, the last record of a key wins.

    Rows are ranked by file and place in the file, so files stay splittable.
    """
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = (
        spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record")
        .json(path)
        .select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_from"),
                F.monotonically_increasing_id().alias("_row"))
    )
    # Within one split rows are numbered in reading order; the split's own start sorts the splits.
    good = rows.where(F.col("_corrupt_record").isNull() & F.col(key).isNotNull())
    fields = [f.name for f in schema.fields]
    last = good.groupBy(key).agg(
        F.max_by(F.struct(*[F.col(f) for f in fields if f != key]), F.struct("_file", "_from", "_row")).alias("_last")
    )
    return last.select(key, "_last.*").select(*fields)


def check_token_metadata(spark: SparkSession, folders: Mapping[str, str]) -> DataFrame:
    """Folders whose ``tokenizer|bytes`` line differs from the most common one; no rows means agreement."""
    lines = None
    for name, folder in folders.items():
        part = spark.read.text(folder).select(F.lit(name).alias("folder"), F.col("value"))
        lines = part if lines is None else lines.unionByName(part)
    heads = lines.where(F.contains("value", F.lit("|"))).select(
        "folder", F.split_part("value", F.lit("|"), F.lit(1)).alias("tokenizer"),
        F.split_part("value", F.lit("|"), F.lit(2)).try_cast("int").alias("width"),
    )
    return disagreeing(heads)


def disagreeing(heads: DataFrame) -> DataFrame:
    """Rows of (folder, tokenizer, width) off the most common pair (the first by name on ties)."""
    votes = heads.groupBy("tokenizer", "width").agg(F.count(F.lit(1)).alias("_n"))
    best = votes.agg(F.min_by(F.struct("tokenizer", "width"), F.struct(-F.col("_n"), "tokenizer", "width")).alias("best"))
    return heads.withColumn("_best", best.scalar()).where(
        ~F.struct("tokenizer", "width").eqNullSafe(F.col("_best"))
    ).drop("_best")
