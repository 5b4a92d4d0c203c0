"""Queries that write and read back: stores, manifests, logs, JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.catalog.registry import (
    CHAT_SOURCES, EOS, GATE, GRADED, JOBS, KEPT, PIECES_SQL, STREAM, TOK, WINDOW, digest, documents, graded_of, hash_sql, jobs_of,
    joined, kept_of, new_folder, placed_of, recipe_of, register,
)
from millrace.functions import text as X
from millrace.operators import evals, pack, quality, tokens
from millrace.plans import prepare
from millrace.session import stored, table
from millrace.sources import corpora, stores


@register("read_text", "SELECT doc_id, length(text)::BIGINT AS chars, md5(text) AS content FROM documents")
def read_text(spark, sf):
    folder = new_folder(spark, "jsonl")
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("body"))
    docs.write.option("compression", "gzip").json(folder)
    back = corpora.read_text(spark, folder, "body", "*.gz", [T.StructField("doc_id", T.LongType())])
    return back.select("doc_id", F.length("text").cast("bigint").alias("chars"), F.md5("text").alias("content"))


@register("read_sources", """
SELECT 'docs' AS source, count(*) AS rows, sum(length(text))::BIGINT AS chars FROM documents
UNION ALL SELECT 'bench', count(*), sum(length(text))::BIGINT FROM benchmark""")
def read_sources(spark, sf):
    readers = {
        "docs": lambda s: table(s, sf, "documents").select("text"),
        "bench": lambda s: table(s, sf, "benchmark").select("text"),
    }
    return corpora.read_sources(spark, ["docs", "bench"], readers).groupBy("source").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.length("text")).alias("chars"))


@register("write_tokens", f"""WITH {KEPT}
SELECT source, shard::INT AS shard, doc_id, take, md5(array_to_string(list_slice(list_append(ids, '{EOS}'), 1, take), ' ')) AS content
FROM kept WHERE NOT dropped""")
def write_tokens(spark, sf):
    folder = new_folder(spark, "tokens")
    stores.write_tokens(pack.cut_to_take(kept_of(spark, sf), eos=EOS).drop("text"), folder)
    return stores.read_tokens(spark, folder).select("source", "shard", "doc_id", "take", digest("ids").alias("content"))


@register("read_tokens", f"""WITH {KEPT}
SELECT source, count(*) AS docs, sum(take)::BIGINT AS tokens FROM kept WHERE NOT dropped AND source IN ('src1', 'src7') GROUP BY source""")
def read_tokens(spark, sf):
    folder = new_folder(spark, "tokens")
    stores.write_tokens(pack.cut_to_take(kept_of(spark, sf), eos=EOS).drop("text"), folder)
    return stores.read_tokens(spark, folder, ["src1", "src7"]).groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(F.size("ids")).alias("tokens"))


def _code_sql(tok: str) -> str:
    return f"({hash_sql('0', tok)} % 60000)"


def _coded(kept):
    """Budgeted documents as 16-bit ids (hash of the piece)."""
    from millrace.functions.seeded import seeded_below

    cut = pack.cut_to_take(kept, eos=EOS)
    return cut.withColumn("ids", F.transform("ids", lambda t: seeded_below(F.lit(60000), 0, t).cast("int")))


@register("write_token_bytes", f"""WITH {STREAM}
SELECT source || '_p' || shard AS folder, count(*) * 2 AS bytes FROM stream GROUP BY source, shard""")
def write_token_bytes(spark, sf):
    folder = new_folder(spark, "bytes")
    stores.write_token_bytes(_coded(kept_of(spark, sf)).select("source", "shard", "doc_id", "ids"), folder, 2, 256)
    files = corpora.list_files(spark, folder, "*.ds")
    return files.groupBy(F.regexp_extract("path", r"([^/]+)/part-[0-9]+\.ds$", 1).alias("folder")).agg(
        F.sum("length").alias("bytes"))


@register("read_token_bytes", f"""WITH {STREAM}
SELECT source || '_p' || shard AS folder, (place // 65)::BIGINT AS win, md5(string_agg({_code_sql("tok")}::VARCHAR, ' ' ORDER BY place)) AS content
FROM stream GROUP BY source, shard, place // 65 HAVING count(*) = 65""")
def read_token_bytes(spark, sf):
    folder = new_folder(spark, "bytes")
    stores.write_token_bytes(_coded(kept_of(spark, sf)).select("source", "shard", "doc_id", "ids"), folder, 4, 256)
    win = stores.read_token_bytes(spark, folder, 64, 4, range_bytes=1 << 14)
    return win.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("folder"), "win", digest("ids").alias("content"))


SKIPPED, MOST = 100, 1000


@register("read_token_bytes_part", f"""WITH {STREAM}
SELECT source || '_p' || shard AS folder, ((place - {SKIPPED}) // 33)::BIGINT AS win, md5(string_agg({_code_sql("tok")}::VARCHAR, ' ' ORDER BY place)) AS content
FROM stream WHERE place >= {SKIPPED} AND place < {SKIPPED + MOST} GROUP BY source, shard, (place - {SKIPPED}) // 33 HAVING count(*) = 33""")
def read_token_bytes_part(spark, sf):
    """Windows of a stretch of every stream: ids passed over at its beginning, and a number of ids from there."""
    folder = new_folder(spark, "bytes")
    stores.write_token_bytes(_coded(kept_of(spark, sf)).select("source", "shard", "doc_id", "ids"), folder, 2, 64)
    win = stores.read_token_bytes(spark, folder, 32, 2, range_bytes=500, skip=SKIPPED, most=MOST)
    return win.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("folder"), "win", digest("ids").alias("content"))


@register("write_manifest", f"""WITH {KEPT}
SELECT source, shard::INT AS shard, max(name) AS name, sum(take)::BIGINT AS tokens, count(*) FILTER (WHERE NOT dropped) AS docs,
       count(*) FILTER (WHERE dropped) AS dropped_too_long, max(kept.budget)::BIGINT AS budget, {GATE} AS max_doc_tokens,
       'pieces' AS tokenizer, max(weight) AS weight
FROM kept JOIN jobs USING (source, shard) GROUP BY source, shard""")
def write_manifest(spark, sf):
    folder = new_folder(spark, "manifest")
    info = quality.shard_info(placed_of(spark, sf)[0], "pieces")
    stores.write_manifest(info, jobs_of(table(spark, sf, "documents")), folder)
    return stores.read_manifest(spark, folder)


#: Length gate of the whole job, whose ids are more than its pieces.
ID_GATE = 4000


def coded_sql(vocab_size: int, texts: str, budget: str = "budget_tokens") -> str:
    """Prepared documents and conversations: ids with byte fallback, budgets over their lengths."""
    return f"""texts AS ({texts}),
recipe AS (
  SELECT source, {budget} AS budget_tokens, shards, sampling_weight, max_doc_tokens FROM (
    SELECT source, count(*) * 400 AS budget_tokens, 1 + try_cast(substr(source, 4) AS INT) % 3 AS shards,
           (1 + try_cast(substr(source, 4) AS INT) % 2)::DOUBLE AS sampling_weight, {ID_GATE} AS max_doc_tokens FROM texts WHERE source <> 'chat' GROUP BY source
    UNION ALL SELECT source, count(*) * 100, 2, 1.0, {ID_GATE} FROM texts WHERE source = 'chat' GROUP BY source)),
{JOBS.split("),", 1)[1].strip()},
counts AS (SELECT token, count(*) AS n FROM (SELECT unnest({PIECES_SQL}) AS token FROM texts) GROUP BY token),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 258)::INT AS id FROM counts ORDER BY n DESC, token LIMIT {vocab_size}),
long AS (
  SELECT source, doc_id, unnest({PIECES_SQL}) AS token, generate_subscripts({PIECES_SQL}, 1) AS ix FROM texts WHERE length(text) >= 50),
spelt AS (
  SELECT source, doc_id, ix, token, id, CASE WHEN id IS NOT NULL THEN [id] ELSE
         list_append(list_transform(range(0, strlen(token)), lambda i: ('0x' || substr(hex(token), 2 * i + 1, 2))::INT + 2), 258) END AS own
  FROM long LEFT JOIN vocab USING (token)),
tok AS (
  SELECT t.source, t.doc_id, coalesce(flatten(list(own ORDER BY ix) FILTER (own IS NOT NULL)), []::INT[]) AS ids, len(ids)::BIGINT AS n
  FROM texts t LEFT JOIN spelt s ON t.source = s.source AND t.doc_id = s.doc_id WHERE length(text) >= 50 GROUP BY t.source, t.doc_id),
sharded AS (
  SELECT t.*, {hash_sql("0", "doc_id")} % r.shards AS shard, source IN ('src0', 'src1', 'src2', 'chat') AND n >= {ID_GATE} AS dropped
  FROM tok t JOIN recipe r USING (source)),
sized AS (SELECT *, CASE WHEN dropped THEN 0 ELSE n + 1 END AS size FROM sharded),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY source, shard ORDER BY doc_id) - size)::BIGINT AS start FROM sized),
kept AS (
  SELECT p.*, j.budget, least(size, budget - start)::BIGINT AS take FROM placed p JOIN jobs j USING (source, shard) WHERE start < budget),
stored AS (SELECT source, shard, doc_id, list_slice(list_append(ids, 0), 1, take) AS ids FROM kept WHERE NOT dropped),
digests AS (
  SELECT source, shard, printf('%x', bit_xor(('0x' || substr(sha256(doc_id || ':' || array_to_string(ids, ' ')), 1, 15))::BIGINT)) AS ids_digest
  FROM stored GROUP BY source, shard),
prepared AS (
  SELECT source, shard::INT AS shard, sum(take)::BIGINT AS tokens, count(*) FILTER (WHERE NOT dropped) AS docs,
         count(*) FILTER (WHERE dropped) AS dropped_too_long, max(ids_digest) AS ids_digest
  FROM kept LEFT JOIN digests USING (source, shard) GROUP BY source, shard)"""


RENDERED = """SELECT 'chat' AS source, conv_id AS doc_id, string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) AS text
FROM conversations GROUP BY conv_id"""
PREPARED = f"SELECT source, doc_id, text FROM documents UNION ALL {RENDERED}"


def chats_of(spark, sf):
    chat = corpora.read_chat(spark, f"{sf}/conversations.parquet", role_map=X.ROLE_MAP_WITH_SYSTEM)
    return chat.select(F.col("conv_id").alias("doc_id"), F.lit("chat").alias("source"), "messages")


def prepared_recipe(docs, chats, budget=None):
    """The recipe of the documents and one source of conversations; ``budget`` changes budgets."""
    chat = chats.groupBy("source").agg((F.count(F.lit(1)) * 100).alias("budget_tokens")).select(
        "source", "budget_tokens", F.lit(2).alias("shards"), F.lit(1.0).alias("sampling_weight"), F.lit(ID_GATE).alias("max_doc_tokens"))
    both = recipe_of(docs).withColumn("max_doc_tokens", F.lit(ID_GATE)).unionByName(chat)
    return both if budget is None else both.withColumn("budget_tokens", budget)


@register("prepare_corpus", f"WITH {coded_sql(2000, PREPARED)} SELECT * FROM prepared")
def prepare_corpus(spark, sf):
    """The whole job: documents and conversations to stored ids, placements, records and manifest."""
    docs, chats = documents(spark, sf), stored(chats_of(spark, sf), "chats")
    manifest = prepare.prepare_corpus(
        spark, docs, prepared_recipe(docs, chats), new_folder(spark, "corpus"), "pieces", CHAT_SOURCES, vocab_size=2000, chats=chats)
    return manifest.select("source", "shard", "tokens", "docs", "dropped_too_long", "ids_digest")


HALVED = "CASE WHEN source IN ('src1', 'chat') THEN budget_tokens // 2 ELSE budget_tokens END"


@register("prepare_corpus_again", f"WITH {coded_sql(500, PREPARED, HALVED)} SELECT *, source NOT IN ('src1', 'chat') AS reused FROM prepared")
def prepare_corpus_again(spark, sf):
    """The job run twice into one folder, two sources with half their budget the second time: only these are made anew."""
    docs, chats, folder = documents(spark, sf), stored(chats_of(spark, sf), "chats"), new_folder(spark, "corpus")
    run = lambda budget, changed: prepare.prepare_corpus(
        spark, docs, prepared_recipe(docs, chats, budget), folder, "pieces", CHAT_SOURCES, vocab_size=500, chats=chats, changed=changed)
    run(None, "refuse")
    halved = F.when(F.col("source").isin("src1", "chat"), F.expr("budget_tokens div 2")).otherwise(F.col("budget_tokens"))
    return run(halved, "rewrite").select("source", "shard", "tokens", "docs", "dropped_too_long", "ids_digest", "reused")


@register("append_run_log", "SELECT event_type AS run, count(*) * 2 AS rows, round(sum(value) * 2, 4) AS seconds FROM events GROUP BY 1")
def append_run_log(spark, sf):
    folder = new_folder(spark, "log")
    log = table(spark, sf, "events").select("event_type", "event_id", "value")
    for _ in range(2):
        stores.append_run_log(log, folder)
    back = stores.read_run_log(spark, folder, "event_type string, event_id bigint, value double")
    return back.groupBy(F.col("event_type").alias("run")).agg(
        F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 4).alias("seconds"))


@register("write_graded", f"""WITH {GRADED}
SELECT bench, count(*) AS samples, sum(correct::INT)::BIGINT AS correct, sum(tokens)::BIGINT AS tokens FROM graded GROUP BY bench""")
def write_graded(spark, sf):
    folder = new_folder(spark, "graded")
    graded = graded_of(spark, sf)
    stores.write_graded(graded, evals.eval_summary(graded), folder)
    back = spark.read.schema("bench string, correct boolean, tokens bigint").json(f"{folder}/graded")
    return back.groupBy("bench").agg(
        F.count(F.lit(1)).alias("samples"), F.sum(F.col("correct").cast("int")).alias("correct"), F.sum("tokens").alias("tokens"))


@register("synthetic_tokens", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row FROM documents),
x AS (SELECT row, i, {hash_sql("8", "row", "i")} % 1000 AS tok,
             CASE WHEN row > 0 OR i < 4 THEN i WHEN i < 10 THEN i - 4 ELSE i - 10 END AS pos FROM r, (SELECT unnest(range(33)) AS i))
SELECT row, md5(string_agg(tok::VARCHAR, ' ' ORDER BY i)) AS ids, md5(string_agg(pos::VARCHAR, ' ' ORDER BY i)) AS positions FROM x GROUP BY row""")
def synthetic_tokens(spark, sf):
    n = table(spark, sf, "documents").count()
    return corpora.synthetic_tokens(spark, n, 32, 1000, 8, True).select("row", digest("ids").alias("ids"), digest("positions").alias("positions"))


@register("list_files", """
SELECT 'documents' AS file, count(*)::BIGINT AS rows, true AS sized FROM documents UNION ALL SELECT 'labels', count(*)::BIGINT, true FROM labels""")
def list_files(spark, sf):
    folder = new_folder(spark, "files")
    for name in ("documents", "labels"):
        table(spark, sf, name).write.parquet(f"{folder}/{name}")
    listed = corpora.list_files(spark, folder, "*.parquet").groupBy(
        F.regexp_extract("path", r"([^/]+)/part-[^/]+$", 1).alias("file")).agg((F.min("length") > 0).alias("sized"))
    rows = [spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("file")) for name in ("documents", "labels")]
    held = rows[0].unionByName(rows[1]).groupBy("file").agg(F.count(F.lit(1)).alias("rows"))
    return listed.join(held, "file").select("file", "rows", "sized")


@register("read_partial_jsonl", """
SELECT 'k' || doc_id AS key, CASE WHEN doc_id % 3 = 0 THEN n_chars + 1 ELSE n_chars END AS tokens FROM documents WHERE doc_id % 7 <> 6""")
def read_partial_jsonl(spark, sf):
    """Lines of one run per file; every third key was written twice, every seventh line is torn."""
    folder = new_folder(spark, "partial")
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    line = lambda tokens: F.to_json(F.struct(F.concat(F.lit("k"), F.col("doc_id")).alias("key"), tokens.alias("tokens")))
    whole = line(F.col("n_chars"))
    torn = F.when(F.col("doc_id") % 7 == 6, F.substr(whole, F.lit(1), F.length(whole) - 2)).otherwise(whole)
    lines = F.when(
        (F.col("doc_id") % 3 == 0) & (F.col("doc_id") % 7 != 6), F.array(torn, line(F.col("n_chars") + 1))
    ).otherwise(F.array(torn))
    docs.select(F.explode(lines).alias("value")).write.text(folder)
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("tokens", T.LongType())])
    return corpora.read_partial_jsonl(spark, folder, schema, "key")


@register("check_token_metadata", """
SELECT source AS folder, 'other' AS tokenizer, 2 AS width FROM documents WHERE source IN ('src3', 'src11') GROUP BY source""")
def check_token_metadata(spark, sf):
    folder = new_folder(spark, "metadata")
    names = table(spark, sf, "documents").select("source").distinct()
    odd = F.col("source").isin("src3", "src11")
    names.select("source", F.when(odd, "other|2").otherwise("pieces|4").alias("value")).write.partitionBy("source").text(folder)
    folders = {r["source"]: f"{folder}/source={r['source']}" for r in names.collect()}
    return corpora.check_token_metadata(spark, folders)
