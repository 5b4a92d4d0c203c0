"""Queries over corpus preparation: readers, filters, tokens, gate, budgets, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import (
    CHAT_SOURCES, EOS, GATE, JOBS, KEPT, PIECES_SQL, RECIPE, STREAM, TOK, WINDOW, digest, documents, hash_sql, jobs_of, joined,
    kept_of, placed_of, recipe_of, register,
)
from millrace.functions import text as X
from millrace.operators import joins, mixture, ordering, pack, quality, tokens
from millrace.plans import prepare
from millrace.session import stored, table
from millrace.sources import corpora

CHAT_SQL = """string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn)"""


@register("read_chat", """
SELECT conv_id, count(*) AS messages, md5(string_agg(role || ':' || text, '|' ORDER BY turn)) AS content
FROM conversations GROUP BY conv_id""")
def read_chat(spark, sf):
    chat = corpora.read_chat(spark, f"{sf}/conversations.parquet", role_map=X.ROLE_MAP_WITH_SYSTEM)
    return chat.select(
        "conv_id", F.size("messages").cast("bigint").alias("messages"),
        F.md5(F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|")).alias("content"),
    )


@register("render_chat", f"""
SELECT conv_id, length({CHAT_SQL})::BIGINT AS chars,
       md5({CHAT_SQL} || '<|im_start|>assistant' || chr(10)) AS prompt_digest
FROM conversations GROUP BY conv_id""")
def render_chat(spark, sf):
    chat = corpora.read_chat(spark, f"{sf}/conversations.parquet", role_map=None)
    both = tokens.render_chat(tokens.render_chat(chat), add_prompt=True, out="prompt")
    return both.select("conv_id", F.length("text").cast("bigint").alias("chars"), F.md5("prompt").alias("prompt_digest"))


@register("normalize_roles", """
SELECT role, count(*) AS n FROM conversations GROUP BY role""")
def normalize_roles(spark, sf):
    raw = table(spark, sf, "conversations").replace({"user": "human", "assistant": "gpt"}, subset=["role"])
    chat = tokens.normalize_roles(corpora.messages_from_turns(raw), X.ROLE_MAP_WITH_SYSTEM)
    return chat.select(F.explode("messages").alias("m")).groupBy(F.col("m.role").alias("role")).agg(
        F.count(F.lit(1)).alias("n"))


@register("drop_short_text", """
SELECT doc_id, source FROM documents WHERE length(text) >= 50""")
def drop_short_text(spark, sf):
    return tokens.drop_short_text(table(spark, sf, "documents")).select("doc_id", "source")


@register("tokenize", f"""
SELECT doc_id, len({PIECES_SQL})::BIGINT AS n_tokens,
       md5(array_to_string(list_append({PIECES_SQL}, '{EOS}'), ' ')) AS content
FROM documents WHERE length(text) >= 50""")
def tokenize(spark, sf):
    docs = tokens.drop_short_text(documents(spark, sf))
    return tokens.tokenize(docs, eos=EOS).select("doc_id", "n_tokens", digest("ids").alias("content"))


VOCAB = f"""counts AS (
  SELECT token, count(*) AS n FROM (SELECT unnest({PIECES_SQL}) AS token FROM documents) GROUP BY token),
vocab AS (
  SELECT token, (row_number() OVER (ORDER BY n DESC, token) + 1)::INT AS id, n FROM counts
  ORDER BY n DESC, token LIMIT 500)"""


@register("build_vocab", f"WITH {VOCAB} SELECT token, id, n FROM vocab")
def build_vocab(spark, sf):
    return tokens.build_vocab(documents(spark, sf), 500)


@register("vocab_fits", f"WITH {VOCAB} SELECT token, id, n FROM vocab WHERE id >= 400")
def vocab_fits(spark, sf):
    return tokens.vocab_fits(tokens.build_vocab(documents(spark, sf), 500), 400)


ENCODED = f"""{VOCAB},
long AS (
  SELECT doc_id, unnest({PIECES_SQL}) AS token, generate_subscripts({PIECES_SQL}, 1) AS ix
  FROM documents WHERE length(text) >= 50),
coded AS (
  SELECT doc_id, ix, coalesce(id, 1) AS id FROM long LEFT JOIN vocab USING (token)),
kept AS (SELECT doc_id FROM documents WHERE length(text) >= 50)"""


@register("encode_ids", f"""WITH {ENCODED}
SELECT doc_id, count(ix) AS n_tokens, (count(ix) FILTER (WHERE id = 1)) AS unknown,
       md5(coalesce(string_agg(id::VARCHAR, ' ' ORDER BY ix), '')) AS content
FROM kept LEFT JOIN coded USING (doc_id) GROUP BY doc_id""")
def encode_ids(spark, sf):
    docs = documents(spark, sf)
    coded = tokens.encode_ids(prepare.tokenized(docs.select("doc_id", "text")).drop("text"), stored(tokens.build_vocab(docs, 500), "vocab"))
    return coded.select(
        "doc_id", "n_tokens", F.size(F.filter("ids", lambda i: i == tokens.UNKNOWN_ID)).cast("bigint").alias("unknown"),
        digest("ids").alias("content"))


@register("encode_ids_by_join", f"""WITH {ENCODED}
SELECT doc_id, count(ix) AS n_tokens, md5(coalesce(string_agg(id::VARCHAR, ' ' ORDER BY ix), '')) AS content
FROM kept LEFT JOIN coded USING (doc_id) GROUP BY doc_id""")
def encode_ids_by_join(spark, sf):
    docs = documents(spark, sf)
    tok = prepare.tokenized(docs.select("doc_id", "text")).drop("text")
    coded = tokens.encode_ids_by_join(tok, tokens.build_vocab(docs, 500), "ids", "ids")
    return coded.select("doc_id", "n_tokens", digest("ids").alias("content"))


CODED_BYTES = f"""{VOCAB},
long AS (
  SELECT doc_id, unnest({PIECES_SQL}) AS token, generate_subscripts({PIECES_SQL}, 1) AS ix FROM documents WHERE length(text) >= 50),
spelt AS (
  SELECT doc_id, ix, token, CASE WHEN id IS NOT NULL THEN [id + 257] ELSE
         list_append(list_transform(range(0, strlen(token)), lambda i: ('0x' || substr(hex(token), 2 * i + 1, 2))::INT + 2), 258) END AS ids
  FROM long LEFT JOIN vocab USING (token)),
kept AS (SELECT doc_id FROM documents WHERE length(text) >= 50)"""


def with_bytes(spark, sf, max_broadcast=tokens.BROADCAST_VOCAB_ROWS):
    """Documents as ids of 500 pieces, the other pieces spelt in bytes, and that vocabulary."""
    docs = documents(spark, sf)
    vocab = stored(tokens.build_vocab(docs, 500, first_id=tokens.FIRST_PIECE_ID), "vocab")
    tok = prepare.tokenized(docs.select("doc_id", "text")).drop("text", "n_tokens")
    return tokens.encode_ids(tok, vocab, max_broadcast=max_broadcast, byte_fallback=True), vocab


ENCODED_BYTES = f"""WITH {CODED_BYTES}
SELECT doc_id, coalesce(sum(len(ids)), 0)::BIGINT AS n_ids, (count(ix) FILTER (WHERE ids[-1] = 258)) AS spelt,
       md5(coalesce(string_agg(array_to_string(ids, ' '), ' ' ORDER BY ix), '')) AS content
FROM kept LEFT JOIN spelt USING (doc_id) GROUP BY doc_id"""


def bytes_result(coded):
    return coded.select(
        "doc_id", F.size("ids").cast("bigint").alias("n_ids"),
        F.size(F.filter("ids", lambda i: i == tokens.BYTES_END_ID)).cast("bigint").alias("spelt"), digest("ids").alias("content"))


@register("encode_ids_bytes", ENCODED_BYTES)
def encode_ids_bytes(spark, sf):
    return bytes_result(with_bytes(spark, sf)[0])


@register("encode_ids_bytes_by_join", ENCODED_BYTES)
def encode_ids_bytes_by_join(spark, sf):
    return bytes_result(with_bytes(spark, sf, 0)[0])


PIECES_BACK = f"""SELECT doc_id, len({PIECES_SQL})::BIGINT AS n_pieces, md5(array_to_string({PIECES_SQL}, ' ')) AS content
FROM documents WHERE length(text) >= 50"""


def pieces_result(back):
    return back.select("doc_id", F.size("pieces").cast("bigint").alias("n_pieces"), digest("pieces").alias("content"))


@register("pieces_of", PIECES_BACK)
def pieces_of(spark, sf):
    """Every piece of every text, read back from ids."""
    return pieces_result(tokens.pieces_of(*with_bytes(spark, sf)))


@register("pieces_of_by_join", PIECES_BACK)
def pieces_of_by_join(spark, sf):
    coded, vocab = with_bytes(spark, sf)
    return pieces_result(tokens.pieces_of(coded, vocab, max_broadcast=0))


@register("ids_to_tokens", f"""WITH {ENCODED}
SELECT k.doc_id, md5(coalesce(string_agg(v.token, ' ' ORDER BY ix), '')) AS content
FROM kept k LEFT JOIN coded c USING (doc_id) LEFT JOIN vocab v USING (id) GROUP BY k.doc_id""")
def ids_to_tokens(spark, sf):
    docs = documents(spark, sf)
    vocab = stored(tokens.build_vocab(docs, 500), "vocab")
    coded = tokens.encode_ids(prepare.tokenized(docs.select("doc_id", "text")).drop("text"), vocab)
    return tokens.ids_to_tokens(coded, vocab).select("doc_id", F.md5("text").alias("content"))


@register("gate_long", f"""WITH {TOK}
SELECT source, count(*) AS docs, max(n) AS longest, sum(n)::BIGINT AS tokens
FROM tok WHERE NOT (source IN ('src0', 'src1', 'src2') AND n >= {GATE}) GROUP BY source""")
def gate_long(spark, sf):
    tok = prepare.tokenized(documents(spark, sf))
    kept = tokens.gate_long(tok, GATE, F.col("source").isin(list(CHAT_SOURCES)))
    return kept.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("longest"), F.sum("n_tokens").alias("tokens"))


@register("preview_text", f"""WITH {ENCODED},
docs AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents WHERE length(text) >= 50)
SELECT doc_id, left(string_agg(v.token, ' ' ORDER BY ix), 400) AS preview
FROM coded JOIN vocab v USING (id) JOIN docs USING (doc_id) WHERE (pos // 8) % 10 = 0 GROUP BY doc_id""")
def preview_text(spark, sf):
    docs = documents(spark, sf)
    vocab = stored(tokens.build_vocab(docs, 500), "vocab")
    coded = tokens.encode_ids(prepare.tokenized(docs.select("doc_id", "text")).drop("text"), vocab)
    numbered = ordering.global_row_index(coded, "doc_id").withColumn("batch", F.expr("pos div 8"))
    return tokens.preview_text(numbered, vocab, 10, "batch", 400, "doc_id")


@register("slug", r"""
SELECT p_partkey,
       trim(regexp_replace(lower(list_extract(string_split('org/' || p_brand || '/' || p_name, '/'), -1)), '[^a-z0-9]+', '_', 'g'), '_') AS slug
FROM part""")
def slug(spark, sf):
    name = F.concat(F.lit("org/"), F.col("p_brand"), F.lit("/"), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", X.slug(name).alias("slug"))


@register("job_name", f"WITH {JOBS} SELECT source, shard::INT AS shard, name FROM jobs")
def job_name(spark, sf):
    return jobs_of(table(spark, sf, "documents")).select("source", "shard", "name")


@register("tokens_label", """
WITH x AS (
  SELECT o_orderkey, (o_orderkey::BIGINT * o_orderkey * 7919)::DOUBLE AS v FROM orders),
r AS (
  SELECT o_orderkey, CASE WHEN v = 0 THEN 0 ELSE round_even(v / pow(10, floor(log10(v)) - 2), 0) * pow(10, floor(log10(v)) - 2) END AS v3
  FROM x),
s AS (
  SELECT o_orderkey, v3, CASE WHEN v3 >= 1e15 THEN 5 WHEN v3 >= 1e12 THEN 4 WHEN v3 >= 1e9 THEN 3 WHEN v3 >= 1e6 THEN 2
         WHEN v3 >= 1e3 THEN 1 ELSE 0 END AS k FROM r)
SELECT o_orderkey,
       regexp_replace(printf('%.6f', v3 / pow(1000, k)), '\\.?0+$', '') || ['', 'K', 'M', 'B', 'T', 'P'][k + 1] AS label
FROM s""".replace("\\\\", "\\"))
def tokens_label(spark, sf):
    value = F.col("o_orderkey") * F.col("o_orderkey") * F.lit(7919)
    return table(spark, sf, "orders").select("o_orderkey", X.short_number(value).alias("label"))


@register("plan_shards", f"""WITH {JOBS}
SELECT source, shard::INT AS shard, name, budget::BIGINT AS budget, weight, max_doc_tokens FROM jobs""")
def plan_shards(spark, sf):
    return jobs_of(table(spark, sf, "documents"))


@register("recipe_faults", f"""WITH {RECIPE}
SELECT source, CASE WHEN shards - 2 < 1 THEN 'shards must be positive' ELSE 'negative length filter' END AS fault
FROM recipe WHERE shards - 2 < 1 OR sampling_weight > 1""")
def recipe_faults(spark, sf):
    rec = recipe_of(table(spark, sf, "documents")).withColumn("shards", F.col("shards") - 2).withColumn(
        "max_doc_tokens", F.when(F.col("sampling_weight") > 1, -1).otherwise(F.col("max_doc_tokens")))
    return mixture.recipe_faults(rec)


@register("shard_source", f"""WITH {RECIPE}
SELECT doc_id, source, ({hash_sql("0", "doc_id")} % shards)::INT AS shard FROM documents JOIN recipe USING (source)""")
def shard_source(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source")
    return prepare.assign_shards(docs, jobs_of(table(spark, sf, "documents"))).select("doc_id", "source", "shard")


@register("budget_tokens", f"""WITH {KEPT}
SELECT source, shard::INT AS shard, doc_id, dropped, start, take,
       md5(CASE WHEN dropped THEN '' ELSE array_to_string(list_slice(list_append(ids, '{EOS}'), 1, take), ' ') END) AS content
FROM kept""")
def budget_tokens(spark, sf):
    kept = kept_of(spark, sf)
    ids = F.when(F.col("dropped"), F.array().cast("array<string>")).otherwise(
        F.slice(F.concat("ids", F.array(F.lit(EOS))), F.lit(1), F.col("take").cast("int")))
    return kept.select("source", "shard", "doc_id", "dropped", "start", "take", digest(ids).alias("content"))


@register("shard_info", f"""WITH {KEPT}
SELECT source, shard::INT AS shard, sum(take)::BIGINT AS tokens, count(*) FILTER (WHERE NOT dropped) AS docs,
       count(*) FILTER (WHERE dropped) AS dropped_too_long, max(budget)::BIGINT AS budget, 'pieces' AS tokenizer
FROM kept GROUP BY source, shard""")
def shard_info(spark, sf):
    return quality.shard_info(placed_of(spark, sf)[0], "pieces")


@register("manifest_totals", f"""WITH {KEPT},
info AS (SELECT source, shard, sum(take) AS tokens FROM kept GROUP BY source, shard)
SELECT sum(tokens)::BIGINT AS total_tokens, count(*) AS shards, round(sum(weight), 6) AS total_weight
FROM jobs LEFT JOIN info USING (source, shard)""")
def manifest_totals(spark, sf):
    docs = table(spark, sf, "documents")
    totals = quality.manifest_totals(quality.shard_info(placed_of(spark, sf)[0], "pieces"), jobs_of(docs))
    return totals.withColumn("total_weight", F.round("total_weight", 6))


@register("reusable_shards", f"""WITH {KEPT},
info AS (SELECT source, shard, sum(take) AS tokens, max(budget) AS b FROM kept GROUP BY source, shard)
SELECT source, shard::INT AS shard, coalesce(tokens > 0 AND b = budget AND shard <> 1, false) AS reuse
FROM jobs LEFT JOIN info USING (source, shard)""")
def reusable_shards(spark, sf):
    jobs = jobs_of(table(spark, sf, "documents"))
    info = quality.shard_info(placed_of(spark, sf)[0], "pieces").withColumn("max_doc_tokens", F.lit(GATE)).withColumn(
        "tokenizer", F.when(F.col("shard") == 1, "other").otherwise(F.col("tokenizer")))
    return quality.reusable_shards(jobs, info, "pieces").select("source", "shard", "reuse")


@register("check_manifest", f"""WITH {KEPT},
info AS (SELECT source || '_p' || shard AS name, source, sum(take)::BIGINT AS tokens FROM kept GROUP BY source, shard)
SELECT name, CASE WHEN source = 'src3' THEN 'missing shard' WHEN source = 'src4' THEN 'not in manifest'
                  WHEN source = 'src5' THEN 'changed' ELSE 'stored size differs' END AS reason
FROM info WHERE source IN ('src3', 'src4', 'src5', 'src6')""")
def check_manifest(spark, sf):
    info = quality.shard_info(placed_of(spark, sf)[0], "pieces").withColumn("max_doc_tokens", F.lit(GATE)).withColumn(
        "name", F.concat("source", F.lit("_p"), "shard"))
    stored = F.when(F.col("source") == "src6", 0).otherwise(F.col("tokens") * 4)
    shards = info.where(F.col("source") != "src3").withColumn("stored_bytes", stored.cast("bigint"))
    manifest = info.where(F.col("source") != "src4").withColumn("weight", F.lit(1.0)).withColumn(
        "docs", F.when(F.col("source") == "src5", -1).otherwise(F.col("docs")).cast("bigint"))
    return joins.check_manifest(manifest, shards, "pieces")


@register("pack_windows", f"""WITH {STREAM}
SELECT source, shard::INT AS shard, (place // {WINDOW + 1})::BIGINT AS win, md5(string_agg(tok, ' ' ORDER BY place)) AS content
FROM stream GROUP BY source, shard, place // {WINDOW + 1} HAVING count(*) = {WINDOW + 1}""")
def pack_windows(spark, sf):
    stream = pack.cut_to_take(kept_of(spark, sf), eos=EOS)
    return pack.pack_windows(stream, WINDOW).select("source", "shard", "win", digest("ids").alias("content"))


@register("pack_summary", f"""WITH {KEPT}
SELECT source, shard::INT AS shard, sum(take)::BIGINT AS tokens, count(*) FILTER (WHERE NOT dropped) AS docs,
       count(*) FILTER (WHERE dropped) AS dropped_too_long, (sum(take) // {WINDOW + 1})::BIGINT AS windows,
       (sum(take) % {WINDOW + 1})::BIGINT AS remainder
FROM kept GROUP BY source, shard""")
def pack_summary(spark, sf):
    return pack.pack_summary(placed_of(spark, sf)[0], WINDOW)


@register("corpus_windows", f"""WITH {STREAM},
wins AS (SELECT source, shard, place // {WINDOW + 1} AS win, count(*) AS n FROM stream GROUP BY ALL),
per AS (SELECT source, count(*) AS windows FROM wins WHERE n = {WINDOW + 1} GROUP BY source),
tot AS (SELECT source, sum(take)::BIGINT AS tokens, count(*) FILTER (WHERE NOT dropped) AS docs,
               count(*) FILTER (WHERE dropped) AS dropped_too_long FROM kept GROUP BY source)
SELECT source, tokens, docs, dropped_too_long, coalesce(windows, 0)::BIGINT AS windows FROM tot LEFT JOIN per USING (source)""")
def corpus_windows(spark, sf):
    """The flagship: documents to training windows under budgets, counted per source."""
    kept, ids = placed_of(spark, sf)
    stream = pack.cut_to_take(kept.join(ids, ["source", "shard", "doc_id"]), eos=EOS)
    wins = pack.pack_windows(stream, WINDOW).groupBy("source").agg(
        F.count(F.lit(1)).alias("windows"))
    per_source = pack.pack_summary(kept, WINDOW, ["source"]).drop("windows", "remainder")
    return per_source.join(wins, "source", "left").withColumn("windows", F.coalesce("windows", F.lit(0)))


POSITIONS = f"""{STREAM},
marked AS (
  SELECT *, place // {WINDOW + 1} AS win, place % {WINDOW + 1} AS ix, count(*) OVER (PARTITION BY source, shard, place // {WINDOW + 1}) AS width
  FROM stream),
segments AS (
  SELECT *, coalesce(sum((tok = '{EOS}')::INT) OVER (PARTITION BY source, shard, win ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seg
  FROM marked WHERE width = {WINDOW + 1}),
positions AS (
  SELECT source, shard, win, ix, tok, row_number() OVER (PARTITION BY source, shard, win, seg ORDER BY ix) - 1 AS pos FROM segments)"""


@register("positions_from_eos", f"""WITH {POSITIONS}
SELECT source, shard::INT AS shard, win::BIGINT AS win, md5(string_agg(pos::VARCHAR, ' ' ORDER BY ix)) AS positions,
       count(*) FILTER (WHERE pos = 0) AS documents
FROM positions GROUP BY source, shard, win""")
def positions_from_eos(spark, sf):
    win = pack.pack_windows(pack.cut_to_take(kept_of(spark, sf), eos=EOS), WINDOW)
    return pack.positions_from_eos(win, EOS).select(
        "source", "shard", "win", digest("positions").alias("positions"),
        F.size(F.filter("positions", lambda p: p == 0)).cast("bigint").alias("documents"))


@register("shift_labels", f"""WITH {POSITIONS}
SELECT source, shard::INT AS shard, win::BIGINT AS win,
       md5(string_agg(tok, ' ' ORDER BY ix) FILTER (WHERE ix < {WINDOW})) AS inputs,
       md5(string_agg(tok, ' ' ORDER BY ix) FILTER (WHERE ix > 0)) AS labels,
       md5(string_agg(pos::VARCHAR, ' ' ORDER BY ix) FILTER (WHERE ix < {WINDOW})) AS positions,
       count(*) FILTER (WHERE ix > 0 AND pos <> 0) AS label_tokens
FROM positions GROUP BY source, shard, win""")
def shift_labels(spark, sf):
    win = pack.pack_windows(pack.cut_to_take(kept_of(spark, sf), eos=EOS), WINDOW)
    shaped = pack.shift_labels(pack.positions_from_eos(win, EOS), WINDOW)
    return shaped.select(
        "source", "shard", "win", digest("input_ids").alias("inputs"), digest("label_ids").alias("labels"),
        digest("position_ids").alias("positions"),
        F.size(F.filter("label_mask", lambda m: m)).cast("bigint").alias("label_tokens"))


@register("context_slices", f"""WITH {POSITIONS}
SELECT source, shard::INT AS shard, win::BIGINT AS win, (ix // {WINDOW // 4})::INT AS part, md5(string_agg(tok, ' ' ORDER BY ix)) AS inputs,
       min(pos) FILTER (WHERE ix % {WINDOW // 4} = 0)::INT AS first_position
FROM positions WHERE ix < {WINDOW} GROUP BY source, shard, win, ix // {WINDOW // 4}""")
def context_slices(spark, sf):
    win = pack.pack_windows(pack.cut_to_take(kept_of(spark, sf), eos=EOS), WINDOW)
    shaped = pack.shift_labels(pack.positions_from_eos(win, EOS), WINDOW)
    return pack.context_slices(shaped, 4, WINDOW, global_positions=False).select(
        "source", "shard", "win", "part", digest("input_ids").alias("inputs"),
        F.get("position_ids", F.lit(0)).alias("first_position"))


@register("running_offset", f"""WITH {TOK}
SELECT doc_id, source, (sum(n) OVER (PARTITION BY source ORDER BY doc_id) - n)::BIGINT AS start FROM tok""")
def running_offset(spark, sf):
    tok = prepare.tokenized(documents(spark, sf)).select("doc_id", "source", "n_tokens")
    return ordering.running_offset(tok, ["source"], "doc_id", "n_tokens").drop("n_tokens")


@register("global_row_index", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders""")
def global_row_index(spark, sf):
    return ordering.global_row_index(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", block=1 << 12)


@register("hash_order", """
SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS pos FROM documents""")
def hash_order(spark, sf):
    return ordering.hash_order(table(spark, sf, "documents").select("doc_id"), 7, ["doc_id"])


@register("order_by_key", "SELECT source, count(*) AS docs FROM documents GROUP BY source ORDER BY source")
def order_by_key(spark, sf):
    return ordering.order_by_key(table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("docs")), "source")


@register("limit_rows", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100")
def limit_rows(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", (-F.col("n_chars")).alias("_k"))
    return ordering.limit_rows(docs, 100, "_k", "doc_id").drop("_k")


@register("debug_limit", "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 64")
def debug_limit(spark, sf):
    from millrace.operators import sft

    return sft.debug_limit(table(spark, sf, "documents").select("doc_id", "source"), 64)


@register("restore_order", """
SELECT l.doc_id, quality, row_number() OVER (ORDER BY md5('3:' || l.doc_id), l.doc_id) - 1 AS pos FROM labels l
JOIN documents USING (doc_id)""")
def restore_order(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    requests = ordering.hash_order(labels.join(table(spark, sf, "documents").select("doc_id"), "doc_id").select("doc_id"), 3, ["doc_id"])
    return ordering.restore_order(labels, requests, "doc_id", "pos")


@register("union_sources", """
SELECT source, count(*) AS rows FROM (
  SELECT source FROM documents UNION ALL SELECT 'conversations' FROM conversations UNION ALL SELECT 'benchmark' FROM benchmark)
GROUP BY source""")
def union_sources(spark, sf):
    frames = [table(spark, sf, "documents").select("source", "text")] + [
        table(spark, sf, t).select(F.lit(t).alias("source"), "text") for t in ("conversations", "benchmark")]
    return ordering.union_sources(*frames).groupBy("source").agg(F.count(F.lit(1)).alias("rows"))


@register("repeat_epochs", """
SELECT doc_id, e::INT AS epoch FROM documents, (SELECT unnest(range(3)) AS e)""")
def repeat_epochs(spark, sf):
    return ordering.repeat_epochs(table(spark, sf, "documents").select("doc_id"), 3)


@register("keys_equal", """
SELECT doc_id, 'left' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def keys_equal(spark, sf):
    return ordering.keys_equal(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@register("keys_missing", """
SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""")
def keys_missing(spark, sf):
    return ordering.keys_missing(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")
