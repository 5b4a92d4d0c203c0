"""Queries over overlapping samples, chunks, SFT, fill-in-the-middle and sentence spans."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from millrace.catalog.registry import EOS, PIECES_SQL, TOK, digest, documents, hash_sql, joined, new_folder, register
from millrace.functions import text as X
from millrace.functions.arrays import packed, unpacked
from millrace.operators import fim, mixture, ordering, pack, sft, spans
from millrace.plans import prepare, stored_plans
from millrace.session import stored, table

L = 200


def _tok(spark, sf):
    """Tokenized once, however often a query reads it."""
    return stored(prepare.tokenized(documents(spark, sf).select("doc_id", "source", "text")).drop("text"), "tokenized")


def _order(tok):
    """Two epochs of all documents in random order."""
    return mixture.doc_order(tok.select("doc_id", F.col("n_tokens").alias("size")), 2, 3, False)


ORDER = f"""{TOK},
ord AS (
  SELECT doc_id, n AS size, ids, row_number() OVER (ORDER BY md5('3:' || e || ':' || doc_id), e, doc_id) - 1 AS pos
  FROM tok, (SELECT unnest(range(2)) AS e)),
long AS (SELECT pos, unnest(ids) AS tok, generate_subscripts(ids, 1) - 1 AS offs FROM ord),
stream AS (SELECT *, row_number() OVER (ORDER BY pos, offs) - 1 AS place FROM long),
total AS (SELECT count(*) AS t FROM stream)"""


@register("sample_index", f"""WITH {ORDER}
SELECT place // {L} AS sample, pos, offs::BIGINT AS "offset" FROM stream, total WHERE place % {L} = 0 AND place <= t - 1""")
def sample_index(spark, sf):
    return pack.sample_index(_order(_tok(spark, sf)), L)


@register("sample_index_open", f"""WITH {ORDER}
SELECT place // {L} AS sample, pos, offs::BIGINT AS "offset" FROM stream, total WHERE place % {L} = 0 AND place <= t - 1
UNION ALL
SELECT ceil((t - 1) / {L})::BIGINT, pos, size - 1 FROM ord, total WHERE pos = (SELECT max(pos) FROM ord) AND (t - 1) % {L} <> 0""")
def sample_index_open(spark, sf):
    return pack.sample_index(_order(_tok(spark, sf)), L, drop_last=False)


def _stream(spark, sf):
    tok = _tok(spark, sf)
    placed = ordering.running_offset(
        _order(tok).withColumn("_g", F.lit(0)), ["_g"], "pos", "size", "start").drop("_g")
    return placed.join(tok.select("doc_id", packed(F.col("ids")).alias("ids")), "doc_id").withColumn("ids", unpacked(F.col("ids")))


@register("sample_text", f"""WITH {ORDER},
w AS (SELECT place // {L} - d AS sample, place, tok FROM stream, (SELECT unnest([0, 1]) AS d) WHERE d = 0 OR (place % {L} = 0 AND place > 0))
SELECT sample::BIGINT AS sample, md5(string_agg(tok, ' ' ORDER BY place)) AS content FROM w GROUP BY sample HAVING count(*) = {L + 1}""")
def sample_text(spark, sf):
    return pack.sample_text(_stream(spark, sf), L).select("sample", digest("ids").alias("content"))


@register("pad_sample", f"""WITH {ORDER},
w AS (SELECT place // {L} - d AS sample, place, tok FROM stream, (SELECT unnest([0, 1]) AS d) WHERE d = 0 OR (place % {L} = 0 AND place > 0)),
s AS (SELECT sample, list(tok ORDER BY place) AS ids FROM w GROUP BY sample HAVING count(*) > 1)
SELECT sample::BIGINT AS sample, md5(array_to_string(ids, ' ') || repeat(' -1', {L + 1} - len(ids))) AS content FROM s""")
def pad_sample(spark, sf):
    samples = pack.sample_text(_stream(spark, sf), L, drop_last=False)
    return pack.pad_sample(samples, L + 1, "-1").select("sample", digest("ids").alias("content"))


CHUNKS = f"""{TOK},
num AS (SELECT doc_id, ids, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch FROM tok),
long AS (SELECT batch, doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS offs FROM num),
stream AS (SELECT batch, tok, row_number() OVER (PARTITION BY batch ORDER BY doc_id, offs) - 1 AS place,
                  count(*) OVER (PARTITION BY batch) AS t FROM long),
w AS (SELECT batch, place // {L} - d AS chunk, place, tok, t FROM stream, (SELECT unnest([0, 1]) AS d) WHERE d = 0 OR (place % {L} = 0 AND place > 0)),
chunks AS (SELECT batch, chunk::BIGINT AS chunk, md5(string_agg(tok, ' ' ORDER BY place)) AS content, max(t) AS t
           FROM w GROUP BY batch, chunk HAVING count(*) = {L + 1})"""


def _batched(spark, sf):
    tok = _tok(spark, sf)
    numbered = ordering.global_row_index(tok.withColumn("ids", packed(F.col("ids"))), "doc_id").withColumn("batch", F.expr("pos div 16"))
    return numbered.withColumn("ids", unpacked(F.col("ids")))


@register("chunk_batch", f"WITH {CHUNKS} SELECT batch, chunk, content FROM chunks")
def chunk_batch(spark, sf):
    return pack.chunk_batch(_batched(spark, sf), L).select("batch", "chunk", digest("ids").alias("content"))


@register("chunk_batch_short", f"WITH {CHUNKS} SELECT batch, chunk, content FROM chunks WHERE chunk < greatest((t - 1) // {L} - 1, 0)")
def chunk_batch_short(spark, sf):
    return pack.chunk_batch(_batched(spark, sf), L, drop_last=True).select("batch", "chunk", digest("ids").alias("content"))


@register("leftpad_positions", f"""WITH {TOK},
long AS (SELECT doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) - 1 AS ix FROM tok),
lead AS (SELECT doc_id, coalesce(max(ix + 1) FILTER (WHERE tok = ','), 0) AS lead FROM long GROUP BY doc_id)
SELECT t.doc_id, md5(coalesce(string_agg((greatest(ix - lead, 0))::VARCHAR, ' ' ORDER BY ix), '')) AS positions
FROM tok t LEFT JOIN long USING (doc_id) LEFT JOIN lead USING (doc_id) GROUP BY t.doc_id""")
def leftpad_positions(spark, sf):
    return pack.leftpad_positions(_tok(spark, sf), ",").select("doc_id", digest("positions").alias("positions"))


# Supervised fine-tuning -----------------------------------------------------------------------

PAIRS = f"""pairs AS (
  SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS completion
  FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'),
coded AS (
  SELECT conv_id, turn, list_slice(list_append({PIECES_SQL.replace('text', 'prompt || completion')}, '{EOS}'), 1, 49) AS ids,
         len({PIECES_SQL.replace('text', 'prompt')}) AS plen FROM pairs),
shaped AS (SELECT conv_id, turn, ids, len(ids) AS n, least(plen, 49) AS plen FROM coded)"""


def _sft(spark, sf):
    return sft.sft_encode(sft.chat_pairs(table(spark, sf, "conversations")), 48)


@register("sft_encode", f"""WITH {PAIRS}
SELECT conv_id, turn, md5(array_to_string(ids, ' ') || repeat(' <pad>', 49 - n)) AS ids,
       md5(array_to_string(list_transform(range(49), lambda i: CASE WHEN i < n THEN i ELSE -1 END), ' ')) AS positions,
       greatest(n - plen, 0)::BIGINT AS label_tokens
FROM shaped""")
def sft_encode(spark, sf):
    return _sft(spark, sf).select(
        "conv_id", "turn", digest("input_ids").alias("ids"), digest("position_ids").alias("positions"),
        F.size(F.filter("label_mask", lambda m: m)).cast("bigint").alias("label_tokens"))


@register("sft_keep", f"WITH {PAIRS} SELECT conv_id, turn FROM shaped WHERE n > plen")
def sft_keep(spark, sf):
    return sft.sft_keep(_sft(spark, sf)).select("conv_id", "turn")


@register("sft_report", f"""WITH {PAIRS}
SELECT count(*) AS rows, count(*) FILTER (WHERE n <= plen) AS prompt_too_long, count(*) FILTER (WHERE n <= plen) AS filtered,
       round(count(*) FILTER (WHERE n <= plen) / count(*), 9) AS filtered_share FROM shaped""")
def sft_report(spark, sf):
    return sft.sft_report(_sft(spark, sf)).withColumn("filtered_share", F.round("filtered_share", 9))


# Fill in the middle ---------------------------------------------------------------------------

FIM = fim.Fim(rate=0.5, spm_rate=0.5, seed=17)


def _pieces(expr: str) -> str:
    return PIECES_SQL.replace("(text,", f"({expr},")


FIM_TEXT = f"""cuts AS (
  SELECT doc_id, text, {hash_sql("17", "'cut0'", "doc_id")} % (length(text) + 1) AS a,
         {hash_sql("17", "'cut1'", "doc_id")} % (length(text) + 1) AS b,
         {hash_sql("17", "'fim'", "doc_id")} < 0.5 * 4294967296 AS drawn,
         {hash_sql("17", "'spm'", "doc_id")} < 0.5 * 4294967296 AS spm FROM documents),
parts AS (
  SELECT doc_id, text, drawn, spm, {_pieces("substr(text, 1, least(a, b))")} AS p,
         {_pieces("substr(text, least(a, b) + 1, greatest(a, b) - least(a, b))")} AS m,
         {_pieces("substr(text, greatest(a, b) + 1)")} AS s FROM cuts)"""


@register("fim_permute", f"""WITH {FIM_TEXT}
SELECT doc_id, md5(array_to_string(CASE
         WHEN NOT drawn THEN {_pieces("text")}
         WHEN spm THEN ['<pre>', '<suf>'] || s || ['<mid>'] || p || m
         ELSE ['<pre>'] || p || ['<suf>'] || s || ['<mid>'] || m END, ' ')) AS content, drawn
FROM parts""")
def fim_permute(spark, sf):
    out = fim.fim_permute(documents(spark, sf).select("doc_id", "text"), FIM)
    return out.select("doc_id", digest("ids").alias("content"), F.array_contains("ids", "<pre>").alias("drawn"))


@register("fim_permute_fixed", f"""WITH {FIM_TEXT},
sized AS (SELECT *, {_pieces("text")} AS u, len(p) + len(m) + len(s) + 3 - len({_pieces("text")}) AS d FROM parts),
fitted AS (
  SELECT doc_id, u, p, m, spm, drawn AND (d <= 0 OR len(s) > d) AS drawn,
         CASE WHEN d > 0 THEN list_slice(s, 1, len(s) - d) ELSE s || list_transform(range(-d), lambda x: '<pad>') END AS s FROM sized)
SELECT doc_id, md5(array_to_string(CASE
         WHEN NOT drawn THEN u
         WHEN spm THEN ['<pre>', '<suf>'] || s || ['<mid>'] || p || m
         ELSE ['<pre>'] || p || ['<suf>'] || s || ['<mid>'] || m END, ' ')) AS content, len(u)::INT AS n
FROM fitted""")
def fim_permute_fixed(spark, sf):
    out = fim.fim_permute(documents(spark, sf).select("doc_id", "text"), replace(FIM, keep_length=True))
    return out.select("doc_id", digest("ids").alias("content"), F.size("ids").alias("n"))


def _packed(spark, sf):
    """Samples of several documents with end tokens inside, one stream per source."""
    tok = _tok(spark, sf).withColumn("ids", F.concat("ids", F.array(F.lit(EOS)))).withColumn("_n", F.col("n_tokens") + 1)
    placed = ordering.running_offset(tok, ["source"], "doc_id", "_n", "start")
    return stored(pack.pack_windows(placed, L, ["source"]), "packed").withColumn("sample", F.concat_ws("/", "source", "win"))


# Samples as lists of segments, each permuted on its own; empty segments are gone unless last.
FIM_SAMPLE = f"""{TOK},
full_ AS (SELECT source, doc_id, list_append(ids, '{EOS}') AS ids FROM tok),
long AS (SELECT source, doc_id, unnest(ids) AS tok, generate_subscripts(ids, 1) AS offs FROM full_),
stream AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY doc_id, offs) - 1 AS place FROM long),
win AS (SELECT source || '/' || (place // {L + 1}) AS sample, place % {L + 1} AS ix, tok,
               count(*) OVER (PARTITION BY source, place // {L + 1}) AS width FROM stream),
seg AS (SELECT *, coalesce(sum((tok = '{EOS}')::INT) OVER (PARTITION BY sample ORDER BY ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS i
        FROM win WHERE width = {L + 1}),
ends AS (SELECT sample, count(*) FILTER (WHERE tok = '{EOS}') AS last FROM seg GROUP BY sample),
spine AS (SELECT sample, last, unnest(range(last + 1)) AS i FROM ends),
segs AS (SELECT s.sample, s.i, s.last, coalesce(list(tok ORDER BY ix) FILTER (WHERE tok <> '{EOS}'), []) AS part
         FROM spine s LEFT JOIN seg USING (sample, i) GROUP BY s.sample, s.i, s.last),
text_ AS (SELECT *, coalesce(array_to_string(part, ' '), '') AS text FROM segs WHERE len(part) > 0 OR i = last),
cuts AS (
  SELECT *, {hash_sql("17", "'cut0'", "sample", "i", "0")} % (length(text) + 1) AS a,
         {hash_sql("17", "'cut1'", "sample", "i", "0")} % (length(text) + 1) AS b,
         {hash_sql("17", "'fim'", "sample", "i", "0")} < 0.5 * 4294967296 AS drawn,
         {hash_sql("17", "'spm'", "sample", "i", "0")} < 0.5 * 4294967296 AS spm FROM text_),
parts AS (
  SELECT *, {_pieces("substr(text, 1, least(a, b))")} AS p,
         {_pieces("substr(text, least(a, b) + 1, greatest(a, b) - least(a, b))")} AS m,
         {_pieces("substr(text, greatest(a, b) + 1)")} AS s FROM cuts),
mixed AS (
  SELECT sample, i, CASE WHEN NOT drawn THEN part WHEN spm THEN ['<pre>', '<suf>'] || s || ['<mid>'] || p || m
                         ELSE ['<pre>'] || p || ['<suf>'] || s || ['<mid>'] || m END
                    || CASE WHEN i < last THEN ['{EOS}'] ELSE [] END AS toks FROM parts)
SELECT sample, {L + 1}::INT AS width,
       md5(array_to_string(list_slice(flatten(list(toks ORDER BY i)) || list_transform(range({L + 1}), lambda z: '<pad>'), 1, {L + 1}), ' ')) AS content
FROM mixed GROUP BY sample"""


@register("fim_sample", f"WITH {FIM_SAMPLE}")
def fim_sample(spark, sf):
    return fim.fim_sample(_packed(spark, sf), FIM).select(
        "sample", F.size("ids").alias("width"), digest("ids").alias("content"))


# The same with every segment cut at full stops: one draw per segment, then one per fragment.
FIM_FRAGMENTS = FIM_SAMPLE[:FIM_SAMPLE.index("text_ AS (")] + f"""cutat AS (
  SELECT *, list_filter(range(1, len(part) + 1), lambda k: part[k] = '.') AS dots FROM segs),
bounds AS (SELECT *, [0] || dots AS lo, dots || [len(part) + 1] AS hi FROM cutat),
frag AS (
  SELECT sample, i, last, len(dots) > 0 AS split, unnest(range(len(lo))) AS j, len(lo) - 1 AS final,
         unnest(list_transform(range(1, len(lo) + 1), lambda k: part[lo[k] + 1 : hi[k] - 1])) AS part FROM bounds),
rule AS (SELECT *, {hash_sql("17", "'frag'", "sample", "i")} < 0.5 * 4294967296 AS opened FROM frag),
text_ AS (
  SELECT *, coalesce(array_to_string(part, ' '), '') AS text FROM rule
  WHERE len(part) > 0 OR (CASE WHEN split THEN NOT opened OR j = final ELSE i = last END)),
cuts AS (
  SELECT *, {hash_sql("17", "'cut0'", "sample", "i", "j")} % (length(text) + 1) AS a,
         {hash_sql("17", "'cut1'", "sample", "i", "j")} % (length(text) + 1) AS b,
         {hash_sql("17", "'fim'", "sample", "i", "j")} < (CASE WHEN split AND NOT opened THEN 0 ELSE 0.5 END) * 4294967296 AS drawn,
         {hash_sql("17", "'spm'", "sample", "i", "j")} < 0.5 * 4294967296 AS spm FROM text_),
parts AS (
  SELECT *, {_pieces("substr(text, 1, least(a, b))")} AS p,
         {_pieces("substr(text, least(a, b) + 1, greatest(a, b) - least(a, b))")} AS m,
         {_pieces("substr(text, greatest(a, b) + 1)")} AS s FROM cuts),
mixed AS (
  SELECT sample, i, j, CASE WHEN NOT drawn THEN part WHEN spm THEN ['<pre>', '<suf>'] || s || ['<mid>'] || p || m
                            ELSE ['<pre>'] || p || ['<suf>'] || s || ['<mid>'] || m END
                       || CASE WHEN j < final THEN ['.'] WHEN i < last THEN ['{EOS}'] ELSE [] END AS toks FROM parts)
SELECT sample, {L + 1}::INT AS width,
       md5(array_to_string(list_slice(flatten(list(toks ORDER BY i, j)) || list_transform(range({L + 1}), lambda z: '<pad>'), 1, {L + 1}), ' ')) AS content
FROM mixed GROUP BY sample"""


@register("fim_fragments", f"WITH {FIM_FRAGMENTS}")
def fim_fragments(spark, sf):
    return fim.fim_fragments(_packed(spark, sf), FIM, ".", 0.5).select(
        "sample", F.size("ids").alias("width"), digest("ids").alias("content"))


# Sentences ------------------------------------------------------------------------------------

SENTENCES = rf"""raw AS (
  SELECT doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS s,
         generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), 1) - 1 AS sent_ord FROM documents),
sent AS (SELECT doc_id, sent_ord::INT AS sent_ord, {_pieces("s")} AS ids, len(ids)::INT AS size FROM raw WHERE len({_pieces("s")}) > 0)"""


def _sent(spark, sf):
    return spans.sentences_table(documents(spark, sf).select("doc_id", "text"))


def _sizes(spark, sf):
    return spans.sentence_sizes(documents(spark, sf).select("doc_id", "text"))


@register("sentences_table", f"""WITH {SENTENCES}
SELECT doc_id, sent_ord, size, md5(array_to_string(ids, ' ')) AS content FROM sent""")
def sentences_table(spark, sf):
    return _sent(spark, sf).select("doc_id", "sent_ord", "size", digest("ids").alias("content"))


@register("document_bounds", f"""WITH {SENTENCES}
SELECT doc_id, count(*) AS items, sum(size)::BIGINT AS tokens FROM sent GROUP BY doc_id""")
def document_bounds(spark, sf):
    return spans.document_bounds(_sent(spark, sf))


@register("merge_tables", f"""WITH {SENTENCES},
m AS (SELECT max(doc_id) + 1 AS shift FROM sent),
both_ AS (SELECT doc_id, size FROM sent UNION ALL SELECT doc_id + shift, size FROM sent, m)
SELECT doc_id::BIGINT AS doc_id, count(*) AS items, sum(size)::BIGINT AS tokens FROM both_ GROUP BY 1""")
def merge_tables(spark, sf):
    sent = _sent(spark, sf)
    return spans.document_bounds(spans.merge_tables(sent, sent))


@register("item_slice", f"""WITH {TOK}
SELECT doc_id, md5(array_to_string(list_slice(ids, 6, 25), ' ')) AS content, len(list_slice(ids, 6, 25))::INT AS size FROM tok""")
def item_slice(spark, sf):
    return spans.item_slice(_tok(spark, sf), None, 5, 20).select("doc_id", digest("ids").alias("content"), F.size("ids").alias("size"))


# The span rule as a recursion over sentences; one target in ten is shortened by the hash.
_DRAW = hash_sql("5", "{e}", "{d}", "{k}")
_TARGET = f"(CASE WHEN {_DRAW} % 10 = 0 THEN 2 + {_DRAW} % 127 ELSE 128 END)"


def _target(e: str, d: str, k: str) -> str:
    return _TARGET.format(e=e, d=d, k=k)


@register("sentence_spans", f"""WITH RECURSIVE {SENTENCES},
ok AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id HAVING count(*) >= 2 AND max(size) <= 512),
num AS (SELECT epoch, doc_id, n, size::BIGINT AS size, row_number() OVER (PARTITION BY epoch, doc_id ORDER BY sent_ord) AS k
        FROM sent JOIN ok USING (doc_id), (SELECT unnest(range(2)) AS epoch)),
walk AS (
  SELECT epoch, doc_id, k, n, 0::BIGINT AS start, size AS len, 0::BIGINT AS no, {_target("epoch", "doc_id", "0")} AS target,
         n = 1 AS closes
  FROM num WHERE k = 1
  UNION ALL
  SELECT epoch, doc_id, k, n, start, len, no, target, (len >= target AND n - k > 1 AND k - start >= 2) OR k = n
  FROM (SELECT *, {_target("epoch", "doc_id", "no")} AS target FROM (
    SELECT w.epoch, w.doc_id, x.k, w.n, CASE WHEN w.closes THEN w.k ELSE w.start END AS start,
           CASE WHEN w.closes THEN x.size ELSE w.len + x.size END AS len, CASE WHEN w.closes THEN w.no + 1 ELSE w.no END AS no
    FROM walk w JOIN num x ON x.epoch = w.epoch AND x.doc_id = w.doc_id AND x.k = w.k + 1)))
SELECT epoch::INT AS epoch, doc_id, start::INT AS start, k::INT AS "end", target::INT AS target,
       row_number() OVER (ORDER BY md5('5:' || epoch || ':' || doc_id || ':' || start), epoch, doc_id, start) - 1 AS pos
FROM walk WHERE closes""")
def sentence_spans(spark, sf):
    return spans.sentence_spans(_sizes(spark, sf), 128, 2, 0.1, 2, 5)


# Without shortened targets the spans follow from a running rule, written here as a recursion over sentences.
@register("block_spans", f"""WITH RECURSIVE {SENTENCES},
ok AS (SELECT doc_id, count(*) AS n FROM sent GROUP BY doc_id HAVING count(*) >= 2 AND max(size) <= 512),
num AS (SELECT doc_id, n, size, row_number() OVER (PARTITION BY doc_id ORDER BY sent_ord) AS k FROM sent JOIN ok USING (doc_id)),
title AS (SELECT doc_id, 1 + (doc_id % 9)::INT AS title_size FROM documents),
walk AS (
  SELECT doc_id, k, 0::BIGINT AS start, size::BIGINT AS len, (size >= 96 - title_size AND n - 1 >= 2) OR n = 1 AS closes, n, title_size
  FROM num JOIN title USING (doc_id) WHERE k = 1
  UNION ALL
  SELECT w.doc_id, x.k, CASE WHEN w.closes THEN w.k ELSE w.start END, CASE WHEN w.closes THEN x.size ELSE w.len + x.size END,
         ((CASE WHEN w.closes THEN x.size ELSE w.len + x.size END) >= 96 - w.title_size AND w.n - x.k >= 2) OR x.k = w.n, w.n, w.title_size
  FROM walk w JOIN num x ON x.doc_id = w.doc_id AND x.k = w.k + 1),
cut AS (SELECT doc_id, start, k AS stop, row_number() OVER (ORDER BY doc_id, start) - 1 AS block_id FROM walk WHERE closes)
SELECT 0::INT AS epoch, doc_id, start::INT AS start, stop::INT AS "end", block_id,
       row_number() OVER (ORDER BY md5('5:0:' || doc_id || ':' || start), doc_id, start) - 1 AS pos FROM cut""")
def block_spans(spark, sf):
    docs = table(spark, sf, "documents")
    titles = docs.select("doc_id", (F.lit(1) + F.col("doc_id") % 9).cast("int").alias("title_size"))
    return spans.block_spans(_sizes(spark, sf), titles, 96, False, 1, 5)


@register("sample_index_stored", f"""WITH {ORDER}
SELECT place // {L} AS sample, pos, offs::BIGINT AS "offset" FROM stream, total WHERE place % {L} = 0 AND place <= t - 1""")
def sample_index_stored(spark, sf):
    """The index as a later run reads it: built by the first call, found by the second."""
    folder = new_folder(spark, "plans")
    docs = _tok(spark, sf).select("doc_id", F.col("n_tokens").alias("size"))
    for _ in range(2):
        index = stored_plans.stored_sample_index(spark, folder, docs, 2, 3, L)
    return index
