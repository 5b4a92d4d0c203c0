"""Queries over mixtures, blends, orders, splits and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import LANGS, SOURCES, TOK, digest, hash_sql, documents, langs_of, register, sources_of
from millrace.functions.permutation import PRIME, rounds
from millrace.operators import batches, joins, mixture, ordering
from millrace.plans import prepare, training
from millrace.session import stored, table


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "source", "lang")


def _lens(docs):
    return langs_of(docs).select("ds", F.col("docs").alias("len"))


def _weights(docs):
    return langs_of(docs).select("ds", "weight")


@register("normalize_weights", f"""WITH {SOURCES}
SELECT source, round(docs / (SELECT sum(docs) FROM sources), 9) AS share FROM sources""")
def normalize_weights(spark, sf):
    w = sources_of(_docs(spark, sf)).withColumn("weight", F.col("docs"))
    return mixture.normalize_weights(w).select("source", F.round("share", 9).alias("share"))


@register("resolve_weights", f"""WITH {TOK},
info AS (SELECT source, sum(n)::BIGINT AS tokens FROM tok GROUP BY source),
spec AS (SELECT source, substr(source, 4)::INT AS k FROM info)
SELECT source || '_p' || j AS folder, (3 + j)::DOUBLE AS weight FROM spec, (SELECT unnest(range(2)) AS j) WHERE k % 4 = 0
UNION ALL
SELECT source, CASE k % 4 WHEN 1 THEN 5.0 WHEN 2 THEN tokens::DOUBLE ELSE 1.0 END FROM spec JOIN info USING (source) WHERE k % 4 > 0""")
def resolve_weights(spark, sf):
    info = prepare.tokenized(documents(spark, sf)).groupBy("source").agg(F.sum("n_tokens").alias("tokens"))
    k = F.substr("source", F.lit(4)).cast("int") % 4
    specs = info.select(F.col("source").alias("folder"), F.when(k == 1, F.lit(5.0)).alias("weight"))
    held = info.where(k == 2).select(F.col("source").alias("folder"), "tokens")
    roots = ordering.repeat_epochs(info.where(k == 0), 2, "j").select(
        F.col("source").alias("root"), F.concat("source", F.lit("_p"), "j").alias("folder"),
        (F.col("j") + 3.0).alias("weight"), F.lit("pieces").alias("tokenizer"))
    return mixture.resolve_weights(specs, held, roots, "pieces")


@register("largest_remainder", f"""WITH {LANGS},
x AS (SELECT ds, weight, weight / (SELECT sum(weight) FROM langs) * (SELECT count(*) + 7 FROM documents) AS exact FROM langs),
f AS (SELECT *, floor(exact)::BIGINT AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, ds DESC) AS r FROM x)
SELECT ds, (fl + CASE WHEN r <= (SELECT count(*) + 7 FROM documents) - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""")
def largest_remainder(spark, sf):
    docs = _docs(spark, sf)
    return mixture.largest_remainder(_weights(docs), docs.count() + 7).select("ds", "quota")


@register("padded_quota", f"""WITH {LANGS},
n AS (SELECT count(*) AS n FROM documents),
s AS (SELECT ds, weight / (SELECT sum(weight) FROM langs) AS share FROM langs)
SELECT ds, ceil(n * share * 1.005)::BIGINT AS quota_train, ceil((n // 10) * share * 1.005)::BIGINT AS quota_valid,
       ceil((n // 20) * share * 1.005)::BIGINT AS quota_test FROM s, n""")
def padded_quota(spark, sf):
    docs = _docs(spark, sf)
    n = docs.count()
    return mixture.padded_quota(_weights(docs), (n, n // 10, n // 20)).select("ds", "quota_train", "quota_valid", "quota_test")


# The greedy order by literal recursion: one row per step, errors in exact integers.
GREEDY = f"""{LANGS},
ws AS (SELECT list(weight ORDER BY ds) AS w, sum(weight)::BIGINT AS total, (SELECT count(*) FROM documents) AS n FROM langs),
steps AS (
  SELECT 0::BIGINT AS pos, list_position(w, list_max(w))::BIGINT AS pick,
         list_transform(w, lambda x: 0::BIGINT) AS taken, w, total, n FROM ws
  UNION ALL
  SELECT pos + 1, list_position(err, list_max(err))::BIGINT, tk, w, total, n FROM (
    SELECT pos, tk, w, total, n, list_transform(range(1, len(w) + 1), lambda i: w[i] * (pos + 1) - tk[i] * total) AS err FROM (
      SELECT pos, w, total, n, list_transform(range(1, len(w) + 1), lambda i: taken[i] + CASE WHEN i = pick THEN 1 ELSE 0 END) AS tk
      FROM steps WHERE pos + 1 < n))),
blend AS (SELECT pos, (pick - 1)::INT AS ds, taken[pick]::BIGINT AS sample FROM steps)"""


@register("blend_greedy", f"WITH RECURSIVE {GREEDY} SELECT pos, ds, sample FROM blend")
def blend_greedy(spark, sf):
    docs = _docs(spark, sf)
    return mixture.blend_greedy(spark, _weights(docs), docs.count())


@register("epoch_index", f"""WITH RECURSIVE {GREEDY},
mixed AS (
  SELECT row_number() OVER (ORDER BY md5('11:' || pos), pos) - 1 AS pos, ds, sample % docs AS sample
  FROM blend JOIN langs USING (ds)),
everything AS (
  SELECT e * n + pos AS pos, ds, sample FROM mixed, (SELECT unnest(range(3)) AS e), (SELECT count(*) AS n FROM documents))
SELECT pos::BIGINT AS pos, ds, sample::BIGINT AS sample FROM everything, (SELECT count(*) AS n FROM documents) WHERE pos < 2 * n + 50""")
def epoch_index(spark, sf):
    docs = _docs(spark, sf)
    return mixture.epoch_index(spark, _weights(docs), _lens(docs), 2 * docs.count() + 50, 11)


@register("epoch_index_unweighted", f"""WITH {LANGS},
lens AS (SELECT ds, sum(length(text))::BIGINT AS len FROM documents JOIN langs USING (lang) GROUP BY ds),
slots AS (SELECT ds, unnest(range(len)) AS sample FROM lens),
mixed AS (SELECT row_number() OVER (ORDER BY md5('11:' || ds || ':' || sample), ds, sample) - 1 AS pos, ds, sample FROM slots),
everything AS (SELECT e * (SELECT sum(len) FROM lens) + pos AS pos, ds, sample FROM mixed, (SELECT unnest(range(2)) AS e))
SELECT ds, (pos // 65536)::BIGINT AS stretch, count(*) AS n, sum(pos % 65536 * (sample % 1000 + 1))::BIGINT AS mark
FROM everything WHERE pos < (SELECT sum(len) + 50 FROM lens) GROUP BY ALL""")
def epoch_index_unweighted(spark, sf):
    """Lengths are the characters of each language, so an epoch is long; summed up by stretches of positions."""
    docs = table(spark, sf, "documents")
    lens = docs.join(langs_of(docs).select("lang", "ds"), "lang").groupBy("ds").agg(F.sum(F.length("text")).alias("len"))
    n = lens.agg(F.sum("len")).first()[0] + 50
    order = mixture.epoch_index(spark, None, lens, n, 11)
    return order.groupBy("ds", F.expr("pos div 65536").alias("stretch")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("pos") % 65536 * (F.col("sample") % 1000 + 1)).alias("mark"))


@register("quota_index", f"""WITH {LANGS},
x AS (SELECT ds, weight / (SELECT sum(weight) FROM langs) * (SELECT count(*) FROM documents) AS exact FROM langs),
f AS (SELECT *, floor(exact)::BIGINT AS fl, row_number() OVER (ORDER BY exact - floor(exact) DESC, ds DESC) AS r FROM x),
q AS (SELECT ds, fl + CASE WHEN r <= (SELECT count(*) FROM documents) - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END AS quota FROM f),
slots AS (SELECT ds, unnest(range(quota::BIGINT)) AS slot FROM q),
placed AS (SELECT ds, row_number() OVER (ORDER BY md5('5:' || ds || ':' || slot), ds, slot) - 1 AS pos FROM slots)
SELECT pos, ds, row_number() OVER (PARTITION BY ds ORDER BY pos) - 1 AS sample FROM placed""")
def quota_index(spark, sf):
    docs = _docs(spark, sf)
    return mixture.quota_index(_weights(docs), docs.count(), 5).select("pos", "ds", "sample")


BINS = f"""{LANGS},
b AS (SELECT ds, docs, floor(weight / (SELECT sum(weight) FROM langs) * 50)::BIGINT AS bins FROM langs),
c AS (SELECT ds, docs, CASE WHEN ds = (SELECT max(ds) FROM b) THEN 50 - (SELECT sum(bins) FROM b) + bins ELSE bins END::BIGINT AS bins FROM b),
bin AS (
  SELECT ds, docs, bins, unnest(range(bins)) AS bias FROM c),
numbered AS (SELECT *, row_number() OVER (ORDER BY ds, bias) - 1 AS bin FROM bin),
blend AS (
  SELECT p.pos, n.ds, ((n.bias + (p.pos // 50) * n.bins) % n.docs)::BIGINT AS sample
  FROM (SELECT unnest(range((SELECT 3 * count(*) FROM documents))) AS pos) p JOIN numbered n ON p.pos % 50 = n.bin)"""


@register("blend_bins", f"WITH {BINS} SELECT pos, ds, sample FROM blend")
def blend_bins(spark, sf):
    docs = _docs(spark, sf)
    return mixture.blend_bins(spark, _weights(docs), _lens(docs), 3 * docs.count(), 50)


@register("blend_report", f"""WITH {BINS}
SELECT ds, round(weight / (SELECT sum(weight) FROM langs), 9) AS requested, count(pos) AS samples,
       round(count(pos) / (SELECT count(*) FROM blend), 9) AS achieved
FROM langs LEFT JOIN blend USING (ds) GROUP BY ds, weight""")
def blend_report(spark, sf):
    docs = _docs(spark, sf)
    blend = mixture.blend_bins(spark, _weights(docs), _lens(docs), 3 * docs.count(), 50)
    return mixture.blend_report(blend, _weights(docs)).select(
        "ds", F.round("requested", 9).alias("requested"), "samples", F.round("achieved", 9).alias("achieved"))


def _rows_by_lang(docs):
    """Documents numbered inside their language: (ds, win, doc_id)."""
    numbered = ordering.global_row_index(docs, "doc_id", ["lang"], "win")
    return numbered.join(langs_of(docs).select("lang", "ds"), "lang").select("ds", "win", "doc_id")


@register("blend_fetch", f"""WITH {BINS},
rows AS (SELECT ds, doc_id, row_number() OVER (PARTITION BY ds ORDER BY doc_id) - 1 AS win FROM documents JOIN langs USING (lang))
SELECT pos, b.ds, sample, win, doc_id FROM blend b JOIN langs l USING (ds)
JOIN rows r ON r.ds = b.ds AND r.win = (b.sample + 13 * (b.ds + 1)) % l.docs""")
def blend_fetch(spark, sf):
    docs = _docs(spark, sf)
    blend = mixture.blend_bins(spark, _weights(docs), _lens(docs), 3 * docs.count(), 50)
    offsets = _lens(docs).select("ds", ((F.col("ds") + 1) * 13).alias("offset"))
    return joins.blend_fetch(blend, _rows_by_lang(docs), _lens(docs), offsets).select("pos", "ds", "sample", "win", "doc_id")


@register("shuffle_windows", """
SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('9:' || right(source, 16) || ':' || doc_id), doc_id) - 1 AS place
FROM documents""")
def shuffle_windows(spark, sf):
    return mixture.shuffle_windows(_docs(spark, sf), 9, row="doc_id").select("doc_id", "source", "place")


FILES = """files AS (
  SELECT lang AS source, source AS file, count(*) AS len FROM documents GROUP BY lang, source),
ranges AS (
  SELECT *, (sum(len) OVER (PARTITION BY source ORDER BY file))::BIGINT AS stop, stop - len AS start FROM files)"""


def _files(docs):
    return docs.groupBy(F.col("lang").alias("source"), F.col("source").alias("file")).agg(F.count(F.lit(1)).alias("len"))


@register("shuffle_files", f"""WITH {FILES},
p AS (SELECT source, file, len, row_number() OVER (PARTITION BY source ORDER BY md5('4:' || file), file) - 1 AS place FROM files)
SELECT source, file, place, (sum(len) OVER (PARTITION BY source ORDER BY place) - len)::BIGINT AS start FROM p""")
def shuffle_files(spark, sf):
    return mixture.shuffle_files(_files(_docs(spark, sf)), 4).select("source", "file", "place", "start")


@register("locate_window", f"""WITH {FILES},
pos AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos FROM documents)
SELECT p.source, p.doc_id, p.pos, r.file, (p.pos - r.start)::BIGINT AS inner_pos
FROM pos p JOIN ranges r ON p.source = r.source AND p.pos >= r.start AND p.pos < r.stop""")
def locate_window(spark, sf):
    docs = _docs(spark, sf)
    pos = ordering.global_row_index(docs, "doc_id", ["lang"], "pos").select(
        F.col("lang").alias("source"), "doc_id", "pos")
    return joins.locate_window(pos, _files(docs)).select("source", "doc_id", "pos", "file", "inner_pos")


@register("files_needed", f"""WITH {FILES}, {LANGS},
need AS (
  SELECT lang AS source, floor(100 * (weight / total))::BIGINT + ds AS now,
         floor(100 * (weight / total))::BIGINT + ds + floor(400 * (weight / total))::BIGINT AS until
  FROM langs, (SELECT sum(weight) AS total FROM langs))
SELECT source, file, greatest(now, start)::BIGINT AS from_sample, least(until, stop)::BIGINT AS to_sample
FROM ranges JOIN need USING (source) WHERE greatest(now, start) < least(until, stop)""")
def files_needed(spark, sf):
    docs = _docs(spark, sf)
    shares = mixture.normalize_weights(langs_of(docs)).select(
        F.col("lang").alias("source"), "share", F.col("ds").alias("offset"))
    return joins.files_needed(_files(docs), joins.need_ranges(shares, 100, 50, 8))


@register("split_docs", """
WITH n AS (SELECT count(*) AS n FROM documents),
cuts AS (SELECT round_even(0.8 * n, 0)::BIGINT AS a, round_even(0.15 * n, 0)::BIGINT AS b, round_even(0.05 * n, 0)::BIGINT AS c, n FROM n),
bounds AS (SELECT a - (a + b + c - n) AS train, a + b - (a + b + c - n) AS valid FROM cuts)
SELECT doc_id, pos, CASE WHEN pos < train THEN 'train' WHEN pos < valid THEN 'valid' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), bounds""")
def split_docs(spark, sf):
    return mixture.split_docs(_docs(spark, sf), "80,15,5").select("doc_id", "pos", "split")


@register("read_splits", """
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT CASE WHEN pos < 0.9 * n THEN 'train' ELSE 'test' END AS split, count(*) AS rows
FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents), n GROUP BY 1""")
def read_splits(spark, sf):
    from millrace.sources.corpora import read_splits as split

    docs = mixture.split_docs(_docs(spark, sf), "90,0,10")
    parts = split(docs, ["train", "test"])
    return ordering.union_sources(*[df.select(F.lit(name).alias("split")) for name, df in parts.items()]).groupBy(
        "split").agg(F.count(F.lit(1)).alias("rows"))


# Fewest epochs by counting up, not by the closed form.
@register("num_epochs", f"""WITH {TOK},
t AS (SELECT source, sum(n)::BIGINT AS tokens, count(*) AS docs FROM tok GROUP BY source),
e AS (SELECT source, tokens, docs, unnest(range(1, 200)) AS e FROM t)
SELECT source, min(e)::BIGINT AS epochs FROM e WHERE (e * tokens - 1) // 128 >= docs * 40 GROUP BY source""")
def num_epochs(spark, sf):
    tok = prepare.tokenized(documents(spark, sf)).groupBy("source").agg(
        F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    return tok.select("source", mixture.num_epochs_col(F.col("tokens"), 128, F.col("docs") * 40).alias("epochs"))


@register("doc_order", """
SELECT doc_id, e::INT AS epoch, row_number() OVER (ORDER BY e = 2, md5('2:' || e || ':' || doc_id), e, doc_id) - 1 AS pos
FROM documents, (SELECT unnest(range(3)) AS e)""")
def doc_order(spark, sf):
    return mixture.doc_order(_docs(spark, sf).select("doc_id"), 3, 2, True)


@register("doc_order_auto", """
WITH t AS (SELECT sum(length(text))::BIGINT AS tokens FROM documents),
n AS (SELECT tokens, (tokens * 9 // 4) // 256 AS n FROM t),
e AS (SELECT tokens, n, greatest(1, (n * 256 + 1 + tokens - 1) // tokens) AS epochs FROM n),
a AS (
  SELECT epochs, epochs > 1 AND n - ((epochs - 1) * tokens - 1) // 256 < floor(0.8::DOUBLE * ((tokens - 1) // 256)) AS apart FROM e)
SELECT doc_id, e::INT AS epoch, row_number() OVER (ORDER BY apart AND e = epochs - 1, md5('2:' || e || ':' || doc_id), e, doc_id) - 1 AS pos
FROM documents, (SELECT epochs, apart, unnest(range(epochs)) AS e FROM a)""")
def doc_order_auto(spark, sf):
    docs = _docs(spark, sf)
    tokens = table(spark, sf, "documents").agg(F.sum(F.length("text"))).first()[0]
    return mixture.doc_order_auto(docs.select("doc_id"), tokens, 256, tokens * 9 // 4 // 256, 2)


@register("sample_order", """
WITH n AS (SELECT count(*) AS n FROM documents)
SELECT sample, row_number() OVER (ORDER BY sample >= n * 3 // 4, md5('6:' || sample), sample) - 1 AS pos
FROM (SELECT unnest(range(n)) AS sample, n FROM n)""")
def sample_order(spark, sf):
    n = _docs(spark, sf).count()
    return mixture.sample_order(spark, n, n * 3 // 4, 6)


def place_sql(x: str, n: str, seed, salt: str = "0", back: bool = False) -> str:
    """The rounds of a permutation in SQL; states are one-number structs, as the list's members are structs."""
    order = rounds(seed)[::-1] if back else rounds(seed)
    constants = ", ".join(f"{{'x': 0::BIGINT, 's': {r.shift}::BIGINT, 'l': {r.low}::BIGINT, 'h': {r.high}::BIGINT, 'a': {r.add}::BIGINT}}" for r in order)
    other = f"((((r.s + ({salt}) * r.l) % ({n})) - a.x) % ({n}) + ({n})) % ({n})"
    top = f"greatest(a.x, {other})"
    h = f"(({top} % {PRIME}) * r.l % {PRIME} + (({top} >> 31) % {PRIME}) * r.h % {PRIME} + r.a + ({salt})) % {PRIME}"
    swap = f"((({h}) * ({h}) % {PRIME}) >> 11) % 2 = 1"
    start = f"{{'x': ({x})::BIGINT, 's': 0::BIGINT, 'l': 0::BIGINT, 'h': 0::BIGINT, 'a': 0::BIGINT}}"
    return f"list_reduce([{constants}], lambda a, r: {{'x': CASE WHEN {swap} THEN {other} ELSE a.x END, 's': 0, 'l': 0, 'h': 0, 'a': 0}}, {start}).x"


@register("sample_places", f"""
WITH n AS (SELECT count(*) AS n, count(*) * 3 // 4 AS k FROM documents),
s AS (SELECT unnest(range(n)) AS sample, n, k FROM n)
SELECT sample, {place_sql("sample", "k", 6)} AS pos FROM s WHERE sample < k
UNION ALL SELECT sample, k + {place_sql("sample - k", "n - k", 6)} FROM s WHERE sample >= k""")
def sample_places(spark, sf):
    n = _docs(spark, sf).count()
    return mixture.sample_places(spark.range(n).withColumnRenamed("id", "sample"), n, n * 3 // 4, 6)


@register("samples_at", f"""
WITH n AS (SELECT count(*) AS n, count(*) * 3 // 4 AS k FROM documents),
s AS (SELECT unnest(range(n)) AS pos, n, k FROM n)
SELECT pos, {place_sql("pos", "k", 6, back=True)} AS sample FROM s WHERE pos < k
UNION ALL SELECT pos, k + {place_sql("pos - k", "n - k", 6, back=True)} FROM s WHERE pos >= k""")
def samples_at(spark, sf):
    n = _docs(spark, sf).count()
    return mixture.samples_at(spark.range(n).withColumnRenamed("id", "pos"), n, n * 3 // 4, 6)


WINDOW_LENS = f"""lens AS (SELECT source, count(*) AS len, {hash_sql("0", "right(source, 16)")} % {PRIME} AS salt FROM documents GROUP BY source),
w AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS win FROM documents)"""


@register("window_places", f"""WITH {WINDOW_LENS}
SELECT source, doc_id, win, {place_sql("win", "len", 9, "salt")} AS place FROM w JOIN lens USING (source)""")
def window_places(spark, sf):
    docs = _docs(spark, sf)
    win = ordering.global_row_index(docs.select("source", "doc_id"), "doc_id", ["source"], "win")
    lens = docs.groupBy("source").agg(F.count(F.lit(1)).alias("len"))
    return mixture.window_places(win, lens, 9).select("source", "doc_id", "win", "place")


@register("windows_at", f"""WITH {WINDOW_LENS}
SELECT source, win AS place, {place_sql("win", "len", 9, "salt", True)} AS win FROM w JOIN lens USING (source)""")
def windows_at(spark, sf):
    docs = _docs(spark, sf)
    lens = docs.groupBy("source").agg(F.count(F.lit(1)).alias("len"))
    places = ordering.global_row_index(docs.select("source", "doc_id"), "doc_id", ["source"], "place").drop("doc_id")
    return mixture.windows_at(places, lens, 9).select("source", "place", "win")


@register("batch_samples", f"""
WITH n AS (SELECT count(*) AS n FROM documents), p AS (SELECT unnest(range(n * 3 // 2, n * 3)) AS pos, n FROM n)
SELECT pos, pos // n AS epoch, pos // 8 AS step, {place_sql("pos % n", "n", 12, f"(pos // n) % {PRIME}", True)} AS sample FROM p""")
def batch_samples(spark, sf):
    """A run resumed in the middle of its second epoch, up to the end of its third."""
    n = _docs(spark, sf).count()
    return mixture.batch_samples(spark, n, n * 3 // 2, n * 3, 12, 8)


@register("mix_fractions", f"""
WITH f AS (SELECT source, count(*) AS n, (substr(source, 4)::INT % 5) / 4.0 AS fraction FROM documents GROUP BY source),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS row FROM documents)
SELECT doc_id, source, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS pos
FROM r JOIN f USING (source) WHERE row < floor(fraction * n)""")
def mix_fractions(spark, sf):
    docs = _docs(spark, sf)
    k = F.substr("source", F.lit(4)).cast("int") % 5
    fractions = sources_of(docs).select("source", (k / 4.0).alias("fraction"))
    return mixture.mix_fractions(docs, fractions, 42).select("doc_id", "source", "pos")


@register("skip_limit_tokens", """
SELECT doc_id, source, win FROM (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS win FROM documents)
WHERE win >= 4 AND win < 4 + 23""")
def skip_limit_tokens(spark, sf):
    win = ordering.global_row_index(_docs(spark, sf), "doc_id", ["source"], "win")
    return mixture.skip_limit_tokens(win, 256, 900, 256 * 23 + 100).select("doc_id", "source", "win")


@register("capacity_check", f"""WITH {LANGS},
s AS (SELECT ds, docs, weight / (SELECT sum(weight) FROM langs) AS share FROM langs),
n AS (SELECT count(*) AS n FROM documents)
SELECT ds, (floor((n // 16) * 16 * share) * 256)::BIGINT AS needed_tokens, docs * 256 AS available_tokens,
       floor((n // 16) * 16 * share) * 256 <= docs * 256 AS enough, floor(docs / (share * 16))::BIGINT AS max_steps
FROM s, n""")
def capacity_check(spark, sf):
    docs = _docs(spark, sf)
    return mixture.capacity_check(_lens(docs), _weights(docs), docs.count() // 16, 16, 256)


# Batches --------------------------------------------------------------------------------------

NUMBERED = "numbered AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


def _numbered(docs):
    return ordering.global_row_index(docs.select("doc_id"), "doc_id")


@register("rank_split", f"""WITH {NUMBERED}
SELECT doc_id, pos, pos AS slot, (pos % 7)::INT AS rank, pos // 7 AS place FROM numbered WHERE pos < n - n % 7""")
def rank_split(spark, sf):
    docs = _docs(spark, sf)
    return batches.rank_split(_numbered(docs), 7, docs.count())


@register("rank_split_loop", f"""WITH {NUMBERED},
s AS (SELECT unnest(range((((SELECT max(n) FROM numbered) + 83) // 84 * 84)::BIGINT)) AS slot)
SELECT doc_id, pos, slot, (slot % 7)::INT AS rank, slot // 7 AS place FROM s JOIN numbered ON slot % n = pos""")
def rank_split_loop(spark, sf):
    docs = _docs(spark, sf)
    return batches.rank_split(_numbered(docs), 7, docs.count(), loop_to=12)


# Literal walk over the samples: number them from the start of the plan and cut.
PLAN = f"""{NUMBERED},
ids AS (SELECT pos AS sample, pos - 30 AS ix, n FROM numbered WHERE pos >= 30)"""


@register("batch_plan", f"""WITH {PLAN}
SELECT sample, doc_id, ix // 48 AS step, (ix % 48) // 12 AS micro, (ix % 12) // 4 AS rank, ix % 4 AS slot
FROM ids JOIN numbered ON pos = sample WHERE ix < (ids.n - 30) // 12 * 12""")
def batch_plan(spark, sf):
    docs = _docs(spark, sf)
    plan = batches.batch_plan(spark, docs.count(), 30, 4, 3, 48)
    return plan.join(_numbered(docs).withColumnRenamed("pos", "sample"), "sample")


@register("batch_plan_padded", f"""WITH {NUMBERED},
goal AS (SELECT max(n) AS n, ((max(n) - 30 + 47) // 48 * 48)::BIGINT AS m FROM numbered),
ids AS (SELECT unnest(range(m)) AS ix, n FROM goal)
SELECT CASE WHEN ix + 30 < n THEN ix + 30 ELSE -1 END::BIGINT AS sample, ix // 48 AS step, (ix % 48) // 12 AS micro,
       (ix % 12) // 4 AS rank, ix % 4 AS slot FROM ids""")
def batch_plan_padded(spark, sf):
    return batches.batch_plan(spark, _docs(spark, sf).count(), 30, 4, 3, 48, drop_last=False, pad=True)


BUCKETS = """dims AS (SELECT count(*) AS n, (count(*) // 12) * 4 AS bucket FROM documents),
ids AS (SELECT r AS rank, x, bucket FROM (SELECT unnest(range(3)) AS r), (SELECT unnest(range(bucket::BIGINT)) AS x, bucket FROM dims))"""


@register("batch_plan_random", f"""WITH {BUCKETS},
placed AS (SELECT *, row_number() OVER (PARTITION BY rank ORDER BY md5('0:' || x), x) - 1 AS place FROM ids)
SELECT 0::BIGINT AS epoch, (place - 8) // 4 AS micro, rank, (place - 8) % 4 AS slot, rank * bucket + x AS sample
FROM placed WHERE place >= 8""")
def batch_plan_random(spark, sf):
    return batches.batch_plan_random(spark, _docs(spark, sf).count(), 24, 4, 3, 48)


@register("batch_plan_cyclic", f"""WITH {BUCKETS}
SELECT 0::BIGINT AS epoch, (x - 8) // 4 AS micro, rank, (x - 8) % 4 AS slot, rank * bucket + x AS sample
FROM ids WHERE x >= 8""")
def batch_plan_cyclic(spark, sf):
    return batches.batch_plan_cyclic(spark, _docs(spark, sf).count(), 24, 4, 3, 48)


@register("resume_skip", f"""WITH {NUMBERED}
SELECT doc_id, pos, pos AS slot, (pos % 7)::INT AS rank, pos // 7 AS place FROM numbered
WHERE pos < n - n % 7 AND pos // 7 >= 45 // 7""")
def resume_skip(spark, sf):
    docs = _docs(spark, sf)
    return batches.resume_skip(batches.rank_split(_numbered(docs), 7, docs.count()), 45, 7)


@register("micro_batches", f"""WITH {NUMBERED}
SELECT doc_id, pos, pos // 24 AS chunk, (pos // 24) % 5 AS rank FROM numbered""")
def micro_batches(spark, sf):
    from millrace.operators.pack import micro_batches as chunks

    return chunks(_numbered(_docs(spark, sf)), 24, 5)


# The whole training plan: windows per source in shuffled order, fixed-bin blend, batch slots.
@register("training_samples", f"""WITH {TOK}, {SOURCES},
long AS (SELECT source, doc_id, unnest(list_append(ids, '<eos>')) AS tok, generate_subscripts(list_append(ids, '<eos>'), 1) AS offs FROM tok),
stream AS (SELECT source, tok, row_number() OVER (PARTITION BY source ORDER BY doc_id, offs) - 1 AS place FROM long),
win AS (SELECT source, place // 65 AS win, list(tok ORDER BY place) AS ids FROM stream GROUP BY 1, 2 HAVING count(*) = 65),
lens AS (SELECT source, count(*) AS len FROM win GROUP BY source),
shuffled AS (SELECT source, ids, row_number() OVER (PARTITION BY source ORDER BY md5('31:' || right(source, 16) || ':' || win), win) - 1 AS place FROM win),
b AS (SELECT ds, source, floor(docs / (SELECT sum(docs) FROM sources) * 100)::BIGINT AS bins FROM sources),
c AS (SELECT ds, source, CASE WHEN ds = (SELECT max(ds) FROM b) THEN 100 - (SELECT sum(bins) FROM b) + bins ELSE bins END::BIGINT AS bins FROM b),
bin AS (SELECT ds, source, bins, unnest(range(bins)) AS bias FROM c),
numbered AS (SELECT *, row_number() OVER (ORDER BY ds, bias) - 1 AS bin FROM bin),
blend AS (
  SELECT p.pos, n.ds, n.source, ((n.bias + (p.pos // 100) * n.bins) % l.len)::BIGINT AS place
  FROM (SELECT unnest(range((SELECT count(*) FROM documents))) AS pos) p JOIN numbered n ON p.pos % 100 = n.bin JOIN lens l USING (source))
SELECT pos AS sample, pos // 32 AS step, (pos % 32) // 16 AS micro, (pos % 16) // 4 AS rank, pos % 4 AS slot, ds,
       md5(array_to_string(list_slice(ids, 1, 64), ' ')) AS inputs, md5(array_to_string(list_slice(ids, 2, 65), ' ')) AS labels
FROM blend JOIN shuffled USING (source, place) WHERE pos < (SELECT count(*) FROM documents) // 16 * 16""")
def training_samples(spark, sf):
    docs = documents(spark, sf).select("doc_id", "source", "text")
    tok = stored(prepare.tokenized(docs).drop("text").withColumn("ids", F.concat("ids", F.array(F.lit("<eos>")))), "tokenized")
    sized = tok.withColumn("_n", F.col("n_tokens") + 1)
    stream = ordering.running_offset(sized, ["source"], "doc_id", "_n", "start")
    sources = sources_of(docs).select("source", "ds", F.col("docs").alias("weight"))
    out = training.training_samples(spark, stream, sources, 64, docs.count(), "<eos>", 31, 4, 4, 32, greedy=False)
    return out.select("sample", "step", "micro", "rank", "slot", "ds", digest("input_ids").alias("inputs"),
                      digest("label_ids").alias("labels"))
