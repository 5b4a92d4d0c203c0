"""Queries over run bookkeeping, column profiles and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.mixing import BINS, _lens, _weights
from millrace.catalog.registry import LANGS, TOK, documents, langs_of, register
from millrace.operators import joins, mixture, quality, runs
from millrace.plans import prepare
from millrace.session import stored, table


def _blend(spark, sf):
    docs = table(spark, sf, "documents")
    return mixture.blend_bins(spark, _weights(docs), _lens(docs), 3 * docs.count(), 50)


@register("consumed_tokens", f"""WITH {BINS},
s AS (SELECT pos // 64 AS step, ds, count(*) * 256 AS tokens FROM blend GROUP BY 1, 2)
SELECT step, ds, tokens, (sum(tokens) OVER (PARTITION BY ds ORDER BY step))::BIGINT AS cumulative FROM s""")
def consumed_tokens(spark, sf):
    return runs.consumed_tokens(_blend(spark, sf), 64, 256)


# Stages from events: a user is a source, a month day block a stage, an event a sample.
STAGES = """log AS (SELECT 'stage' || ((day(ts) - 1) // 6) AS stage, 'u' || user_id AS source, 100 AS tokens FROM events),
consumed AS (SELECT stage, source, sum(tokens)::BIGINT AS tokens FROM log GROUP BY stage, source),
stages AS (SELECT stage, count(*) + (CASE WHEN stage = 'stage2' THEN 1 ELSE 0 END) AS consumed_samples FROM log GROUP BY stage)"""


def _log(spark, sf):
    return table(spark, sf, "events").select(
        F.concat(F.lit("stage"), F.expr("(day(ts) - 1) div 6").cast("string")).alias("stage"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.lit(100).alias("tokens"))


def _consumed(spark, sf):
    return _log(spark, sf).groupBy("stage", "source").agg(F.sum("tokens").cast("bigint").alias("tokens"))


@register("check_consumption", f"""WITH {STAGES}
SELECT s.stage, s.consumed_samples * 100 AS expected, (SELECT sum(tokens)::BIGINT FROM consumed c WHERE c.stage = s.stage) AS tokens,
       s.stage <> 'stage2' AS ok FROM stages s""")
def check_consumption(spark, sf):
    stages = _log(spark, sf).groupBy("stage").agg(F.count(F.lit(1)).alias("n")).select(
        "stage", (F.col("n") + F.when(F.col("stage") == "stage2", 1).otherwise(0)).alias("consumed_samples"), F.lit(100).alias("seq_len"))
    return runs.check_consumption(_consumed(spark, sf), stages)


@register("consumed_total", f"""WITH {STAGES}
SELECT source, sum(tokens)::BIGINT AS tokens, sum(tokens // 64)::BIGINT AS sample_offset FROM consumed GROUP BY source""")
def consumed_total(spark, sf):
    return runs.consumed_total(_consumed(spark, sf).withColumn("seq_len", F.lit(64)))


# A stage starts where a quarter of the orders begins.
STAGE_TABLE = """stage_table AS (
  SELECT 'q' || q AS name, 1 + q * ((SELECT count(*) FROM orders) // 5) AS start_step FROM (SELECT unnest(range(5)) AS q))"""


def _stages(spark, sf):
    fifth = table(spark, sf, "orders").agg(F.expr("count(1) div 5").alias("k"))
    return fifth.select("k", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("q")).select(
        F.concat(F.lit("q"), F.col("q").cast("string")).alias("name"), (1 + F.col("q") * F.col("k")).cast("bigint").alias("start_step"))


@register("stage_for_step", f"""WITH {STAGE_TABLE}
SELECT o_orderkey AS step, name FROM orders ASOF JOIN stage_table ON o_orderkey >= start_step""")
def stage_for_step(spark, sf):
    steps = table(spark, sf, "orders").select(F.col("o_orderkey").alias("step"))
    return joins.stage_for_step(steps, _stages(spark, sf)).select("step", "name")


@register("next_stage_start", f"WITH {STAGE_TABLE} SELECT name, start_step, lead(start_step) OVER (ORDER BY start_step) AS next_start FROM stage_table")
def next_stage_start(spark, sf):
    return runs.next_stage_start(_stages(spark, sf))


@register("stage_plan", f"""WITH {STAGE_TABLE}, n AS (SELECT count(*) AS n FROM orders),
e AS (SELECT name, start_step, coalesce(lead(start_step) OVER (ORDER BY start_step), n) AS end_step, n // 2 AS last FROM stage_table, n)
SELECT name, start_step, end_step, CASE WHEN last > start_step THEN 0 ELSE end_step - last + 1 END AS remaining_steps FROM e""")
def stage_plan(spark, sf):
    n = table(spark, sf, "orders").count()
    return runs.stage_plan(_stages(spark, sf), n, n // 2)


@register("stage_faults", """
SELECT o_orderpriority AS value, 'name used twice' AS rule FROM orders GROUP BY 1 HAVING count(*) > 1
UNION ALL SELECT (o_orderkey + 2)::VARCHAR, 'start used twice' FROM orders GROUP BY o_orderkey HAVING count(*) > 1
UNION ALL SELECT (min(o_orderkey) + 2)::VARCHAR, 'first stage must start at 1' FROM orders""")
def stage_faults(spark, sf):
    return runs.stage_faults(table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") + 2).alias("start_step")))


@register("run_throughput", """
WITH s AS (SELECT event_type AS run, event_id AS step, value AS seconds FROM events)
SELECT run, count(*) AS steps, round(count(*) * 512.0 * 1024 / sum(seconds), 4) AS tokens_per_sec,
       round(count(*) * 512.0 * 1024 / sum(seconds) / 8, 4) AS tokens_per_sec_per_device,
       round((200000 - max(step)) * sum(seconds) / count(*), 2) AS eta_seconds FROM s GROUP BY run""")
def run_throughput(spark, sf):
    log = table(spark, sf, "events").select(
        F.col("event_type").alias("run"), F.col("event_id").alias("step"), F.col("value").alias("seconds"))
    out = runs.run_throughput(log, 512, 1024, 8, total_steps=200000)
    return out.select("run", "steps", F.round("tokens_per_sec", 4).alias("tokens_per_sec"),
                      F.round("tokens_per_sec_per_device", 4).alias("tokens_per_sec_per_device"), F.round("eta_seconds", 2).alias("eta_seconds"))


def _profile_sql(col: str, source: str, group: str) -> str:
    """Two passes: moments around the mean, not Spark's one-pass formula."""
    return f"""
SELECT {group}, '{col}' AS "column", count(*) AS n, round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std, min(x) AS min, max(x) AS max,
       round(sum(abs(x)), 1) AS norm_l1, round(sqrt(sum(x * x)), 2) AS norm_l2, round(avg((abs(x) < 1e-10)::INT), 9) AS zero_frac,
       round(avg(pow((x - m) / s, 4)) - 3, 5) AS kurtosis
FROM (SELECT *, {col}::DOUBLE AS x FROM {source}) t
JOIN (SELECT {group} AS g, avg({col}::DOUBLE) AS m, stddev_samp({col}::DOUBLE) AS s FROM {source} GROUP BY ALL) u ON g IS NOT DISTINCT FROM {group}
GROUP BY ALL"""


def _rounded(df):
    digits = {"mean": 4, "std": 4, "norm_l1": 1, "norm_l2": 2, "zero_frac": 9, "kurtosis": 5}
    for c, d in digits.items():
        df = df.withColumn(c, F.round(c, d))
    return df


@register("column_profile", "SELECT * EXCLUDE (g) FROM (" + " UNION ALL ".join(
    _profile_sql(c, "(SELECT *, 1 AS g1 FROM lineitem)", "g1").replace("SELECT g1,", "SELECT g1 AS g,", 1)
    for c in ("l_quantity", "l_extendedprice", "l_discount")) + ")")
def column_profile(spark, sf):
    return _rounded(quality.column_profile(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"]))


@register("column_profile_by", _profile_sql("l_extendedprice", "lineitem", "l_returnflag") + " UNION ALL " + _profile_sql(
    "l_extendedprice", "(SELECT * REPLACE (NULL::VARCHAR AS l_returnflag) FROM lineitem)", "l_returnflag"))
def column_profile_by(spark, sf):
    return _rounded(quality.column_profile_by(table(spark, sf, "lineitem"), ["l_extendedprice"], ["l_returnflag"]))


@register("vector_profile", """
WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT label, avg(x) AS m, stddev_samp(x) AS s FROM x GROUP BY label)
SELECT label, count(*) AS n, round(avg(x), 7) AS mean, round(stddev_samp(x), 7) AS std, round(sqrt(sum(x * x)), 6) AS norm_l2,
       round(avg(pow((x - m) / s, 4)) - 3, 5) AS kurtosis FROM x JOIN m USING (label) GROUP BY label""")
def vector_profile(spark, sf):
    long = table(spark, sf, "embeddings").select("label", F.explode("embedding").alias("x"))
    out = quality.column_profile_by(long, ["x"], ["label"]).where(F.col("label").isNotNull())
    return out.select("label", "n", F.round("mean", 7).alias("mean"), F.round("std", 7).alias("std"),
                      F.round("norm_l2", 6).alias("norm_l2"), F.round("kurtosis", 5).alias("kurtosis"))


@register("table_fingerprint", """
WITH d AS (SELECT sha256(concat_ws(chr(31), doc_id::VARCHAR, coalesce(text, '\\N'), lang, source, n_chars::VARCHAR)) AS h FROM documents),
f AS (SELECT count(*) AS rows, bit_xor(('0x' || substr(h, 1, 15))::BIGINT) AS x, sum(('0x' || substr(h, 1, 15))::HUGEINT)::VARCHAR AS s FROM d)
SELECT rows, sha256(rows || ':' || x || ':' || s) AS fingerprint FROM f""".replace("\\\\N", "\\N"))
def table_fingerprint(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    return quality.table_fingerprint(docs)


@register("masked_mean", """
SELECT l_returnflag || (l_linenumber % 2) AS g, round(CASE WHEN sum(m) > 0 THEN sum(l_extendedprice * m) / sum(m) ELSE 'nan'::DOUBLE END, 4) AS masked_mean
FROM (SELECT *, (l_returnflag <> 'R' AND l_quantity < 25)::INT AS m FROM lineitem) GROUP BY 1""")
def masked_mean(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("m", (F.col("l_returnflag") != "R") & (F.col("l_quantity") < 25)).withColumn(
        "g", F.concat("l_returnflag", (F.col("l_linenumber") % 2).cast("string")))
    return runs.masked_mean(rows, "l_extendedprice", "m", ["g"]).withColumn("masked_mean", F.round("masked_mean", 4))


@register("epochs_used", f"""WITH {TOK}
SELECT source, (count(*) * 9000) // sum(n)::BIGINT AS epochs, count(*) * 9000 * 256 AS planned_tokens FROM tok GROUP BY source""")
def epochs_used(spark, sf):
    lens = prepare.tokenized(documents(spark, sf)).groupBy("source").agg(
        F.sum("n_tokens").alias("len"), (F.count(F.lit(1)) * 9000).alias("requested"))
    return runs.epochs_used(lens, L=256).select("source", "epochs", "planned_tokens")


@register("changed_blocks", """
WITH d AS (SELECT source, doc_id, doc_id // 16 AS block FROM documents),
odd AS (SELECT source, block, 'changed' AS change FROM d WHERE doc_id % 97 = 5
        UNION SELECT source, block, 'changed' FROM d GROUP BY source, block HAVING bool_or(doc_id % 89 = 3) AND NOT bool_and(doc_id % 89 = 3)),
gone AS (SELECT source, block, 'removed' AS change FROM d GROUP BY source, block HAVING bool_and(doc_id % 89 = 3)),
fresh AS (SELECT DISTINCT 'new' AS source, block, 'added' AS change FROM d WHERE doc_id % 211 = 7)
SELECT source, block::BIGINT AS block, change FROM odd WHERE (source, block) NOT IN (SELECT (source, block) FROM gone)
UNION ALL SELECT * FROM gone UNION ALL SELECT * FROM fresh""")
def changed_blocks(spark, sf):
    """Documents against a copy with some texts changed, some rows taken out and a source added: exactly the blocks that differ."""
    docs = table(spark, sf, "documents").select("source", "doc_id", "text", "n_chars")
    kept = docs.where("doc_id % 89 <> 3").withColumn("text", F.when(F.col("doc_id") % 97 == 5, F.concat("text", F.lit("."))).otherwise(F.col("text")))
    copy = kept.unionByName(docs.where("doc_id % 211 = 7").withColumn("source", F.lit("new")))
    leaves = [stored(quality.block_digests(t, "doc_id", 16, ["source"]), "leaves") for t in (docs, copy)]
    return quality.changed_blocks(*leaves, ["source"])
