"""Queries over benchmark items, answers, grades and result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.registry import GRADED, TOK, graded_of, hash_sql, register
from millrace.functions import text as X
from millrace.operators import evals, joins, ordering, quality, ranking
from millrace.operators.ordering import plan_table
from millrace.plans import prepare
from millrace.session import table

# Answers built from documents: a nested group, a plain one, an unbalanced one, none, one before the
# end of the thinking part, an empty one after it, a choice, and one with an early brace.
ANSWER_SQL = r"""answers AS (
  SELECT doc_id, CASE doc_id % 8
    WHEN 0 THEN text || ' \boxed{\frac{' || n_chars || '}{2}} so'
    WHEN 1 THEN text || ' \boxed{1} then \boxed{' || n_chars || '}.'
    WHEN 2 THEN text || ' \boxed{' || n_chars
    WHEN 3 THEN text
    WHEN 4 THEN ' \boxed{' || n_chars || '}</think> ' || text
    WHEN 5 THEN text || ' \boxed{' || n_chars || '}</think>so \boxed{}'
    WHEN 6 THEN text || ' x</think>The answer is \boxed{' || substr('ABCD', (1 + doc_id % 4)::INT, 1) || '}'
    ELSE text || ' a } b \boxed x { ' || n_chars || ' {y} } z' END AS text, n_chars FROM documents)"""


def _answers(spark, sf):
    k, n = F.col("doc_id") % 8, F.col("n_chars").cast("string")
    head = F.col("text")
    text = (
        F.when(k == 0, F.concat(head, F.lit(" \\boxed{\\frac{"), n, F.lit("}{2}} so")))
        .when(k == 1, F.concat(head, F.lit(" \\boxed{1} then \\boxed{"), n, F.lit("}.")))
        .when(k == 2, F.concat(head, F.lit(" \\boxed{"), n))
        .when(k == 3, F.col("text"))
        .when(k == 4, F.concat(F.lit(" \\boxed{"), n, F.lit("}</think> "), F.col("text")))
        .when(k == 5, F.concat(head, F.lit(" \\boxed{"), n, F.lit("}</think>so \\boxed{}")))
        .when(k == 6, F.concat(head, F.lit(" x</think>The answer is \\boxed{"),
                               F.substr(F.lit("ABCD"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)), F.lit("}")))
        .otherwise(F.concat(head, F.lit(" a } b \\boxed x { "), n, F.lit(" {y} } z")))
    )
    return table(spark, sf, "documents").select("doc_id", text.alias("text"), "n_chars")


def _boxed_sql(source: str, out: str) -> str:
    """Brace depth per character after the last marker: (doc_id, boxed)."""
    return rf"""{out}_tail AS (
  SELECT doc_id, list_extract(string_split(text, '\boxed'), -1) AS tail FROM {source} WHERE contains(text, '\boxed')),
{out}_body AS (SELECT doc_id, substr(tail, strpos(tail, '{{')) AS body FROM {out}_tail WHERE contains(tail, '{{')),
{out}_chars AS (SELECT doc_id, body, unnest(range(1, length(body) + 1)) AS k FROM {out}_body),
{out}_depth AS (
  SELECT doc_id, body, k, sum(CASE substr(body, k, 1) WHEN '{{' THEN 1 WHEN '}}' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS depth
  FROM {out}_chars),
{out} AS (SELECT doc_id, substr(body, 2, min(k) FILTER (WHERE depth = 0) - 2) AS boxed FROM {out}_depth GROUP BY doc_id, body)"""


@register("answer_part", f"""WITH {ANSWER_SQL}
SELECT doc_id, md5(list_extract(string_split(text, '</think>'), -1)) AS part FROM answers""")
def answer_part(spark, sf):
    return _answers(spark, sf).select("doc_id", F.md5(X.answer_part(F.col("text"))).alias("part"))


@register("last_boxed", f"""WITH {ANSWER_SQL}, {_boxed_sql("answers", "b")}
SELECT doc_id, boxed FROM answers LEFT JOIN b USING (doc_id)""")
def last_boxed(spark, sf):
    return _answers(spark, sf).select("doc_id", X.last_boxed(F.col("text")).alias("boxed"))


PRED = f"""{ANSWER_SQL},
finals AS (SELECT doc_id, list_extract(string_split(text, '</think>'), -1) AS text FROM answers),
{_boxed_sql("finals", "f")}, {_boxed_sql("answers", "b")},
pred AS (
  SELECT a.doc_id, a.n_chars, coalesce(nullif(f.boxed, ''), b.boxed) AS pred
  FROM answers a LEFT JOIN f ON f.doc_id = a.doc_id LEFT JOIN b ON b.doc_id = a.doc_id)"""


@register("pred_answer", f"WITH {PRED} SELECT doc_id, pred FROM pred")
def pred_answer(spark, sf):
    return _answers(spark, sf).select("doc_id", X.pred_answer(F.col("text")).alias("pred"))


@register("gold_after_marker", """
SELECT doc_id, replace(trim(' ' || printf('%,d', n_chars * 1000) || ' '), ',', '') AS gold FROM documents""")
def gold_after_marker(spark, sf):
    raw = F.concat(F.lit("steps #### 1 then #### "), F.format_number(F.col("n_chars") * 1000, 0), F.lit(" "))
    return table(spark, sf, "documents").select("doc_id", X.gold_after_marker(raw).alias("gold"))


@register("grade_choice", f"""WITH {PRED}
SELECT doc_id, coalesce(nullif(regexp_extract(pred, '[ABCD]', 0), '') = 'C', false) AS correct FROM pred""")
def grade_choice(spark, sf):
    return _answers(spark, sf).select(
        "doc_id", X.choice_correct(X.pred_answer(F.col("text")), F.lit("C")).alias("correct"))


@register("grade_math", f"""WITH {PRED}
SELECT doc_id, coalesce(CASE
         WHEN regexp_full_match(pred, '[0-9]+') THEN pred::DOUBLE = n_chars
         WHEN pred LIKE '\\frac%' THEN regexp_extract(pred, '([0-9]+)', 1)::DOUBLE / 2 = n_chars ELSE false END, false) AS correct
FROM pred""".replace("\\\\frac", "\\frac"))
def grade_math(spark, sf):
    gold = F.concat(F.col("n_chars").cast("string"), F.lit(".0"))
    return _answers(spark, sf).select("doc_id", X.math_correct(X.pred_answer(F.col("text")), gold).alias("correct"))


def _bench_tables(spark, sf):
    docs = table(spark, sf, "documents")
    items = table(spark, sf, "benchmark").select(F.col("item_id").alias("key"), F.col("text").alias("question"), F.length("text").alias("answer"))
    return {
        "amc23": items,
        "gsm8k": docs.select(F.col("doc_id").alias("key"), F.col("text").alias("question"), F.col("n_chars").alias("answer")),
    }


ITEMS = """items AS (
  SELECT 'amc23' AS bench, 'amc23/' || item_id AS id, text AS question, length(text)::VARCHAR AS answer, 8 AS n FROM benchmark
  UNION ALL SELECT 'gsm8k', 'gsm8k/' || doc_id, text, n_chars::VARCHAR, 1 FROM documents)"""


@register("bench_items", f"WITH {ITEMS} SELECT bench, id, md5(question) AS question, answer, n::INT AS n FROM items")
def bench_items(spark, sf):
    items = evals.bench_items(_bench_tables(spark, sf), ("amc23", "gsm8k"), 8)
    return items.withColumn("question", F.md5("question"))


@register("sample_requests", """WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark)
SELECT 'amc23/' || item_id || '#' || j AS key, idx * 1000 + j AS seed,
       md5('<|im_start|>user' || chr(10) || text || chr(10) ||
           'Please reason step by step, and put your final answer within \\boxed{}.' || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10)) AS prompt
FROM b, (SELECT unnest(range(8)) AS j)""".replace("\\\\boxed", "\\boxed"))
def sample_requests(spark, sf):
    numbered = ordering.global_row_index(table(spark, sf, "benchmark"), "item_id", out="idx").select(
        "idx", F.concat(F.lit("amc23/"), F.col("item_id").cast("string")).alias("id"), F.col("text").alias("question"), F.lit(8).alias("n"))
    return evals.request_prompts(evals.sample_requests(numbered)).select("key", "seed", F.md5("prompt").alias("prompt"))


@register("pending_samples", """
SELECT 'd/' || doc_id || '#' || j AS key FROM documents, (SELECT unnest(range(2)) AS j)
WHERE NOT (j = 0 AND doc_id IN (SELECT doc_id FROM labels))""")
def pending_samples(spark, sf):
    items = table(spark, sf, "documents").select(
        F.concat(F.lit("d/"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("idx"), F.lit(2).alias("n"))
    done = table(spark, sf, "labels").select(F.concat(F.lit("d/"), F.col("doc_id").cast("string"), F.lit("#0")).alias("key"))
    return joins.pending_samples(evals.sample_requests(items), done).select("key")


@register("settings_differ", """
SELECT 'max_tokens' AS setting, max(n_chars)::VARCHAR AS stored, (max(n_chars) + 1)::VARCHAR AS wanted FROM documents""")
def settings_differ(spark, sf):
    base = table(spark, sf, "documents").agg(F.max("n_chars").alias("max_tokens"), F.min("lang").alias("model"))
    return evals.settings_differ(base, base.withColumn("max_tokens", F.col("max_tokens") + 1), ("model", "max_tokens"))


@register("unknown_benchmarks", """
SELECT DISTINCT lang AS bench FROM documents WHERE lang <> 'fr'""")
def unknown_benchmarks(spark, sf):
    names = table(spark, sf, "documents").select(F.col("lang").alias("bench")).distinct()
    return evals.unknown_benchmarks(names, ("fr",))


_OPT = "list_transform(range(4), lambda i: substr(text, 1 + i * (length(text) // 4), CASE WHEN i < 3 THEN length(text) // 4 ELSE length(text) END))"


def _quarters():
    """The text in four parts."""
    step = F.expr("length(text) div 4").cast("int")
    size = lambda i: step if i < 3 else F.length("text")
    return F.array(*[F.substr(F.col("text"), F.lit(1) + step * i, size(i)) for i in range(4)])


@register("shuffle_options", f"""
WITH o AS (SELECT item_id, text, unnest({_OPT}) AS o, unnest(range(4)) AS i FROM benchmark),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY md5('0:' || item_id || ':' || i)) AS place FROM o)
SELECT item_id, max(substr('ABCD', place::INT, 1)) FILTER (WHERE i = 0) AS answer,
       md5(trim(max(text)) || chr(10) || chr(10) || string_agg(substr('ABCD', place::INT, 1) || '. ' || trim(o), chr(10) ORDER BY place) || chr(10) || chr(10)
           || 'Answer with the letter of the correct option.') AS question
FROM r GROUP BY item_id""")
def shuffle_options(spark, sf):
    items = table(spark, sf, "benchmark").select("item_id", F.col("text").alias("question"), _quarters().alias("options"))
    return evals.shuffle_options(items, 0).select("item_id", "answer", F.md5("question").alias("question"))


@register("normalize_mcq", f"""
SELECT doc_id, (doc_id % 4)::INT AS gold_idx, md5(array_to_string({_OPT}, '|')) AS choices FROM documents""")
def normalize_mcq(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    place = (F.col("doc_id") % 4).cast("int")
    choices = _quarters()
    letter = F.substr(F.lit("ABCD"), place + 1, F.lit(1))
    key = F.when(F.col("doc_id") % 3 == 0, (place + 1).cast("string")).otherwise(F.concat(F.lit(" "), letter))
    two = docs.where(F.col("doc_id") % 3 < 2)
    by_key = evals.normalize_mcq(two, F.col("text"), choices, key)
    labels = F.array(*[F.lit(x) for x in ("p", "q", "r", "s")])
    by_label = evals.normalize_mcq(docs.where(F.col("doc_id") % 3 == 2), F.col("text"), choices,
                                   F.get(labels, place), labels)
    return by_key.unionByName(by_label).select(
        "doc_id", "gold_idx", F.md5(F.array_join("choices", "|")).alias("choices"))


@register("grade_items", """
SELECT lang || '/' || source AS bench, count(*) AS items, count(*) FILTER (WHERE quality = toxic) AS same
FROM documents JOIN labels USING (doc_id) GROUP BY 1""")
def grade_items(spark, sf):
    gens = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("/", "lang", "source").alias("bench"))
    labels = table(spark, sf, "labels")
    items = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("answer"))
    joined = joins.grade_items(gens, items).join(labels.select(F.col("doc_id").alias("id"), "toxic"), "id")
    return joined.groupBy("bench").agg(F.count(F.lit(1)).alias("items"), F.count_if(F.col("gold") == F.col("toxic")).alias("same"))


@register("grade", f"""WITH {PRED}
SELECT d.lang AS bench, d.doc_id, p.pred, coalesce(CASE
         WHEN regexp_full_match(p.pred, '[0-9]+') THEN p.pred::DOUBLE = d.n_chars
         WHEN p.pred LIKE '\\frac%' THEN regexp_extract(p.pred, '([0-9]+)', 1)::DOUBLE / 2 = d.n_chars ELSE false END, false) AS correct
FROM pred p JOIN documents d USING (doc_id)""".replace("\\\\frac", "\\frac"))
def grade(spark, sf):
    langs = table(spark, sf, "documents").select("doc_id", F.col("lang").alias("bench"))
    gens = _answers(spark, sf).join(langs, "doc_id").withColumn("answer", F.col("n_chars").cast("string"))
    return evals.grade(gens).select("bench", "doc_id", "pred", "correct")


@register("eval_summary", f"""WITH {GRADED}
SELECT bench, round_even(100.0::DOUBLE * sum(correct::INT) / count(*), 2) AS accuracy, count(*) AS samples,
       round_even(sum(tokens)::DOUBLE / count(*), 0)::BIGINT AS mean_tokens,
       round_even(100.0::DOUBLE * sum(truncated::INT) / count(*), 1) AS truncated
FROM graded GROUP BY bench""")
def eval_summary(spark, sf):
    return evals.eval_summary(graded_of(spark, sf))


@register("avg_at_n", f"""WITH {GRADED},
q AS (SELECT bench, id, avg(correct::INT) AS q, count(*) AS n FROM graded GROUP BY bench, id)
SELECT bench, count(*) AS questions, sum(n)::BIGINT AS samples, round(100 * avg(q), 6) AS accuracy FROM q GROUP BY bench""")
def avg_at_n(spark, sf):
    return evals.avg_at_n(graded_of(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


@register("wilson_interval", f"""WITH {GRADED},
s AS (SELECT bench, sum(correct::INT)::BIGINT AS correct, count(*) AS samples FROM graded GROUP BY bench),
p AS (SELECT *, correct / samples AS p, 1.96::DOUBLE AS z FROM s)
SELECT bench, correct, samples,
       round((p + z * z / (2 * samples) - z * sqrt((p * (1 - p) + z * z / (4 * samples)) / samples)) / (1 + z * z / samples), 9) AS ci_low,
       round((p + z * z / (2 * samples) + z * sqrt((p * (1 - p) + z * z / (4 * samples)) / samples)) / (1 + z * z / samples), 9) AS ci_high
FROM p""")
def wilson_interval(spark, sf):
    counts = graded_of(spark, sf).groupBy("bench").agg(
        F.sum(F.col("correct").cast("int")).alias("correct"), F.count(F.lit(1)).alias("samples"))
    out = evals.wilson_interval(counts)
    return out.withColumn("ci_low", F.round("ci_low", 9)).withColumn("ci_high", F.round("ci_high", 9))


@register("token_quantiles", f"""WITH {GRADED},
r AS (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY tokens) AS rn, count(*) OVER (PARTITION BY bench) AS n FROM graded)
SELECT bench, avg(tokens) FILTER (WHERE rn IN ((n + 1) // 2, (n + 2) // 2)) AS median_tokens,
       (min(tokens) FILTER (WHERE rn * 10 >= n * 9))::DOUBLE AS p90_tokens, round(avg(truncated::INT), 9) AS truncation_rate
FROM r GROUP BY bench""")
def token_quantiles(spark, sf):
    out = evals.token_quantiles(graded_of(spark, sf), "bench")
    return out.withColumn("p90_tokens", F.col("p90_tokens").cast("double")).withColumn(
        "truncation_rate", F.round("truncation_rate", 9))


@register("value_quantiles", """
WITH r AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS rn, count(*) OVER (PARTITION BY lang) AS n FROM documents),
h AS (SELECT *, (n - 1) // 4 AS lo, (n - 1) % 4 AS rest FROM r)
SELECT lang, max(n_chars) FILTER (WHERE rn = lo) + CASE WHEN max(rest) > 0 THEN
         (max(n_chars) FILTER (WHERE rn = lo + 1) - max(n_chars) FILTER (WHERE rn = lo)) * max(rest) / 4.0::DOUBLE ELSE 0.0::DOUBLE END AS q25,
       (max(n_chars) FILTER (WHERE rn = (99 * n + 99) // 100 - 1))::DOUBLE AS p99, (min(n_chars) FILTER (WHERE rn = 0))::DOUBLE AS least
FROM h GROUP BY lang""")
def value_quantiles(spark, sf):
    wanted = {"q25": ("interpolated", 1, 4), "p99": ("nearest", 99, 100), "least": ("nearest", 0, 1)}
    return evals.value_quantiles(table(spark, sf, "documents"), "n_chars", wanted, "lang")


@register("quantile_sketches", """
SELECT lang, share, true AS within FROM (SELECT DISTINCT lang FROM documents), (VALUES (0.01), (0.5), (0.9), (0.999)) AS v(share)""")
def quantile_sketches(spark, sf):
    """Sketches per language and source, merged by language; whether each quantile's rank is within the sketch's error of its share."""
    docs = table(spark, sf, "documents").select("lang", "source", "n_chars")
    sketches = evals.merged_sketches(evals.quantile_sketches(docs, "n_chars", "lang", "source"), "lang")
    shares = [0.01, 0.5, 0.9, 0.999]
    told = sketches.select("lang", F.explode(F.array(*[
        F.struct(F.lit(s).alias("share"), evals.sketched_quantile(s).alias("value")) for s in shares])).alias("s")).select("lang", "s.*")
    ranks = docs.join(plan_table(told), "lang").groupBy("lang", "share").agg(
        F.avg((F.col("n_chars") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("n_chars") <= F.col("value")).cast("int")).alias("upto"))
    slack = 2 * evals.SKETCH_ERROR
    return ranks.select("lang", F.col("share").cast("decimal(4,3)").alias("share"), ((F.col("below") - slack <= F.col("share")) & (F.col("share") <= F.col("upto") + slack)).alias("within"))


# The bootstrap by its definition: every replicate draws a Poisson(1) weight per question.
@register("paired_diff_ci", f"""WITH {GRADED},
q AS (SELECT bench, id, avg(correct::INT) - avg(truncated::INT) AS d FROM graded GROUP BY bench, id),
u AS (SELECT bench, id, d, r, {hash_sql("23", "r", "bench", "id")} / 4294967296.0::DOUBLE AS u FROM q, (SELECT unnest(range(200)) AS r)),
cdf AS (SELECT k, sum(exp(-1) / gamma(k + 1)) OVER (ORDER BY k) AS c FROM (SELECT unnest(range(12)) AS k)),
w AS (SELECT bench, id, d, r, count(c) AS w FROM u LEFT JOIN cdf ON u.u >= cdf.c GROUP BY bench, id, d, r),
m AS (SELECT bench, r, sum(w * d) / nullif(sum(w), 0) AS m FROM w GROUP BY bench, r),
e AS (SELECT bench, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM m GROUP BY bench)
SELECT bench, round(avg(d), 9) AS difference, count(*) AS questions, round(max(ci_low), 6) AS ci_low, round(max(ci_high), 6) AS ci_high
FROM q JOIN e USING (bench) GROUP BY bench""")
def paired_diff_ci(spark, sf):
    graded = graded_of(spark, sf)
    other = graded.withColumn("correct", F.col("truncated"))
    out = evals.paired_diff_ci(graded, other, 200, 23)
    return out.select("bench", F.round("difference", 9).alias("difference"), "questions",
                      F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


POINTS = f"""{GRADED},
points AS (
  SELECT 's' || (substr(id, 4)::INT % 3) AS series, (substr(id, 4)::INT // 3) * 500 AS step, bench, count(DISTINCT id) AS questions,
         count(*) AS samples, sum(correct::INT)::BIGINT AS correct FROM graded GROUP BY 1, 2, 3)"""


def _points(spark, sf):
    k = F.substr("id", F.lit(4)).cast("int")
    return graded_of(spark, sf).withColumn("series", F.concat(F.lit("s"), k % 3)).withColumn(
        "step", F.expr("cast(substr(id, 4) as int) div 3 * 500")
    ).groupBy("series", "step", "bench").agg(
        F.countDistinct("id").alias("questions"), F.count(F.lit(1)).alias("samples"),
        F.sum(F.col("correct").cast("int")).alias("correct"),
    ).withColumn("accuracy", F.lit(100.0) * F.col("correct") / F.col("samples"))


@register("compare_runs", f"""WITH {POINTS}
SELECT a.bench, a.step::BIGINT AS step, round(100.0 * a.correct / a.samples - 100.0 * b.correct / b.samples, 9) AS difference
FROM points a JOIN points b ON a.bench = b.bench AND a.step = b.step WHERE a.series = 's0' AND b.series = 's1'""")
def compare_runs(spark, sf):
    return joins.compare_runs(_points(spark, sf), "s0", "s1").select("bench", "step", F.round("difference", 9).alias("difference"))


@register("compare_runs_at_compute", f"""WITH {POINTS}
SELECT a.bench, a.step::BIGINT AS step, round(100.0 * a.correct / a.samples - 100.0 * b.correct / b.samples, 9) AS difference
FROM points a JOIN points b ON a.bench = b.bench AND a.step * 3 = b.step * 2 WHERE a.series = 's0' AND b.series = 's1'""")
def compare_runs_at_compute(spark, sf):
    return joins.compare_runs(_points(spark, sf), "s0", "s1", (3, 2)).select("bench", "step", F.round("difference", 9).alias("difference"))


@register("validate_points", f"""WITH {POINTS},
steps AS (SELECT DISTINCT series, step FROM points),
broken AS (SELECT *, samples % 4 = 0 AS t, samples % 5 = 0 AS a FROM points)
SELECT series, step, NULL AS bench, 'unexpected step' AS rule FROM steps WHERE step = 0
UNION ALL SELECT series, step + 100000, NULL, 'missing step' FROM steps WHERE step = 500
UNION ALL SELECT series, step, bench, 'tokens' FROM broken WHERE t
UNION ALL SELECT series, step, bench, 'unknown benchmark' FROM broken WHERE bench = 'de'
UNION ALL SELECT series, step, bench, 'sample counts' FROM broken WHERE bench <> 'de' AND (questions <> 1 OR samples <> 6)
UNION ALL SELECT series, step, bench, 'accuracy' FROM broken WHERE a""")
def validate_points(spark, sf):
    points = _points(spark, sf).withColumn("samples_per_question", F.lit(6)).withColumn(
        "tokens_b", (F.col("step") + F.when(F.col("samples") % 4 == 0, 1).otherwise(0)) * F.lit(float(evals.TOKENS_PER_STEP)) / F.lit(1e9)
    ).withColumn("accuracy", F.col("accuracy") + F.when(F.col("samples") % 5 == 0, 0.5).otherwise(0.0))
    have = points.select("series", "step").distinct()
    steps = have.where(F.col("step") != 0).unionByName(have.where(F.col("step") == 500).withColumn("step", F.col("step") + 100000))
    benches = points.select("bench").distinct().where(F.col("bench") != "de").select(
        "bench", F.lit(1).alias("questions"), F.lit(6).alias("samples_per_question"))
    return evals.validate_points(points, steps, benches)


@register("flatten_results", f"""WITH {GRADED},
s AS (SELECT bench, id, avg(tokens) AS mean, max(tokens)::DOUBLE AS longest FROM graded GROUP BY bench, id)
SELECT bench AS dataset, id AS subtask, metric, round(value, 9) AS value, bench || '/' || id || '/' || metric AS name
FROM (SELECT bench, id, unnest(['mean', 'longest']) AS metric, unnest([mean, longest]) AS value FROM s)""")
def flatten_results(spark, sf):
    stats = graded_of(spark, sf).groupBy("bench", "id").agg(
        F.avg("tokens").alias("mean"), F.max("tokens").cast("double").alias("longest"), F.stddev("tokens").alias("mean_stderr"))
    metrics = F.map_from_arrays(
        F.array(F.lit("mean"), F.lit("longest"), F.lit("mean_stderr")), F.array("mean", "longest", F.coalesce("mean_stderr", F.lit(0.0))))
    one = stats.select("bench", F.concat(F.lit("suite|"), F.col("bench"), F.lit(":"), F.col("id"), F.lit("|0")).alias("task"), metrics.alias("m"))
    # A result file per task.
    whole = F.map_concat(F.create_map("task", "m"), F.create_map(F.lit("all"), F.create_map(F.lit("mean"), F.lit(1.0))))
    results = one.select(F.to_json(F.struct(whole.alias("results"))).alias("json"))
    return evals.flatten_results(results).withColumn("value", F.round("value", 9))


SCORES = """long AS (
  SELECT label % 3 AS bench, vec_id AS item_id, unnest(embedding) AS logprob, unnest(range(len(embedding))) AS choice FROM embeddings),
scores AS (SELECT bench, item_id, choice, logprob::DOUBLE - 1 AS logprob, 1 + (choice + item_id) % 4 AS n_tokens, 3 + (choice * item_id) % 7 AS n_chars,
                  logprob::DOUBLE * choice AS base_logprob, item_id % 5 AS gold_idx FROM long)"""


def _scores(spark, sf):
    long = table(spark, sf, "embeddings").select(
        F.pmod("label", F.lit(3)).alias("bench"), F.col("vec_id").alias("item_id"),
        F.posexplode("embedding").alias("choice", "x"))
    x = F.col("x").cast("double")
    return long.select(
        "bench", "item_id", "choice", (x - 1).alias("logprob"), (1 + (F.col("choice") + F.col("item_id")) % 4).alias("n_tokens"),
        (3 + (F.col("choice") * F.col("item_id")) % 7).alias("n_chars"), (x * F.col("choice")).alias("base_logprob"),
        (F.col("item_id") % 5).alias("gold_idx"))


_NORMS = {"raw": "logprob", "token": "logprob / n_tokens", "char": "logprob / n_chars", "pmi": "logprob - base_logprob"}


@register("mcq_accuracy", f"WITH {SCORES} " + " UNION ALL ".join(f"""
SELECT bench::INT AS bench, round(avg((choice = gold_idx)::INT), 9) AS accuracy, count(*) AS items, '{name}' AS norm FROM (
  SELECT *, row_number() OVER (PARTITION BY bench, item_id ORDER BY {value} DESC, choice) AS r FROM scores) WHERE r = 1 GROUP BY bench"""
    for name, value in _NORMS.items()))
def mcq_accuracy(spark, sf):
    parts = [evals.mcq_accuracy(_scores(spark, sf), norm).withColumn("norm", F.lit(norm)) for norm in _NORMS]
    return ordering.union_sources(*parts).withColumn("accuracy", F.round("accuracy", 9))


CANDIDATES = """cand AS (
  SELECT vec_id AS item, unnest(embedding)::DOUBLE * 10 AS score, unnest(range(len(embedding)))::INT AS id FROM embeddings)"""


def _candidates(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item"), F.posexplode("embedding").alias("id", "x")
    ).select("item", "id", (F.col("x").cast("double") * 10).alias("score"))


@register("topk_per_group", f"""WITH {CANDIDATES},
r AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id)::INT AS rank FROM cand),
t AS (SELECT *, exp(score / 0.7) AS w FROM r WHERE rank <= 5)
SELECT item, id, rank, round(w / sum(w) OVER (PARTITION BY item), 8) AS prob FROM t""")
def topk_per_group(spark, sf):
    return ranking.topk_per_group(_candidates(spark, sf), ["item"], "score", 5, 0.7).select(
        "item", "id", "rank", F.round("prob", 8).alias("prob"))


@register("topp_per_group", f"""WITH {CANDIDATES},
p AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY item) AS prob FROM cand),
c AS (SELECT *, sum(prob) OVER (PARTITION BY item ORDER BY score, id DESC ROWS UNBOUNDED PRECEDING) AS cum,
             row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS r FROM p)
SELECT item, id, round(prob, 8) AS prob FROM c WHERE cum > 1 - 0.6 OR r <= 2""")
def topp_per_group(spark, sf):
    return ranking.topp_per_group(_candidates(spark, sf), ["item"], "score", 0.6, keep=2, step=0.5).select(
        "item", "id", F.round("prob", 8).alias("prob"))


@register("best_per_group", f"""WITH {CANDIDATES}
SELECT item, id, score FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, id) AS r FROM cand) WHERE r = 1""")
def best_per_group(spark, sf):
    return ranking.best_per_group(_candidates(spark, sf), ["item"], "score")


@register("top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def top_k(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(50)
