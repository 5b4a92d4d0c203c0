"""Benchmark items, answers, grades and the statistics over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as X
from millrace.functions.seeded import HASH_RANGE, seeded_md5
from millrace.operators.ordering import block_width, running_offset
from millrace.session import stored

# Names of the benchmarks, of the one answered by letter, and of those sampled often.
BENCHMARKS = ("aime24", "aime25", "hmmt25", "amc23", "math500", "gsm8k", "gpqa")
REPEATED = ("aime24", "aime25", "hmmt25", "amc23")
CHOICE_BENCH = "gpqa"
# Fixed value: tokens of one training step.
TOKENS_PER_STEP = 524288
# Fixed value: data set and, behind a colon, subtask in the name of a task.
TASK_PATTERN = r"\|(.*?)(?::(.*?))?\|"
# Fixed value: normal quantile of a 95 % interval.
Z95 = 1.96


def unknown_benchmarks(names: DataFrame, known: tuple[str, ...] = BENCHMARKS) -> DataFrame:
    """Names that are no benchmark."""
    return names.where(~F.col("bench").isin(list(known)))


def bench_items(tables: Mapping[str, DataFrame], names: tuple[str, ...], n: int,
                repeated: tuple[str, ...] = REPEATED) -> DataFrame:
    """Item rows (bench, id, question, answer, n); sources have (key, question, answer)."""
    wrong = [name for name in names if name not in tables]
    if wrong:
        raise ValueError(f"unknown benchmarks {wrong}; choose from {sorted(tables)}")
    out = None
    for name in names:
        part = tables[name].select(
            F.lit(name).alias("bench"), F.concat(F.lit(f"{name}/"), F.col("key").cast("string")).alias("id"),
            "question", F.col("answer").cast("string").alias("answer"),
            F.lit(n if name in repeated else 1).alias("n"),
        )
        out = part if out is None else out.unionByName(part)
    return out


def shuffle_options(df: DataFrame, seed: int = 0, key: str = "item_id", options_col: str = "options",
                    question_col: str = "question") -> DataFrame:
    """Answer options in an order fixed per item; option 0 is the right one and gives the gold letter."""
    order = F.transform(
        F.array_sort(
            F.transform(
                options_col,
                lambda o, i: F.struct(seeded_md5(seed, F.col(key), i).alias("h"), i.alias("i"), F.trim(o).alias("o")),
            )
        ),
        lambda s: F.struct(s["i"].alias("i"), s["o"].alias("o")),
    )
    letter = lambda i: F.substr(F.lit(X.CHOICE_LETTERS), i + 1, F.lit(1))
    out = df.withColumn("_order", order)
    body = F.array_join(F.transform("_order", lambda s, i: F.concat(letter(i), F.lit(". "), s["o"])), "\n")
    place = F.array_position(F.transform("_order", lambda s: s["i"]), 0).cast("int")
    prompt = F.concat(F.trim(question_col), F.lit("\n\n"), body, F.lit("\n\n" + X.CHOICE_INSTRUCTION))
    return out.withColumn("answer", letter(place - 1)).withColumn(question_col, prompt).drop("_order")


def sample_requests(items: DataFrame, idx: str = "idx") -> DataFrame:
    """One request per sample with its own seed; ``idx`` is the dense item number."""
    rows = items.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return rows.select(
        "*", F.concat("id", F.lit("#"), F.col("j").cast("string")).alias("key"),
        (F.col(idx) * 1000 + F.col("j")).cast("bigint").alias("seed"),
    )


def request_prompts(requests: DataFrame, template: X.ChatTemplate = X.ChatTemplate()) -> DataFrame:
    """The prompt of every request: question and instruction as one user turn."""
    turn = F.array(F.struct(
        F.lit("user").alias("role"),
        F.concat(F.col("question"), F.lit("\n" + X.BOXED_INSTRUCTION)).alias("content"),
    ))
    return requests.withColumn("prompt", X.chat_text(turn, template, add_prompt=True))


def settings_differ(stored: DataFrame, wanted: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Settings under which stored samples and a new run disagree; any row forbids a resume."""
    long = lambda df, name: df.select(
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(k) for k in keys]), F.array(*[F.col(k).cast("string") for k in keys])
        )).alias("setting", name)
    )
    return long(stored, "stored").join(long(wanted, "wanted"), "setting").where(
        ~F.col("stored").eqNullSafe(F.col("wanted"))
    )


def grade(gens: DataFrame, verifier: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Add ``pred`` and ``correct``; ``verifier(gold, pred)`` replaces the built-in comparison."""
    out = gens.withColumn("pred", X.pred_answer(F.col("text")))
    if verifier:
        math = F.coalesce(verifier(F.col("answer"), F.col("pred")), F.lit(False))
    else:
        # Step by step, so that every cleaned text and number is worked out once.
        out = out.withColumn("_p", X.plain_math(F.col("pred"))).withColumn("_g", X.plain_math(F.col("answer")))
        out = out.withColumn("_pn", X.math_number(F.col("_p"))).withColumn("_gn", X.math_number(F.col("_g")))
        math = X.same_math(F.col("_p"), F.col("_g"), F.col("_pn"), F.col("_gn"))
    choice = X.choice_correct(F.col("pred"), F.col("answer"))
    return out.withColumn("correct", F.when(F.col("bench") == CHOICE_BENCH, choice).otherwise(math)).drop(
        "_p", "_g", "_pn", "_gn"
    )


def _flag(name: str) -> Column:
    return F.col(name).cast("int")


def eval_summary(graded: DataFrame) -> DataFrame:
    """Accuracy, samples, mean tokens and truncation per benchmark."""
    return graded.groupBy("bench").agg(
        F.bround(F.lit(100.0) * F.sum(_flag("correct")) / F.count(F.lit(1)), 2).alias("accuracy"),
        F.count(F.lit(1)).alias("samples"),
        F.bround(F.sum("tokens") / F.count(F.lit(1)), 0).cast("bigint").alias("mean_tokens"),
        F.bround(F.lit(100.0) * F.sum(_flag("truncated")) / F.count(F.lit(1)), 1).alias("truncated"),
    )


def avg_at_n(graded: DataFrame) -> DataFrame:
    """Mean over questions of the mean over each question's samples."""
    per_question = graded.groupBy("bench", "id").agg(
        F.avg(_flag("correct")).alias("_q"), F.count(F.lit(1)).alias("_n")
    )
    return per_question.groupBy("bench").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("_n").cast("bigint").alias("samples"),
        (F.lit(100.0) * F.avg("_q")).alias("accuracy"),
    )


def wilson_interval(df: DataFrame, correct: str = "correct", n: str = "samples", z: float = Z95) -> DataFrame:
    """Wilson score interval of a share, as ``ci_low`` and ``ci_high``."""
    total, zz = F.col(n), z * z
    share = F.col(correct) / total
    middle = share + F.lit(zz) / (2 * total)
    spread = F.lit(z) * F.sqrt(share * (1 - share) / total + F.lit(zz) / (4 * total * total))
    scale = 1 + F.lit(zz) / total
    return df.withColumn("ci_low", (middle - spread) / scale).withColumn("ci_high", (middle + spread) / scale)


def value_quantiles(df: DataFrame, value: str, quantiles: dict[str, tuple[str, int, int]], *by: str, shares: dict[str, Column] | None = None,
                    block: int | None = None) -> DataFrame:
    """Exact quantiles of an integer column per group, from counts per value.

    ``quantiles`` maps a name to ("interpolated" or "nearest", numerator, denominator): the value at rank q (n - 1) between its two
    neighbours, or the smallest value that a share q of the rows reaches.  Counts combine map-side, their running sum is
    taken in blocks of values, and a rank is looked up by a comparison; so no task holds the values of a group.  Null values
    don't count; a group without others has null quantiles.  ``shares`` adds means of 0/1 columns over all rows of a group.
    """
    shares = shares or {}
    ones = [F.sum(c).alias(f"_sum_{k}") for k, c in shares.items()] + [F.count(c).alias(f"_of_{k}") for k, c in shares.items()]
    group = F.struct(*by) if by else F.struct(F.lit(0).alias("_all"))
    # The key stands for the group in joins, so null groups are groups like others.
    keyed = df.select("*", group.alias("_group"), F.to_json(group, {"ignoreNullFields": "false"}).alias("_key"))
    counts = keyed.groupBy("_key", F.col(value).cast("bigint").alias("_v")).agg(F.any_value("_group").alias("_group"), F.count(F.lit(1)).alias("_n"), *ones)
    packed = stored(counts, "value-counts")
    totals = packed.groupBy("_key").agg(
        F.any_value("_group").alias("_group"), F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_n"))), F.lit(0)).alias("_rows"),
        *[(F.sum(f"_sum_{k}") / F.nullif(F.sum(f"_of_{k}"), F.lit(0))).alias(k) for k in shares])
    held = packed.where("_v is not null").select("_key", "_v", "_n")
    placed = running_offset(held, ["_key"], "_v", "_n", "_start", block or block_width(held, "_v"))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("_start") <= rank) & (rank < F.col("_start") + F.col("_n")), F.col("_v"))).cast("double")

    out = []
    for name, (kind, top, bottom) in quantiles.items():
        if kind == "nearest":
            out.append(at(F.greatest(F.expr(f"({top} * _rows + {bottom - 1}) div {bottom} - 1"), F.lit(0))).alias(name))
            continue
        whole, rest = F.expr(f"{top} * (_rows - 1) div {bottom}"), F.max(F.expr(f"{top} * (_rows - 1) % {bottom}")) / F.lit(bottom)
        out.append((at(whole) + F.when(rest > 0, (at(whole + 1) - at(whole)) * rest).otherwise(F.lit(0.0))).alias(name))
    found = placed.join(totals.select("_key", "_rows"), "_key").groupBy("_key").agg(*out)
    return totals.join(found, "_key", "left").select(*[F.col(f"_group.{k}").alias(k) for k in by], *quantiles, *shares)


def token_quantiles(graded: DataFrame, *by: str) -> DataFrame:
    """Median (interpolated), p90 (nearest rank) and truncation rate of the answer lengths, exactly."""
    wanted = {"median_tokens": ("interpolated", 1, 2), "p90_tokens": ("nearest", 9, 10)}
    return value_quantiles(graded, "tokens", wanted, *by, shares={"truncation_rate": _flag("truncated")})


#: Size of a quantile sketch, and its rank error: of a hundred sketches 99 are at most so far off.
SKETCH_K, SKETCH_ERROR = 400, 0.0075


def quantile_sketches(df: DataFrame, value: str, *by: str) -> DataFrame:
    """A mergeable sketch of a numeric column per group: a few KB, whatever the number of rows.  ``merged_sketches`` adds them up."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"))


def merged_sketches(sketches: DataFrame, *by: str) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"))


def sketched_quantile(share: float, sketch: str = "sketch") -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(share))


def poisson_weights(seed: int, replicates: int, bench: str, item: str) -> np.ndarray:
    """Poisson(1) draws of a question in every replicate, by inversion of seeded uniform numbers."""
    digits = (hashlib.md5(f"{seed}:{r}:{bench}:{item}".encode()).hexdigest()[:8] for r in range(replicates))
    u = np.fromiter((int(d, 16) for d in digits), np.float64, replicates) / HASH_RANGE
    return np.searchsorted(POISSON_CDF, u, "right")


def _poisson_cdf() -> np.ndarray:
    out, term, total = [], 0.36787944117144233, 0.0  # exp(-1), the Poisson(1) mass at 0
    for k in range(12):
        total += term
        out.append(total)
        term /= k + 1
    return np.asarray(out)


POISSON_CDF = _poisson_cdf()
#: Benchmarks whose sums a task holds before it passes them on.
HELD_SUMS = 1000


def replicate_sums(diff: DataFrame, replicates: int, seed: int) -> DataFrame:
    """(bench, replicate, weights, weighted): sums of the draws and of draws times difference over questions (bench, id, d).

    A task adds up all replicates of its questions in one array per benchmark, so what is shuffled are replicates times tasks, not
    questions times replicates.
    """

    columns = ["bench", "replicate", "weights", "weighted"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            names, sums = np.repeat(np.asarray(list(held), object), replicates), np.concatenate(list(held.values()), 1)
            number = np.tile(np.arange(replicates, dtype=np.int32), len(held))
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(number), pa.array(sums[0]), pa.array(sums[1])], names=columns)

        for batch in batches:
            for bench, item, d in zip(*(batch.column(c).to_pylist() for c in ("bench", "id", "d"))):
                if d is None:
                    continue
                if bench not in held and len(held) >= HELD_SUMS:
                    yield out()
                    held.clear()
                w = poisson_weights(seed, replicates, bench, item)
                sums = held.setdefault(bench, np.zeros((2, replicates)))
                sums += [w, w * d]
        if held:
            yield out()

    parts = diff.select(F.col("bench").cast("string").alias("bench"), F.col("id").cast("string").alias("id"), F.col("d").cast("double").alias("d")).mapInArrow(
        run, "bench string, replicate int, weights double, weighted double")
    return parts.groupBy("bench", "replicate").agg(F.sum("weights").alias("weights"), F.sum("weighted").alias("weighted"))


def paired_diff_ci(a: DataFrame, b: DataFrame, replicates: int, seed: int) -> DataFrame:
    """Difference of two runs with a 95 % interval by a paired bootstrap over questions.

    Samples are averaged per question first; each replicate weights a question by a Poisson(1) draw
    fixed by (seed, replicate, question), so replicates add up inside the tasks.
    """
    mean = lambda df, name: df.groupBy("bench", "id").agg(F.avg(_flag("correct")).alias(name))
    diff = mean(a, "_a").join(mean(b, "_b"), ["bench", "id"]).select("bench", "id", (F.col("_a") - F.col("_b")).alias("d"))
    means = replicate_sums(diff, replicates, seed).withColumn("_m", F.col("weighted") / F.nullif(F.col("weights"), F.lit(0.0)))
    ends = means.groupBy("bench").agg(
        F.percentile("_m", F.lit(0.025)).alias("ci_low"), F.percentile("_m", F.lit(0.975)).alias("ci_high")
    )
    return diff.groupBy("bench").agg(F.avg("d").alias("difference"), F.count(F.lit(1)).alias("questions")).join(
        ends, "bench"
    )


def validate_points(points: DataFrame, steps: DataFrame, benches: DataFrame) -> DataFrame:
    """Broken rules of a result table, one row each.

    ``points`` is flat: (series, step, tokens_b, bench, questions, samples, samples_per_question, correct,
    accuracy).  ``steps`` lists the wanted (series, step), ``benches`` the wanted (bench, questions,
    samples_per_question).
    """
    have = points.select("series", "step").distinct()
    missing = steps.join(have, ["series", "step"], "left_anti").withColumn("rule", F.lit("missing step"))
    extra = have.join(steps, ["series", "step"], "left_anti").withColumn("rule", F.lit("unexpected step"))
    wanted = benches.select(F.col("bench").alias("_b"), F.col("questions").alias("_q"), F.col("samples_per_question").alias("_k"))
    rows = points.join(wanted, F.col("bench") == F.col("_b"), "left")
    rules = F.array_compact(F.array(
        F.when(F.col("tokens_b") != F.col("step") * F.lit(float(TOKENS_PER_STEP)) / F.lit(1e9), F.lit("tokens")),
        F.when(F.col("_b").isNull(), F.lit("unknown benchmark")),
        F.when(
            (F.col("questions") != F.col("_q")) | (F.col("samples_per_question") != F.col("_k"))
            | (F.col("samples") != F.col("_q") * F.col("_k")), F.lit("sample counts")),
        F.when(F.abs(F.col("accuracy") - F.lit(100.0) * F.col("correct") / F.col("samples")) >= 1e-10, F.lit("accuracy")),
    ))
    broken = rows.select("series", "step", "bench", F.explode(rules).alias("rule"))
    by_step = missing.unionByName(extra).select("series", "step", F.lit(None).cast("string").alias("bench"), "rule")
    return by_step.unionByName(broken)


def flatten_results(results: DataFrame, json_col: str = "json") -> DataFrame:
    """Long rows (dataset, subtask, metric, value, name) of nested evaluation results.

    ``json`` holds ``{"results": {task: {metric: value}}}``; the task ``all`` and ``_stderr`` metrics
    are left out, tasks without two bars too.
    """
    parsed = F.from_json(json_col, "struct<results: map<string, map<string, double>>>")["results"]
    tasks = results.select(F.explode(parsed).alias("task", "metrics")).where(
        (F.col("task") != "all") & F.col("task").rlike(TASK_PATTERN)
    )
    long = tasks.select(
        "task", F.regexp_extract("task", TASK_PATTERN, 1).alias("dataset"),
        F.nullif(F.regexp_extract("task", TASK_PATTERN, 2), F.lit("")).alias("subtask"),
        F.explode("metrics").alias("metric", "value"),
    ).where(~F.contains(F.col("metric"), F.lit("_stderr")))
    return long.select(
        "dataset", "subtask", "metric", "value", F.concat_ws("/", "dataset", "subtask", "metric").alias("name")
    )


def normalize_mcq(df: DataFrame, question: Column, choices: Column, gold: Column, labels: Column | None = None) -> DataFrame:
    """Bring a multiple-choice source to (question, choices, gold_idx).

    ``gold`` may be a 1-based number, a letter, or - with ``labels`` - one of the item's own labels.
    """
    key = F.trim(gold.cast("string"))
    if labels is not None:
        idx = F.array_position(labels, key).cast("int") - 1
    else:
        idx = F.when(key.rlike("^[0-9]+$"), key.try_cast("int") - 1).otherwise(
            F.ascii(F.upper(key)) - F.lit(ord("A"))
        )
    return df.withColumn("question", question).withColumn("choices", choices).withColumn("gold_idx", idx.cast("int"))


def mcq_accuracy(scores: DataFrame, norm: str = "raw", by: str = "bench") -> DataFrame:
    """Share of items whose best-scored choice is the gold one.

    ``scores``: (bench, item_id, choice, logprob, n_tokens, n_chars, base_logprob, gold_idx).  ``norm`` is
    raw, token, char or pmi (minus the unconditioned score).  Ties go to the first choice.
    """
    value = {
        "raw": F.col("logprob"),
        "token": F.col("logprob") / F.col("n_tokens"),
        "char": F.col("logprob") / F.col("n_chars"),
        "pmi": F.col("logprob") - F.col("base_logprob"),
    }[norm]
    best = scores.groupBy(by, "item_id").agg(
        F.max_by("choice", F.struct(value, -F.col("choice"))).alias("best"), F.max("gold_idx").alias("gold_idx")
    )
    return best.groupBy(by).agg(
        F.avg((F.col("best") == F.col("gold_idx")).cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("items")
    )
