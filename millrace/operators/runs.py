"""Run bookkeeping: tokens consumed, stages, throughput."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ordering import running_offset


def consumed_tokens(blend: DataFrame, gb: int, L: int) -> DataFrame:
    """Tokens each source gave per step and up to that step."""
    per_step = blend.withColumn("step", F.expr(f"pos div {gb}")).groupBy("step", "ds").agg(
        (F.count(F.lit(1)) * L).cast("bigint").alias("tokens")
    )
    return running_offset(per_step, ["ds"], "step", "tokens", "_earlier").withColumn(
        "cumulative", F.col("_earlier") + F.col("tokens")
    ).drop("_earlier")


def check_consumption(consumed: DataFrame, stages: DataFrame) -> DataFrame:
    """Per stage: expected and counted tokens, and whether they agree."""
    by_stage = consumed.groupBy("stage").agg(F.sum("tokens").cast("bigint").alias("tokens"))
    want = stages.select("stage", (F.col("consumed_samples") * F.col("seq_len")).cast("bigint").alias("expected"))
    both = want.join(by_stage, "stage", "full_outer").na.fill(0, ["tokens", "expected"])
    return both.withColumn("ok", F.col("tokens") == F.col("expected"))


def consumed_total(consumed: DataFrame) -> DataFrame:
    """Tokens per source over all stages and the sample offset they leave.

    ``consumed`` has a row (source, tokens, seq_len) per stage and source; ``F.explode`` makes such rows of a map.
    """
    return consumed.groupBy("source").agg(
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.sum(F.expr("tokens div seq_len")).cast("bigint").alias("sample_offset"),
    )


def next_stage_start(stages: DataFrame, order: str = "start_step", out: str = "next_start") -> DataFrame:
    """Start of the following stage (a stage table has a handful of rows)."""
    return stages.withColumn(out, F.lead(order).over(Window.orderBy(order)))


def stage_faults(stages: DataFrame) -> DataFrame:
    """Broken rules: no stage starts at 1, a start or a name is used twice."""
    twice = lambda col, rule: stages.groupBy(F.col(col).cast("string").alias("value")).count().where(
        F.col("count") > 1
    ).select("value", F.lit(rule).alias("rule"))
    first = stages.agg(F.min("start_step").alias("m")).where(~F.col("m").eqNullSafe(F.lit(1))).select(
        F.col("m").cast("string").alias("value"), F.lit("first stage must start at 1").alias("rule")
    )
    return twice("start_step", "start used twice").unionByName(twice("name", "name used twice")).unionByName(first)


def stage_plan(stages: DataFrame, train_steps: int, last_step: int = 0) -> DataFrame:
    """Steps every stage still has to run after ``last_step`` (0 = fresh start).

    A stage that was started before ``last_step`` counts as passed.
    """
    ends = next_stage_start(stages).withColumn("end_step", F.coalesce("next_start", F.lit(train_steps)))
    start = F.lit(last_step) if last_step > 0 else F.col("start_step")
    left = F.when(F.lit(last_step) > F.col("start_step"), F.lit(0)).otherwise(F.col("end_step") - start + 1)
    return ends.withColumn("remaining_steps", left.cast("bigint")).drop("next_start")


def run_throughput(step_log: DataFrame, batch: int, L: int, devices: int, by: Sequence[str] = ("run",),
                   total_steps: int | None = None) -> DataFrame:
    """Tokens per second, also per device, and the time left, averaged per run.

    ``step_log`` has (run, step, seconds).
    """
    tokens = float(batch * L)
    out = step_log.groupBy(*by).agg(
        F.count(F.lit(1)).alias("steps"), F.sum("seconds").alias("seconds"), F.max("step").alias("last_step")
    )
    out = out.withColumn("tokens_per_sec", F.col("steps") * F.lit(tokens) / F.col("seconds")).withColumn(
        "tokens_per_sec_per_device", F.col("tokens_per_sec") / F.lit(float(devices))
    )
    if total_steps is not None:
        left = F.greatest(F.lit(total_steps) - F.col("last_step"), F.lit(0))
        out = out.withColumn("eta_seconds", left * F.col("seconds") / F.col("steps"))
    return out


def masked_mean(df: DataFrame, x: str, mask: str, by: Sequence[str]) -> DataFrame:
    """Mean of ``x`` where the mask is set; NaN for a group with an empty mask."""
    m = F.col(mask).cast("double")
    total = F.sum(m)
    return df.groupBy(*by).agg(
        F.when(total > 0, F.sum(F.col(x) * m) / F.nullif(total, F.lit(0.0))).otherwise(F.lit(float("nan"))).alias("masked_mean")
    )


def epochs_used(lens: DataFrame, requested: str = "requested", have: str = "len", L: int = 1) -> DataFrame:
    """Whole passes over each source and the tokens planned for it."""
    return lens.withColumn("epochs", F.expr(f"{requested} div {have}")).withColumn(
        "planned_tokens", (F.col(requested) * L).cast("bigint")
    )
