"""Evaluation: requests still to answer, grading, and the summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from millrace.operators import evals, joins


def open_requests(items: DataFrame, done: DataFrame) -> DataFrame:
    """Requests without a stored sample, with their seeds."""
    return joins.pending_samples(evals.sample_requests(items), done)


def summarize(gens: DataFrame) -> dict[str, DataFrame]:
    """Graded rows and every table over them."""
    graded = evals.grade(gens)
    return {
        "graded": graded,
        "summary": evals.eval_summary(graded),
        "avg_at_n": evals.avg_at_n(graded),
        "quantiles": evals.token_quantiles(graded, "bench"),
    }
