"""Headline queries, timed: prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores.
Every query is built and run to a sink that keeps nothing, once after a warm-up of the session.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "corpus_windows", "budget_tokens", "pack_windows", "shift_labels", "encode_ids", "build_vocab", "shuffle_windows",
    "blend_greedy", "epoch_index", "blend_bins", "blend_fetch", "training_samples", "sample_index", "sample_text",
    "doc_order", "mix_fractions", "batch_plan", "sft_encode", "fim_permute", "fim_sample", "sentence_spans", "grade",
    "eval_summary", "token_quantiles", "paired_diff_ci", "consumed_tokens", "column_profile", "table_fingerprint",
    "topk_per_group", "topp_per_group", "stage_for_step", "prepare_corpus",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from millrace.catalog import QUERIES
    from millrace.session import local_session, table

    spark = local_session("bench", cores, int(cores) if cores.isdigit() else 8)
    table(spark, sf, "documents").selectExpr("max(length(text))", "count(distinct source)").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": sf.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
