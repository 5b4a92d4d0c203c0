"""Planning tables kept by what made them: built once, read by every later run that asks for the same.

An epoch's order or a sample index follows from its parameters and the lengths it was built on.  Its folder is named by a digest of both, and it
is published by one rename, so a reader sees a whole table or none, and of two runs that build at once one is kept.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import mixture, pack
from millrace.operators.quality import table_fingerprint


def plan_key(name: str, parameters: dict[str, object], inputs: DataFrame) -> str:
    """Digest of the parameters and of the input table, whatever the order of its rows."""
    seen = table_fingerprint(inputs).first()
    told = json.dumps([name, parameters, seen["rows"], seen["fingerprint"], inputs.dtypes], sort_keys=True)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def stored_plan(spark: SparkSession, folder: str, name: str, parameters: dict[str, object], inputs: DataFrame, make: Callable[[], DataFrame]) -> DataFrame:
    """The table that ``make`` gives for these parameters and inputs, from ``folder`` if it is there."""
    at = f"{folder}/{name}-{plan_key(name, parameters, inputs)}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(at).getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path(f"{at}/_SUCCESS")):
        own = f"{folder}/_{uuid4().hex}"
        make().write.parquet(own)
        if not files.rename(path(own), path(at)) or files.exists(path(f"{at}/{own.rsplit('/', 1)[1]}")):
            # Another run was first; into an existing folder some file systems move instead of failing.
            files.delete(path(f"{at}/{own.rsplit('/', 1)[1]}"), True)
            files.delete(path(own), True)
    return spark.read.parquet(at)


def stored_doc_order(spark: SparkSession, folder: str, docs: DataFrame, epochs: int, seed: int, split_last: bool) -> DataFrame:
    """``doc_order`` of (doc_id, ...), kept."""
    made = {"epochs": epochs, "seed": seed, "split_last": split_last}
    return stored_plan(spark, folder, "doc_order", made, docs, lambda: mixture.doc_order(docs, epochs, seed, split_last))


def stored_sample_index(spark: SparkSession, folder: str, docs: DataFrame, epochs: int, seed: int, L: int, drop_last: bool = True) -> DataFrame:
    """``sample_index`` over the stored order of (doc_id, size), kept; another length reuses the order."""
    order = stored_doc_order(spark, folder, docs, epochs, seed, False)
    made = {"epochs": epochs, "seed": seed, "L": L, "drop_last": drop_last}
    return stored_plan(spark, folder, "sample_index", made, docs, lambda: pack.sample_index(order, L, drop_last))


def stored_epoch_index(spark: SparkSession, folder: str, weights: DataFrame | None, lens: DataFrame, n: int, seed: int) -> DataFrame:
    """``epoch_index`` of ``n`` samples, kept; weights are a planning table."""
    told = None if weights is None else sorted((r["ds"], str(r["weight"])) for r in weights.collect())
    return stored_plan(spark, folder, "epoch_index", {"weights": told, "n": n, "seed": seed}, lens, lambda: mixture.epoch_index(spark, weights, lens, n, seed))
