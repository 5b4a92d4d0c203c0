"""Operator 3: language of whole texts by averaged hashed subword embeddings and a linear softmax.

Every word is lower-cased and cut into runs of two to four characters with marks at its ends; runs are hashed to buckets.
A text is the mean embedding of all its runs, its language a softmax over it.  ``train`` fits embeddings and
softmax in numpy by stochastic gradient descent on a sample of at most twice ``SAMPLE`` labelled rows; a fifth of it is held
back to fit a temperature, so that scores are probabilities, and a threshold below which a prediction is
rejected: at most ``LOST`` of the right predictions fall below it.  Embeddings and softmax multiply to one small
table, so scoring adds one row of it per run, once per distinct word of a batch.

Texts that are null or have no letter are ``und`` with score 0 and rejected.  If no labelled row is left to learn from,
all are.  Empty tables give empty results, repeated rows equal predictions; other columns are ignored by
``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import encoded, in_arrow, let_go, passes, utf8, words
from millrace.llm.sampling import bounded_by

#: Rows that are learned from at most, before a factor of two; every label gets an equal part of them, or all its rows.
SAMPLE = 4000
BUCKETS = 1 << 14
RUNS = (2, 3, 4)
WIDTH = 16
EPOCHS = 6
BATCH = 32
RATE = 0.5
LOST = 0.002
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # buckets x languages, divided by the temperature
    bias: np.ndarray
    threshold: float


def runs_of(distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all runs of all words, and the word each belongs to."""
    lowered = [w.lower() for w in distinct]
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    points = np.frombuffer(("\x02" + "\x03\x02".join(lowered) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) if lowered else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lowered)), size)
    buckets, owners = [], []
    for n in RUNS:
        m = len(points) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ points[k : k + m]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[:m] == owner[n - 1 :]
        buckets.append((h[inside] >> np.uint64(20)) & np.uint64(BUCKETS - 1))
        owners.append(owner[:m][inside])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners)


def has_letter(column: pa.Array, data: np.ndarray, at: np.ndarray) -> np.ndarray:
    ascii_letters = np.concatenate([[0], np.cumsum(((data | 0x20) >= 0x61) & ((data | 0x20) <= 0x7A))])
    seen = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
    for i in np.flatnonzero(~seen).tolist():
        seen[i] = any(c.isalpha() for c in column[i].as_py() or "")
    return seen


def counted(docs: DataFrame) -> DataFrame:
    """(key, label, buckets, counts) of every row of (key, text, label) with a word: how often a bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            data, at = utf8(batch.column("text"))
            found, rows = words(data, at)
            found = found.to_pylist()
            out = []
            for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
                buckets, n = np.unique(runs_of(found[a:b])[0], return_counts=True)
                # Two bytes each: buckets are fewer than 2^14, and a count beyond 2^16 - 1 is as good as that.
                out.append((buckets.astype("<u2").tobytes(), np.minimum(n, 0xFFFF).astype("<u2").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), batch.column("label"), pa.array([x for x, _ in out], pa.binary()), pa.array([y for _, y in out], pa.binary())],
                ["key", "label", "buckets", "counts"],
            )

    return in_arrow(docs, run, "key string, label string, buckets binary, counts binary").where(F.octet_length("buckets") > 0)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit(rows: pa.Table, seed: int = 7) -> Model | None:
    """Train on (key, label, buckets, counts); the keys fix the order, so that reruns agree."""
    labels = rows["label"].to_pylist()
    if not labels:
        return None
    languages = sorted(set(labels))
    y = np.asarray([languages.index(x) for x in labels])
    by_key = np.argsort(np.asarray(rows["key"].to_pylist()), kind="stable")
    y = y[by_key]
    parts = []
    for places, n in zip(rows["buckets"].take(by_key).to_pylist(), rows["counts"].take(by_key).to_pylist()):
        n = np.frombuffer(n, "<u2").astype(np.float32)
        parts.append((np.frombuffer(places, "<u2"), n / n.sum()))
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, used = order[: len(y) // 5], order[len(y) // 5 :]
    weights = np.bincount(y[used], minlength=len(languages)).astype(np.float32)
    weights = np.where(weights > 0, len(used) / (len(languages) * np.maximum(weights, 1)), 0) ** 0.5
    emb = rng.normal(0, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    out = np.zeros((WIDTH, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)

    steps, done = EPOCHS * -(-len(used) // BATCH), 0
    for _ in range(EPOCHS):
        rng.shuffle(used)
        for a in range(0, len(used), BATCH):
            which = used[a : a + BATCH]
            touched, column = np.unique(np.concatenate([parts[i][0] for i in which]), return_inverse=True)
            x = np.zeros((len(which), len(touched)), np.float32)
            x[np.repeat(np.arange(len(which)), [len(parts[i][0]) for i in which]), column] = np.concatenate([parts[i][1] for i in which])
            own = emb[touched]
            hidden = x @ own
            grad = softmax(hidden @ out + bias)
            grad[np.arange(len(which)), y[which]] -= 1
            grad *= weights[y[which]][:, None] / len(which)
            rate = RATE * (1 - done / steps)
            emb[touched] = own - rate * 200 * (x.T @ (grad @ out.T))
            out -= rate * 20 * hidden.T @ grad
            bias -= rate * grad.sum(0)
            done += 1
    table = emb @ out
    test = held if len(held) else used
    z = np.stack([parts[i][1] @ table[parts[i][0]] for i in test]) + bias
    truth = y[test]
    grid = 2.0 ** np.arange(-4, 5, 0.25)
    loss = [-np.log(softmax(z / t)[np.arange(len(test)), truth] + 1e-12).mean() for t in grid]
    t = grid[int(np.argmin(loss))]
    p = softmax(z / t)
    right = p.max(1)[p.argmax(1) == truth]
    threshold = min(0.5, float(np.quantile(right, LOST))) if len(right) else 0.0
    return Model(languages, (table / t).astype(np.float32), (bias / t).astype(np.float32), threshold)


def train(labelled: DataFrame, most: int = SAMPLE, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> Model | None:
    """Fit on a bounded sample of the rows that have a label and an id: rare languages have their part in it."""
    rows = labelled.select(F.col(id_col).cast("string").alias("key"), F.col(lang_col).cast("string").alias("label"), F.col(text_col).cast("string").alias("text"))
    model = fit(counted(bounded_by(rows.where("label is not null and key is not null"), most, "label", "key", "text").select("key", "text", "label")).toArrow())
    let_go(labelled.sparkSession)
    return model


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Add lang_pred, score and rejected to all columns; columns of these names are replaced."""
    return _predicted(docs.drop("lang_pred", "score", "rejected"), model, lambda batch: batch.column(text_col))


def _predicted(docs: DataFrame, model: Model | None, text_of: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in passes(batches, text_of):
            text = text_of(batch).cast(pa.large_string())
            data, at = utf8(text)
            letters = has_letter(text, data, at)
            best, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            known = letters & (model is not None)
            if model is not None:
                found, rows = words(data, at)
                codes, distinct = encoded(found)
                buckets, owner = runs_of(distinct.to_pylist())
                row = np.repeat(np.arange(batch.num_rows), np.diff(rows))
                each = np.bincount(owner, minlength=len(distinct)).astype(np.float64)
                count = np.maximum(np.bincount(row, each[codes], batch.num_rows), 1)
                z = np.empty((batch.num_rows, len(model.languages)))
                for k in range(len(model.languages)):
                    own = np.bincount(owner, model.table[buckets, k], len(distinct))
                    z[:, k] = np.bincount(row, own[codes], batch.num_rows) / count + model.bias[k]
                p = softmax(z)
                best, score = p.argmax(1), np.where(known, p.max(1), 0.0)
            names = pa.array([model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())], pa.string())
            rejected = ~known | (score < (model.threshold if model else 0))
            yield pa.RecordBatch.from_arrays([*batch.columns, names, pa.array(score), pa.array(rejected)], [*columns, "lang_pred", "score", "rejected"])

    return in_arrow(docs, run, schema)


def keep_known(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """The documents whose prediction is not rejected, with their own columns.  A text that is one of them is sent to the workers once."""
    own = F.struct(*[F.col(c) for c in docs.columns]).alias("_own")
    if text_col in docs.columns:
        told = _predicted(docs.select(own), model, lambda batch: batch.column("_own").field(text_col))
    else:
        told = predict(docs.select(F.col(text_col).alias("_text"), own), model, "_text")
    return told.where(~F.col("rejected")).select("_own.*")
