"""Operator 9: quality of whole texts by positive-unlabelled learning.

Only trusted positives and unlabelled texts are learned from.  The class prior is estimated first: a classifier of positives
against unlabelled texts ranks a held-back part of both, and the prior is the smallest ratio, over thresholds, of the
shares of unlabelled and of positive texts above (with a bound for chance in choosing the threshold).  Then a
logistic model minimises the non-negative unbiased risk by mini-batches in numpy: where the estimated risk on negatives falls
below zero, the step goes back instead of on.  An estimated prior is a little high, so the bias is set last: all but
``LOST`` of the trusted positives score 0.5 or more.

A text is described by the mean of hashed shape and length over its words and of hashed spelling over its distinct words
(drawn towards 0 where there are few), and by a dozen ratios (repetition of words, pairs and lines, kinds of characters).  The model is linear in
the means, so a batch adds one number per distinct word.

Both samples hold at most twice their bound (``POSITIVES``, ``UNLABELLED``).  Null and empty texts have all features 0 before
scaling and get a score like any text.  Without positives or unlabelled texts every score is 0.5.  An empty table gives
an empty result, repeated rows score alike, other columns are kept and those named as an added one replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import encoded, passes, row_sums, stored, utf8, words
from millrace.llm.sampling import bounded, texts_of

POSITIVES, UNLABELLED = 2000, 4000
SPELLINGS, SHAPES, LENGTHS = 1024, 256, 16
MEANS = SPELLINGS + SHAPES + LENGTHS
RATIOS = 12
EPOCHS, BATCH, RATE, DECAY = 20, 128, 0.02, (1e-3, 1e-4)
#: DECAY holds the weight decay of means and of ratios.  Distinct words that pull the means towards 0, and the least scale of a mean.
PULL, LEAST_SCALE = 20, 0.08
#: Share of the trusted positives that may fall below a score of 0.5.
LOST = 0.005
DELTA = 0.1

_UPPER, _LOWER, _DIGIT = re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\W\d_A-Z]+"), re.compile(r"\d+")
_SAME = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters as A and a, digits as 0, runs as one character."""
    return _SAME.sub(r"\1", _DIGIT.sub("0", _LOWER.sub("a", _UPPER.sub("A", word)))) if not (word.isascii() and word.isalpha() and word.islower()) else "a"


def word_places(distinct: list[str]) -> np.ndarray:
    """(words, 3): places of spelling, shape and length among the means."""
    h = xxhash.xxh3_64_intdigest
    out = np.empty((len(distinct), 3), np.int64)
    out[:, 0] = np.fromiter((h(w.lower()) % SPELLINGS for w in distinct), np.int64, len(distinct))
    out[:, 1] = np.fromiter((SPELLINGS + h(shape(w)) % SHAPES for w in distinct), np.int64, len(distinct))
    out[:, 2] = np.fromiter((SPELLINGS + SHAPES + min(len(w), LENGTHS) - 1 for w in distinct), np.int64, len(distinct))
    return out


def distinct(keys: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every key of a row once, with the row."""
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    first = np.ones(len(k), bool)
    first[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return k[first], r[first]


def ratios(text: pa.Array, data: np.ndarray, at: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, RATIOS) numbers of whole texts."""
    rows = len(at) - 1
    n = np.diff(starts)
    row = np.repeat(np.arange(rows), n)
    bytes_ = np.maximum(np.diff(at), 1)
    some = np.maximum(n, 1)
    out = np.zeros((rows, RATIOS))
    out[:, 0] = np.log1p(n)
    out[:, 1] = np.bincount(distinct(codes, row)[1], minlength=rows) / some
    same = np.zeros(len(codes), bool)
    same[1:] = (codes[1:] == codes[:-1]) & (row[1:] == row[:-1])
    out[:, 2] = np.bincount(row, same, rows) / some
    for k, width in ((3, 2), (4, 3)):
        m = len(codes) - width + 1
        if m > 0:
            inside = row[:m] == row[width - 1 :]
            key = np.zeros(m, np.uint64)
            for j in range(width):
                key = key * np.uint64(0x9E3779B97F4A7C15) + codes[j : j + m].astype(np.uint64) + np.uint64(1)
            r = row[:m][inside]
            out[:, k] = 1 - np.bincount(distinct(key[inside].view(np.int64), r)[1], minlength=rows) / np.maximum(np.bincount(r, minlength=rows), 1)
    kinds = ((data >= 0x41) & (data <= 0x5A), (data >= 0x30) & (data <= 0x39), np.isin(data, np.frombuffer(b"#*$%&|<>{}[]=~^_", np.uint8)), np.isin(data, np.frombuffer(b".,;:!?", np.uint8)), np.isin(data, np.frombuffer(b"!?", np.uint8)))
    for k, kind in enumerate(kinds):
        out[:, 5 + k] = row_sums(kind, at) / bytes_
    out[:, 10] = bytes_ / some / 10
    for i, t in enumerate(text.to_pylist()):
        lines = [x for x in (t or "").split("\n") if x.strip()]
        out[i, 11] = 1 - len(set(lines)) / len(lines) if lines else 0
    out[n == 0] = 0
    return out


@dataclass
class Model:
    weights: np.ndarray
    center: np.ndarray
    scale: np.ndarray
    bias: float
    prior: float


def vectors(docs: DataFrame) -> DataFrame:
    """(key, kind, x) of every row of (key, text, kind): means and ratios as 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            text = batch.column("text").cast(pa.large_string())
            data, at = utf8(text)
            found, starts = words(data, at)
            codes, known = encoded(found)
            places = word_places(known.to_pylist())
            extra = ratios(text, data, at, codes, starts)
            out = []
            for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
                own = np.unique(codes[a:b])
                x = np.bincount(places[own, 0], minlength=MEANS) / (len(own) + PULL)
                x += np.bincount(places[codes[a:b], 1:].ravel(), minlength=MEANS) / (b - a + PULL)
                out.append(np.concatenate([x, extra[i]]).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("kind"), pa.array(out, pa.binary())], ["key", "kind", "x"])

    return docs.mapInArrow(run, "key string, kind int, x binary")


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def class_prior(pos: np.ndarray, unl: np.ndarray) -> float:
    """Smallest ratio of shares above a threshold, from scores of held-back positives and unlabelled texts."""
    cuts = np.sort(pos)
    p = 1 - np.arange(len(cuts)) / len(cuts)
    u = 1 - np.searchsorted(np.sort(unl), cuts) / len(unl)
    slack = np.sqrt(np.log(4 / DELTA) / (2 * len(unl))) + np.sqrt(np.log(4 / DELTA) / (2 * len(pos)))
    best = int(np.argmin((u + slack) / p))
    return float(np.clip(u[best] / p[best], 0.05, 0.99))


def descend(pos: np.ndarray, unl: np.ndarray, prior: float | None, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias.  With a prior: non-negative risk; without: positives against unlabelled texts."""
    rng = np.random.default_rng(seed)
    w = np.zeros(pos.shape[1] + 1)
    decay = np.full(len(w), DECAY[0])
    decay[MEANS:] = DECAY[1]
    mean, square, t = np.zeros_like(w), np.zeros_like(w), 0
    steps = max(1, len(unl) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(unl))
        for k in range(steps):
            xu = unl[order[k * BATCH : (k + 1) * BATCH]]
            xp = pos[rng.integers(0, len(pos), min(BATCH, len(pos)))]
            zp, zu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
            # Derivatives of the logistic losses: towards 1 for positives, towards 0 for the rest.
            up, down_p, down_u = logistic(zp) - 1, logistic(zp), logistic(zu)
            gp, gu = up / len(xp), down_u / len(xu)
            if prior is not None:
                negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
                if negative >= 0:
                    gp, gu = (prior * up - prior * down_p) / len(xp), down_u / len(xu)
                else:
                    gp, gu = prior * down_p / len(xp), -down_u / len(xu)
            grad = np.append(xp.T @ gp + xu.T @ gu, gp.sum() + gu.sum()) + decay * w
            t += 1
            mean = 0.9 * mean + 0.1 * grad
            square = 0.999 * square + 0.001 * grad * grad
            w -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8) * (1 - 0.9 * t / (EPOCHS * steps))
    return w[:-1], float(w[-1])


def fit(pos: np.ndarray, unl: np.ndarray, seed: int = 5) -> Model | None:
    if not len(pos) or not len(unl):
        return None
    center, scale = unl.mean(0), unl.std(0)
    scale[:MEANS] = np.maximum(scale[:MEANS], LEAST_SCALE)
    scale[MEANS:] = np.where(scale[MEANS:] > 1e-6, scale[MEANS:], 1)
    p, u = (pos - center) / scale, (unl - center) / scale
    for x in (p, u):
        x[:, MEANS:] = np.clip(x[:, MEANS:], -5, 5)
    rng = np.random.default_rng(seed)
    p, u = p[rng.permutation(len(p))], u[rng.permutation(len(u))]
    a, b = max(1, len(p) * 7 // 10), max(1, len(u) * 7 // 10)
    w, bias = descend(p[:a], u[:b], None, seed)
    prior = class_prior(p[a:] @ w if a < len(p) else p @ w, u[b:] @ w if b < len(u) else u @ w)
    w, bias = descend(p, u, prior, seed)
    bias -= float(np.quantile(p @ w + bias, LOST))
    return Model(w, center, scale, bias, prior)


def train(docs: DataFrame, positives: DataFrame, most_positive: int = POSITIVES, most_unlabelled: int = UNLABELLED) -> Model | None:
    """Fit on bounded samples: ids of trusted positives, and any rows of docs (doc_id, text) as unlabelled."""
    chosen = bounded(positives.select("doc_id").distinct().withColumn("kind", F.lit(1)), most_positive).unionByName(
        bounded(docs.select("doc_id").distinct().withColumn("kind", F.lit(0)), most_unlabelled, seed=1))
    # At most 2 * (positives + unlabelled) rows, of ids as of texts, however ids repeat.
    texts = texts_of(docs.select("doc_id", F.col("text").cast("string").alias("text")), chosen, most_positive + most_unlabelled)
    sample = stored(texts.select(F.col("doc_id").cast("string").alias("key"), "text", "kind"), "quality-sample")
    # Sorted by key, so that reruns agree.
    rows = vectors(sample).toArrow().sort_by("key")
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), np.float32).reshape(rows.num_rows, MEANS + RATIOS).astype(np.float64)
    kind = rows["kind"].to_numpy() if rows.num_rows else np.zeros(0)
    return fit(x[kind == 1], x[kind == 0])


def predict(docs: DataFrame, model: Model | None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Add score and predicted."""
    docs = docs.drop("score", "predicted")
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in passes(batches, text_col):
            score = np.full(batch.num_rows, 0.5)
            if model is not None:
                text = batch.column(text_col).cast(pa.large_string())
                data, at = utf8(text)
                found, starts = words(data, at)
                codes, known = encoded(found)
                places = word_places(known.to_pylist())
                extra = ratios(text, data, at, codes, starts)
                row = np.repeat(np.arange(batch.num_rows), np.diff(starts))
                own, of = distinct(codes, row)
                slope = model.weights / model.scale
                each = slope[:MEANS][places]
                z = np.bincount(of, each[own, 0], batch.num_rows) / (np.bincount(of, minlength=batch.num_rows) + PULL)
                z += np.bincount(row, each[codes, 1:].sum(1), batch.num_rows) / (np.diff(starts) + PULL)
                z += model.bias - (slope[:MEANS] * model.center[:MEANS]).sum()
                z += np.clip((extra - model.center[MEANS:]) / model.scale[MEANS:], -5, 5) @ model.weights[MEANS:]
                score = logistic(z)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32))], [*columns, "score", "predicted"])

    return docs.mapInArrow(run, schema)
