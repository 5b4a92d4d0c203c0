"""Operator 1: approximate nearest neighbours with randomly rotated one-bit codes.

Vectors are assigned to centroids fitted on a bounded sample.  What a vector has beyond its centroid is scaled to length 1 and
rotated by a random orthogonal matrix; its signs are packed into bits, and two numbers are kept: the length and the
inner product of the rotated vector with its own signs.  For a query the packed bits and these numbers give
an unbiased estimate of the inner product, and with it of the distance, with an error bound.  Bounds of a tile of queries and
vectors are one product of matrices.  A vector is looked at exactly only if its lower bound beats the k-th distance of the query so far.

Of equal vectors only the k + 1 of smallest id are indexed, and equal queries are asked once, which changes no result and
keeps a vector shared by many rows from growing into pairs.  Queries probe the nearest clusters; how many is measured:
``CALIBRATION`` queries are answered by brute force against all vectors, and the probes chosen reach
``RECALL`` of their neighbours.  Clusters are put together to groups, or cut into several, and a task holds up to ``QUERY_BLOCK`` queries
that probe its group while the group's vectors pass by: a query is sent once to a group, not to every cluster it probes, and vectors
are sent once per block of queries.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those without an id or of another
length than most.  Repeated rows (equal id and vector) count once, as queries and as neighbours; an id with several different
vectors counts with each.  A query never finds its own id.  An empty table, or no query, gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh_folder, in_arrow, let_go, remove, stored, tasks

SAMPLE = 16_384
MOST_CLUSTERS = 4096
CALIBRATION = 64
RECALL = 0.96
QUERY_BITS = 6
#: Width of the error bound in standard deviations.
EPSILON = 3.0
#: Vectors of a group of clusters, and queries that a task holds.
LEAST_GROUP, MOST_GROUP, QUERY_BLOCK = 4096, 1 << 18, 1 << 16
ROWS_AT_ONCE = 2048
#: Queries and vectors of a tile, and the share of its pairs from which on distances are made for the whole tile.
TILE, DENSE = (256, 2048), 1 / 16
#: Numbers that one batch or one matrix of distances holds.
AT_ONCE = 1 << 21


@dataclass
class Index:
    """Centroids, rotation, and the table (cluster, vec_id, body, code, length, own) of all vectors, whose bodies hold numbers of ``kind``."""

    centroids: np.ndarray
    rotation: np.ndarray
    rows: DataFrame
    kind: str


def bodies(column: pa.Array, size: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), size).astype(np.float64)


def distances2(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    step = max(1, AT_ONCE // k)
    for _ in range(rounds):
        own = np.concatenate([distances2(x[a : a + step], c).argmin(1) for a in range(0, len(x), step)])
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        at = np.concatenate([[0], np.cumsum(n)])[:-1]
        full = n > 0
        sums = np.add.reduceat(x[order], at[full], axis=0)
        c[full] = sums / n[full][:, None]
        if (~full).any():
            c[~full] = x[rng.choice(len(x), int((~full).sum()), replace=False)]
    return c


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): vectors that take part, as doubles; those of floats are packed as floats again."""
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & fine)


def packed_vectors(rows: DataFrame, kind: str) -> DataFrame:
    """Doubles as bytes of numbers of ``kind``, which holds them without loss."""
    width = np.dtype(kind).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            at = v.offsets.to_numpy()
            flat = v.values.to_numpy(zero_copy_only=False).astype(kind)
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(v), [None, pa.py_buffer(at.astype(np.int64) * width), pa.py_buffer(np.ascontiguousarray(flat))])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), body.cast(pa.binary())], ["vec_id", "body"])

    return rows.mapInArrow(run, "vec_id bigint, body binary")


def coded(x: np.ndarray, own: np.ndarray, centroids: np.ndarray, rotation: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, length beyond the centroid, inner product with the own signs) of every vector."""
    rest = x - centroids[own]
    length = np.sqrt((rest * rest).sum(1))
    turned = (rest / np.where(length > 0, length, 1)[:, None]) @ rotation.T
    bits = np.packbits(turned >= 0, axis=1, bitorder="little")
    return bits, length, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def words_of(bits: np.ndarray) -> np.ndarray:
    """Packed bits as rows of 64-bit words."""
    pad = -bits.shape[1] % 8
    return np.ascontiguousarray(np.pad(bits, ((0, 0), (0, pad)))).view(np.uint64)


def build(rows: DataFrame, size: int, kind: str) -> Index:
    """Index all rows (vec_id, body) of vectors with ``size`` components."""
    n = rows.count()
    share = min(1.0, SAMPLE / max(1, n))
    picked = rows.where(F.pmod(F.xxhash64("body"), F.lit(1 << 20)) < F.lit(max(1, round(share * (1 << 20))))).select("body").limit(2 * SAMPLE).toArrow()
    x = bodies(picked["body"].combine_chunks(), size, kind) if picked.num_rows else np.zeros((1, size))
    x = np.unique(x, axis=0)
    k = int(max(1, min(MOST_CLUSTERS, len(x), round(n**0.5 / 2))))
    centroids = k_means(x, k)
    rotation = np.linalg.qr(np.random.default_rng(11).normal(size=(size, size)))[0]
    shared = rows.sparkSession.sparkContext.broadcast((centroids, rotation))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, rotation = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(a, ROWS_AT_ONCE)
                x = bodies(batch.column("body"), size, kind)
                own = distances2(x, centroids).argmin(1)
                bits, length, along = coded(x, own, centroids, rotation)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own.astype(np.int32)), batch.column("vec_id"), batch.column("body"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(along)],
                    ["cluster", "vec_id", "body", "code", "length", "own"])

    return Index(centroids, rotation, stored(rows.mapInArrow(run, "cluster int, vec_id bigint, body binary, code binary, length double, own double"), "vector-index"), kind)


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(1))


def probes_needed(index: Index, asked: DataFrame, size: int, k: int) -> int:
    """Probes that reach RECALL for a bounded set of queries, which are answered by brute force."""
    some = asked.orderBy(F.xxhash64("body", F.lit(1)), "body").limit(CALIBRATION).toArrow()
    if not some.num_rows:
        return 1
    q = bodies(some["body"].combine_chunks(), size, index.kind)
    shared, kind = index.rows.sparkSession.sparkContext.broadcast(q), index.kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        best: list[list[tuple[float, int, int]]] = [[] for _ in q]
        for batch in batches:
            x = bodies(batch.column("body"), size, kind)
            ids, cluster = batch.column("vec_id").to_numpy(), batch.column("cluster").to_numpy()
            d = distances2(q, x)
            for i in range(len(q)):
                near = np.argpartition(d[i], min(k, len(x) - 1))[: k + 1]
                best[i] = sorted([*best[i], *zip(d[i][near].tolist(), ids[near].tolist(), cluster[near].tolist())])[: k + 1]
        out = [(i, *b) for i, own in enumerate(best) for b in own]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["i", "d", "vec_id", "cluster"])

    found = index.rows.select("vec_id", "cluster", "body").mapInArrow(run, "i bigint, d double, vec_id bigint, cluster bigint")
    w = Window.partitionBy("i").orderBy("d", "vec_id")
    top = found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("i", "cluster").toArrow()
    order = np.argsort(distances2(q, index.centroids), axis=1)
    place = np.argsort(order, axis=1)
    need = np.sort(place[top["i"].to_numpy(), top["cluster"].to_numpy()]) + 1
    return int(need[min(len(need) - 1, int(np.ceil(RECALL * len(need))) - 1)])


@dataclass
class Groups:
    """Where the clusters' vectors are searched: cluster c in the groups ``begin[c]`` to ``begin[c] + parts[c] - 1``, of several by hash of the id."""

    begin: np.ndarray
    parts: np.ndarray


def groups_of(counts: np.ndarray, most: int) -> Groups:
    """Neighbouring clusters together up to ``most`` vectors, and a larger cluster in parts of its own."""
    begin, parts, at, held = np.zeros(len(counts), np.int32), np.maximum(1, -(-counts // most)).astype(np.int32), -1, most + 1
    for c, (n, cut) in enumerate(zip(counts.tolist(), parts.tolist())):
        if cut > 1 or held + n > most:
            at, held = at + 1, 0
        begin[c], held = at, held + n
        if cut > 1:
            at, held = at + cut - 1, most + 1
    return Groups(begin, parts)


def probed(asked: DataFrame, index: Index, groups: Groups, probes: int, size: int) -> DataFrame:
    """(x, asked, body, clusters): every query once per group, with those of the group's clusters that it probes."""
    shared, kind = asked.sparkSession.sparkContext.broadcast((index.centroids, groups)), index.kind
    step = max(1, min(ROWS_AT_ONCE, AT_ONCE // len(index.centroids), AT_ONCE // size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, groups = shared.value
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                batch = whole.slice(a, step)
                near = np.argsort(distances2(bodies(batch.column("body"), size, kind), centroids), axis=1)[:, :probes]
                parts = groups.parts[near.ravel()]
                row, cluster = np.repeat(np.repeat(np.arange(batch.num_rows), near.shape[1]), parts), np.repeat(near.ravel(), parts)
                x = groups.begin[cluster] + np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
                order = np.lexsort((cluster, x, row))
                row, x, cluster = row[order], x[order].astype(np.int32), cluster[order].astype("<u2")
                at = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (x[1:] != x[:-1])]))
                ends = np.append(at, len(row))
                # Bodies are repeated for a bounded part of the rows at once.
                rows = max(1, AT_ONCE // size)
                for b in range(0, len(at), rows):
                    here, cut = at[b : b + rows], ends[b : b + rows + 1]
                    who = pa.array(row[here])
                    lists = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(here), [None, pa.py_buffer((cut - cut[0]).astype(np.int64) * 2), pa.py_buffer(cluster[cut[0] : cut[-1]])])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x[here]), batch.column("asked").take(who), batch.column("body").take(who), lists.cast(pa.binary())], ["x", "asked", "body", "clusters"])

    return asked.mapInArrow(run, "x int, asked bigint, body binary, clusters binary")


class Asked:
    """Queries of one cluster: rotated, cut to a few bits per component, with the best distances found so far.

    ``d`` and ``found`` may be given: rows ``of`` them are these queries', which other clusters have changed before.
    """

    def __init__(self, q: np.ndarray, centroid: np.ndarray, rotation: np.ndarray, k: int, d: np.ndarray | None = None, found: np.ndarray | None = None, of: np.ndarray | None = None):
        self.q, self.k = q, k
        rest = q - centroid
        length = np.sqrt((rest * rest).sum(1))
        turned = (rest / np.where(length > 0, length, 1)[:, None]) @ rotation.T
        low = turned.min(1)
        step = np.maximum((turned.max(1) - low) / ((1 << QUERY_BITS) - 1), 1e-300)
        level = np.rint((turned - low[:, None]) / step[:, None])
        # The lower bound length^2 + length'^2 - 2 length length' (cos + spread + step) is the inner product of ``near`` and a vector's row in ``meet``.
        cut = (step[:, None] * level + low[:, None]) * length[:, None]
        self.near = np.column_stack([-cut, np.ones(len(q)), length, length * step, length * length])
        self.q2 = (q * q).sum(1)
        self.d = np.full((len(q), k), np.inf) if d is None else d
        self.found = np.zeros((len(q), k), np.int64) if found is None else found
        self.of = np.arange(len(q)) if of is None else of

    @property
    def best(self) -> list[tuple[np.ndarray, np.ndarray]]:
        return [(d[d < np.inf], found[d < np.inf]) for d, found in zip(self.d[self.of], self.found[self.of])]

    def meet(self, ids: np.ndarray, x: np.ndarray, code: np.ndarray, length: np.ndarray, own: np.ndarray) -> None:
        size = x.shape[1]
        signs = np.unpackbits(np.ascontiguousarray(code).view(np.uint8), axis=1, count=size, bitorder="little") * 2.0 - 1
        along = np.where(own > 0, own, 1)
        spread = EPSILON * np.sqrt(np.maximum(1 - own * own, 0)) / along / np.sqrt(max(1, size - 1))
        far = np.column_stack([signs * (2 * length / along / np.sqrt(size))[:, None], length * length, -2 * length * spread, -2 * length, np.ones(len(x))])
        x2 = (x * x).sum(1)
        # Single precision where squares neither overflow nor vanish in it; ``slack`` is more than what is lost by rounding.
        most = max(float(self.q2.max()), float(x2.max()), float(self.near[:, -1].max()), float((length * length).max()))
        kind = np.float32 if 1e-20 < most < 1e20 else np.float64
        slack = 64 * size * float(np.finfo(kind).eps) * most
        near, q, far, xs = self.near.astype(kind), self.q.astype(kind), far.astype(kind), x.astype(kind)
        for a in range(0, len(q), TILE[0]):
            for b in range(0, len(x), TILE[1]):
                self._tile(slice(a, a + TILE[0]), ids[b : b + TILE[1]], x[b : b + TILE[1]], x2[b : b + TILE[1]], near, far[b : b + TILE[1]], q, xs[b : b + TILE[1]], slack)

    def _tile(self, at: slice, ids: np.ndarray, x: np.ndarray, x2: np.ndarray, near: np.ndarray, far: np.ndarray, q: np.ndarray, xs: np.ndarray, slack: float) -> None:
        of = self.of[at]
        limit = self.d[of, -1] ** 2
        limit = limit * (1 + 1e-9) + slack
        look = near[at] @ far.T <= limit[:, None].astype(near.dtype)
        if np.count_nonzero(look) > DENSE * look.size:
            d2 = self.q2[at][:, None].astype(q.dtype) + x2.astype(q.dtype) - 2 * (q[at] @ xs.T)
            short = np.flatnonzero(np.isinf(limit))
            if len(short) and len(x) > self.k:
                limit[short] = np.partition(d2[short], self.k - 1, axis=1)[:, self.k - 1].astype(np.float64) * (1 + 1e-6) + 2 * slack
            look &= d2 <= limit[:, None].astype(d2.dtype) + d2.dtype.type(slack)
        i, j = np.nonzero(look)
        if not len(i):
            return
        d = np.concatenate([exact(x[j[a : a + AT_ONCE // 64]], self.q[at][i[a : a + AT_ONCE // 64]]) for a in range(0, len(i), AT_ONCE // 64)])
        # The best of the rows that were met, old and new ones together.
        met, i = np.unique(i, return_inverse=True)
        whose = np.concatenate([np.repeat(np.arange(len(met)), self.k), i])
        d, found = np.concatenate([self.d[of[met]].ravel(), d]), np.concatenate([self.found[of[met]].ravel(), ids[j]])
        order = np.lexsort((found, d, whose))
        first = np.searchsorted(whose[order], np.arange(len(met)))
        keep = order[first[:, None] + np.arange(self.k)]
        self.d[of[met]], self.found[of[met]] = d[keep], found[keep]


class Block:
    """Queries that a task holds, and which of them probe a cluster."""

    def __init__(self, asked: np.ndarray, q: np.ndarray, clusters: list[bytes], k: int):
        self.asked, self.q = asked, q
        lists = [np.frombuffer(c, "<u2") for c in clusters]
        cluster, row = np.concatenate(lists), np.repeat(np.arange(len(lists)), [len(c) for c in lists])
        order = np.argsort(cluster, kind="stable")
        self.cluster, self.row = cluster[order], row[order]
        self.d, self.found = np.full((len(q), k), np.inf), np.zeros((len(q), k), np.int64)

    def of(self, cluster: int, centroid: np.ndarray, rotation: np.ndarray) -> Asked | None:
        rows = self.row[np.searchsorted(self.cluster, cluster) : np.searchsorted(self.cluster, cluster, "right")]
        return Asked(self.q[rows], centroid, rotation, self.d.shape[1], self.d, self.found, rows) if len(rows) else None

    def answers(self) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(self.asked), ROWS_AT_ONCE):
            d = self.d[a : a + ROWS_AT_ONCE]
            i, j = np.nonzero(d < np.inf)
            yield pa.RecordBatch.from_arrays([pa.array(self.asked[a + i]), pa.array(self.found[a + i, j]), pa.array(d[i, j])], ["asked", "vec_id", "score"])


def search(index: Index, asked: DataFrame, probes: int, size: int, k: int) -> DataFrame:
    """(asked, vec_id, score): for each query (asked, body) the ``k`` nearest of the vectors in every group it probes."""
    spark = asked.sparkSession
    held = index.rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).toArrow()  # a row per cluster
    counts = np.zeros(len(index.centroids), np.int64)
    counts[held["cluster"].to_numpy()] = held["n"].to_numpy()
    groups = groups_of(counts, int(min(MOST_GROUP, max(LEAST_GROUP, -(-counts.sum() // (4 * tasks(spark)))))))
    queries = probed(asked, index, groups, probes, size)
    shared, kind = spark.sparkContext.broadcast((index.centroids, index.rotation)), index.kind
    # A row per group and per cluster: both tables are local and small.
    blocks = queries.groupBy("x").agg(F.count(F.lit(1)).alias("m")).toArrow()
    blocks = F.broadcast(spark.createDataFrame(pa.table({"x": blocks["x"], "ys": pa.array(-(-blocks["m"].to_numpy() // QUERY_BLOCK), pa.int32())}), "x int, ys int"))
    places = F.broadcast(spark.createDataFrame(pa.table({"cluster": np.arange(len(counts), dtype=np.int32), "begin": groups.begin, "parts": groups.parts}), "cluster int, begin int, parts int"))
    part = lambda col, n: F.pmod(F.xxhash64(col), F.col(n)).cast("int")
    cols = ["x", "y", "role", "cluster", "id", "body", "code", "length", "own"]
    told = index.rows.join(places, "cluster").withColumn("x", F.col("begin") + part("vec_id", "parts")).join(blocks, "x").select(
        "*", F.explode(F.sequence(F.lit(0), F.col("ys") - 1)).alias("y"), F.lit(1).alias("role"), F.col("vec_id").alias("id")).select(*cols)
    wants = queries.join(blocks, "x").select(
        "x", part("asked", "ys").alias("y"), F.lit(0).alias("role"), F.lit(-1).alias("cluster"), F.col("asked").alias("id"), "body", F.col("clusters").alias("code"),
        F.lit(None).cast("double").alias("length"), F.lit(None).cast("double").alias("own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, rotation = shared.value
        key, parts, block, cluster, asking = None, [], None, None, None
        for batch in batches:
            k4 = np.stack([batch.column(c).to_numpy() for c in ("x", "y", "role", "cluster")])
            cut = np.concatenate([[0], np.flatnonzero((k4[:, 1:] != k4[:, :-1]).any(0)) + 1, [k4.shape[1]]])
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if (here := tuple(k4[:2, a].tolist())) != key:
                    if block is not None:
                        yield from block.answers()
                    key, parts, block, cluster, asking = here, [], None, None, None
                rows = batch.slice(a, b - a)
                x = bodies(rows.column("body"), size, kind)
                if k4[2, a] == 0:
                    parts.append((rows.column("id").to_numpy(), x, rows.column("code").to_pylist()))
                    continue
                if block is None and parts:
                    block = Block(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), [c for p in parts for c in p[2]], k)
                    parts = []
                if block is not None and k4[3, a] != cluster:
                    cluster = int(k4[3, a])
                    asking = block.of(cluster, centroids[cluster], rotation)
                if asking is not None:
                    code = np.frombuffer(b"".join(rows.column("code").to_pylist()), np.uint8).reshape(len(x), -1)
                    asking.meet(rows.column("id").to_numpy(), x, code, rows.column("length").to_numpy(), rows.column("own").to_numpy())
        if block is not None:
            yield from block.answers()

    met = told.unionByName(wants).repartition("x", "y").sortWithinPartitions("x", "y", "role", "cluster")
    return in_arrow(met, run, "asked bigint, vec_id bigint, score double")


def first(rows: DataFrame, n: int, by: list[str], order: list[Column | str], out: str) -> DataFrame:
    """The first ``n`` rows of every group; Spark limits groups before it shuffles them."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(out) <= n)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every query; ``is_query`` is a condition on ``vec_id``."""
    rows = usable(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("size")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    empty = "query_id long, rank int, vec_id long, score double"
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], empty)
    size = sizes["size"]
    spark = vectors.sparkSession
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    # Without repeated rows the k + 1 of one vector are k + 1 ids.
    paths = fresh_folder(spark, "vectors"), fresh_folder(spark, "unique")
    packed_vectors(rows.where(F.size("v") == size), kind).dropDuplicates(["vec_id", "body"]).write.parquet(paths[0])
    whole = spark.read.schema("vec_id bigint, body binary").parquet(paths[0])
    first(whole, k + 1, ["body"], ["vec_id"], "_n").drop("_n").write.parquet(paths[1])
    unique = spark.read.schema("vec_id bigint, body binary").parquet(paths[1])
    let_go(spark)  # shuffles of whole vectors
    index = build(unique, size, kind)
    queries = stored(whole.where(is_query).select(F.col("vec_id").alias("query_id"), "body"), "queries")
    asked = stored(queries.select("body").distinct().withColumn("asked", F.monotonically_increasing_id()), "asked")
    probes = probes or probes_needed(index, asked, size, k)
    remove(spark, *paths)  # their vectors are in the index and among the queries
    let_go(spark)
    found = search(index, asked, probes, size, k + 1)
    top = first(found, k + 1, ["asked"], ["score", "vec_id"], "_n").drop("_n")
    met = queries.join(asked, "body").select("query_id", "asked").join(top, "asked").where("vec_id <> query_id")
    return first(met, k, ["query_id"], ["score", "vec_id"], "rank").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
