"""Operator 7: near duplicates by b-bit MinHash, confirmed on full shingle sets.

A text's set holds the 64-bit hashes of its distinct word pairs (A-Z lower-cased, words ``[^\\x20\\x09-\\x0D]+``).  Sets that are
equal form a class, and only one row per class goes on.  Of each class 160 minima are taken: 32 bands of five give the
buckets for candidates (a pair at similarity 0.8 misses all with probability 3e-6), and the low four bits of each are
packed into 80 bytes, from which bit counts, corrected for chance collisions, estimate the similarity of a pair.

Links are found without listing the pairs of a bucket.  Star rounds propose to every class its most similar pivot of another
component, confirm that one pair on the full sets and join components.  In buckets that still span several components the
members outside the largest one are compared with all others by packed bits, block by block, and tied into clusters by
those estimates that could reach the threshold; inside a cluster the same is done on full sets, which decides every
such pair.  Both give a forest of edges per block.  Blocks bound what a task
holds, keys are salted, and components are joined by alternating star contractions on stored tables.

Null texts and texts without words have an empty set, link with nothing and stand alone.  Rows that share a doc_id but not
their text may be linked to one another.  A null doc_id stands alone with a null component and is kept.  An empty table gives an empty result; other
columns are ignored by ``near_duplicates`` and kept by ``keep_first``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import by_bits, encoded, fresh_folder, gather, in_arrow, key_bits, passes, scratch, stored, tasks, utf8, words

BANDS, ROWS, BITS = 32, 5, 4
MINIMA = BANDS * ROWS
STAR_ROUNDS = 2
BLOCK, SET_BLOCK = 4096, 512
#: Estimates this far below the threshold are still confirmed: 4.5 standard deviations of 160 minima at 0.8.
MARGIN = 0.15
COLUMN_STEP = 2048

_mix = np.random.default_rng(20240607)
FACTORS = _mix.integers(1 << 62, 1 << 63, MINIMA, dtype=np.uint64) | np.uint64(1)
SHIFTS = _mix.integers(0, 1 << 63, MINIMA, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
ONES = np.uint64(0x1111111111111111)


# Sets and signatures --------------------------------------------------------------------------


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(text: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the shingles of every row; a shorter text is one shingle, no words give none."""
    data, at = utf8(text)
    found, rows = words(LOWER[data], at)
    codes, distinct = encoded(found)
    own = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct.to_pylist()), np.uint64, len(distinct))[codes]
    n, rolled = len(own), np.zeros(len(own), np.uint64)
    for k in range(width):
        m = max(0, n - k)
        rolled[:m] = mixed(rolled[:m] * np.uint64(0x9E3779B97F4A7C15) + own[k:])
    out = []
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            whole = np.zeros(1, np.uint64)
            for x in own[a:b]:
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + x)
            out.append(whole ^ np.uint64(b - a))
        else:
            out.append(own[:0])
    return out


def minima(shingles: np.ndarray) -> np.ndarray:
    best = np.full(MINIMA, 0xFFFFFFFF, np.uint64)
    for a in range(0, len(shingles), COLUMN_STEP):
        values = FACTORS[:, None] * shingles[None, a : a + COLUMN_STEP] + SHIFTS[:, None]
        np.minimum(best, values.min(1) >> np.uint64(32), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    keys = np.arange(BANDS, dtype=np.uint64)
    for column in best.reshape(BANDS, ROWS).T:
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64)


def packed(best: np.ndarray) -> bytes:
    low = (best & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | low[1::2] << 4).tobytes()


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (rows of 64-bit words): minima that differ are counted as set bits."""
    x = many ^ one
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    differ = np.bitwise_count(x & ONES).sum(-1, dtype=np.int64)
    chance = 1 / (1 << BITS)
    return (1 - differ / MINIMA - chance) / (1 - chance)


def unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(len(column), MINIMA * BITS // 64)


SIGNED = "doc_id bigint, n_shingles bigint, digest binary, bands array<bigint>, sig binary"


def signatures(docs: DataFrame, width: int) -> DataFrame:
    """One row of SIGNED per row of (doc_id, text); empty sets have no digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            rows = []
            for s in shingle_sets(batch.column("text"), width):
                best = minima(s) if len(s) else None
                rows.append((len(s), *((xxhash.xxh3_128_digest(s.tobytes()), band_keys(best), packed(best)) if len(s) else (None, None, None))))
            n, digest, bands, sig = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())],
                ["doc_id", "n_shingles", "digest", "bands", "sig"],
            )

    return in_arrow(docs, run, SIGNED)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(id, shingles): sorted hashes of every row of (doc_id, text) as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    return in_arrow(docs, run, "id bigint, shingles binary")


# Components -----------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, label): smallest id of the component for every id but the smallest; edges are (a, b)."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return e.select(F.col("u").alias("id"), F.col("v").alias("label"))
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        e = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")


def relabelled(comp: DataFrame, edges: DataFrame) -> DataFrame:
    """Components of (id, comp) after joining those of every edge's two ends."""
    a, b = comp.select(F.col("id").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    joined = edges.join(a, "a").join(b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    labels = components(joined)
    return stored(comp.join(labels.withColumnRenamed("id", "comp"), "comp", "left").select("id", F.coalesce("label", "comp").alias("comp")), "components")


# Pairs ----------------------------------------------------------------------------------------


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets reach the threshold.  b's set meets those of its partners in salted groups."""
    salted = pairs.select("a", "b", F.pmod(F.xxhash64("a"), F.lit(4 * tasks(pairs.sparkSession))).cast("int").alias("salt"))
    members = salted.join(sets.withColumnRenamed("id", "a"), "a").select("b", "salt", "a", "shingles")
    hubs = salted.select("b", "salt").distinct().join(sets.withColumnRenamed("id", "b"), "b").select("b", "salt", F.lit(None).cast("bigint").alias("a"), "shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, held = None, []
        for batch in batches:
            left, right = [], []
            for b, a, body in zip(*(batch.column(c).to_pylist() for c in ("b", "a", "shingles"))):
                own = np.frombuffer(body, np.uint64)
                if a is None:
                    held = [own] if b != hub else [*held, own]
                    hub = b
                    continue
                for other in held:
                    small, big = (own, other) if len(own) <= len(other) else (other, own)
                    at = np.searchsorted(big, small)
                    at[at == len(big)] = 0
                    both = int((big[at] == small).sum()) if len(big) else 0
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        left.append(a)
                        right.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    # Every salted group begins with its hub, as null sorts first; the hub of another salt is the same set.
    met = members.unionByName(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    return in_arrow(met, run, "a bigint, b bigint")


def best_pivots(pairs: DataFrame, signed: DataFrame, least: float) -> DataFrame:
    """Of proposals (id, pivot) the one with the highest estimate per id, if it can reach the threshold."""
    sig = signed.select("id", "sig")
    met = pairs.join(sig, "id").join(sig.select(F.col("id").alias("pivot"), F.col("sig").alias("other")), "pivot")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            value = estimates(unpacked(batch.column("sig")), unpacked(batch.column("other")))
            keep = pa.array(value >= least)
            yield pa.RecordBatch.from_arrays([batch.column("id").filter(keep), batch.column("pivot").filter(keep), pa.array(value).filter(keep)], ["id", "pivot", "value"])

    valued = in_arrow(met.select("id", "pivot", "sig", "other"), run, "id bigint, pivot bigint, value double")
    return valued.groupBy("id").agg(F.max(F.struct("value", "pivot")).alias("m")).select(F.col("id").alias("a"), F.col("m.pivot").alias("b"))


def in_shared_buckets(classes: DataFrame) -> DataFrame:
    """(bucket, id) of the buckets that hold more than one class."""
    spread = classes.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    # Spark takes an explode for one row each, 32 times too few here, and would broadcast all buckets of a table that looks small.
    return spread.hint("merge").join(shared.hint("merge"), "bucket")


def open_buckets(members: DataFrame, comp: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """Members (bucket, id, comp), and of buckets with more than one component a pivot chosen by hash."""
    met = members.join(comp, "id")
    order = F.struct(F.xxhash64("id", F.lit(seed)), "id", "comp")
    wide = met.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min(order).alias("p"), F.count(F.lit(1)).alias("n"))
    return met, wide.where("low <> high").select("bucket", F.col("p.id").alias("pivot"), F.col("p.comp").alias("pivot_comp"), "n")


def crossing(rows: DataFrame, key: str, payload: str, block: int) -> DataFrame:
    """Rows (key, id, comp, payload) laid out so that members outside their key's largest component (role 0) stand before
    all members (role 1) of the same (key, x, y); x and y are blocks by hash of about ``block`` rows."""
    shares = rows.groupBy(key, "comp").agg(F.count(F.lit(1)).alias("c"))
    main = shares.groupBy(key).agg(F.max(F.struct("c", "comp")).alias("m"), F.sum("c").alias("n"), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = rows.join(main.select(key, F.col("m.comp").alias("main"), "n"), key)
    blocks = F.ceil(F.col("n") / F.lit(block)).cast("int")
    own, every = F.pmod(F.xxhash64("id"), blocks).cast("int"), F.sequence(F.lit(0), blocks - 1)
    cols = [F.col(key).alias("key"), "x", "y", "role", "id", "comp", payload]
    asked = met.where("comp <> main").select("*", own.alias("x"), F.explode(every).alias("y"), F.lit(0).alias("role")).select(*cols)
    told = met.select("*", F.explode(every).alias("x"), own.alias("y"), F.lit(1).alias("role")).select(*cols)
    return asked.unionByName(told).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "role")


def spanning(rows: DataFrame, payload: str, load, compare, joined: bool) -> DataFrame:
    """Edges (a, b) that join what ``compare`` finds alike across components: a forest per block, never all pairs.

    ``load`` turns a payload column into something that ``compare(asked, i, told)`` can read, which gives a mask of told rows.
    With ``joined`` the rows of a component count as tied already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, asking = None, []
        for batch in batches:
            k = np.stack([batch.column(c).to_numpy() for c in ("key", "x", "y", "role")])
            cut = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(0)) + 1, [k.shape[1]]])
            ids, comps = batch.column("id").to_numpy(), batch.column("comp").to_numpy()
            left, right = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if tuple(k[:3, a]) != key:
                    key, asking = tuple(k[:3, a]), []
                part = (ids[a:b].copy(), comps[a:b].copy(), load(batch.column(payload).slice(a, b - a)))
                if k[3, a] == 0:
                    asking.append(part)
                    continue
                root = np.unique(part[1], return_inverse=True)[1] if joined else np.arange(b - a)
                for qi, qc, ql in asking:
                    for i in range(len(qi)):
                        ok = np.flatnonzero(compare(ql, i, part[2]) & (part[1] != qc[i]))
                        if len(ok):
                            roots, first = np.unique(root[ok], return_index=True)
                            left.append(part[0][ok[first]])
                            right.append(np.full(len(first), qi[i]))
                            if len(roots) > 1:
                                root[np.isin(root, roots)] = roots[0]
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], ["a", "b"])

    return in_arrow(rows, run, "a bigint, b bigint")


class Postings:
    """Sets of a block, and for every shingle the rows that hold it."""

    def __init__(self, column: pa.Array):
        bodies = column.to_pylist()
        self.size = np.fromiter((len(b) // 8 for b in bodies), np.int64, len(bodies))
        self.flat = np.frombuffer(b"".join(bodies), np.uint64)
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.order = None

    def shared(self, asked: np.ndarray) -> np.ndarray:
        """Shingles in common with every row."""
        if self.order is None:
            order = np.argsort(self.flat, kind="stable")
            self.sorted = self.flat[order]
            self.order = np.repeat(np.arange(len(self.size)), self.size)[order]
        low, high = np.searchsorted(self.sorted, asked), np.searchsorted(self.sorted, asked, "right")
        return np.bincount(gather(self.order, low, high - low), minlength=len(self.size))


def close_sets(percent: int):
    def compare(asked: Postings, i: int, told: Postings) -> np.ndarray:
        own = asked.flat[asked.at[i] : asked.at[i + 1]]
        both = told.shared(own)
        return 100 * both >= percent * (len(own) + told.size - both)

    return compare


def last_links(members: DataFrame, comp: DataFrame, signed: DataFrame, sets: DataFrame, percent: int, least: float) -> DataFrame:
    """Links that join all components which any candidate pair of a bucket joins.

    Estimates first tie the members of buckets into clusters; inside a cluster full sets are compared, so every pair
    whose estimate could reach the threshold is decided exactly.
    """
    rows = members.join(comp, "id").join(signed.select("id", "sig"), "id")
    compare = lambda asked, i, told: estimates(asked[i], told) >= least
    ties = spanning(crossing(rows, "bucket", "sig", BLOCK), "sig", unpacked, compare, False)
    labels = components(ties)
    cluster = labels.select("id", F.col("label").alias("cluster")).unionByName(labels.select(F.col("label").alias("id"), F.col("label").alias("cluster")).distinct())
    whole = stored(cluster, "clusters").join(comp, "id").join(sets, "id")
    return spanning(crossing(whole, "cluster", "shingles", SET_BLOCK), "shingles", Postings, close_sets(percent), True)


# Operator -------------------------------------------------------------------------------------


def near_duplicates(docs: DataFrame, percent: int = 80, width: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): links at ``percent`` of shared shingles of ``width`` words."""
    source = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    least = percent / 100 - MARGIN
    signed = stored(signatures(source, width), "signatures")
    linked = F.col("digest").isNotNull() & F.col("doc_id").isNotNull()
    classes = signed.where(linked).groupBy("digest").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    classes = stored(classes, "classes")
    members = stored(in_shared_buckets(classes), "members")
    candidates = members.select("id").distinct()
    # Texts are not shuffled: bits of the candidates' ids choose which sets are made, and the sets are joined exactly.
    likely = by_bits(source, F.col("doc_id"), *key_bits(candidates, "id")).where("_maybe").select("doc_id", "text")
    sets = stored(full_sets(likely, width).join(candidates, "id", "left_semi"), "sets")
    some = stored(classes.join(candidates, "id", "left_semi").select("id", "sig"), "candidates")
    comp = stored(candidates.select("id", F.col("id").alias("comp")), "components")
    for seed in range(STAR_ROUNDS):
        met, wide = open_buckets(members, comp, seed)
        proposed = met.join(wide, "bucket").where("comp <> pivot_comp").select("id", "pivot").distinct()
        comp = relabelled(comp, stored(confirmed(best_pivots(proposed, some, least), sets, percent), "links"))
    comp = relabelled(comp, stored(last_links(members, comp, some, sets, percent, least), "links"))
    labels = classes.select("digest", "id").join(comp, "id", "left").select("digest", F.coalesce("comp", "id").alias("component_id"))
    out = ["doc_id", "n_shingles", "component_id"]
    alone = signed.where(~linked).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    all_rows = signed.where(linked).join(labels, "digest").select(*out).unionByName(alone)
    return all_rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, percent: int = 80, width: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stand for their group, all columns kept; of rows that share the standing doc_id one stays.

    Ids alone decide; only documents whose id may be among those that go, or stand in several rows, are shuffled for the exact answer.
    """
    spark = docs.sparkSession
    found = fresh_folder(spark, "kept")
    with scratch(spark):
        near_duplicates(docs, percent, width, id_col, text_col).select("doc_id", "kept").where("doc_id is not null").write.parquet(found)
    rows = spark.read.schema("doc_id bigint, kept boolean").parquet(found)
    decided = rows.groupBy("doc_id").agg((~F.every("kept")).alias("gone"), (F.count_if("kept") > 1).alias("twice"))
    decided = stored(decided.where("gone or twice"), "decided")
    whole = docs.select(F.col(id_col).cast("bigint").alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    told = by_bits(whole, F.col("key"), *key_bits(decided, "doc_id"))
    met = told.where("_maybe").select("key", "row").join(decided, F.col("key") == F.col("doc_id"), "left").where("not coalesce(gone, false)")
    met = stored(met.select("key", "row", F.coalesce("twice", F.lit(False)).alias("twice")), "met")
    parts = told.where("not _maybe"), met.where("not twice"), met.where("twice").dropDuplicates(["key"])
    first, *others = (p.select("row.*") for p in parts)
    for other in others:
        first = first.unionAll(other)
    return first
