"""Embedding near-duplicates by iterative quantisation and multi-index Hamming tables.

A rotation of the centred principal components is learned that brings vectors
as close as possible to binary codes (iterative quantisation). The code is cut
into substrings, one hash table each: vectors that agree in a substring meet
in its bucket. There the whole codes are compared first, within a radius that
every simulated pair keeps; only vectors with such a partner are shuffled
themselves, and their cosine in double precision decides. Substrings are as long as keeps an average bucket near
``BUCKET_ROWS``; the number of tables is then chosen so that pairs simulated
exactly at the threshold meet with probability ``RECALL`` at least (pairs above
it meet more often), whether their difference is alike in all directions or
follows the vectors' own axes. Where ``MAX_TABLES`` do not reach that,
substrings get shorter. ``measure_recall`` checks that against brute force.

Identical vectors are collapsed first. A bucket above ``BLOCK_ROWS`` vectors is
split into blocks, and pairs of blocks go to different tasks. A bucket returns
link counts and star edges per vector, never its pairs; a pair that meets in
several tables counts in the first."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, checkpointed, components, partitions_of, with_global_index

THRESHOLD = 0.93
#: Vectors a rotation is learned from, at most, and its alternating steps.
SAMPLE_ROWS, STEPS = 5000, 40
#: Average bucket aimed at, largest block of a bucket, and probability that a pair at the threshold meets.
BUCKET_ROWS, BLOCK_ROWS, RECALL = 32, 2048, 0.995
#: Sample from which on one half learns and the other measures.
LEAST_SPLIT = 64
#: Shortest and longest substring (bits), and most tables.
MIN_BITS, MAX_BITS, MAX_TABLES = 4, 24, 64


@dataclass
class Codes:
    """Learned code: ``bits`` a substring, ``tables`` substrings, one hyperplane a bit."""

    mean: np.ndarray
    planes: np.ndarray  # dimension x (bits * tables)
    bits: int
    tables: int
    radius: int  # most differing bits of any pair simulated at the threshold

    def signs(self, unit: np.ndarray) -> np.ndarray:
        return ((unit - self.mean) @ self.planes) >= 0

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """Substring values (vectors x tables) of unit vectors."""
        weights = (1 << np.arange(self.bits, dtype=np.int64))
        return self.signs(unit).reshape(len(unit), self.tables, self.bits) @ weights


def _rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Iterative quantisation: alternate codes ``sign(vR)`` and the orthogonal R nearest to them."""
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(STEPS):
        codes = np.where(v @ r >= 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(v.T @ codes)
        r = left @ right
    return r


def _pairs(sample: np.ndarray, wide: np.ndarray, threshold: float, rng: np.random.Generator) -> list[tuple]:
    """Kinds of pairs the code must keep, ``(left, right)`` each: exactly at the
    threshold around the sample's vectors, with noise alike in all directions
    and with noise that follows the sample's own axes (``wide``); and the
    sample's own pairs just above the threshold, if there are enough to measure."""
    out = []
    for axes in (None, wide):
        left = sample[rng.integers(0, len(sample), 4000)]
        noise = rng.standard_normal(left.shape)
        if axes is not None:
            noise = noise @ axes.T
        noise -= (noise * left).sum(axis=1, keepdims=True) * left
        size = np.linalg.norm(noise, axis=1, keepdims=True)
        some = size[:, 0] > 1e-9  # none is left where all the sample lies on one line
        if axes is None or some.any():
            left, noise = left[some | (axes is None)], (noise / np.maximum(size, 1e-12))[some | (axes is None)]
            out.append((left, threshold * left + np.sqrt(1 - threshold ** 2) * noise))
    found = []
    for a in range(0, len(sample), 512):
        cosine = np.tril(sample[a:a + 512] @ sample.T, k=a - 1)
        i, j = np.nonzero((cosine >= threshold) & (cosine < threshold + (1 - threshold) / 4))
        found.append(np.stack([i + a, j], axis=1))
    own = np.concatenate(found)
    if len(own) >= 1 / (1 - RECALL):
        own = own[rng.permutation(len(own))[:4000]]
        out.append((sample[own[:, 0]], sample[own[:, 1]]))
    return out


def learn(sample: np.ndarray, rows: int, threshold: float = THRESHOLD, seed: int = 11) -> Codes:
    """Code for ``rows`` vectors from a sample of unit vectors (any number, also none of use)."""
    rng = np.random.default_rng(seed)
    d = sample.shape[1]
    # a large group of near copies must not pull the centre and the axes to itself
    keep = np.ones(len(sample), dtype=bool)
    for a in range(0, len(sample), 512):
        close = np.tril(sample[a:a + 512] @ sample.T >= threshold, k=a - 1)
        keep[a:a + 512] = ~(close & keep[None, :]).any(axis=1)
    # recall is measured on vectors the rotation has not seen, where there are enough
    learnt = np.flatnonzero(keep)
    learnt = learnt[::2] if len(learnt) >= LEAST_SPLIT else learnt
    x = sample[learnt]
    unseen = np.delete(sample, learnt, axis=0) if len(learnt) < keep.sum() else sample
    mean = x.mean(axis=0)
    spread, axes = np.linalg.eigh((x - mean).T @ (x - mean))
    spread, axes = spread[::-1], axes[:, ::-1]  # widest first; all of them: the code sees every difference
    bits = int(np.clip(round(np.log2(max(rows, 2) / BUCKET_ROWS)), MIN_BITS, MAX_BITS))
    pairs = _pairs(unseen, axes * np.sqrt(np.maximum(spread, 0)), threshold, rng)
    planes = np.zeros((d, 0))
    while True:
        met = [np.zeros(len(left), dtype=bool) for left, _ in pairs]
        apart = [np.zeros(len(left), dtype=np.int64) for left, _ in pairs]
        tables = 0
        while tables < MAX_TABLES and min(m.mean() for m in met) < RECALL:
            while planes.shape[1] < (tables + 1) * bits:  # a further rotation gives further bits
                planes = np.hstack([planes, axes @ _rotation((x - mean) @ axes, rng)])
            p = planes[:, tables * bits:(tables + 1) * bits]
            for (left, right), m, n in zip(pairs, met, apart):
                differ = (((left - mean) @ p) >= 0) != (((right - mean) @ p) >= 0)
                m |= ~differ.any(axis=1)
                n += differ.sum(axis=1)
            tables += 1
        recall = min(m.mean() for m in met)
        if recall >= RECALL or bits == MIN_BITS:
            break
        bits -= 1  # all tables miss too many: shorter substrings, larger buckets
    return Codes(mean, planes[:, :tables * bits], bits, tables, int(max(n.max() for n in apart)))


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows (double precision) of a list column with lists of one length, none null."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # neither overflow nor underflow
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _roots(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = up[x]
        if np.array_equal(x, y):
            return x
        x = y


def _bucket(unit, keys, table, weight, block, two, threshold):
    """Links inside one block of a bucket, or between ``two`` blocks of it:
    weighted counts and local roots by position."""
    n = len(unit)
    counts, up = np.zeros(n, dtype=np.int64), np.arange(n)
    for a in range(0, n, 512):
        near = unit[a:a + 512] @ unit.T >= threshold
        i, j = np.nonzero(near)
        i = i + a
        keep = (i < j) & ((block[i] != block[j]) | (not two))
        i, j = i[keep], j[keep]
        if table and len(i):
            fresh = ~(keys[i, :table] == keys[j, :table]).any(axis=1)  # met in no earlier table
            i, j = i[fresh], j[fresh]
        np.add.at(counts, i, weight[j])
        np.add.at(counts, j, weight[i])
        while len(i):
            x, y = _roots(up, i), _roots(up, j)
            apart = x != y
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            np.minimum.at(up, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
    return counts, _roots(up, np.arange(n))


def valid(vector: Column, label: Column) -> Column:
    """Vectors that can link: labelled, not empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(label.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def _sample(vectors: DataFrame, dim: int, rows: int) -> np.ndarray:
    share = min(1 << 30, int(SAMPLE_ROWS / max(rows, 1) * (1 << 30)))
    picked = vectors.where((F.size("v") == dim) & (F.pmod(F.xxhash64("node"), F.lit(1 << 30)) <= share)).select("node", "v")
    found = picked.toArrow().sort_by("node").column("v")
    return np.concatenate([_matrix(c) for c in found.chunks if len(c)] or [np.zeros((0, dim))])


def _retrieved(codes: np.ndarray, two: bool, block: np.ndarray, radius: int) -> np.ndarray:
    """Which of a bucket's members have another one (of the other block, if
    there are ``two``) within ``radius`` bits. ``codes``: rows of 64-bit words."""
    n = len(codes)
    hit = np.zeros(n, dtype=bool)
    for a in range(0, n, 512):
        far = np.zeros((len(codes[a:a + 512]), n), dtype=np.uint16)
        for w in range(codes.shape[1]):
            far += np.bitwise_count(codes[a:a + 512, w][:, None] ^ codes[:, w][None, :])
        near = far <= radius
        if two:
            near &= block[a:a + 512][:, None] != block[None, :]
        rows = np.arange(near.shape[0])
        near[rows, rows + a] = False
        hit[a:a + 512] |= near.any(axis=1)
    return hit


def _buckets(batches: Iterator[pa.RecordBatch], done) -> Iterator[tuple]:
    """``done(rows)`` of every run of rows with equal first three columns
    (bucket and pair of blocks) that has two rows or more, batch by batch."""
    parts, last = [], None
    for batch in batches:
        key = np.stack([batch.column(c).to_numpy() for c in range(3)], axis=1)
        cuts = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(key)]):
            if a == b:
                continue
            k = tuple(key[a])
            if k != last:
                if sum(p.num_rows for p in parts) > 1:
                    yield done(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])
                parts, last = [], k
            parts.append(batch.slice(a, b - a))
    if sum(p.num_rows for p in parts) > 1:
        yield done(pa.Table.from_batches(parts).combine_chunks().to_batches()[0])


def _dealt(coded: DataFrame, payload: list[str]) -> DataFrame:
    """Rows ``cell, a, b, t, i, node, <payload>`` of every bucket with two members
    or more, sorted by bucket and pair of blocks (``i``: the row's own block)."""
    cell = F.shiftleft("grp", 30) + F.shiftleft(F.col("t").cast("bigint"), 24) + F.col("key")
    spread = coded.select("node", *payload, "grp", F.posexplode("keys").alias("t", "key")) \
        .select("node", *payload, "t", cell.alias("cell"))
    sizes = checkpointed(spread.groupBy("cell").agg(F.count(F.lit(1)).alias("c")).where("c > 1"))
    spread = spread.join(broadcast_if_small(sizes), "cell").withColumn("k", F.ceil(F.col("c") / BLOCK_ROWS).cast("int")) \
        .withColumn("i", F.pmod("node", F.col("k")).cast("int"))
    return spread.select("node", *payload, "t", "cell", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j")) \
        .select("cell", F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), "t", "i", "node", *payload) \
        .repartition(partitions_of(coded.sparkSession), "cell", "a", "b").sortWithinPartitions("cell", "a", "b", "node")


def _links_of(vectors: DataFrame, dim: int, rows: int, threshold: float) -> DataFrame:
    """``node, root, links`` (partial: sums and edges over tables) among
    ``vectors(node, grp, v, n)`` of one dimension.

    First only codes travel: a vector goes on if a bucket holds another one
    within the code radius. Then those vectors meet in the same tables and
    their cosine decides."""
    spark = vectors.sparkSession
    sample = _sample(vectors, dim, rows)
    if not len(sample):
        sample = np.eye(dim)[:2]
    shared = spark.sparkContext.broadcast(learn(sample, rows, threshold))
    mine = vectors.where(F.size("v") == dim).select("node", "grp", "v", "n")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value
        for b in batches:
            if b.num_rows:
                signs = codes.signs(_matrix(b.column(2)))
                k = signs.reshape(b.num_rows, codes.tables, codes.bits) @ (1 << np.arange(codes.bits, dtype=np.int64))
                packed = np.packbits(signs, axis=1)
                packed = np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array([row.tobytes() for row in packed], type=pa.binary()),
                     pa.ListArray.from_arrays(pa.array(np.arange(0, k.size + 1, codes.tables, dtype=np.int32)),
                                              pa.array(k.ravel()))], names=["node", "grp", "code", "keys"])

    def retrieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(batch):
            words = np.frombuffer(b"".join(batch.column(6).to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            hit = _retrieved(words, batch.column(1)[0] != batch.column(2)[0], batch.column(4).to_numpy(), shared.value.radius)
            return batch.column(5).to_numpy()[hit]
        for nodes in _buckets(batches, done):
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes)], names=["node"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = shared.value

        def done(batch):
            unit = _matrix(batch.column(7))
            nodes, t = batch.column(5).to_numpy(), batch.column(3)[0].as_py()
            counts, roots = _bucket(unit, codes.keys(unit) if t else None, t, batch.column(6).to_numpy(),
                                    batch.column(4).to_numpy(), batch.column(1)[0] != batch.column(2)[0], threshold)
            hit = counts > 0
            return nodes[hit], nodes[roots[hit]], counts[hit]
        for found in _buckets(batches, done):
            if len(found[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "root", "links"])

    coded = checkpointed(mine.mapInArrow(code, "node bigint, grp bigint, code binary, keys array<bigint>"))
    near = checkpointed(_dealt(coded, ["code"]).mapInArrow(retrieve, "node bigint").distinct())
    kept = mine.join(near, "node").join(coded.select("node", "keys"), "node")
    return _dealt(kept, ["n", "v"]).mapInArrow(link, "node bigint, root bigint, links bigint")


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of ``rows``: ``id_col, n_links, component_id, kept``.

    Vectors link when their labels are equal, their lengths too, and their
    cosine is at least ``threshold``. Vectors that are null, empty, zero or hold
    null or non-finite components, rows without a label and rows without an id
    link with nothing; their class is their own id (``kept`` is false without
    one). Identical vectors all link with each other; repeated ids are vectors
    of their own."""
    base = rows.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    able = valid(F.col("v"), F.col("label")) & F.col("id").isNotNull()
    distinct = checkpointed(base.where(able).groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")))
    labels = with_global_index(checkpointed(distinct.select("label").distinct()), [F.col("label")], "grp")
    known = with_global_index(distinct, [F.col("id")], "node")  # nodes are ordered like ids
    # both sides are materialized, so a hot label is split where the labels are too many to broadcast
    vectors = checkpointed(known.join(broadcast_if_small(checkpointed(labels)), "label"))
    found = None
    for dim, count in sorted((r[0], r[1]) for r in vectors.groupBy(F.size("v")).count().collect()):
        part = _links_of(vectors, dim, count, threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], "node bigint, root bigint, links bigint")
    found = checkpointed(found)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    comp = checkpointed(components(found.select(F.col("node").alias("u"), F.col("root").alias("v"))))
    names = vectors.select(F.col("node").alias("root"), F.col("id").alias("component_id"))
    comp = comp.join(names, "root").select("node", "component_id")
    classes = vectors.select("node", "label", "v", "n", "id").join(links, "node", "left").join(comp, "node", "left") \
        .select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"))
    linked = base.where(able).join(checkpointed(classes), ["label", "v"]).select("id", "n_links", "component_id")
    alone = base.where(~able).select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), "n_links", "component_id",
                      F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def measure_recall(rows: DataFrame, every: int = 50, threshold: float = THRESHOLD, id_col: str = "vec_id",
                   vector_col: str = "embedding", label_col: str = "label") -> tuple[int, int]:
    """(links found, links there) of the vectors whose id is divisible by
    ``every``, against all vectors; the queries are collected, the table is
    searched by brute force in its tasks."""
    base = rows.where(valid(F.col(vector_col), F.col(label_col)) & F.col(id_col).isNotNull()) \
        .select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))
    queries = [(r["id"], r["label"], np.array(r["v"], dtype=np.float64)) for r in base.where(F.col("id") % every == 0).collect()]
    shared = rows.sparkSession.sparkContext.broadcast(queries)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict = {}
        for i, label, v in shared.value:
            groups.setdefault((label, len(v)), []).append((i, v / np.linalg.norm(v)))
        groups = {k: (np.array([i for i, _ in g]), np.array([v for _, v in g])) for k, g in groups.items()}
        for b in batches:
            ids, labels = b.column(0).to_numpy(), b.column(2).to_pylist()
            lengths = [len(v) for v in b.column(1)]
            for key in set(zip(labels, lengths)) & groups.keys():
                at = [i for i, k in enumerate(zip(labels, lengths)) if k == key]
                x = _matrix(b.column(1).take(pa.array(at)))
                qi, q = groups[key]
                near = (q @ x.T >= threshold) & (qi[:, None] != ids[at][None, :])
                for i, n in zip(qi.tolist(), near.sum(axis=1).tolist()):
                    if n:
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([n])], names=["id", "n"])

    there = base.mapInArrow(count, "id bigint, n bigint").agg(F.sum("n")).first()[0] or 0
    got = near_duplicates(rows, id_col, vector_col, label_col, threshold).where(F.col(id_col) % every == 0) \
        .agg(F.sum("n_links")).first()[0] or 0
    return int(got), int(there)
