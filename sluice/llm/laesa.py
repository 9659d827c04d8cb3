"""Centroid clustering with a LAESA pivot table.

Vectors become integers and are clustered by rounds of assignment to the
nearest centroid and exact, floored means. A few pivots, chosen far from each other, stay fixed:
the distance of every vector to every pivot is computed once and stored beside it in the shared
folder. In a round only the centroids' distances to the pivots are new; by the triangle inequality
``|d(v, p) - d(c, p)|`` is at most ``d(v, c)``, so the largest such difference over the pivots rules
centroids out. Each vector meets the centroid of its lowest bound first; those whose bound does not
exceed the distance found get exact integer distances.

Bounds are compared with a slack above the rounding of their square roots, so no centroid that could
win or tie is ruled out. A round is one narrow pass; a task hands on one sum a centroid and component."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch_path

DIMENSIONS, SCALE, CENTROIDS, ROUNDS = 64, 1024, 8, 10
PIVOTS, PIVOT_CANDIDATES = 8, 256
#: Integer components stay below this, so that a squared distance over 64 of them fits a long.
LARGEST = 1 << 27


def kept_column(vector: Column, dimensions: int = DIMENSIONS) -> Column:
    """True for a vector of ``dimensions`` finite components whose integers are below ``LARGEST``."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) >= LARGEST // SCALE))
    return F.coalesce((F.size(vector) == dimensions) & ~bad, F.lit(False))


def grid(column: pa.Array, dimensions: int) -> np.ndarray:
    """Arrow lists of doubles as rows of integers floor(1024 x)."""
    return np.floor(column.flatten().to_numpy(zero_copy_only=False) * SCALE).astype(np.int64).reshape(-1, dimensions)


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one point, or to one a row."""
    diff = rows - point
    return np.einsum("ij,ij->i", diff, diff)


def choose_pivots(candidates: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different candidates, each the one with the largest sum of
    distances to those chosen before; the first candidate begins."""
    if not len(candidates):
        return candidates
    chosen, total = [0], np.zeros(len(candidates))
    while len(chosen) < n:
        total += np.sqrt(squared(candidates, candidates[chosen[-1]]))
        total[chosen] = -1.0
        far = int(total.argmax())
        if not squared(candidates[chosen], candidates[far]).all():
            break  # everything left equals a pivot
        chosen.append(far)
    return candidates[chosen]


def nearest(rows: np.ndarray, away: np.ndarray, centroids: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance, exact distances computed) for
    integer ``rows`` with their distances ``away`` to the pivots; ties go to the smaller number."""
    if not len(rows):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 0
    apart = np.sqrt(np.array([squared(pivots, c) for c in centroids], dtype=np.float64))
    low = np.zeros((len(rows), len(centroids)))
    for p in range(len(pivots)):
        np.maximum(low, np.abs(away[:, p, None] - apart[None, :, p]), out=low)
    slack = 1e-6 + 1e-9 * (away.max(axis=1) + apart.max())
    first = low.argmin(axis=1)
    label, best, computed = first.copy(), squared(rows, centroids[first]), len(rows)
    for c in range(len(centroids)):
        at = np.flatnonzero((low[:, c] <= np.sqrt(best) + slack) & (first != c))
        found = squared(rows[at], centroids[c])
        computed += len(at)
        better = (found < best[at]) | ((found == best[at]) & (c < label[at]))
        label[at[better]], best[at[better]] = c, found[better]
    return label, best, computed


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS,
            k: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS, seed: str = "3") -> DataFrame:
    """One row per kept vector: ``id_col, cluster, distance, cluster_inertia,
    inertia, centroid_sha256``.

    Vectors that are null, have another length, or hold a null, a non-finite component or one
    of magnitude ``LARGEST / 1024`` = 131,072 or more (its squared distance need not fit a long) are not
    kept. Centroids start as the ``k`` kept vectors with the smallest sha256 of ``<seed>:<id>``
    (null id: the empty text; equal ids in the order of their components); fewer vectors give
    fewer centroids, none an empty result. Repeated rows count each. Inertias that no long holds raise an error."""
    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(kept_column(F.col("v"), dimensions))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    # bounded by the two parameters
    heads = rows.select(digest.alias("h"), "v").orderBy("h", "v").limit(max(k, PIVOT_CANDIDATES)).collect()
    starts = np.floor(np.array([r["v"] for r in heads], dtype=np.float64).reshape(-1, dimensions) * SCALE).astype(np.int64)
    pivot_rows, centroids = choose_pivots(starts[:PIVOT_CANDIDATES], pivots), starts[:k]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = grid(b.column(1), dimensions)
            away = np.sqrt(np.array([squared(points, p) for p in pivot_rows], dtype=np.float64)).T
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(away), pa.list_(pa.float64()))], names=["id", "v", "away"])

    path = scratch_path(spark, "pivot-table")
    rows.mapInArrow(measure, f"id {kind}, v array<double>, away array<double>").write.parquet(path)
    stored = spark.read.parquet(path)

    def assigned(b: pa.RecordBatch, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = grid(b.column("v"), dimensions)
        away = b.column("away").flatten().to_numpy(zero_copy_only=False).reshape(len(points), -1)
        return points, *nearest(points, away, centres, pivot_rows)[:2]

    def sums(centres: np.ndarray) -> tuple[dict, dict]:
        """({cluster: (rows, summed distance)}, {cluster: component sums}) of one assignment."""
        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, far = np.zeros(len(centres), dtype=np.int64), np.zeros(len(centres), dtype=np.int64)
            total = np.zeros((len(centres), dimensions), dtype=np.int64)
            for b in batches:
                points, label, distance = assigned(b, centres)
                for c in np.unique(label):
                    at = label == c
                    n[c], far[c], total[c] = n[c] + at.sum(), far[c] + distance[at].sum(), total[c] + points[at].sum(axis=0)
            c, d = np.indices(total.shape)
            met = (n > 0)[c.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(a.ravel()[met].astype(np.int64)) for a in
                                              (c, d, total, n[c], far[c])], names=["c", "d", "s", "n", "far"])

        found = stored.select("v", "away").mapInArrow(tally, "c bigint, d bigint, s bigint, n bigint, far bigint") \
            .groupBy("c", "d").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum("far").alias("far")).collect()  # k * dimensions rows
        whole, parts = {}, {}
        for r in found:
            whole[r["c"]] = (r["n"], r["far"])
            parts.setdefault(r["c"], [0] * dimensions)[r["d"]] = r["s"]
        return whole, parts

    for _ in range(rounds if len(centroids) else 0):
        whole, parts = sums(centroids)
        centroids = np.array([[s // whole[c][0] for s in parts[c]] if c in whole else old.tolist()
                              for c, old in enumerate(centroids)], dtype=np.int64)
    whole = sums(centroids)[0] if len(centroids) else {}
    far = [whole.get(c, (0, 0))[1] for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, label, distance = assigned(b, centroids)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(label, pa.int32()), pa.array(distance), pa.array([far[c] for c in label], pa.int64()),
                 pa.array([sum(far)] * len(label), pa.int64()), pa.array([digests[c] for c in label], pa.string())],
                names=["id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return stored.mapInArrow(final, f"id {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, "
                                    "centroid_sha256 string").withColumnRenamed("id", id_col)
