import hashlib
import math
import os
import random

import duckdb
import numpy as np
import pytest

from sluice.llm import laesa, queries

SF = "/root/testdata/sf0.001"


def plain(rows, k=8, rounds=10, dims=64):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: f"3:{'' if i is None else i}".encode()
    centres = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(text(r[0])).hexdigest(), r[1]))[:k]]
    away = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((away(v, c), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *near(v)) for i, v in kept]
    per = [sum(d for _, d, n in found if n == c) for c in range(len(centres))]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, n, d, per[n], sum(per), sha[n]) for i, d, n in found), key=str)


@pytest.mark.parametrize("seed, spread, n", [(1, 0.3, 150), (2, 0.002, 60), (3, 90000.0, 60), (4, 0.2, 5)])
def test_equals_plain(spark, seed, spread, n):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(64)] for _ in range(5)]
    rows = [(i, [c + rng.gauss(0, spread / 8) for c in rng.choice(centres)]) for i in range(n)]
    rows = [(i, [max(-130000.0, min(130000.0, x)) for x in v]) for i, v in rows]
    rows += [(900, None), (901, []), (902, [0.0] * 63), (903, [0.0] * 63 + [None]), (904, [float("nan")] * 64),
             (905, [float("inf")] + [0.0] * 63), (906, [0.0] * 64), (None, rows[0][1]), (1, rows[1][1]), (1, rows[2][1]), (907, rows[3][1])]
    d = spark.createDataFrame([(i, v, 4, 5.0) for i, v in rows], "vec_id long, embedding array<double>, cluster int, away double").repartition(5)
    got = [tuple(r) for r in laesa.cluster(d).collect()]
    assert sorted(got, key=str) == plain(rows)


def test_bounds_prune_and_ties_go_to_the_smaller_number():
    rng = np.random.default_rng(7)
    homes = rng.integers(-3000, 3000, (8, 64))
    rows = homes[rng.integers(0, 8, 3000)] + rng.integers(-40, 40, (3000, 64))
    pivots = laesa.choose_pivots(rows[:256], 8)
    away = np.sqrt(np.array([laesa.squared(rows, p) for p in pivots], dtype=float)).T
    label, best, computed = laesa.nearest(rows, away, homes, pivots)
    every = np.array([laesa.squared(rows, c) for c in homes])
    assert (label == every.argmin(axis=0)).all() and (best == every.min(axis=0)).all()
    assert computed < 0.3 * every.size
    same = np.array([[5] * 64, [5] * 64, [3] * 64])
    assert laesa.nearest(np.array([[4] * 64, [5] * 64]), np.ones((2, 1)), same[:, :], np.array([[4] * 64]))[0].tolist() == [0, 0]
    assert len(laesa.choose_pivots(np.array([[1] * 64] * 9), 8)) == 1


def test_empty(spark):
    d = spark.createDataFrame([(1, None), (2, [200000.0] * 64)], "vec_id long, embedding array<float>")
    got = laesa.cluster(d)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert laesa.cluster(d.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    names = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    want = con.execute(f"SELECT {names} FROM ({queries.ORACLES['op13_laesa_centroids']}) q").fetchall()
    got = queries.QUERIES["op13_laesa_centroids"](spark, SF).select(*names.split(", ")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and len({r[1] for r in want}) > 1
