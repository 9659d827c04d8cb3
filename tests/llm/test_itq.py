import math

import numpy as np
import pytest

from sluice.llm import itq

SCHEMA = "vec_id long, embedding array<float>, label int, node string, v int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def vectors(seed=0, d=16):
    rng = np.random.default_rng(seed)
    out = []
    for g in range(40):
        centre = rng.standard_normal(d)
        for _ in range(rng.integers(1, 8)):
            out.append((centre + rng.standard_normal(d) * rng.choice([0.0, 0.05, 0.2, 0.3]), int(g % 3)))
    return out


def brute(rows):
    ok = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])
          and any(r[1])]
    units = [np.float32(r[1]).astype(np.float64) for r in ok]
    units = [u / np.linalg.norm(u) for u in units]
    up, links = list(range(len(ok))), [0] * len(ok)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x
    close = []
    for i in range(len(ok)):
        for j in range(len(ok)):
            if i != j and ok[i][2] == ok[j][2] and len(units[i]) == len(units[j]):
                c = units[i] @ units[j]
                if abs(c - 0.93) < 1e-9:
                    close.append((i, j))
                if c >= 0.93:
                    links[i] += 1
                    up[max(root(i), root(j))] = min(root(i), root(j))
    assert not close
    low = {}
    for i, r in enumerate(ok):
        low[root(i)] = min(r[0], low.get(root(i), r[0]))
    return sorted((r[0], links[i], low[root(i)]) for i, r in enumerate(ok)), len(ok)


def edge_rows():
    v = [1.0] * 16
    return [(2000, v, 1), (2001, v, 1), (2001, v, 1), (2002, v, None), (2003, None, 1), (2004, [0.0] * 16, 1),
            (2005, [float("nan")] + v[1:], 1), (2006, [None] + v[1:], 1), (2007, [float("inf")] + v[1:], 1), (2008, [], 1),
            (2009, [1.0, 1.0], 1), (2010, [2.0, 2.0], 1), (None, v, 1), (2011, [x * 1e30 for x in v], 1)]


def test_links_and_classes(spark):
    rows = [(i * 7 % 1999, v.tolist(), g) for i, (v, g) in enumerate(vectors())] + edge_rows()
    got = itq.near_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want, n = brute(rows)
    alone = [r for r in got if r["vec_id"] is None or r["n_links"] == 0]
    assert all(r["component_id"] == r["vec_id"] for r in alone if r["vec_id"] is not None)
    linked = {r[0] for r in want}
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got if r["vec_id"] in linked
                  ) == sorted((*w,) for w in want)
    for r in got:
        assert r["kept"] == (r["vec_id"] is not None and r["vec_id"] == r["component_id"])
    assert len(got) - n == sum(r["vec_id"] not in linked for r in got)


def test_hot_bucket_is_split(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + rng.standard_normal(16) * 0.02).tolist(), 1) for i in range(150)]
    rows += [(1000 + i, rng.standard_normal(16).tolist(), 1) for i in range(100)]
    got = itq.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == brute(rows)[0]


def test_recall_is_measured(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(120):
        c = rng.standard_normal(32)
        rows += [(3 * i + k, (c + rng.standard_normal(32) * 0.2).tolist(), 0) for k in range(3)]
    got, there = itq.measure_recall(frame(spark, rows), every=10)
    assert there > 20 and got >= 0.9 * there


def test_simulated_recall_at_every_size():
    rng = np.random.default_rng(6)
    sample = rng.standard_normal((800, 32))
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    for rows in (10, 1000, 10 ** 6):
        codes = itq.learn(sample, rows)
        assert codes.tables <= itq.MAX_TABLES and itq.MIN_BITS <= codes.bits <= itq.MAX_BITS
        signs = codes.keys(sample)
        assert signs.shape == (800, codes.tables) and signs.max() < 1 << codes.bits


@pytest.mark.parametrize("d", [384, 768])
def test_recall_on_anisotropic_vectors(d, monkeypatch):
    monkeypatch.setattr(itq, "STEPS", 5)
    rng = np.random.default_rng(7)
    spectrum = 1 / np.arange(1, d + 1)

    def draw(n):
        return rng.standard_normal((n, d)) * spectrum
    sample = draw(1500) + 0.5 * spectrum
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    codes = itq.learn(sample, 10 ** 6)
    left = draw(1000) + 0.5 * spectrum
    left /= np.linalg.norm(left, axis=1, keepdims=True)
    noise = draw(1000)
    noise -= (noise * left).sum(axis=1, keepdims=True) * left
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    right = itq.THRESHOLD * left + math.sqrt(1 - itq.THRESHOLD ** 2) * noise
    met = (codes.keys(left) == codes.keys(right)).any(axis=1)
    near = (codes.signs(left) != codes.signs(right)).sum(axis=1) <= codes.radius
    assert (met & near).mean() >= 0.9


def test_empty(spark):
    assert itq.near_duplicates(frame(spark, []).limit(0)).count() == 0
    assert itq.near_duplicates(frame(spark, [(1, None, None)])).first()["kept"]
