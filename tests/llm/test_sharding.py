import random
import zlib

import pytest

from sluice.llm import sharding


def plain_capacity(sizes, shards):
    def need(c):
        k, at = 1, 0
        for x in sizes:
            if at + x > c:
                k, at = k + 1, 0
            at += x
        return k
    lo, hi = max(sizes), sum(sizes)
    while lo < hi:
        mid = (lo + hi) // 2
        lo, hi = (lo, mid) if need(mid) <= shards else (mid + 1, hi)
    return lo


@pytest.mark.parametrize("seed", range(6))
def test_cuts_are_minimax(spark, seed):
    rng = random.Random(seed)
    sizes = [int(rng.paretovariate(0.8) * 10) + 1 for _ in range(rng.randint(1, 300))]
    shards = rng.randint(1, 8)
    groups = spark.createDataFrame([(f"{i:06d}", s) for i, s in enumerate(sizes)], "digest string, size long")
    cuts = [int(c) for c in sharding.minimax_cuts(groups, shards, coarse=rng.randint(2, 9), fine=rng.randint(2, 5))]
    bounds = [0, *cuts, len(sizes)]
    assert len(cuts) < shards and cuts == sorted(set(cuts))
    assert max(sum(sizes[a:b]) for a, b in zip(bounds, bounds[1:])) == plain_capacity(sizes, shards)


def test_assignment(spark):
    rng = random.Random(9)
    texts = ["".join(rng.choices("abcé ", k=rng.randint(0, 80))) for _ in range(200)] + ["copy"] * 150 + [None, "", None, "z" * 100000]
    rows = [(i if i % 50 else None, t, "x", 5) for i, t in enumerate(texts)] + [(3, texts[3], "x", 5)] * 4
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, shard int")
    got = sharding.assign(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values()) and set(by) <= set(range(16))
    want = sorted((i is not None and i or -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in got) == \
        sorted((i if i is not None else -1, n, c) for i, n, c in want)
    assert all(len({r["shard"] for r in got if r["digest"] == d}) == 1 for d in {r["digest"] for r in got})
    sizes = {}
    for r in got:
        sizes[r["digest"]] = sizes.get(r["digest"], 0) + r["size"]
    held = {}
    for r in got:
        held[r["shard"]] = held.get(r["shard"], 0) + r["size"]
    assert max(held.values()) == plain_capacity([sizes[d] for d in sorted(sizes)], 16)


def test_empty_and_single(spark):
    docs = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert sharding.assign(docs.limit(0)).count() == 0
    r = sharding.assign(docs).first()
    assert (r["size"], r["text_crc32"], r["shard"], r["slot"]) == (1, 0, 0, 0)
