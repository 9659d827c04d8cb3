import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest

from sluice.llm import importance, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, longest=1):
    words = WORD.findall((text or "").translate(LOWER))
    return [" ".join(words[i:i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)], len(words)


def plain(docs, target, longest=1, buckets=10000, percent=10, least=20, seed="2024"):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, plain_features(text, longest)[0]))
    for text in target:
        t.update(map(bucket, plain_features(text, longest)[0]))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (big_s + buckets) / ((s[b] + 1.0) * (big_t + buckets))))
    rows = []
    for i, text in docs:
        f, n = plain_features(text, longest)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain(bucket(x)) for x in f)
        rows.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[4] = k + 1
    return sorted((r[:5] for r in rows), key=str)


def test_payloads_of_gaps_pieces_and_runs(monkeypatch):
    rng = random.Random(3)
    parts = ["the", "The", "né", "x1", "日本", "-", " ", "\n", "..", "a", "ba", "\x7f", "É", "zz" * 40]
    for piece in (1 << 20, 7, 30):
        monkeypatch.setattr(importance, "PIECE", piece)
        for known in ([], ["a", "the", "né"], ["a", "ba", "the", "né", "x1", "日本", "É"]):
            scanner = importance.Scanner([w.encode() for w in known])
            for _ in range(150):
                text = "".join(rng.choices(parts, k=rng.randint(0, 40)))
                n, found = scanner.features(text, 3, 997)
                want, words = plain_features(text, 3)
                assert n == words and found.tolist() == [zlib.crc32(f.encode()) % 997 for f in want]
            assert scanner.features(None, 2, 10)[1].tolist() == []


def test_shift_is_crc_of_joined_bytes():
    rng = random.Random(5)
    for _ in range(200):
        a, b = rng.randbytes(rng.randint(0, 9)), rng.randbytes(rng.choice([0, 1, 2, 63, 64, 1000, 70000]))
        got = importance.shifted(np.array([zlib.crc32(a)]), np.array([len(b)]))[0] ^ zlib.crc32(b)
        assert got == zlib.crc32(a + b)


@pytest.mark.parametrize("longest, words", [(1, None), (2, []), (3, [b"alpha", b"gamma"])])
def test_ranks_equal_plain(spark, longest, words):
    rng = random.Random(longest)
    vocabulary = ["alpha", "Beta", "gamma", "né", "42", "delta-x", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "..."), (None, " ".join(["alpha"] * 30)), (3, docs[3][1]), (600, "gamma " * 60000)]
    target = ["alpha beta alpha", None, "", "gamma né"]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, rank int, w int")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.ranked(d, t, longest=longest, least_words=10, words=words)
    assert sorted(([r["doc_id"], r["n_features"], r["weight"], r["score"], r["rank"]] for r in got.collect()), key=str) == \
        plain(docs, target, longest, least=10)
    if words is None:
        drawn = importance.resample(d, t, least_words=10)
        assert drawn.columns == d.columns
        assert sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in drawn.collect()) == \
            sorted(-1 if r[0] is None else r[0] for r in plain(docs, target, 1, least=10) if r[4])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.ranked(none, one).count() == 0 and importance.resample(none, one).count() == 0
    r = importance.ranked(one, none).first()
    assert (r["n_features"], r["rank"]) == (3, None)
    assert importance.ranked(one, none, least_words=1, percent=100).first()["rank"] == 1


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")
def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = con.execute(f"SELECT doc_id, n_features, weight, score, rank FROM ({queries.ORACLES['op11_importance_ahocorasick']}) q").fetchall()
    got = queries.QUERIES["op11_importance_ahocorasick"](spark, SF).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r[4] for r in want)
