import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from sluice.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
PARTS = ["a", "b", " ", "  ", "\n", "'", "'r", "e", "'ll", "é", "ñ", "日本", "👩‍👩", "1", "22", "$", "###", "\t", "the ", "aaaa",
         "th", "ing", "\r\n", " ", "x"]


@pytest.fixture(scope="module")
def ranks():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def exact(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_tree_equals_library(ranks, exact):
    rng, codec = random.Random(1), bpe.Codec(ranks, P.PATTERN)
    for _ in range(4000):
        text = "".join(rng.choices(PARTS, k=rng.randint(0, 50)))
        leaf = rng.choice([1, 2, 3, 5, 9, 17, 64])
        ids = codec.encode(text, leaf)
        assert list(ids) == exact.encode_ordinary(text), (text, leaf)
        assert codec.decode(ids, 3) == text.encode()


def test_piece_tree_joins_tokens(ranks, exact, monkeypatch):
    monkeypatch.setattr(bpe, "LEAF_BYTES", 2)
    rng, codec = random.Random(2), bpe.Codec(ranks, P.PATTERN)
    for _ in range(3000):
        word = "".join(rng.choices(["a", "b", "e", "th", "in", "é", "aaaa", "日", "ab", "ing"], k=rng.randint(0, 30)))
        assert list(codec.encode(word)) == exact.encode_ordinary(word)


@pytest.mark.parametrize("text", ["a" * 20000, "ab" * 9000, "=" * 15001, " " * 9000 + "x", "\n" * 9000, "日" * 5000])
def test_long_runs(ranks, exact, text):
    codec = bpe.Codec(ranks, P.PATTERN)
    ids = codec.encode(text)
    assert list(ids) == exact.encode_ordinary(text)
    assert codec.decode(ids) == text.encode()


def test_digests(spark, exact):
    texts = [None, "", "Hello world", "Hello world", "word " * 30000, "x" * 70000]
    docs = spark.createDataFrame([(i, t, "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string, _text int")
    got = {r["doc_id"]: r for r in bpe.digests(docs, PATH, P.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = exact.encode_ordinary(t or "")
        raw = b"".join(x.to_bytes(4, "little") for x in ids)
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == \
            (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_round_trip_columns(spark):
    docs = spark.createDataFrame([("Ünï code 1",), ("",), (None,)], "text string")
    ids = docs.select("text", bpe.encode_column(docs["text"], PATH, P.PATTERN).alias("ids"))
    rows = ids.select("text", bpe.decode_column(ids["ids"], PATH, P.PATTERN).alias("b")).collect()
    assert [bytes(r["b"]).decode() for r in rows] == [r["text"] or "" for r in rows]
