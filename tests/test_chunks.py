"""Files above a row's bound as rows of bounded size."""
import gzip
import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from conftest import write
from sluice.functions import sha256
from sluice.operators import joins
from sluice.plans.ingest import Lake, ingest_sources
from sluice.sources import chunks, config, files, jsontext, quoted


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in names}

    def use(n):
        spark.conf.set(names[0], str(n))
        spark.conf.set(names[1], "0")
    yield use
    for k, v in before.items():
        spark.conf.set(k, v)


def _files(root):
    rng = random.Random(5)
    made = {"random.bin": rng.randbytes(5000), "zeros.bin": bytes(3000), "ends.bin": b"\n" * 700, "one": b"x", "returns.bin": b"a\r\nb\r" * 300,
            "mark.txt": b"\xef\xbb\xbf" + "é ü\n".encode() * 200, "mark no end.txt": b"\xef\xbb\xbfab\ncd", "exact.bin": b"y" * 511 + b"\n" + b"z" * 512,
            "no end 5%.bin": b"line\n" * 300 + b"rest", "long.bin": b"s\n" + b"q" * 4000 + b"\n" + b"t\n" * 50, "mark only.bin": b"\xef\xbb\xbf\n"}
    for name, data in made.items():
        write(f"{root}/{name}", data)
    return made


def _read(df):
    got, numbers = {}, {}
    for r in df.orderBy("path", "offset").collect():
        name = os.path.basename(r["path"])
        assert r["issue"] is None and r["offset"] == len(got.get(name, b"")) and r["content"], (name, r["issue"])
        got[name] = got.get(name, b"") + bytes(r["content"])
        numbers.setdefault(name, []).append((r["chunk"], len(r["content"])))
    return got, numbers


@pytest.mark.parametrize("split", [61, 500, 4096, 1 << 20])
@pytest.mark.parametrize("size", [100, 512])
def test_chunks_are_the_file_however_it_is_split(spark, tmp_path, small_splits, split, size):
    root = str(tmp_path / "in")
    made = _files(root)
    small_splits(split)
    got, numbers = _read(chunks.file_chunks(spark, root, chunk_bytes=size))
    assert got == made
    for name, data in made.items():  # fixed boundaries, whatever the splits
        assert numbers[name] == [(k, len(data[k * size:(k + 1) * size])) for k in range(-(-len(data) // size))]


@pytest.mark.parametrize("split", [61, 700, 1 << 20])
def test_chunks_of_whole_lines(spark, tmp_path, small_splits, split):
    root = str(tmp_path / "in")
    made = _files(root)
    small_splits(split)
    got, numbers = _read(chunks.file_chunks(spark, root, chunk_bytes=100, by_line=True))
    assert got == made
    for name, data in made.items():
        want, at = {}, 0
        for line in data.split(b"\n"):
            n = min(len(line) + 1, len(data) - at)
            if n:
                want[at // 100] = want.get(at // 100, 0) + n
            at += n
        assert numbers[name] == sorted(want.items())


def test_digests_and_files_that_cannot_be_cut(spark, tmp_path, small_splits):
    root = str(tmp_path / "in")
    data = random.Random(1).randbytes(900)
    write(f"{root}/a.bin", data)
    write(f"{root}/small.bin", b"12")
    write(f"{root}/empty.bin", b"")
    write(f"{root}/packed.gz", gzip.compress(b"x\n" * 4000))
    small_splits(100)
    found = chunks.file_chunks(spark, root, above=10, chunk_bytes=256)
    rows = {os.path.basename(r["path"]): r for r in chunks.chunk_digests(found).collect()}
    parts = "".join(hashlib.sha256(data[k:k + 256]).hexdigest() for k in range(0, 900, 256))
    assert (rows["a.bin"]["n_chunks"], rows["a.bin"]["digest"], rows["a.bin"]["complete"]) == (4, hashlib.sha256(parts.encode()).hexdigest(), True)
    assert set(rows) == {"a.bin", "packed.gz"} and not rows["packed.gz"]["complete"]
    assert [r["issue"] for r in found.filter("content IS NULL").collect()] == [files.TOO_LARGE]
    assert chunks.file_chunks(spark, root, above=10_000).count() == 0
    with pytest.raises(ValueError):
        chunks.file_chunks(spark, root, chunk_bytes=0)


def test_one_file_in_many_tasks(spark, tmp_path, small_splits):
    root = str(tmp_path / "in")
    write(f"{root}/a.bin", random.Random(2).randbytes(200_000))
    small_splits(8_000)
    pieces = chunks.file_chunks(spark, root, chunk_bytes=1000).filter("content IS NOT NULL")
    per_task = pieces.groupBy(F.spark_partition_id()).count().collect()
    counts = sorted(r["count"] for r in per_task)  # the chunks that cross splits (one a split) meet in a task of their own
    assert len(per_task) >= 20 and counts[-2] <= 9 and sum(counts) == 200


def test_stored_runs(spark, tmp_path):
    root = str(tmp_path / "d")
    text = "".join(f"wört {i}\n" for i in range(300))
    write(f"{root}/t/big.log", text)
    write(f"{root}/t/small.txt", "a b\n")
    write(f"{root}/t/none.txt", "")
    video = random.Random(3).randbytes(3000)
    write(f"{root}/v/a.mp4", video)
    write(f"{root}/v/b.mp4", b"123")
    write(f"{root}/o/a.dat", video)
    write(f"{root}/o/b.csv", "x,y\n1,2\n")
    how = {"rowBytes": 1000, "chunkBytes": 256}
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "t", "path": f"{root}/t", "worker": "text", "options": how},
                                           {"name": "v", "path": f"{root}/v", "worker": "video", "options": how},
                                           {"name": "o", "path": f"{root}/o", "options": how},
                                           {"name": "r", "path": f"{root}/v", "worker": "video", "options": how | {"largeFiles": "refuse"}}])
    got = {r["source_name"]: r for r in ingest_sources(spark, src, lake, gate="record").collect()}
    assert {n: (r["status"], r["record_count"], r["invalid_count"]) for n, r in got.items() if n != "o"} == {
        "t": ("stored", 3, 0), "v": ("stored", 2, 0), "r": ("partial", 2, 1)}
    rows = spark.read.parquet(got["t"]["lakehouse_path"]).filter("path LIKE '%big.log'").orderBy("_offset").collect()
    assert "".join(r["text"] for r in rows) == text and len(rows) > 10
    assert all(r["text"].endswith("\n") for r in rows)
    rows = spark.read.parquet(got["v"]["lakehouse_path"]).filter("path LIKE '%a.mp4'").orderBy("_offset").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == video and [r["_chunk"] for r in rows] == list(range(12))
    assert got["o"]["error"] is None
    rows = spark.read.parquet(got["o"]["staging_path"]).filter("_source_file LIKE '%.dat'").orderBy("_offset").collect()
    assert b"".join(bytes(r["content"]) for r in rows) == video


def test_split_tables_too_large_to_broadcast_keep_the_order(spark, tmp_path, small_splits, monkeypatch):
    root = str(tmp_path / "in")
    made = _files(root)
    write(f"{root}/c/a.csv", "a,b\n" + "".join(f'{i},"x\n{i}"\n' for i in range(200)))
    write(f"{root}/j/a.json", "".join('{"a":\n%d}\n' % i for i in range(200)))
    small_splits(97)
    monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got, _ = _read(chunks.file_chunks(spark, root, chunk_bytes=100, glob="*.[bt][ix][nt]"))
        assert got == {n: d for n, d in made.items() if n != "one"}
        rows = quoted.read_quoted_csv(spark, f"{root}/c", ["a", "b"], ",", "*.csv", lambda d: d).collect()
        assert sorted((int(r["a"]), r["b"]) for r in rows) == [(i, f"x\n{i}") for i in range(200)]
        values = jsontext.json_documents(spark, f"{root}/j").select(F.col("v").cast("string").alias("v")).collect()
        assert sorted(r["v"] for r in values) == sorted('{"a":%d}' % i for i in range(200))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("split", [61, 700, 1 << 20])
def test_digests_of_whole_files_go_from_task_to_task(spark, tmp_path, small_splits, monkeypatch, split):
    root = str(tmp_path / "in")
    made = _files(root)
    made |= {"a [b]{c}.gz": gzip.compress(random.Random(4).randbytes(900)), "two.bin": bytes(random.Random(6).choices(range(40), k=2500))}
    for name in ("a [b]{c}.gz", "two.bin"):
        write(f"{root}/{name}", made[name])
    small_splits(split)
    alone, read = [], chunks.read_binary
    monkeypatch.setattr(chunks, "read_binary", lambda s, paths, **k: alone.extend(paths) or read(s, paths, **k))
    rows = chunks.file_digests(spark, root, above=600, chunk_bytes=100).collect()
    assert {os.path.basename(r["path"]): (r["size_bytes"], r["digest"]) for r in rows} == {
        n: (len(d), hashlib.sha256(d).hexdigest()) for n, d in made.items() if len(d) > 600}
    assert len(rows) == sum(len(d) > 600 for d in made.values())
    # packed, or no line end in 600 bytes
    assert {os.path.basename(p).replace("\\", "") for p in alone} == {
        n for n, d in made.items() if len(d) > 600 and (n.endswith(".gz") or max(map(len, d.split(b"\n"))) >= 600)}
    assert not {"two.bin", "mark.txt", "no end 5%.bin", "exact.bin"} & {os.path.basename(p) for p in alone}
    assert chunks.file_digests(spark, root, above=10_000).count() == 0


def test_no_task_digests_a_large_file_alone(spark, tmp_path, small_splits, monkeypatch):
    root = str(tmp_path / "in")
    data = random.Random(7).randbytes(200_000)
    write(f"{root}/a.bin", data)
    write(f"{root}/b.bin", b"12")
    small_splits(8_000)
    monkeypatch.setattr(chunks, "DIGEST_BYTES", 10_000)
    told, link = [], chunks._link
    monkeypatch.setattr(chunks, "_link", lambda states: told.append(len(states)) or link(states))
    rows = {os.path.basename(r["path"]): (r["length"], r["content_sha256"]) for r in queries()["binary_scan"](spark, root).collect()}
    assert rows == {"a.bin": (200_000, hashlib.sha256(data).hexdigest()), "b.bin": (2, hashlib.sha256(b"12").hexdigest())}
    assert told == [1] * 25  # a job a split


def test_a_digest_goes_on_from_a_state():
    data = random.Random(8).randbytes(1000)
    for cut in (0, 1, 63, 64, 65, 640, 1000):
        state = sha256.Sha256().update(data[:cut]).state()
        assert sha256.Sha256(state).update(data[cut:]).hexdigest() == hashlib.sha256(data).hexdigest()


def test_without_openssl_a_file_is_read_by_one_task(spark, tmp_path, small_splits, monkeypatch):
    root = str(tmp_path / "in")
    write(f"{root}/a.bin", b"xy\n" * 900)
    small_splits(500)
    told = chunks._told
    monkeypatch.setattr(chunks, "_told", lambda index, rows: ((*r[:5], False) for r in told(index, rows)))
    assert [r["digest"] for r in chunks.file_digests(spark, root, above=600).collect()] == [hashlib.sha256(b"xy\n" * 900).hexdigest()]
