"""Structured Streaming (F-STREAM): throttling, restart, replay, dead letters."""

import glob
import os

from pyspark.sql import functions as F

from sluice.functions import codec
from sluice.operators import quality
from sluice.streaming import jobs
from sluice.streaming import sources as ssrc

SCHEMA = "id bigint, ts timestamp, v double"


def _files(spark, path, n_files=4, rows=400):
    df = spark.range(rows).select(F.col("id"), F.timestamp_seconds(F.col("id") * 60).alias("ts"),
                                  (F.col("id") % 97).cast("double").alias("v"))
    df.repartitionByRange(n_files, "id").write.parquet(path)


def test_throttled_batches(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _files(spark, src)
    s = ssrc.file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    q = jobs.append_stream(s, out + "/t", out + "/ck")
    batches = [p for p in q.recentProgress if p["numInputRows"] > 0]
    assert len(batches) == 4                                  # one file per micro-batch (W3)
    from sluice.operators.profile import stream_progress_row
    row = stream_progress_row(batches[-1])                    # P4 from the query's own progress
    assert row["num_input_rows"] == 100 and row["batch_id"] is not None
    assert spark.read.parquet(out + "/t").count() == 400


def test_watermark_keeps_rows(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _files(spark, src)
    s = jobs.with_watermark(ssrc.file_stream(spark, src, SCHEMA, max_files_per_trigger=1), "ts")
    jobs.append_stream(s, out + "/t", out + "/ck")
    assert spark.read.parquet(out + "/t").count() == 400


def test_restart_and_batch_replay_are_exact(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    _files(spark, src, n_files=2, rows=200)
    s = ssrc.file_stream(spark, src, SCHEMA, max_files_per_trigger=1)
    fn = jobs.batch_writer(out + "/rows", lambda d: [F.col("offset"), codec.kv_get("_msg", "id", "int").alias("id"),
                                                     codec.kv_get("_msg", "v", "float").alias("v")], rules=[])
    enc = s.select(codec.kv_encode("id", "v").alias("value"), F.col("id").alias("offset"))
    jobs.foreach_batch_stream(enc, fn, out + "/ck")
    assert jobs.read_side(spark, out + "/rows", "curated").count() == 200
    # lose the last commit: the batch is replayed into the same _batch folder
    commits = sorted(glob.glob(out + "/ck/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    last = commits[-1]
    os.remove(last)                       # simulate a crash between the sink write and the commit
    crc = os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")
    if os.path.exists(crc):
        os.remove(crc)
    jobs.foreach_batch_stream(enc, fn, out + "/ck")
    assert jobs.read_side(spark, out + "/rows", "curated").count() == 200


def test_dead_letters(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    rows = [("k", "a:1,b:2.5", 1), ("k", "broken", 2), ("k", "a:5,b:x", 3)]
    spark.createDataFrame([(k, v, None, "t", 0, o) for k, v, o in rows],
                          "key string, value string, timestamp timestamp, topic string, partition int, offset bigint"
                          ).write.parquet(src)
    s = ssrc.kafka_shaped_file_stream(spark, src)
    proj = lambda d: [F.col("offset"), codec.kv_get("_msg", "a", "int").alias("a"),
                      codec.kv_get("_msg", "b", "float").alias("b")]
    fn = jobs.batch_writer(out + "/rows", proj, rules=[quality.not_null("b")])
    jobs.foreach_batch_stream(s, fn, out + "/ck")
    assert [r["value"] for r in jobs.read_side(spark, out + "/rows", "dead_letter").collect()] == ["broken"]
    assert [r["offset"] for r in jobs.read_side(spark, out + "/rows", "curated").collect()] == [1]
    assert [r["offset"] for r in jobs.read_side(spark, out + "/rows", "quarantine").collect()] == [3]


def test_text_lines_and_sink(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    os.makedirs(src)
    with open(src + "/a.csv", "w") as f:
        f.write("h1,h2\n1,2\n3,4\n")
    s = ssrc.text_line_stream(spark, src)
    jobs.text_file_sink(s, out + "/lines", out + "/ck")
    assert sorted(r[0] for r in spark.read.text(out + "/lines").collect()) == ["1,2", "3,4", "h1,h2"]


def test_socket_source_schema_without_connecting(spark):
    s = ssrc.socket_stream(spark, "localhost", 9)
    assert s.isStreaming and s.dtypes == [("value", "string")]


def test_kafka_source_without_connector_is_reported(spark):
    import pytest
    try:
        df = ssrc.kafka_stream(spark, "localhost:9092", "t")
    except ssrc.ConnectorMissing:
        return
    assert df.isStreaming and df.columns == ssrc.KAFKA_COLUMNS        # connector present
    pytest.skip("connector present")


def test_json_kafka_shaped_stream_keeps_microseconds(spark, tmp_path):
    import datetime as dt

    from sluice.sinks import tables
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    ts = dt.datetime(2024, 1, 1, 0, 0, 7, 179575)
    rows = spark.createDataFrame([("k", "a:1", ts, "t", 0, 1)],
                                 "key string, value string, timestamp timestamp, topic string, partition int, offset bigint")
    tables.write_json(rows, src)
    s = ssrc.kafka_shaped_file_stream(spark, src, fmt="json")
    jobs.append_stream(s, out + "/t", out + "/ck")
    got = spark.read.parquet(out + "/t").first()
    assert got["timestamp"] == ts and got["value"] == "a:1"
