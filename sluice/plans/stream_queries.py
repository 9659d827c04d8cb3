"""Structured Streaming query keys.

Events are written to a scratch folder as several files (the arrival
order follows event time), read back as a stream, processed with
``availableNow`` triggers and checkpoints, and the sink tables are returned.
Every row of ``events`` flows through each stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import quality
from ..session import scratch_path
from ..streaming import jobs
from ..streaming import sources as ssrc
from . import derive
from .queries import EVENT_MESSAGE_SQL, TS_FMT_SPARK, TS_FMT_SQL, event_message, query

table = derive.table
MIN_FILES = 4
N_BATCHES = 4
EVENT_COLS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def n_files_for(df: DataFrame) -> int:
    """As many files as the input has scan partitions (so file size stays at
    the scan split size at any scale), and at least MIN_FILES so small inputs
    still arrive in several files."""
    try:
        n = df.rdd.getNumPartitions()          # planning only, no job
    except Exception:  # pragma: no cover - no RDD API (Spark Connect)
        n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(MIN_FILES, n)


def per_trigger(n_files: int, batches: int = N_BATCHES) -> int:
    """Files per micro-batch for a fixed number of batches: throttling that
    does not turn into one batch per file at 1000x the data."""
    return max(1, -(-n_files // batches))


def _spread(df: DataFrame, path: str, order: str) -> int:
    """Write ``df`` as files range-partitioned on ``order`` (arrival order)."""
    n = n_files_for(df)
    df.repartitionByRange(n, order).write.parquet(path)
    return n


def _event_files(spark: SparkSession, sf: str) -> tuple:
    """Events as parquet files, range-partitioned on event time."""
    src = scratch_path(spark, "events-src")
    n = _spread(table(spark, sf, "events"), src, "ts")
    return src, n


def _read_sink(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@query("stream_append", "SELECT event_id, user_id, event_type, value FROM events")
def q_stream_append(spark, sf):
    """A file stream appended to a table (S5, W2 no watermark, W4 drain)."""
    (src, _), out = _event_files(spark, sf), scratch_path(spark, "stream-append")
    s = ssrc.file_stream(spark, src, EVENT_COLS)
    jobs.append_stream(s.select("event_id", "user_id", "event_type", "value"), out + "/table", out + "/_ckpt")
    return _read_sink(spark, out + "/table")


@query("stream_watermark", f"""
SELECT event_id, event_type, value, strftime(ts, '{TS_FMT_SQL}') AS ts_text FROM events
""")
def q_stream_watermark(spark, sf):
    """A zero-delay watermark on rising event time keeps every row of a
    stateless append."""
    (src, _), out = _event_files(spark, sf), scratch_path(spark, "stream-wm")
    s = jobs.with_watermark(ssrc.file_stream(spark, src, EVENT_COLS), "ts")
    s = s.select("event_id", "event_type", "value", F.date_format("ts", TS_FMT_SPARK).alias("ts_text"))
    jobs.append_stream(s, out + "/table", out + "/_ckpt")
    return _read_sink(spark, out + "/table")


@query("stream_throttled", "SELECT event_id, value FROM events")
def q_stream_throttled(spark, sf):
    """A bounded number of files per micro-batch (``maxFilesPerTrigger``)
    instead of a sleep; ``availableNow`` still drains all files, batch by
    batch."""
    (src, n), out = _event_files(spark, sf), scratch_path(spark, "stream-throttle")
    s = ssrc.file_stream(spark, src, EVENT_COLS, max_files_per_trigger=per_trigger(n))
    jobs.append_stream(s.select("event_id", "value"), out + "/table", out + "/_ckpt")
    return _read_sink(spark, out + "/table")


@query("stream_restart", "SELECT event_id, event_type FROM events")
def q_stream_restart(spark, sf):
    """The earlier half of the events arrives, the query runs and stops;
    the later half arrives and the query restarts from its checkpoint. The
    sink holds every row exactly once."""
    src, out = scratch_path(spark, "events-src"), scratch_path(spark, "stream-restart")
    ev = table(spark, sf, "events")
    # the middle of the event-time range: one aggregate value
    lo, hi = ev.agg(F.min("ts"), F.max("ts")).first()
    mid = lo + (hi - lo) / 2
    ev.filter(F.col("ts") <= F.lit(mid)).write.mode("append").parquet(src)

    def run():
        s = ssrc.file_stream(spark, src, EVENT_COLS).select("event_id", "event_type")
        jobs.append_stream(s, out + "/table", out + "/_ckpt")
    run()
    ev.filter(F.col("ts") > F.lit(mid)).write.mode("append").parquet(src)
    run()
    return _read_sink(spark, out + "/table")


def _kafka_rows(ev: DataFrame, damaged=None) -> DataFrame:
    """Events as Kafka-shaped rows: key user, value = ``k:v`` message,
    topic ``events``, partition by user, offset = event id. ``damaged`` marks
    rows whose producer broke the separator (dead letters downstream)."""
    j = event_message(ev, "user_id", "ts", "event_type")
    value = F.col("message")
    if damaged is not None:
        value = F.when(damaged, F.regexp_replace(value, "user_id:", "user_id=")).otherwise(value)
    return j.select(F.col("user_id").cast("string").alias("key"), value.alias("value"),
                    F.col("ts").cast("timestamp").alias("timestamp"), F.lit("events").alias("topic"),
                    (F.col("user_id") % 4).cast("int").alias("partition"), F.col("event_id").alias("offset"))


def _kafka_files(spark, sf, damaged=None) -> tuple:
    src = scratch_path(spark, "kafka-src")
    n = _spread(_kafka_rows(table(spark, sf, "events"), damaged), src, "offset")
    return src, n


@query("stream_kafka_shape", """
SELECT CAST(user_id AS VARCHAR) AS key, 'events' AS topic, CAST(user_id % 4 AS BIGINT) AS kafka_partition,
       event_id AS kafka_offset, event_id, event_type, CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS value
FROM events
""")
def q_stream_kafka_shape(spark, sf):
    """A13 + C3 + G2: Kafka-shaped records (fixed stream schema) decoded in
    the stream."""
    (src, _), out = _kafka_files(spark, sf), scratch_path(spark, "stream-kafka")
    s = ssrc.kafka_shaped_file_stream(spark, src)
    d = codec.decode_messages(s, "value", "_m")
    d = d.select("key", "topic", F.col("partition").cast("bigint").alias("kafka_partition"),
                 F.col("offset").alias("kafka_offset"),
                 codec.kv_get("_m", "event_id", "int").alias("event_id"),
                 codec.kv_get("_m", "event_type").alias("event_type"),
                 codec.kv_get("_m", "value", "float").alias("value"))
    jobs.append_stream(d, out + "/table", out + "/_ckpt")
    return _read_sink(spark, out + "/table")


@query("stream_text_lines", f"SELECT {EVENT_MESSAGE_SQL} AS message FROM events")
def q_stream_text_lines(spark, sf):
    """A14 + S6: text-line files streamed line by line into a row-format
    text sink."""
    src, out = scratch_path(spark, "lines-src"), scratch_path(spark, "stream-lines")
    msgs = event_message(table(spark, sf, "events")).select("message")
    n = n_files_for(msgs)
    msgs.repartition(n).write.text(src)
    s = ssrc.text_line_stream(spark, src, max_files_per_trigger=per_trigger(n))
    jobs.text_file_sink(s, out + "/lines", out + "/_ckpt")
    return spark.read.text(out + "/lines").select(F.col("value").alias("message"))


DAMAGED_SQL = "event_type = 'error'"


def _damaged():
    return F.col("event_type") == "error"


def _decoded_projection(d: DataFrame) -> list:
    return [F.col("offset").alias("kafka_offset"),
            codec.kv_get("_msg", "event_id", "int").alias("event_id"),
            codec.kv_get("_msg", "value", "float").alias("value")]


def _gated_stream(spark, sf) -> str:
    (src, n), out = _kafka_files(spark, sf, damaged=_damaged()), scratch_path(spark, "stream-gate")
    s = ssrc.kafka_shaped_file_stream(spark, src, max_files_per_trigger=per_trigger(n))
    fn = jobs.batch_writer(out + "/rows", _decoded_projection, rules=[quality.in_range("value", hi=400)])
    jobs.foreach_batch_stream(s, fn, out + "/_ckpt")
    return out + "/rows"


@query("stream_dead_letter", f"""
SELECT event_id AS kafka_offset, replace({EVENT_MESSAGE_SQL}, 'user_id:', 'user_id=') AS raw
FROM events WHERE {DAMAGED_SQL}
""")
def q_stream_dead_letter(spark, sf):
    """Undecodable messages are kept whole in a dead-letter table."""
    out = _gated_stream(spark, sf)
    dl = jobs.read_side(spark, out, "dead_letter")
    return dl.select(F.col("offset").alias("kafka_offset"), F.col("value").alias("raw"))


@query("stream_gate", f"""
SELECT CASE WHEN {DAMAGED_SQL} THEN 'dead_letter'
            WHEN CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) > 400 THEN 'quarantine'
            ELSE 'curated' END AS side,
       event_id AS kafka_offset
FROM events
""")
def q_stream_gate(spark, sf):
    """Stage -> validate -> store / quarantine per micro-batch, plus the
    dead letters, all keyed by batch id."""
    rows = spark.read.parquet(_gated_stream(spark, sf))
    return rows.select(F.col("_row_state").alias("side"), F.coalesce("kafka_offset", "_dead_letter.offset").alias("kafka_offset"))
