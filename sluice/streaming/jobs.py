"""Streaming operators and sinks.

All queries keep their progress in a checkpoint folder under the shared
scratch area, so a restarted or replayed query neither loses nor repeats
rows. The ``foreachBatch`` writer replaces its own ``_batch=<id>`` folders: a
batch replayed after a failure rewrites exactly its own output (idempotent)."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import codec
from ..operators import quality
from ..operators.joins import released


def with_watermark(df: DataFrame, ts: str, delay: str = "0 seconds") -> DataFrame:
    """Event-time watermark for rising timestamps. ``timestamp_ntz``
    columns are cast to ``timestamp`` first (watermarks need it). A
    stateless append drops no row; W2 is simply not calling this."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def _trigger(writer, available_now: bool, processing_time: str | None):
    if processing_time:
        return writer.trigger(processingTime=processing_time)
    if available_now:
        return writer.trigger(availableNow=True)
    return writer


def append_stream(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                  available_now: bool = True, processing_time: str | None = None, wait: bool = True):
    """S5 + W4: append every row to a table; ``availableNow`` drains what is
    there (honouring ``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``, W3)
    and stops."""
    w = df.writeStream.format(fmt).outputMode("append").option("checkpointLocation", checkpoint)
    q = _trigger(w, available_now, processing_time).start(path)
    if wait and (available_now or processing_time is None):
        q.awaitTermination()
    return q


def text_file_sink(df: DataFrame, path: str, checkpoint: str, column: str = "value", fmt: str = "text",
                   available_now: bool = True, wait: bool = True):
    """Row-format file sink (one line per row). Spark names the part
    files; the reference's file prefix becomes the folder."""
    w = (df.select(F.col(column).cast("string").alias("value")).writeStream.format(fmt)
         .outputMode("append").option("checkpointLocation", checkpoint))
    q = _trigger(w, available_now, None).start(path)
    if wait:
        q.awaitTermination()
    return q


def message_rows(df: DataFrame, fields, key_col: str | None = None) -> DataFrame:
    """S7 payload: ``key, value`` rows with the ``k:v`` message (G1)."""
    return df.select((F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")).alias("key"),
                     codec.kv_encode(*fields).alias("value"))


def publish_messages(df: DataFrame, bootstrap: str, topic: str, fields, key_col: str | None = None):
    """Rows -> ``k:v`` messages -> a Kafka topic (connector required). A
    failed send fails the task (and is retried) instead of a per-row callback."""
    (message_rows(df, fields, key_col).write.format("kafka")
     .option("kafka.bootstrap.servers", bootstrap).option("topic", topic).save())


def decode_batch(batch: DataFrame, value_col: str = "value") -> DataFrame:
    """W6 decode step: adds ``_msg`` (decoded struct) and ``_ok``."""
    d = codec.decode_messages(batch, value_col, "_msg")
    return d.withColumn("_ok", F.col("_msg.ok"))


SIDES = ("curated", "quarantine", "dead_letter")


def batch_writer(root: str, project, rules=(), unique=None, fmt: str = "parquet", stats: dict | None = None,
                 value_col: str = "value", seen=None, committed=None):
    """A ``foreachBatch`` function that decodes, gates and stores a
    micro-batch in ONE write, partitioned by side, query and batch:
    ``<root>/_row_state=<side>/_query=<id>/_batch=<id>`` (batch ids count from 0 again
    under a new checkpoint; its query id is another). Messages that do not decode are
    dead letters (W6) and keep their own columns in ``_dead_letter``; decoded
    rows have the columns of ``project(decoded_df)`` and go to ``curated`` or, by
    ``rules`` (in ``_reasons``), to ``quarantine`` (D6). The write replaces its
    own batch's folders only, so a replay is exact.

    ``unique`` (columns or field accesses such as ``fields['id']``) rejects decoded rows
    whose key occurs more than once in the batch or is in ``seen(query_id, batch_id)``, a frame of
    ``_key`` digests of earlier batches; a key with a null part never collides. The batch's
    keys are aggregated before they meet the earlier ones, so a hot key is one row there.
    ``committed(query_id, batch_id, counts)`` is called after the write. ``stats`` (a driver-side
    dict) accumulates records / invalid / dead letter counts and one line per
    batch, observed in the write."""
    def run(batch: DataFrame, batch_id: int):
        with released():
            write(batch, batch_id)

    def write(batch: DataFrame, batch_id: int):
        began = time.time()
        query_id = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or "none"
        d = decode_batch(batch, value_col)
        ok = F.coalesce(F.col("_ok"), F.lit(False))
        whole = F.when(~ok, F.struct(*[F.col(c) for c in batch.columns]))
        rows = d.select(*project(d), ok.alias("_ok"), whole.alias("_dead_letter"))
        # only decoded rows are tested, also for uniqueness: dead letters have no fields
        tested = [(n, F.col("_ok") & v) for n, v in rules]
        key = F.when(F.col("_ok"), quality.key_digest(unique)) if unique else F.lit(None).cast("binary")
        earlier = seen(query_id, batch_id) if unique and seen is not None else None
        tagged = quality.apply_rules(rows.withColumn("_key", key), tested, unique=["_key"] if unique else None,
                                     unique_name=f"unique:{','.join(unique or [])}", seen=earlier)
        side = F.when(~F.col("_ok"), F.lit("dead_letter")).when(F.size(quality.REASONS) == 0, F.lit("curated")) \
            .otherwise(F.lit("quarantine"))
        tagged = tagged.withColumn("_row_state", side).withColumn("_query", F.lit(query_id)) \
            .withColumn("_batch", F.lit(batch_id)).drop("_ok")
        obs = Observation(f"batch_{batch_id}_{uuid.uuid4().hex[:8]}")
        tagged = tagged.observe(obs, *[F.count_if(F.col("_row_state") == s).alias(s) for s in SIDES])
        tagged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").format(fmt) \
            .partitionBy("_row_state", "_query", "_batch").save(root)
        n = {s: int(obs.get[s]) for s in SIDES}
        counts = {"records": sum(n.values()), "invalid": n["quarantine"], "dead_letters": n["dead_letter"]}
        if committed is not None:
            committed(query_id, batch_id, counts)
        if stats is not None:
            for k, v in counts.items():
                stats[k] = stats.get(k, 0) + v
            stats["batches"] = stats.get("batches", 0) + 1
            stats.setdefault("progress", []).append((batch_id, counts["records"], time.time() - began))
    return run


def read_side(spark, root: str, side: str, fmt: str = "parquet") -> DataFrame:
    """Rows of one side of a gated stream, without the columns of the others."""
    df = spark.read.format(fmt).load(root).filter(F.col("_row_state") == side)
    if side == "dead_letter":
        return df.select("_dead_letter.*", "_batch")
    return df.drop("_dead_letter", "_row_state", "_query", "_key", *(["_reasons"] if side == "curated" else []))


def generic_projection(d: DataFrame) -> list:
    """Decoded messages of unknown keys: the stream's own columns, the
    fields as a map and the typed JSON document (what the reference wrote)."""
    meta = [F.col(c) for c in d.columns if c not in ("_msg", "_ok")]
    return [*meta, F.col("_msg.fields").alias("fields"), codec.kv_to_json(F.col("_msg")).alias("json")]


def foreach_batch_stream(df: DataFrame, fn, checkpoint: str, available_now: bool = True,
                         processing_time: str | None = None, wait: bool = True):
    w = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint)
    q = _trigger(w, available_now, processing_time).start()
    if wait and (available_now or processing_time is None):
        q.awaitTermination()
    return q
