"""Stream sources (A13-A15) with the reference's Kafka record shape.

Spark's Kafka source yields ``key``/``value`` as binary; ``kafka_stream``
casts them to strings so the rows match the fixed stream schema. The Kafka
connector jar is optional: without it, ``kafka_stream`` raises on load and
the same downstream operators run on a file stream of the same shape."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.schema import STREAM_SCHEMA

KAFKA_COLUMNS = ["key", "value", "timestamp", "topic", "partition", "offset"]


class ConnectorMissing(RuntimeError):
    pass


def kafka_stream(spark: SparkSession, bootstrap: str, topic: str, group_id: str | None = None,
                 starting_offsets: str = "earliest", max_offsets_per_trigger: int | None = None,
                 min_partitions: int | None = None) -> DataFrame:
    """A13 + W5: subscribe from the earliest offset; progress is kept in the
    query checkpoint (replay-safe), the group id is passed through.
    ``min_partitions`` splits the offset range of a hot topic partition over
    several tasks (a topic partition is otherwise one task per batch)."""
    r = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap)
         .option("subscribe", topic).option("startingOffsets", starting_offsets))
    if group_id:
        r = r.option("kafka.group.id", group_id)
    if max_offsets_per_trigger:
        r = r.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    if min_partitions:
        r = r.option("minPartitions", min_partitions)
    try:
        df = r.load()
    except Exception as e:  # the connector jar is optional
        msg = str(e).lower()
        if "kafka" in msg and ("find data source" in msg or "not found" in msg or "data_source_not_found" in msg):
            raise ConnectorMissing("the Kafka connector (spark-sql-kafka) is not on the classpath; "
                                   "kafka_shaped_file_stream reads files of the same shape") from e
        raise
    return df.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"),
                     "timestamp", "topic", "partition", "offset")


def _text_format_options(r, fmt: str):
    """JSON/CSV files written by our sinks carry microsecond timestamps."""
    if fmt in ("json", "csv"):
        from ..sinks.tables import TS_OPTIONS
        r = r.options(**TS_OPTIONS)
    return r


def kafka_shaped_file_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None,
                             fmt: str = "parquet") -> DataFrame:
    """Files holding Kafka-shaped rows, read as a stream (test stand-in for
    a broker; same schema, same downstream plan)."""
    r = _text_format_options(spark.readStream.schema(STREAM_SCHEMA).format(fmt), fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def file_stream(spark: SparkSession, path: str, schema, fmt: str = "parquet",
                max_files_per_trigger: int | None = None) -> DataFrame:
    r = _text_format_options(spark.readStream.schema(schema).format(fmt), fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def text_line_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Every line of every file is one row ``value`` (a header line is an
    ordinary line, as in the reference's line format)."""
    r = spark.readStream.format("text")
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(path)


def socket_stream(spark: SparkSession, host: str, port: int) -> DataFrame:
    """Lines from a socket (connects only when a query starts)."""
    return spark.readStream.format("socket").option("host", host).option("port", port).load()
