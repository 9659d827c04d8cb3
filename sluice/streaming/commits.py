"""Commit records of gated streams (W7, K5): which run owns which micro-batch.

A run of a stream writes its batches to its own folder,
``streams/<name>/_run=<run>/_row_state=<side>/_query=<query>/_batch=<batch>``, and after each batch one
commit record. The query id tells apart the batches of a new checkpoint, which count from 0 again.
A record names the folder the rows lie in (``written_by``) and the run that answers for them
(``run_id``); of several records for one batch the one of the latest run holds:

* a batch replayed after a lost commit belongs to the run that replayed it, the earlier copy to none;
* batches of a run that ended without a verdict (its driver was lost, or a later batch failed) are adopted by
  the next run of the source, which adds a record and judges them with its own.

A snapshot joins the rows with the records of accepted runs on partition columns alone, so a run
exposes exactly its batches, and files without a record (a write cut off, a refused run) are never read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.joins import join_small
from ..sources import files

SECTION = "stream_commits"
SCHEMA = ("source_name string, query_id string, batch_id bigint, run_id string, written_by string, records bigint, "
          "invalid bigint, dead_letters bigint, committed_at timestamp")
#: Verdicts that settle a run's batches; a run without one leaves them to the next.
SETTLED = ("stored", "partial", "quarantined", "empty")
#: Columns of a stored stream row that are no data.
TECHNICAL = ("_run", "_row_state", "_query", "_batch", "_key", "_dead_letter", "_reasons")


def root_of(lake, source_name: str) -> str:
    return f"{lake.root}/streams/{source_name}"


def commit(spark: SparkSession, lake, source_name: str, run_id: str, query_id: str, batch_id: int, counts: dict) -> None:
    """Record one written batch (one row). A replay in the same run overwrites its own record."""
    row = spark.createDataFrame([(source_name, query_id, batch_id, run_id, run_id, counts["records"], counts["invalid"],
                                  counts["dead_letters"])], SCHEMA.rsplit(",", 1)[0]) \
        .withColumn("committed_at", F.current_timestamp())
    lake.write_leaf(row.coalesce(1), SECTION, f"{run_id}-{query_id}-{batch_id}", source_name)


def current(spark: SparkSession, lake, source_name: str | None = None) -> DataFrame:
    """The record that holds for each batch (one row a batch)."""
    found = lake.read_section(spark, SECTION)
    if found is None:
        return spark.createDataFrame([], SCHEMA)
    found = found.select(*[c.split()[0] for c in SCHEMA.split(", ")])
    if source_name is not None:
        found = found.filter(F.col("source_name") == source_name)
    rest = [c for c in found.columns if c not in ("source_name", "query_id", "batch_id")]
    return found.groupBy("source_name", "query_id", "batch_id") \
        .agg(F.max_by(F.struct(*rest), "run_id").alias("_c")).select("source_name", "query_id", "batch_id", "_c.*")


def adopt(spark: SparkSession, lake, source_name: str, run_id: str) -> None:
    """Give the batches of runs without a verdict to this run."""
    runs = lake.read_section(spark, "runs")
    left = current(spark, lake, source_name)
    if runs is not None:
        settled = runs.filter((F.col("source_name") == source_name) & F.col("status").isin(*SETTLED)).select("run_id")
        left = left.join(settled, "run_id", "left_anti")
    left = left.select(*[c.split()[0] for c in SCHEMA.split(", ")]).withColumn("run_id", F.lit(run_id))
    if not left.isEmpty():
        lake.write_leaf(left.coalesce(1), SECTION, f"{run_id}-adopted", source_name)


def totals(spark: SparkSession, lake, source_name: str, run_id: str) -> dict:
    """Counts over the batches that a run owns."""
    r = current(spark, lake, source_name).filter(F.col("run_id") == run_id).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("records", "invalid", "dead_letters")]).first()
    return r.asDict()


def accepted(spark: SparkSession, lake, source_name: str, also: str | None = None) -> DataFrame:
    """Records of the batches of stored or partly stored runs (and of the run ``also``, which is still at work)."""
    records = current(spark, lake, source_name)
    runs = lake.read_section(spark, "runs")
    ids = spark.createDataFrame([(also,)] if also else [], "run_id string")
    if runs is not None:
        ids = ids.unionByName(runs.filter((F.col("source_name") == source_name) & F.col("lakehouse_path").isNotNull()).select("run_id"))
    return records.join(ids.distinct(), "run_id", "left_semi")


def stored_rows(spark: SparkSession, lake, source_name: str) -> DataFrame | None:
    """Every row under the source's folder, committed or not, with its
    partition columns as text (an id that looks like a number stays as it is)."""
    root = root_of(lake, source_name)
    if not files.path_exists(spark, root):
        return None
    read = spark.read.format(lake.fmt)
    found = read.load(root).schema
    text = T.StructType([T.StructField(f.name, T.StringType()) if f.name in ("_run", "_query", "_batch") else f for f in found.fields])
    return spark.read.format(lake.fmt).schema(text).load(root)


def rows_of(spark: SparkSession, lake, source_name: str, records: DataFrame, side: str = "curated") -> DataFrame:
    """Rows of one side that ``records`` name. The join is on partition
    columns; the records (one a batch) are broadcast where they are measured small, and
    other folders are then pruned before they are read."""
    rows = stored_rows(spark, lake, source_name)
    if rows is None:
        raise LookupError(f"no stored batch of {source_name!r}")
    names = records.select(F.col("written_by").alias("_run"), F.col("query_id").alias("_query"),
                           F.col("batch_id").cast("string").alias("_batch"))
    return join_small(rows.filter(F.col("_row_state") == side), names, ["_run", "_query", "_batch"], "left_semi")


def snapshot(spark: SparkSession, lake, source_name: str, up_to_run: str | None = None, only_run: str | None = None) -> DataFrame:
    """Data rows of the accepted runs of a stream: all of them, those up to a
    run, or one run's own (none if it was refused)."""
    records = accepted(spark, lake, source_name)
    if up_to_run is not None:
        records = records.filter(F.col("run_id") <= up_to_run)
    if only_run is not None:
        records = records.filter(F.col("run_id") == only_run)
    return rows_of(spark, lake, source_name, records).drop(*TECHNICAL)


def seen_keys(spark: SparkSession, lake, source_name: str, run_id: str, query_id: str, batch_id: int,
              within: str | None = None) -> DataFrame | None:
    """``_key`` of the curated rows of all earlier batches: those of accepted
    runs and of this one, without this batch's own earlier copy. ``within`` (an interval such as
    ``7 days``) forgets batches committed before. Only the key column of the files is read."""
    records = accepted(spark, lake, source_name, also=run_id) \
        .filter((F.col("query_id") != query_id) | (F.col("batch_id") != batch_id))
    if within:
        records = records.filter(F.col("committed_at") >= F.current_timestamp() - F.expr(f"INTERVAL {within}"))
    if records.isEmpty():
        return None
    return rows_of(spark, lake, source_name, records).select("_key").filter(F.col("_key").isNotNull())
