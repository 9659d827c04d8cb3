"""Sinks (S1-S4, S8, S9).

Parquet has no transactions, so full-refresh tables are written to a new
version folder ``<table>/_v=<run_id>`` and never overwrite what a reader may
be reading; the run table names the current version. Re-running the same
run id overwrites only its own folder, which makes a retried job idempotent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


# Spark's text formats default to millisecond timestamps; keep microseconds.
TS_OPTIONS = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
              "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def version_path(root: str, table: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/{table}/_v={run_id}"


def write_version(df: DataFrame, root: str, table: str, run_id: str, fmt: str = "parquet",
                  partition_by=None) -> str:
    """Write one full-refresh version of ``table``."""
    path = version_path(root, table, run_id)
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def write_create_only(df: DataFrame, path: str, fmt: str = "parquet", partition_by=None) -> str:
    """The reference's default write mode: fail if the target exists."""
    w = df.write.mode("errorifexists").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return path


def csv_to_json(spark: SparkSession, csv_path: str, json_path: str, multi_line: bool = True,
                schema=None) -> str:
    """Every CSV file under ``csv_path`` (header row, all strings) to
    JSON Lines - one object per row, always newline-terminated (E20)."""
    r = (spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
         .option("recursiveFileLookup", True))
    if schema is not None:
        r = r.schema(schema)
    r.csv(csv_path).write.mode("errorifexists").options(**TS_OPTIONS).json(json_path)
    return json_path


def write_csv(df: DataFrame, path: str, sep: str = ",", header: bool = True, extension: str = "csv") -> str:
    """CSV with quotes escaped by doubling, so values with separators,
    quotes and newlines read back (with ``multiLine``) as one row."""
    (df.write.mode("errorifexists").option("header", header).option("sep", sep)
     .option("escape", '"').option("quoteAll", False).option("extension", extension).options(**TS_OPTIONS).csv(path))
    return path


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> str:
    """JSON Lines, one object per row, newline-terminated, microsecond
    timestamps."""
    df.write.mode(mode).options(**TS_OPTIONS).json(path)
    return path


def write_run_summary(runs: DataFrame, path: str) -> str:
    """The run rows as JSON Lines (the reference dumped one JSON list).
    ``path`` names one run's summary; a re-run overwrites it (idempotent)."""
    runs.write.mode("overwrite").options(**TS_OPTIONS).json(path)
    return path


def read_versions(spark: SparkSession, root: str, table: str, fmt: str = "parquet") -> DataFrame:
    """All versions of a table with ``_v`` as a partition column; filter on
    ``_v`` to prune to one version."""
    return spark.read.format(fmt).load(f"{root.rstrip('/')}/{table}")


def current_version(df: DataFrame, run_id: str) -> DataFrame:
    return df.filter(F.col("_v") == run_id).drop("_v")
