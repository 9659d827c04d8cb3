"""Catalog, lineage and exposure (K1-K7) as append-only tables.

The reference keeps a JSON document rewritten on every change. Here each
section is a table that only ever gets appended; "current" values are
latest-wins views computed with ``max_by`` (partial aggregation, so a source
with a long history costs one row per task before the shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension, file_name, source_file
from ..functions.text import line_count, word_count

# ---------------------------------------------------------------------------
# Fixed values used by the reference's catalog entries.
# ---------------------------------------------------------------------------
OP_STAGE = "route_to_temporary_staging"
OP_STORE = "store_validated_data_in_lakehouse"
OP_QUARANTINE_PREFIX = "quarantine:"
DEFAULT_QUARANTINE_REASON = "schema_or_quality_violation"
EXPOSED_STATUS = "available"
ACCESS_MODE = "lakehouse_table_path"
# ---------------------------------------------------------------------------

# content_type of file entities: the reference declares the column but never
# fills it; we fill it from the extension (our choice, documented deviation).
CONTENT_TYPES = {
    ".csv": "text/csv", ".tsv": "text/tab-separated-values", ".json": "application/json",
    ".xml": "application/xml", ".yaml": "application/yaml", ".yml": "application/yaml",
    ".txt": "text/plain", ".md": "text/markdown", ".log": "text/plain",
    ".parquet": "application/vnd.apache.parquet",
    ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".png": "image/png", ".bmp": "image/bmp",
    ".gif": "image/gif", ".webp": "image/webp",
    ".mp4": "video/mp4", ".avi": "video/x-msvideo", ".mov": "video/quicktime",
    ".mkv": "video/x-matroska", ".webm": "video/webm",
}


def content_type(ext) -> Column:
    e = F.col(ext) if isinstance(ext, str) else ext
    m = F.create_map(*[x for k, v in CONTENT_TYPES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(m[e], F.lit("application/octet-stream"))


def file_entities(manifest: DataFrame, run_id: Column | str | None = None,
                  limit: int | None = None) -> DataFrame:
    """K2: manifest -> file entity rows (C4 schema plus source and run).
    ``limit`` keeps the first files by path (the reference capped a call at
    5000 files, E16); off by default."""
    rid = F.lit(run_id) if isinstance(run_id, str) or run_id is None else run_id
    if limit is not None:
        manifest = manifest.orderBy("path").limit(limit)
    return manifest.select(
        F.lit("File").alias("entity_type"), "source_name",
        F.col("path").alias("file_path"), file_name(F.col("path")).alias("file_name"),
        extension(file_name(F.col("path"))).alias("extension"),
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        content_type(extension(file_name(F.col("path")))).alias("content_type"),
        rid.cast("string").alias("run_id"))


def text_entities(df: DataFrame, text_col: str = "text", keys=()) -> DataFrame:
    """K6 text entities: characters, words and lines of each document."""
    t = F.col(text_col)
    return df.select(*keys, F.length(t).cast("bigint").alias("n_chars"),
                     word_count(t).alias("n_words"), line_count(t).alias("n_lines"))


def log_entities(manifest: DataFrame) -> DataFrame:
    """K6 logs: the ``.log`` files of a source."""
    return manifest.filter(F.col("extension") == ".log").select(
        F.lit("Log").alias("entity_type"), "source_name", F.col("path").alias("file_path"),
        "file_name", F.col("size_bytes").cast("bigint").alias("size_bytes"))


def text_file_entities(spark, path: str, manifest: DataFrame | None = None) -> DataFrame:
    """K6 for files of any size: lines are read splittably (``lineSep`` LF)
    and aggregated per file - characters (without line breaks), words,
    lines - so no file ever becomes a single row. Files without a line
    (zero bytes) come from the manifest with zero counts."""
    lines_df = (spark.read.option("lineSep", "\n").option("recursiveFileLookup", True)
                .option("ignoreCorruptFiles", True).text(path))
    per_file = lines_df.groupBy(source_file().alias("path")).agg(
        F.sum(F.length("value")).cast("bigint").alias("n_chars"),
        F.sum(word_count(F.col("value"))).cast("bigint").alias("n_words"),
        F.count(F.lit(1)).alias("n_lines"))
    if manifest is None:
        return per_file
    out = manifest.select("path").join(per_file, "path", "left")
    return out.select("path", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                for c in ("n_chars", "n_words", "n_lines")])


def lineage_id(*parts) -> Column:
    """Deterministic edge id (the reference used a random uuid)."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def lineage_edges(runs: DataFrame) -> DataFrame:
    """K3: every run stages its source; then stores and/or quarantines it
    (a record-gated run can do both; edges follow the paths it wrote).
    ``runs``: run_id, source_name, source_path, staging_path, status,
    lakehouse_path, quarantine_path, error."""
    def edge(a, b, operation):
        return F.struct(F.col(a).alias("from_path"), F.col(b).alias("to_path"), operation.alias("operation"))
    reason = F.concat(F.lit(OP_QUARANTINE_PREFIX), F.coalesce(F.col("error"), F.lit(DEFAULT_QUARANTINE_REASON)))
    edges = F.array_compact(F.array(
        edge("source_path", "staging_path", F.lit(OP_STAGE)),
        F.when(F.col("lakehouse_path").isNotNull(), edge("staging_path", "lakehouse_path", F.lit(OP_STORE))),
        F.when(F.col("quarantine_path").isNotNull(), edge("staging_path", "quarantine_path", reason))))
    e = runs.select("run_id", "source_name", F.explode(edges).alias("_e")).select("run_id", "source_name", "_e.*")
    return e.withColumn("lineage_id", lineage_id(F.col("run_id"), F.col("source_name"), F.col("operation"),
                                                 F.col("from_path"), F.col("to_path")))


def dataset_log(runs: DataFrame) -> DataFrame:
    """K1 log: one entry when staged (no lakehouse path) and, for stored
    runs, a second entry with the lakehouse path - as the reference writes
    it twice on success. When the runs carry ``fields`` / ``metadata`` (the
    orchestrator's run rows), the entry holds the dataset entity: type,
    schema, metadata and the time it was written."""
    keys = ["run_id", "source_name", "staging_path", "schema_version", "modality"]
    extra = [c for c in ("target_table", "fields", "metadata") if c in runs.columns]
    entry = F.array_compact(F.array(
        F.struct(F.lit(None).cast("string").alias("lakehouse_path"), F.lit(0).alias("write_seq")),
        F.when(F.col("lakehouse_path").isNotNull(), F.struct(F.col("lakehouse_path"), F.lit(1).alias("write_seq")))))
    log = runs.select(*keys, *extra, F.explode(entry).alias("_e")).select(*keys, *extra, "_e.*")
    if "fields" in extra:
        log = log.withColumn("entity_type", F.lit("Dataset")).withColumn("updated_at", F.current_timestamp())
    return log


def latest_datasets(log: DataFrame) -> DataFrame:
    """K1 view: last write wins per source, by (run_id, write_seq)."""
    cols = [c for c in log.columns if c != "source_name"]
    g = log.groupBy("source_name").agg(
        F.max_by(F.struct(*cols), F.struct("run_id", "write_seq")).alias("_l"))
    return g.select("source_name", "_l.*").drop("write_seq")


def exposed_datasets(runs: DataFrame) -> DataFrame:
    """K5: the newest *stored* run of each source stays exposed even when a
    later run was quarantined (E17); ``stale_since_run`` names the first
    quarantined run after it."""
    stored = F.col("lakehouse_path").isNotNull()
    g = runs.groupBy("source_name").agg(
        F.max(F.when(stored, F.col("run_id"))).alias("exposed_run"),
        F.max_by(F.when(stored, F.col("lakehouse_path")),
                 F.when(stored, F.col("run_id"))).alias("lakehouse_path"))
    g = g.filter(F.col("exposed_run").isNotNull())
    # runs meet their source's newest stored run (a row a source) and are aggregated once more
    quarantined = F.when((F.col("status") == "quarantined") & (F.col("run_id") > F.col("exposed_run")), F.col("run_id"))
    out = runs.select("source_name", "run_id", "status").join(g, "source_name").groupBy("source_name").agg(
        F.first("lakehouse_path").alias("lakehouse_path"), F.first("exposed_run").alias("exposed_run"),
        F.min(quarantined).alias("stale_since_run"))
    return out.select("source_name", F.lit(EXPOSED_STATUS).alias("status"),
                      F.lit(ACCESS_MODE).alias("access_mode"), "lakehouse_path", "exposed_run",
                      "stale_since_run")


def run_rows(runs: DataFrame) -> DataFrame:
    """One row per source and run with its outcome and profile."""
    path = F.when(F.col("status") == "stored", F.col("lakehouse_path")).otherwise(F.col("quarantine_path"))
    return runs.select("run_id", F.col("source_name").alias("source"), "status", "modality",
                       "load_mode", "schema_version", "record_count", "invalid_count",
                       "valid_count", path.alias("output_path"), "error")
