"""Inputs that Spark derives from the driver tables for the query keys.

The driver's tables are relational; the engine's operators work on file
manifests, source configurations and run histories. These functions derive
such inputs from the tables by fixed rules, so every query's work grows with
the tables. Each rule has a twin in ``oracle_sql`` (same constants)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import extension, file_name
from ..functions.text import line_count, lines, py_strip
from ..operators.schema import fields_literal

# Rule constants shared with the SQL oracles.
EXT_CYCLE = [".csv", ".json", ".png", ".mp4", ".txt", ".xml", ".JPG", ".log", ".yaml", ".tsv",
             ".md", ".AVI", ".parquet", ".bin"]
WORKER_CYCLE = [None, "direct", "text", "image", "video", "streaming", "legacy_script"]
LANG_FIELDS = {
    "en": [("doc_id", "int"), ("text", "str")],
    "fr": [("text", "str"), ("doc_id", "int")],
    "de": [("doc_id", "int"), ("text", "str"), ("lang", "str")],
}
OTHER_LANG_FIELDS = [("doc_id", "str"), ("text", "str")]
SEMI_STRUCTURED_MIN_CHARS = 15000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_manifest(docs: DataFrame) -> DataFrame:
    """One synthetic file per document: ``/lake/<source>/d<id%3>/doc_<id><ext>``.
    Each source ``k`` draws extensions from a window of ``k % 5 + 1``
    consecutive entries of EXT_CYCLE starting at ``k``, so sources differ in
    their mix (pure csv, json + png, media only, ...)."""
    k = F.col("doc_id") % 20
    i = F.expr("doc_id div 20") % (k % 5 + 1)
    idx = ((k + i) % len(EXT_CYCLE) + 1).cast("int")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXT_CYCLE]), idx)
    path = F.concat(F.lit("/lake/"), F.col("source"), F.lit("/d"), (F.col("doc_id") % 3).cast("string"),
                    F.lit("/doc_"), F.col("doc_id").cast("string"), ext)
    m = docs.select(F.col("source").alias("source_name"), "doc_id", path.alias("path"),
                    F.col("n_chars").cast("bigint").alias("size_bytes"), "text")
    name = file_name(F.col("path"))
    return m.withColumn("file_name", name).withColumn("extension", extension(name))


def document_sources(docs: DataFrame) -> DataFrame:
    """One configured source per distinct ``documents.source`` (``srcK``)."""
    s = docs.select("source").distinct()
    k = F.substring(F.col("source"), 4, 12).cast("int")
    worker = F.element_at(F.array(*[F.lit(w).cast("string") for w in WORKER_CYCLE]),
                          (k % len(WORKER_CYCLE) + 1).cast("int"))
    return s.select(
        F.col("source").alias("name"),
        F.when(k % 8 == 3, F.concat(F.lit("/lake/upstream/"), F.col("source")))
         .otherwise(F.concat(F.lit("/lake/"), F.col("source"))).alias("path"),
        F.when(k % 6 == 5, F.lit("semi_structured")).alias("modality"),
        F.when(k % 9 == 4, F.lit("stream")).alias("load_mode"),
        F.concat(F.lit("t_"), F.col("source")).alias("target_table"),
        worker.alias("worker"))


def document_attempts(docs: DataFrame) -> DataFrame:
    """Schema registration attempts: each document is one discovery of its
    source, in doc_id order; the snapshot's fields depend on ``lang`` and
    the modality on the text size."""
    fields = F.when(F.col("lang") == "en", fields_literal(LANG_FIELDS["en"]))
    for lang in ("fr", "de"):
        fields = fields.when(F.col("lang") == lang, fields_literal(LANG_FIELDS[lang]))
    fields = fields.otherwise(fields_literal(OTHER_LANG_FIELDS))
    modality = F.when(F.col("n_chars") > SEMI_STRUCTURED_MIN_CHARS, F.lit("semi_structured")) \
        .otherwise(F.lit("structured"))
    return docs.select(F.col("source").alias("source_name"), F.col("doc_id").alias("attempt_id"),
                       modality.alias("modality"), fields.alias("fields"), "lang", "text")


def with_run_counts(attempts: DataFrame) -> DataFrame:
    """Records of a run are the document's lines; a blank line is an invalid
    record. Counted per row before any shuffle, so the text never travels."""
    ls = lines(F.col("text"))
    n_blank = F.size(F.filter(ls, lambda l: py_strip(l) == ""))
    return attempts.withColumn("record_count", line_count(F.col("text"))) \
        .withColumn("invalid_count", n_blank.cast("bigint")).drop("text")


def document_runs(versions: DataFrame) -> DataFrame:
    """A run history: each document is one run of its source; any invalid
    record quarantines the run (source gate). ``versions`` are attempts with
    run counts (``with_run_counts``) and their schema version."""
    r = versions.select(
        F.col("attempt_id").alias("run_id"), "source_name", "modality",
        F.col("version").alias("schema_version"), "record_count", "invalid_count")
    rid = F.col("run_id").cast("string")
    stored = F.col("invalid_count") == 0
    return r.select(
        "run_id", "source_name", "record_count", "invalid_count",
        F.greatest(F.col("record_count") - F.col("invalid_count"), F.lit(0)).alias("valid_count"),
        "modality", F.lit("batch").alias("load_mode"), "schema_version",
        F.when(stored, F.lit("stored")).otherwise(F.lit("quarantined")).alias("status"),
        F.concat(F.lit("/lake/"), F.col("source_name")).alias("source_path"),
        F.concat(F.lit("/staging/"), F.col("source_name"), F.lit("/_v="), rid).alias("staging_path"),
        F.when(stored, F.concat(F.lit("/lakehouse/t_"), F.col("source_name"), F.lit("/_v="), rid))
         .alias("lakehouse_path"),
        F.when(~stored, F.concat(F.lit("/quarantine/"), F.col("source_name"), F.lit("/_v="), rid))
         .alias("quarantine_path"),
        F.lit(None).cast("string").alias("error"))
