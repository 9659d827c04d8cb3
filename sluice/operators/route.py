"""Routing (B3-B5) and first-file choice (C5) over a file manifest.

A manifest is one row per file (``source_name, path, extension, size_bytes``)
as produced by :func:`sluice.sources.files.file_manifest`. Everything here is
one partial aggregation per source plus a join with the (small) source table;
AQE picks a broadcast at run time when the per-source summary is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import extension_class, has_streaming_hint

WORKERS = ("direct", "text", "image", "video", "streaming")


def _blank_null(c):
    return F.when(F.col(c) == "", F.lit(None)).otherwise(F.col(c))


def manifest_summary(manifest: DataFrame) -> DataFrame:
    """A3 + B3 inputs: per source size, file count, sorted extensions and
    the class flags used by directory precedence."""
    cls = extension_class(F.col("extension"))
    return manifest.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("file_count"),
        F.sum("size_bytes").alias("size_bytes"),
        F.sort_array(F.collect_set("extension")).alias("extensions"),
        F.bool_or(cls == "structured").alias("has_structured"),
        F.bool_or(cls == "semi_structured").alias("has_semi_structured"),
        F.bool_or(cls == "image").alias("has_image"),
        F.bool_or(cls == "video").alias("has_video"),
        F.bool_or(cls == "text").alias("has_text"),
    )


def modality_expr(explicit, path, has_structured, has_semi):
    """B3 precedence: explicit modality, streaming hint, structured, semi
    structured, otherwise unstructured (images, videos, text, nothing)."""
    return F.coalesce(
        explicit,
        F.when(has_streaming_hint(path), F.lit("streaming")),
        F.when(F.coalesce(has_structured, F.lit(False)), F.lit("structured")),
        F.when(F.coalesce(has_semi, F.lit(False)), F.lit("semi_structured")),
        F.lit("unstructured"),
    )


def load_mode_expr(explicit, modality):
    """B4."""
    return F.coalesce(explicit, F.when(modality == "streaming", F.lit("stream"))
                      .otherwise(F.lit("batch")))


def worker_expr(worker, modality, has_image=None, has_video=None, auto_media=False):
    """Explicit worker names win; ``*_script`` adapters are not supported
    (they ran the reference's scripts); ``direct`` and unknown names fall
    through to the modality (E4); unstructured goes to text (E5) unless
    ``auto_media`` routes image/video directories to their own rule."""
    routed = (F.when(worker.isin("image", "video", "text", "streaming"), worker)
              .when(worker.endswith("_script"), F.lit("unsupported"))
              .when(modality.isin("structured", "semi_structured"), F.lit("direct"))
              .when(modality == "streaming", F.lit("streaming")))
    if auto_media and has_image is not None:
        routed = (routed.when(F.coalesce(has_image, F.lit(False)), F.lit("image"))
                  .when(F.coalesce(has_video, F.lit(False)), F.lit("video")))
    return routed.otherwise(F.lit("text"))


def route_sources(sources: DataFrame, manifest: DataFrame, auto_media: bool = False) -> DataFrame:
    """B3-B5 for every configured source in one plan.

    ``sources``: name, path, modality, load_mode, worker (+ others).
    Returns the source columns plus ``modality``, ``load_mode``,
    ``worker_name`` and the manifest summary."""
    summary = manifest_summary(manifest)
    s = sources.select(
        "*",
        _blank_null("modality").alias("_explicit_modality"),
        _blank_null("load_mode").alias("_explicit_mode"),
        F.coalesce(_blank_null("worker"), F.lit("")).alias("_worker"),
    ).drop("modality", "load_mode")
    j = s.join(summary, s["name"] == summary["source_name"], "left").drop("source_name")
    modality = modality_expr(F.col("_explicit_modality"), F.col("path"),
                             F.col("has_structured"), F.col("has_semi_structured"))
    j = j.withColumn("modality", modality)
    j = j.withColumn("load_mode", load_mode_expr(F.col("_explicit_mode"), F.col("modality")))
    j = j.withColumn("worker_name", worker_expr(F.col("_worker"), F.col("modality"),
                                                F.col("has_image"), F.col("has_video"), auto_media))
    return j.drop("_explicit_modality", "_explicit_mode", "_worker")


def first_files(manifest: DataFrame, picks=None) -> DataFrame:
    """Per source the file chosen for schema discovery: the first suffix
    in priority order that has any file, and within it the smallest path
    (deterministic, where the reference took file-system order, E15).
    ``picks`` maps an output column to its suffix priority list; all picks
    come out of one aggregation."""
    picks = picks or {"first_path": (".csv", ".tsv")}
    aggs = [F.coalesce(*[F.min(F.when(F.col("extension") == s, F.col("path"))) for s in suffixes]).alias(name)
            for name, suffixes in picks.items()]
    return manifest.groupBy("source_name").agg(*aggs)
