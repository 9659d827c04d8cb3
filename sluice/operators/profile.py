"""Counting and profiling.

Counts come out of the same pass that writes the data (``observe``), never a
second scan. Column statistics are one aggregate over all columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import line_count
from .quality import REASONS


def profile_exprs(invalid: Column | None = None) -> list[Column]:
    """P2 aggregate expressions: record / invalid / valid counts."""
    bad = invalid if invalid is not None else (F.size(F.col(REASONS)) > 0)
    rec = F.count(F.lit(1))
    inv = F.count_if(bad)
    return [rec.alias("record_count"), inv.alias("invalid_count"),
            F.greatest(rec - inv, F.lit(0)).alias("valid_count")]


def observed(df: DataFrame, name: str = "profile", invalid: Column | None = None, counted: Column | None = None):
    """Attach P2 counts to ``df``; read ``obs.get`` after the write action.
    ``counted`` says which rows are records (all, if not given)."""
    bad = invalid if invalid is not None else (F.size(F.col(REASONS)) > 0)
    obs = Observation(name)
    rows, records = F.count(F.lit(1)), []
    if counted is not None:
        rows, records = F.count_if(counted), [rows.alias("row_count")]
    return df.observe(obs, rows.alias("record_count"), F.count_if(bad).alias("invalid_count"), *records), obs


def profile_row(counts: dict, seconds: float) -> dict:
    """P2 numbers from observed counts and a measured duration (seconds > 0
    gives valid / second, else 0 as in the reference)."""
    rec = int(counts.get("record_count", 0) or 0)
    inv = int(counts.get("invalid_count", 0) or 0)
    valid = max(rec - inv, 0)
    return {"record_count": rec, "invalid_count": inv, "valid_count": valid,
            "processing_time_seconds": float(seconds),
            "rate_records_per_second": (valid / seconds) if seconds > 0 else 0.0}


def record_counts(manifest: DataFrame, rows_col: str = "csv_rows") -> DataFrame:
    """P1 (E6): a source with csv/tsv files counts their data rows; any other
    source counts files. ``rows_col`` holds each file's data-row count."""
    tabular = F.col("extension").isin(".csv", ".tsv")
    return manifest.groupBy("source_name").agg(
        F.bool_or(tabular).alias("_has_tab"),
        F.sum(F.when(tabular, F.col(rows_col))).alias("_rows"),
        F.count(F.lit(1)).alias("_files"),
    ).select("source_name",
             F.when(F.col("_has_tab"), F.col("_rows")).otherwise(F.col("_files")).cast("bigint").alias("record_count"),
             F.when(F.col("_has_tab"), F.lit("rows")).otherwise(F.lit("files")).alias("count_unit"))


def text_data_rows(text) -> Column:
    """Data rows of a quote-free delimited text: lines less the header, no
    trailing empty line."""
    t = text if isinstance(text, Column) else F.col(text)
    trailing = F.when(t.endswith("\n"), F.lit(1)).otherwise(F.lit(0))
    return F.greatest(line_count(t) - 1 - trailing, F.lit(0))


def load_rate(df: DataFrame, keys, ts: str, count_col: str | None = None) -> DataFrame:
    """Records, event-time span (seconds) and records per second."""
    n = F.sum(count_col) if count_col else F.count(F.lit(1))
    # timestamp_diff works on TIMESTAMP_NTZ as is: no session time zone involved
    span_us = F.timestamp_diff("MICROSECOND", F.min(F.col(ts)), F.max(F.col(ts)))
    g = df.groupBy(*keys).agg(n.alias("records"), span_us.alias("_span_us"))
    return g.select(*keys, "records",
                    (F.col("_span_us") / F.lit(1_000_000)).alias("span_seconds"),
                    F.try_divide(F.col("records") * F.lit(1_000_000), F.col("_span_us")).alias("records_per_second"))


def column_profile(df: DataFrame, cols=None, exact: bool = False, rsd: float = 0.05) -> DataFrame:
    """P5: one aggregate pass; long output ``(column_name, n, n_null,
    n_distinct, min_text, max_text, min_num, max_num, min_len, max_len)``;
    lengths are those of each value's text form, for every column.
    ``exact`` uses count(distinct) (a shuffle per distinct column via one
    Expand); the default HyperLogLog sketch merges map-side."""
    cols = cols or df.columns
    types = dict(df.dtypes)
    aggs = []
    for c in cols:
        col = F.col(c)
        t = types[c]
        numeric = t in ("int", "bigint", "double", "float", "smallint", "tinyint") or t.startswith("decimal")
        aggs += [
            F.count(col).alias(f"{c}__nn"),
            (F.countDistinct(col) if exact else F.approx_count_distinct(col, rsd)).alias(f"{c}__nd"),
            (F.min(col).cast("double") if numeric else F.lit(None).cast("double")).alias(f"{c}__minn"),
            (F.max(col).cast("double") if numeric else F.lit(None).cast("double")).alias(f"{c}__maxn"),
            (F.lit(None).cast("string") if numeric else F.min(col).cast("string")).alias(f"{c}__mint"),
            (F.lit(None).cast("string") if numeric else F.max(col).cast("string")).alias(f"{c}__maxt"),
            F.min(F.length(col.cast("string"))).cast("bigint").alias(f"{c}__minl"),
            F.max(F.length(col.cast("string"))).cast("bigint").alias(f"{c}__maxl"),
        ]
    wide = df.agg(F.count(F.lit(1)).alias("__n"), *aggs)
    parts = ", ".join(
        f"'{c}', `{c}__nn`, `{c}__nd`, `{c}__minn`, `{c}__maxn`, `{c}__mint`, `{c}__maxt`, `{c}__minl`, `{c}__maxl`"
        for c in cols)
    long = wide.selectExpr(
        "__n", f"stack({len(cols)}, {parts}) as (column_name, n_non_null, n_distinct, min_num, max_num,"
               " min_text, max_text, min_len, max_len)")
    return long.select(
        "column_name", F.col("__n").alias("n"),
        (F.col("__n") - F.col("n_non_null")).alias("n_null"),
        F.col("n_distinct").cast("bigint").alias("n_distinct"),
        "min_num", "max_num", "min_text", "max_text", "min_len", "max_len")


def stream_progress_row(progress) -> dict:
    """P4 for streams: numbers of the last ``StreamingQueryProgress``."""
    if progress is None:
        return {}
    p = progress if isinstance(progress, dict) else getattr(progress, "json", lambda: {})()
    if isinstance(p, str):
        import json
        p = json.loads(p)
    return {"batch_id": p.get("batchId"), "num_input_rows": p.get("numInputRows"),
            "input_rows_per_second": p.get("inputRowsPerSecond"),
            "processed_rows_per_second": p.get("processedRowsPerSecond"),
            "duration_ms": (p.get("durationMs") or {}).get("triggerExecution")}

