"""Dataset loads in the shape of the reference's per-dataset scripts: a
folder of CSV, image or binary files becomes ONE table in one read and one
write (the scripts ran a count job and a write job per file), with the
record count observed during the write and the load rate (P3)."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, source_file
from ..sinks import tables
from ..sources import files


def _first_paths(spark: SparkSession, path: str, extensions, n: int) -> list[str]:
    """The first ``n`` files in path order (n is the cap the caller asks for)."""
    m = files.file_manifest(spark, path, extensions=extensions)
    return [r["path"] for r in files.bounded_take(m.select("path"), n, "path").collect()]


def load_dataset(spark: SparkSession, path: str, target: str, kind: str = "csv", header: bool = False,
                 first_files: int | None = None, fmt: str = "parquet", partition_by=None) -> dict:
    """Read every file of ``kind`` under ``path`` (``csv``: headerless by
    default, as the scripts read; ``image``; ``binary`` for videos) into one
    create-only table at ``target`` with ``_source_file``. ``first_files``
    keeps the first N files by path (the scripts' 1000-file batches)."""
    exts = {"csv": (".csv",), "image": IMAGE_EXTENSIONS, "binary": VIDEO_EXTENSIONS}[kind]
    src = _first_paths(spark, path, exts, first_files) if first_files else path
    if kind == "csv":
        df = (spark.read.option("header", header).option("recursiveFileLookup", True)
              .option("pathGlobFilter", "*.[cC][sS][vV]").csv(src))
        df = df.withColumn("_source_file", source_file())
    elif kind == "image":
        df = files.read_images(spark, src)
    else:
        df = files.read_binary(spark, src, with_content=True)
        # a file that no value can hold stops the load: a table without its bytes would look complete
        df = df.withColumn("content", F.when(F.col("issue").isNotNull(), F.raise_error(F.concat_ws(
            ": ", F.col("issue"), F.col("path"))).cast("binary")).otherwise(F.col("content"))).drop("issue")
    return write_counted(df, target, fmt, partition_by)


def write_counted(df: DataFrame, target: str, fmt: str = "parquet", partition_by=None) -> dict:
    """S4 + P3: create-only write; the count comes from the write itself."""
    from pyspark.sql import Observation
    obs = Observation("load")
    t0 = time.time()
    tables.write_create_only(df.observe(obs, F.count(F.lit(1)).alias("records")), target, fmt, partition_by)
    seconds = time.time() - t0
    n = int(obs.get["records"])
    return {"records": n, "seconds": seconds, "records_per_second": n / seconds if seconds > 0 else 0.0,
            "target": target}


__all__ = ["load_dataset", "write_counted"]
