"""File listings and whole-file scans.

A manifest is built from Spark's own file index: ``binaryFile`` rows with
only ``path, length, modificationTime`` selected never read file bytes (the
projection prunes ``content``), and zero-byte files - which ``binaryFile``
does not emit - are added back from the same index. Every path is in one
canonical form (:func:`sluice.functions.paths.plain_path`), so listings, scans
and reasons join whatever characters a name holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import (IMAGE_EXTENSIONS, VIDEO_EXTENSIONS, decoded_path, extension, file_name, plain_path,
                               source_file)

#: Bytes that one value of a Spark row can hold, with some room. A larger file
#: is never loaded as one value and never dropped: it is a row with a reason.
MAX_ROW_BYTES = 2_000_000_000
TOO_LARGE = "too_large_for_row"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there; a storage failure is raised, never read as "no"."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p))


def create_exclusive(spark: SparkSession, path: str) -> bool:
    """Create an empty file that must not exist yet; False if it does."""
    from py4j.protocol import Py4JJavaError
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if fs.getUri().getScheme() == "file":  # the file system class of local disks looks first and creates then
        f = jvm.java.io.File(p.toUri().getPath())
        f.getParentFile().mkdirs()
        return bool(f.createNewFile())
    try:
        fs.create(p, False).close()
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True)
            .load(path).select("path", "length", "modificationTime"))


def _indexed(listing: DataFrame):
    """(number of files in the scan's index, frame of their paths). The index
    is what Spark holds on the driver for any file scan; its paths become a
    frame inside the JVM and never a Python list."""
    spark = listing.sparkSession
    jvm = spark.sparkContext._jvm
    names = listing._jdf.inputFiles()
    listed = jvm.scala.collection.immutable.ArraySeq.unsafeWrapArray(names)
    rows = spark._jsparkSession.createDataset(listed, jvm.org.apache.spark.sql.Encoders.STRING())
    return len(names), DataFrame(rows.toDF(), spark).select(decoded_path("value").alias("path"))


def file_manifest(spark: SparkSession, path: str, source_name: str | None = None,
                  extensions=None, include_empty: bool = True) -> DataFrame:
    """A2: one row per file under ``path``: source_name, path, file_name,
    extension (lower-case, with dot), size_bytes, modified."""
    listing = _listing(spark, path)
    rows = listing.select(plain_path("path").alias("path"), F.col("length").alias("size_bytes"),
                          F.col("modificationTime").alias("modified"))
    if include_empty:
        n, indexed = _indexed(listing)
        if n and n > rows.count():  # the index holds files that gave no row: zero-byte ones
            empties = indexed.join(rows.select("path"), "path", "left_anti").select(
                "path", F.lit(0).cast("bigint").alias("size_bytes"),
                F.lit(None).cast("timestamp").alias("modified"))
            rows = rows.unionByName(empties)
    name = file_name(F.col("path"))
    out = rows.select(F.lit(source_name).cast("string").alias("source_name"), "path",
                      name.alias("file_name"), extension(name).alias("extension"),
                      "size_bytes", "modified")
    if extensions:
        out = out.filter(F.col("extension").isin(*[e.lower() for e in extensions]))
    return out


def bounded_take(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows in a stated order (TakeOrderedAndProject:
    each task keeps its own top n, the driver merges n x tasks rows)."""
    return df.orderBy(*order).limit(n)


def read_text_documents(spark: SparkSession, path: str, ignore_corrupt: bool = False, glob: str | None = None,
                        max_bytes: int = MAX_ROW_BYTES) -> DataFrame:
    """A10: one row per text file (``wholetext``) with its path. Files above
    ``max_bytes`` cannot be one value and give no row here; the manifest
    names them."""
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if ignore_corrupt:
        r = r.option("ignoreCorruptFiles", True)
    df = r.text(path, wholetext=True).filter(F.col("_metadata.file_size") <= max_bytes)
    return df.select(source_file().alias("path"), F.col("value").alias("text"),
                     F.col("_metadata.file_size").alias("size_bytes"))


def read_images(spark: SparkSession, path: str, drop_invalid: bool = False) -> DataFrame:
    """Decoded images; an undecodable file has width/height -1."""
    df = (spark.read.format("image").option("recursiveFileLookup", True)
          .option("dropInvalid", drop_invalid).load(path))
    # the image source names its files URL-encoded
    origin = decoded_path("image.origin")
    return df.filter(extension(file_name(origin)).isin(*IMAGE_EXTENSIONS)).select(
        origin.alias("path"), "image.height", "image.width", "image.nChannels", "image.mode", "image.data")


def read_binary(spark: SparkSession, path: str, with_content: bool = False,
                extensions=VIDEO_EXTENSIONS, max_content_bytes: int = MAX_ROW_BYTES) -> DataFrame:
    """Binary files (videos by default): path, modificationTime, length
    and, when ``with_content`` asks for the bytes, ``content`` and ``issue``.
    A file above ``max_content_bytes`` cannot be one value: its row has no
    content and the issue ``too_large_for_row``, for callers to quarantine."""
    def scan():
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if with_content:
        small = scan().filter(F.col("length") <= max_content_bytes).select(
            "path", "modificationTime", "length", "content", F.lit(None).cast("string").alias("issue"))
        large = scan().filter(F.col("length") > max_content_bytes).select(
            "path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("issue"))
        out = small.unionByName(large)
    else:
        out = scan().select("path", "modificationTime", "length")
    out = out.withColumn("path", plain_path("path"))
    if extensions:
        out = out.filter(extension(file_name(F.col("path"))).isin(*extensions))
    return out


def unreadable_files(spark: SparkSession, manifest: DataFrame, path: str) -> DataFrame:
    """Non-empty files that produced no text row under
    ``ignoreCorruptFiles`` (zero-byte files are readable and empty)."""
    docs = read_text_documents(spark, path, ignore_corrupt=True).select("path")
    return (manifest.filter((F.col("size_bytes") > 0) & (F.col("size_bytes") <= MAX_ROW_BYTES))
            .join(docs, "path", "left_anti").select("source_name", "path", F.lit("unreadable").alias("reason")))
