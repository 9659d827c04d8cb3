"""First records of delimited files (C1, D1), read by Spark's text scan.

A folder's delimited files are scanned once as lines; per file one aggregate
row keeps the first non-empty line and whether any line holds an odd number
of quotes (a quoted value may then run over line ends, see ``sources.quoted``)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import decoded_path
from ..operators.joins import join_small_in_order

#: File globs of the text formats, in any case.
GLOBS = {".csv": "*.[cC][sS][vV]", ".tsv": "*.[tT][sS][vV]", ".json": "*.[jJ][sS][oO][nN]", ".xml": "*.[xX][mM][lL]",
         ".parquet": "*.[pP][aA][rR][qQ][uU][eE][tT]"}
#: Chosen files are named to the scan, which then lists only them, up to this many; beyond, rows are joined to the choice.
NAMED_FILES = 4096


def _lines(spark: SparkSession, path: str, glob: str, ignore_corrupt: bool = False) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob)
            .option("ignoreCorruptFiles", ignore_corrupt).text(path))


def split_record(line, sep: str) -> Column:
    """Cells of one delimited record: separators inside quotes do not count,
    doubled quotes stand for one. NULL for a NULL line."""
    line = F.col(line) if isinstance(line, str) else line
    s = "\\t" if sep == "\t" else sep
    cell = f'{s}(?:"[^"]*(?:""[^"]*)*"[^{s}]*|[^{s}]*)'  # each match eats its separator: empty cells count
    found = F.regexp_extract_all(F.concat(F.lit(sep), line), F.lit(cell), F.lit(0))

    def value(c):
        c = F.substr(c, F.lit(2))
        inner = F.regexp_extract(c, '^"([^"]*(?:""[^"]*)*)"', 1)
        return F.when(c.startswith('"') & c.rlike('^"[^"]*(?:""[^"]*)*"'), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(found, value)


def delimited_files(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """One row per readable file with extension ``ext`` and a line: ``file_path,
    uri`` (as scans spell it), ``head`` (first non-empty line, NULL if there is
    none) and ``multi_line``."""
    lines = _lines(spark, path, GLOBS[ext], ignore_corrupt=True).select(
        F.col("_metadata.file_path").alias("uri"), F.col("value"),
        F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i")).alias("at"))
    text = F.when(F.col("value") != "", F.col("value"))
    odd = F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1
    return lines.groupBy("uri").agg(
        F.min_by(text, F.when(text.isNotNull(), F.col("at"))).alias("head"), F.bool_or(odd).alias("multi_line")) \
        .select(decoded_path("uri").alias("file_path"), "uri", F.regexp_replace("head", "^\\ufeff", "").alias("head"), "multi_line")


def first_records(spark: SparkSession, path: str, extensions=(".csv", ".tsv")) -> DataFrame:
    """``file_path, uri, extension, cells, multi_line`` of every readable
    delimited file under ``path``; cells NULL for a file of empty lines only. A
    header that itself runs over a line end is read to the end of its record."""
    out = None
    for ext in extensions:
        sep = "\t" if ext == ".tsv" else ","
        files = delimited_files(spark, path, ext)
        broken = F.length(F.regexp_replace("head", '[^"]+', "")) % 2 == 1
        cells = F.when(~broken, split_record("head", sep))
        part = files.select("file_path", "uri", F.lit(ext).alias("extension"), cells.alias("cells"), "multi_line",
                            F.coalesce(broken, F.lit(False)).alias("broken"))
        out = part if out is None else out.unionByName(part)
    return out


def quoted_headers(spark: SparkSession, path: str, ext: str, files: DataFrame, width: int) -> DataFrame:
    """``uri, cells`` of files whose header runs over a line end, read as CSV
    with ``width`` columns; cells NULL where the header has another width."""
    names = [f"c{i}" for i in range(width)]
    rows = (spark.read.schema(", ".join(f"`{n}` string" for n in [*names, "_corrupt"])).option("header", False)
            .option("sep", "\t" if ext == ".tsv" else ",").option("multiLine", True).option("escape", '"')
            .option("columnNameOfCorruptRecord", "_corrupt").option("recursiveFileLookup", True)
            .option("pathGlobFilter", GLOBS[ext]).csv(path))
    rows = chosen(rows, files).select(
        F.col("_metadata.file_path").alias("uri"), F.monotonically_increasing_id().alias("i"),
        F.when(F.col("_corrupt").isNull(), F.array(*[F.coalesce(F.col(n), F.lit("")) for n in names])).alias("cells"))
    return rows.groupBy("uri").agg(F.min_by(F.struct("cells"), "i").alias("first")).select("uri", "first.cells")


def literal(path: str) -> str:
    """A canonical path as a load argument: characters that globs use are escaped."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def header_of(spark: SparkSession, path: str, sep: str, multi_line: bool) -> list[str]:
    """Header cells of one file, as Spark's CSV reader finds them (it reads the
    first record only)."""
    path = literal(path)
    r = spark.read.option("header", False).option("sep", sep).option("escape", '"').option("multiLine", multi_line)
    row = r.csv(path).first()
    return [] if row is None else ["" if c is None else c for c in row]


def chosen(df: DataFrame, files: DataFrame, uri: str = "uri", keep: bool = True) -> DataFrame:
    """Rows of ``df`` (a file scan) that come from ``files`` (or do not). A
    short choice is named in a filter on the file path, which prunes the scan's
    file list; a long one is joined, in the scan's order. The rows are the same; a join hides what
    a scan knows of its files, so its result has ``_metadata`` as a column."""
    rows = files.select(uri).limit(NAMED_FILES + 1).collect()
    if len(rows) <= NAMED_FILES:
        hit = F.col("_metadata.file_path").isin([r[0] for r in rows]) if rows else F.lit(False)
        return df.filter(hit if keep else ~hit)
    told = df.select("*", "_metadata", F.col("_metadata.file_path").alias("_uri"))
    names = files.select(F.col(uri).alias("_uri")).distinct()
    return join_small_in_order(told, names, "_uri", "left_semi" if keep else "left_anti").drop("_uri")
