"""Tabular and semi-structured readers.

Every reader takes a directory (or file) and reads all matching files in ONE
scan, adding ``_source_file`` from the hidden ``_metadata`` column, instead of
one job per file. Explicit schemas are preferred: inference is a full extra
pass over the data at scale."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import stored_names
from ..functions.paths import source_file
from ..sinks.tables import TS_OPTIONS


def _with_file(df: DataFrame) -> DataFrame:
    return df.withColumn("_source_file", source_file())


def read_headerless_csv(spark: SparkSession, path: str, sep: str = ",", schema=None) -> DataFrame:
    """A4: the reference scripts' ``spark.read.format('csv').load(f)``: no
    header option, so each header line is a data row; columns ``_c0..``."""
    r = spark.read.option("header", False).option("sep", sep).option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    return _with_file(r.csv(path))


def string_schema(columns, corrupt: str | None = "_corrupt") -> T.StructType:
    fields = [T.StructField(c, T.StringType()) for c in columns]
    if corrupt:
        fields.append(T.StructField(corrupt, T.StringType()))
    return T.StructType(fields)


def read_csv(spark: SparkSession, path: str, columns, sep: str = ",", multi_line: bool = False,
             corrupt: str | None = "_corrupt", header: bool = True,
             path_glob: str | None = None, keep=None) -> DataFrame:
    """A5: headered CSV/TSV, every field a string (the reference's types),
    PERMISSIVE with a corrupt-record column so short and long rows are kept
    and flagged (D7) instead of failing the job. ``multi_line`` is needed for
    quoted newlines and makes each file one task; leave it off otherwise.
    ``keep`` narrows the scan to some of its files."""
    r = (spark.read.schema(string_schema(columns, corrupt)).options(**TS_OPTIONS)
         .option("header", header).option("sep", sep).option("mode", "PERMISSIVE")
         .option("multiLine", multi_line).option("escape", '"')
         .option("recursiveFileLookup", True))
    if corrupt:
        r = r.option("columnNameOfCorruptRecord", corrupt)
    if path_glob:
        r = r.option("pathGlobFilter", path_glob)
    df = r.csv(path)
    if keep is None:
        return _with_file(df)
    names = df.columns
    return _with_file(keep(df)).select(*[F.col(f"`{c}`") for c in names], "_source_file")


def sep_for(ext: str) -> str:
    return "\t" if ext.lower() == ".tsv" else ","


def read_json(spark: SparkSession, path: str, schema=None, multi_line: bool = False) -> DataFrame:
    """JSON Lines (or one array per line); ``multi_line`` for pretty
    printed documents and whole-file arrays."""
    r = spark.read.option("multiLine", multi_line).option("recursiveFileLookup", True).options(**TS_OPTIONS)
    if schema is not None:
        r = r.schema(schema)
    return _with_file(r.json(path))


def read_parquet(spark: SparkSession, path: str, merge_schema: bool = False, recursive: bool = False, reserved=()) -> DataFrame:
    """Parquet (filters and projections push into the scan). A table
    folder keeps partition discovery; a source folder of loose files is read
    recursively (only ``*.parquet`` files). Data columns named like one of
    ``reserved`` get a number behind their name."""
    r = spark.read.option("mergeSchema", merge_schema)
    if recursive:
        r = r.option("recursiveFileLookup", True).option("pathGlobFilter", "*.[pP][aA][rR][qQ][uU][eE][tT]")
    df = r.parquet(path)
    if {c.lower() for c in df.columns} & set(reserved):
        names = stored_names(df.columns, reserved)
        return df.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(df.columns, names)], source_file().alias("_source_file"))
    return _with_file(df)


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table in the configured format (``delta`` when its jar is on
    the classpath; parquet otherwise)."""
    return spark.read.format(fmt).load(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema=None, glob: str | None = None) -> DataFrame:
    """XML with one row per ``row_tag`` element (built-in reader)."""
    r = spark.read.option("rowTag", row_tag).option("recursiveFileLookup", True)
    if schema is not None:
        r = r.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return _with_file(r.xml(path))


def read_yaml_documents(spark: SparkSession, path: str) -> DataFrame:
    """YAML files are carried as whole-document rows (schema ``unknown``);
    no YAML parser runs here."""
    # pathGlobFilter is case-sensitive: character classes accept any case
    df = (spark.read.option("recursiveFileLookup", True)
          .option("pathGlobFilter", "*.{[yY][aA][mM][lL],[yY][mM][lL]}").text(path, wholetext=True))
    return df.select(source_file().alias("_source_file"), F.col("value").alias("document"))
