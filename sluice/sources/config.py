"""A1: source configuration -> a ``sources`` DataFrame.

The file is the reference's JSON shape ``{"sources": [{name, path, ...}]}``.
It is read by Spark (``multiLine`` JSON + ``inline``), so the same call works
for a config on shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the key that configuration files spell this way; our column is ``load_mode``.
MODE_KEY = "ingestion_mode"


def _source_type(mode: str) -> T.StructType:
    return T.StructType([
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("modality", T.StringType()),
        T.StructField(mode, T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("worker", T.StringType()),
        T.StructField("options", T.MapType(T.StringType(), T.StringType())),
    ])


SOURCE_TYPE = _source_type("load_mode")
FILE_TYPE = _source_type(MODE_KEY)
CONFIG_SCHEMA = T.StructType([T.StructField("sources", T.ArrayType(FILE_TYPE))])


class ConfigError(ValueError):
    pass


def load_sources(spark: SparkSession, config_path: str, validate: bool = True) -> DataFrame:
    """Rows ``name, path, modality, load_mode, target_table, worker,
    options``; ``options`` defaults to an empty map. ``name`` and ``path`` are
    required: with ``validate`` a row missing either raises ``ConfigError``."""
    raw = spark.read.schema(CONFIG_SCHEMA).option("multiLine", True).json(config_path)
    rows = raw.select(F.inline(F.coalesce(F.col("sources"), F.array().cast(T.ArrayType(FILE_TYPE))))) \
        .withColumnRenamed(MODE_KEY, "load_mode")
    rows = rows.withColumn("options", F.coalesce(
        F.col("options"), F.create_map().cast(T.MapType(T.StringType(), T.StringType()))))
    rows = rows.withColumn("target_table", F.coalesce(F.col("target_table"), F.col("name")))
    if validate:
        bad = rows.filter(F.col("name").isNull() | F.col("path").isNull()).limit(1).count()
        if bad:
            raise ConfigError("every source needs 'name' and 'path'")
    return rows


def sources_from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Programmatic form of a configuration (tests, notebooks)."""
    data = [(r["name"], r["path"], r.get("modality"), r.get(MODE_KEY),
             r.get("target_table") or r["name"], r.get("worker"),
             {k: str(v) for k, v in (r.get("options") or {}).items()}) for r in rows]
    return spark.createDataFrame(data, SOURCE_TYPE)
