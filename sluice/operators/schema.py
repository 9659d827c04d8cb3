"""Schema discovery and the schema registry.

Fields are ``array<struct<pos int, name string, type string>>`` so header
order is kept; equality between versions ignores order (the reference
compares dicts), through a canonical sorted ``fields_key``.

The registry is an append-only table ``(source_name, modality, fields,
fields_key, version, ...)``. Versions are computed with a chunked two-level
scan so that a source with a huge history never lands in a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import blank_to_null
from ..session import ensure_checkpoint_dir

FIELD_TYPE = T.StructType([
    T.StructField("pos", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("type", T.StringType()),
])
FIELDS_TYPE = T.ArrayType(FIELD_TYPE)

# ---------------------------------------------------------------------------
# The reference's fixed schemas for streams (C3) and for
# unstructured files (C4), and Python type names for JSON values.
# ---------------------------------------------------------------------------
STREAM_FIELDS = [("key", "string"), ("value", "string"), ("timestamp", "timestamp"),
                 ("topic", "string"), ("partition", "integer"), ("offset", "long")]
FILE_ENTITY_FIELDS = [("file_path", "string"), ("file_name", "string"), ("extension", "string"),
                      ("size_bytes", "long"), ("content_type", "string")]
UNKNOWN_FIELDS = [("unknown", "string")]
PY_TYPE_NAMES = ("str", "int", "float", "bool", "list", "dict", "NoneType")
# ---------------------------------------------------------------------------

STREAM_SCHEMA = T.StructType([
    T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
    T.StructField("timestamp", T.TimestampType()), T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
])
FILE_ENTITY_SCHEMA = T.StructType([
    T.StructField("file_path", T.StringType()), T.StructField("file_name", T.StringType()),
    T.StructField("extension", T.StringType()), T.StructField("size_bytes", T.LongType()),
    T.StructField("content_type", T.StringType()),
])


def fields_literal(pairs) -> Column:
    """A constant fields array from ``[(name, type), ...]``."""
    return F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("name"), F.lit(t).alias("type"))
                     for i, (n, t) in enumerate(pairs)])


def header_fields(cells: Column, type_name: str = "string") -> Column:
    """Header cells -> fields. Cells are stripped, a blank cell becomes
    ``column_<i>`` (0-based), and a repeated name keeps its first position
    (dict semantics). Pure per-row array work: no shuffle."""
    named = F.transform(cells, lambda c, i: F.struct(
        i.alias("pos"),
        F.coalesce(blank_to_null(c), F.concat(F.lit("column_"), i.cast("string"))).alias("name"),
        F.lit(type_name).alias("type")))
    return F.filter(named, lambda f, i: ~F.exists(F.slice(named, F.lit(1), i),
                                                  lambda g: g["name"] == f["name"]))


def fields_key(fields: Column) -> Column:
    """Order-insensitive canonical text of a fields array."""
    return F.array_join(F.array_sort(F.transform(
        fields, lambda f: F.concat(f["name"], F.lit(":"), f["type"]))), ",")


def variant_type_to_py(type_text: Column) -> Column:
    """Map ``schema_of_variant`` output to Python type names."""
    t = F.upper(type_text)
    return (F.when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit("int"))
            .when(t.rlike(r"^DECIMAL\(\d+,0\)$"), F.lit("int"))
            .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), F.lit("float"))
            .when(t == "STRING", F.lit("str"))
            .when(t == "BOOLEAN", F.lit("bool"))
            .when(t.startswith("ARRAY"), F.lit("list"))
            .when(t.startswith("OBJECT"), F.lit("dict"))
            .when(t == "VOID", F.lit("NoneType"))
            .otherwise(F.lower(t)))


def json_key_types(df: DataFrame, json_col: str, keys=()) -> DataFrame:
    """C2 over a whole column: one row per (document, top-level key) with the
    Python type name of its value. A top-level array uses its first element,
    as the reference does; anything not an object yields no key. The JSON is
    parsed once into a variant and its fields are exploded by
    ``variant_explode`` (planned as a Generate, not a join)."""
    keys = list(keys)
    v = df.select(*keys, F.try_parse_json(F.col(json_col)).alias("_v"))
    o = v.select(*keys, F.when(F.schema_of_variant("_v").startswith("ARRAY"),
                               F.try_variant_get("_v", "$[0]", "variant")).otherwise(F.col("_v")).alias("_o"))
    e = o.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_o").outer()))
    e = e.filter(F.col("key").isNotNull())
    return e.select(*keys, "key", variant_type_to_py(F.schema_of_variant("value")).alias("type_name"))


def json_field_types(df: DataFrame, json_col: str) -> DataFrame:
    """C2 aggregated: (key, type_name, n). Partial aggregation per task, so a
    dominant key costs nothing extra."""
    return json_key_types(df, json_col).groupBy("key", "type_name").agg(F.count(F.lit(1)).alias("n"))


def merged_key_types(df: DataFrame, variant_col: str) -> DataFrame:
    """C2 over all objects: ``key, type_name`` with the type that holds every
    value of the key: int and float give float, other mixtures ``any``, a key that is only ever
    null NoneType. At most seven kinds a key pass the shuffle; the kinds are collected map-side, so
    a key of every row costs one row a task. Values that are no object have no keys."""
    is_object = F.coalesce(F.schema_of_variant(variant_col).startswith("OBJECT"), F.lit(False))
    pairs = df.filter(is_object).select(F.explode(F.col(variant_col).cast("map<string,variant>")).alias("key", "value"))
    kinds = pairs.select("key", variant_type_to_py(F.schema_of_variant("value")).alias("kind")) \
        .groupBy("key").agg(F.collect_set("kind").alias("kinds"))
    real = F.array_remove("kinds", "NoneType")
    merged = F.when(F.size(real) == 0, F.lit("NoneType")).when(F.size(real) == 1, real[0]) \
        .when(F.size(F.array_except(real, F.array(F.lit("int"), F.lit("float")))) == 0, F.lit("float")).otherwise(F.lit("any"))
    return kinds.select("key", merged.alias("type_name"))


def versions_by_change(df: DataFrame, key: str, order: str, sig: str, chunks: int | None = None) -> DataFrame:
    """C6/C7 over a history: ``changed`` is true on a source's first attempt
    and whenever ``sig`` differs from the previous attempt; ``version`` is the
    running count of changes (A -> B -> A gives 1, 2, 3).

    Rows are range partitioned by (source, order), and each partition is a
    chunk: its size follows the rows there are, not the values of ``order``, so
    the row-level windows are bounded per task even when one source holds
    most rows and its order column is sparse. Only one summary row per source
    and chunk goes through the per-source window, and it joins back on (key,
    chunk). The chunks are checkpointed to the shared folder, because range
    bounds are sampled anew whenever a plan is run again."""
    spark = df.sparkSession
    n = chunks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ensure_checkpoint_dir(spark)
    d = df.repartitionByRange(n, key, order).withColumn("_chunk", F.spark_partition_id()).checkpoint(eager=True)
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    d = (d.withColumn("_rn", F.row_number().over(w))
          .withColumn("_prev", F.lag(sig).over(w)))
    d = d.withColumn("_local_change", (F.col("_rn") > 1) & ~F.col(sig).eqNullSafe(F.col("_prev")))
    d = d.withColumn("_local_cum", F.sum(F.col("_local_change").cast("bigint")).over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    # the chunk summary comes from the same partitioned, sorted rows: whole-
    # chunk frames give the last signature and the change count, and the
    # chunk's first row carries them (a filter, no extra aggregation)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = (d.withColumn("_last_in_chunk", F.last(sig).over(whole))
          .withColumn("_n_in_chunk", F.sum(F.col("_local_change").cast("bigint")).over(whole)))
    summary = d.filter(F.col("_rn") == 1).select(
        key, "_chunk", F.col(sig).alias("_first_sig"), F.col("_last_in_chunk").alias("_last_sig"),
        F.col("_n_in_chunk").alias("_n_local"))
    wc = Window.partitionBy(key).orderBy("_chunk")
    summary = (summary
               .withColumn("_prev_last", F.lag("_last_sig").over(wc))
               .withColumn("_is_first_chunk", F.row_number().over(wc) == 1))
    summary = summary.withColumn(
        "_first_change", F.col("_is_first_chunk") | ~F.col("_first_sig").eqNullSafe(F.col("_prev_last")))
    summary = summary.withColumn("_chunk_changes", F.col("_first_change").cast("bigint") + F.col("_n_local"))
    summary = summary.withColumn("_offset", F.coalesce(F.sum("_chunk_changes").over(
        wc.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = d.join(summary.select(key, "_chunk", "_first_change", "_offset"), [key, "_chunk"])
    j = j.withColumn("changed", F.when(F.col("_rn") == 1, F.col("_first_change"))
                     .otherwise(F.col("_local_change")))
    j = j.withColumn("version", (F.col("_offset") + F.col("_first_change").cast("bigint")
                                 + F.col("_local_cum")).cast("int"))
    return j.drop("_chunk", "_rn", "_prev", "_local_change", "_local_cum", "_first_change", "_offset",
                  "_last_in_chunk", "_n_in_chunk")


def snapshot_signature(fields: Column, modality: Column) -> Column:
    """What decides evolution: the field set (order-free) and the modality."""
    return F.concat_ws("|", modality, fields_key(fields))


def registry_from_history(attempts: DataFrame, key: str = "source_name", order: str = "attempt_id") -> DataFrame:
    """C7 batch form: registration attempts -> registry rows (one per new
    version). ``attempts`` has key, order, modality, fields."""
    a = attempts.withColumn("_sig", snapshot_signature(F.col("fields"), F.col("modality")))
    v = versions_by_change(a, key, order, "_sig")
    return v.filter("changed").drop("_sig", "changed")


def latest_versions(registry: DataFrame, key: str = "source_name") -> DataFrame:
    """Newest registry row per source (partial aggregation, no window)."""
    cols = [c for c in registry.columns if c != key]
    agg = registry.groupBy(key).agg(F.max_by(F.struct(*cols), F.col("version")).alias("_l"))
    return agg.select(key, "_l.*")


def evolve(discovered: DataFrame, registry: DataFrame, key: str = "source_name") -> DataFrame:
    """C6 + C7 live form: compare newly discovered schemas against the latest
    registered version; evolved rows get ``max(version) + 1``, the others keep
    the latest number (the reference's reuse path)."""
    latest = latest_versions(registry.select(key, "modality", "fields", "version"), key)
    latest = latest.select(key, F.col("modality").alias("_l_modality"),
                           F.col("fields").alias("_l_fields"), F.col("version").alias("_l_version"))
    j = discovered.join(latest, key, "left")
    evolved = (F.col("_l_version").isNull()
               | (fields_key(F.col("fields")) != fields_key(F.col("_l_fields")))
               | ~F.col("modality").eqNullSafe(F.col("_l_modality")))
    j = j.withColumn("evolved", evolved)
    j = j.withColumn("version", F.when(F.col("evolved"), F.coalesce(F.col("_l_version"), F.lit(0)) + 1)
                     .otherwise(F.col("_l_version")).cast("int"))
    return j.drop("_l_modality", "_l_fields", "_l_version")


def schema_diff(registry: DataFrame, key: str = "source_name") -> DataFrame:
    """Field-level changes between consecutive versions of each source:
    ``added``, ``removed`` or ``retyped`` (position changes are not changes)."""
    cur = registry.select(key, "version", F.explode("fields").alias("f")) \
        .select(key, "version", F.col("f.name").alias("name"), F.col("f.type").alias("type"))
    prev = registry.select(key, (F.col("version") + 1).alias("version"), F.explode("fields").alias("f")) \
        .select(key, "version", F.col("f.name").alias("name"), F.col("f.type").alias("prev_type"))
    existing = registry.select(key, "version")
    prev = prev.join(existing, [key, "version"], "left_semi")
    j = cur.join(prev, [key, "version", "name"], "full_outer")
    j = j.filter(F.col("version") > 1)
    change = (F.when(F.col("prev_type").isNull(), F.lit("added"))
              .when(F.col("type").isNull(), F.lit("removed"))
              .when(F.col("type") != F.col("prev_type"), F.lit("retyped")))
    return j.withColumn("change", change).filter(F.col("change").isNotNull())
