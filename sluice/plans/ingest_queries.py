"""Query keys that run the staged write and the file readers/sinks over
driver tables written to the shared scratch folder (S1-S4, S8, A4, A5, A8,
A2, A3, A12, C4, K2). Keys of whole configured runs are in ``source_queries``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, quality, route
from ..session import scratch_path
from ..sinks import tables
from ..sources import chunks, files, headers, readers
from . import derive
from .ingest import Lake, ingest_frame, new_run_id, record_run
from .queries import ORDER_RULES_SQL, order_rules, query

table = derive.table

def _orders_run(spark: SparkSession, sf: str) -> dict:
    """One staged run of ``orders`` under the record gate."""
    lake = Lake(scratch_path(spark, "lake"))
    row = ingest_frame(spark, table(spark, sf, "orders"), lake, "orders", new_run_id(),
                       rules=order_rules(), gate="record", target_table="orders_curated",
                       source_path=f"{sf}/orders.parquet")
    return {"lake": lake, "run": row}


@query("ingest_stage", f"""
SELECT o_orderkey, o_orderstatus, o_totalprice, {ORDER_RULES_SQL} AS reasons FROM orders
""")
def q_ingest_stage(spark, sf):
    r = _orders_run(spark, sf)["run"]
    st = spark.read.parquet(r["staging_path"])
    return st.select("o_orderkey", "o_orderstatus", "o_totalprice",
                     F.array_join(quality.REASONS, "|").alias("reasons"))


@query("ingest_curated", f"""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority
FROM orders WHERE {ORDER_RULES_SQL} = ''
""")
def q_ingest_curated(spark, sf):
    r = _orders_run(spark, sf)["run"]
    cur = spark.read.parquet(r["lakehouse_path"])
    return cur.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("ingest_quarantine", f"""
SELECT o_orderkey, reasons FROM (SELECT o_orderkey, {ORDER_RULES_SQL} AS reasons FROM orders) o WHERE reasons <> ''
""")
def q_ingest_quarantine(spark, sf):
    r = _orders_run(spark, sf)["run"]
    q = spark.read.parquet(r["quarantine_path"])
    return q.select("o_orderkey", F.array_join(quality.REASONS, "|").alias("reasons"))


def flagship_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The minimum slice: orders through staging, record gate,
    curated + quarantine; returns the run row joined with its profile."""
    done = _orders_run(spark, sf)
    lake = done["lake"]
    record_run(spark, lake, [done["run"]])
    runs = spark.read.parquet(lake.section("runs"))
    prof = spark.read.parquet(lake.section("profiles"))
    return runs.select("run_id", "source_name", "status", "modality", "load_mode",
                       "lakehouse_path", "quarantine_path").join(
        prof.select("run_id", "source_name", "record_count", "invalid_count", "valid_count"),
        ["run_id", "source_name"])


# --- file round trips -------------------------------------------------------------
CONV_COLS = ["conv_id", "turn", "role", "text"]


def _conversations_csv(spark, sf) -> str:
    path = scratch_path(spark, "conv-csv") + "/data"
    tables.write_csv(table(spark, sf, "conversations").select(*CONV_COLS), path)
    return path


@query("csv_roundtrip", "SELECT conv_id, turn, role, text FROM conversations")
def q_csv_roundtrip(spark, sf):
    """A5: texts with commas and newlines survive a CSV write and read."""
    path = _conversations_csv(spark, sf)
    df = readers.read_csv(spark, path, CONV_COLS, multi_line=True)
    return df.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                     F.col("turn").cast("bigint").alias("turn"), "role", "text")


@query("csv_to_json", "SELECT conv_id, turn, role, text FROM conversations")
def q_csv_to_json(spark, sf):
    """Every CSV file to JSON Lines, read back."""
    csv_path = _conversations_csv(spark, sf)
    json_path = scratch_path(spark, "conv-json") + "/data"
    tables.csv_to_json(spark, csv_path, json_path, multi_line=True,
                       schema=readers.string_schema(CONV_COLS, corrupt=None))
    js = readers.read_json(spark, json_path, schema=readers.string_schema(CONV_COLS, corrupt=None))
    return js.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                     F.col("turn").cast("bigint").alias("turn"), "role", "text")


ORDER_COLS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]


@query("headerless_csv_count", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def q_headerless_csv_count(spark, sf):
    """A4: a headerless read counts every header line as data. The header
    lines are known from one aggregate row a file, so
    their counts are subtracted after the aggregation - one scan of the data
    and no row-level anti-join."""
    path = scratch_path(spark, "orders-csv") + "/data"
    tables.write_csv(table(spark, sf, "orders").select(*ORDER_COLS), path)
    raw = readers.read_headerless_csv(spark, path)
    counts = raw.groupBy(F.col("_c2").alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("_n"))
    heads = headers.first_records(spark, path, (".csv",)).filter(F.col("cells").isNotNull())
    head_counts = heads.groupBy(F.col("cells")[2].alias("o_orderstatus")).agg(F.count(F.lit(1)).alias("_h"))
    j = counts.join(head_counts, "o_orderstatus", "left")
    n = F.col("_n") - F.coalesce(F.col("_h"), F.lit(0))
    return j.select("o_orderstatus", n.alias("n")).filter(F.col("n") > 0)


@query("xml_decode", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders
""")
def q_xml_decode(spark, sf):
    """Orders written as XML (one <order> per row) and read back by row tag."""
    path = scratch_path(spark, "orders-xml") + "/data"
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
                                      "o_orderpriority")
    o.write.option("rowTag", "order").option("rootTag", "orders").xml(path)
    sch = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderpriority string"
    x = readers.read_xml(spark, path, "order", schema=sch)
    return x.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


# --- listings -----------------------------------------------------------------------
def _source_files(spark: SparkSession, sf: str) -> str:
    """Documents as one text file a source, in folders whose names need
    URL-encoding (``src 7%`` and the like)."""
    path = scratch_path(spark, "docs by source") + "/data"
    d = table(spark, sf, "documents").select(F.concat(F.col("source"), F.lit(" 7%")).alias("folder"),
                                             F.translate("text", "\n\r", "  ").alias("text"))
    d.repartition("folder").write.partitionBy("folder").text(path)
    return path


_FOLDER = r"/folder=([^/]+) 7%25/[^/]*$"  # Spark itself escapes the per cent sign of a partition value


@query("file_manifest", """
SELECT source AS source_name, 'File' AS entity_type, '.txt' AS extension, 'text/plain' AS content_type,
       CAST(1 AS BIGINT) AS n_files, CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes
FROM documents GROUP BY source
""")
def q_file_manifest(spark, sf):
    """A2 + C4 + K2: file entities of a folder of text files, per source."""
    m = files.file_manifest(spark, _source_files(spark, sf), source_name="docs")
    e = catalog.file_entities(m).withColumn("source", F.regexp_extract("file_path", _FOLDER, 1))
    return e.groupBy(F.col("source").alias("source_name"), "entity_type", "extension", "content_type").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("size_bytes").cast("bigint").alias("size_bytes"))


@query("manifest_summary", """
SELECT 'docs' AS source_name, count(DISTINCT source) AS file_count,
       CAST(sum(octet_length(encode(text)) + 1) AS BIGINT) AS size_bytes, '.txt' AS extensions
FROM documents
""")
def q_manifest_summary(spark, sf):
    """A3: size, file count and sorted extensions of a folder."""
    m = files.file_manifest(spark, _source_files(spark, sf), source_name="docs")
    s = route.manifest_summary(m)
    return s.select("source_name", "file_count", "size_bytes", F.array_join("extensions", ",").alias("extensions"))


@query("binary_scan")
def q_binary_scan(spark, sf):
    """The binary scan with bytes: path, length and a content digest. Files too large for a task are digested split by split."""
    b = files.read_binary(spark, sf, with_content=True, extensions=None, max_content_bytes=chunks.DIGEST_BYTES)
    small = b.filter("issue IS NULL").select("path", "length", F.sha2("content", 256).alias("content_sha256"))
    large = chunks.file_digests(spark, sf, above=chunks.DIGEST_BYTES).withColumnsRenamed({"size_bytes": "length", "digest": "content_sha256"})
    return small.unionByName(large)


# --- D1 + D7 on driver data ---------------------------------------------------------
@query("csv_header_checks", """
SELECT 'orders' AS dataset, true AS header_ok, count(*) AS n_rows, CAST(0 AS BIGINT) AS n_bad_rows FROM orders
UNION ALL
SELECT 'customer', false, count(*), count(*) FROM customer
""")
def q_csv_header_checks(spark, sf):
    """One folder holds ``orders`` (6 columns) and ``customer`` (5 columns) as
    headered CSV part files. Against the 6-column schema, D1 flags every
    customer file's header (``header_width``) and D7 flags every customer row
    (too few cells); orders pass both. One scan each, any number of files."""
    root = scratch_path(spark, "mixed-csv")
    tables.write_csv(table(spark, sf, "orders").select(*ORDER_COLS), root + "/orders")
    cust = table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    tables.write_csv(cust, root + "/customer")
    dataset = F.regexp_extract(F.col("file_path"), r"/(orders|customer)/[^/]*$", 1)
    checks = quality.header_checks(spark, root, files.file_manifest(spark, root), len(ORDER_COLS))
    per_ds = checks.groupBy(dataset.alias("dataset")).agg(F.bool_and(F.col("reason").isNull()).alias("header_ok"))
    rows = readers.read_csv(spark, root, ORDER_COLS)
    tagged = quality.apply_rules(rows, [quality.row_width("_corrupt")])
    # stage the tagged rows as the ingest does; counts come from the staged version
    staged_path = tables.write_version(tagged, root + "/_staging", "mixed", "q")
    tagged = spark.read.parquet(staged_path)
    ds_rows = F.regexp_extract(F.col("_source_file"), r"/(orders|customer)/[^/]*$", 1)
    counts = tagged.groupBy(ds_rows.alias("dataset")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.size(quality.REASONS) > 0).alias("n_bad_rows"))
    return per_ds.join(counts, "dataset")


# --- A6 JSON Lines, S4 create-only, S9 run summary file -----------------------------
EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("json_roundtrip", """
SELECT event_id, user_id, event_type, value, props, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts_text FROM events
""")
def q_json_roundtrip(spark, sf):
    """Events written as JSON Lines (S8's sink format) and read back
    with an explicit schema - no inference pass."""
    path = scratch_path(spark, "events-json") + "/data"
    tables.write_json(table(spark, sf, "events"), path)
    js = readers.read_json(spark, path, schema=EVENT_SCHEMA)
    return js.select("event_id", "user_id", "event_type", "value", "props",
                     F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts_text"))


@query("create_only_write", """
SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders
""")
def q_create_only_write(spark, sf):
    """The first create-only write succeeds; a second one to the same
    path must fail and leave the first table unchanged."""
    path = scratch_path(spark, "create-only") + "/orders"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    tables.write_create_only(o, path)
    try:
        tables.write_create_only(table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("o_orderstatus"),
            F.col("l_extendedprice").alias("o_totalprice")), path)
    except Exception as e:  # the expected outcome: the path already exists
        if "already exists" not in str(e).lower() and "path_already_exists" not in str(e).lower():
            raise
    else:
        raise AssertionError("create-only write replaced an existing table")
    back = spark.read.parquet(path)
    return back.select("o_orderkey", "o_orderstatus", "o_totalprice")


# --- A10 + K6 on text files ---------------------------------------------------------
@query("text_file_entities", r"""
SELECT source,
       CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS n_lines,
       CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\x0B]+'), lambda t: t <> ''))) AS BIGINT) AS n_words,
       CAST(sum(length(text) - (len(string_split(text, chr(10))) - 1)) AS BIGINT) AS n_chars
FROM documents GROUP BY source
""")
def q_text_file_entities(spark, sf):
    """Documents written as text files partitioned by source, read back
    line by line (splittable) and counted per file (K6), then per source."""
    from ..operators import catalog
    path = scratch_path(spark, "docs-text") + "/data"
    table(spark, sf, "documents").select("source", "text").write.partitionBy("source").text(path)
    ents = catalog.text_file_entities(spark, path)
    src = F.regexp_extract(F.col("path"), r"/source=([^/]+)/[^/]*$", 1)
    return ents.groupBy(src.alias("source")).agg(
        F.sum("n_lines").cast("bigint").alias("n_lines"), F.sum("n_words").cast("bigint").alias("n_words"),
        F.sum("n_chars").cast("bigint").alias("n_chars"))
