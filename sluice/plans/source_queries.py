"""Query keys of whole configured runs: driver tables written as files of
several formats are read, gated and stored by ``ingest_sources``, and the
stored tables are returned."""

from __future__ import annotations

import contextlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality, schema
from ..session import scratch_path
from ..sinks import tables
from ..sources import chunks, config
from . import derive
from .ingest import Lake, ingest_sources, read_current
from .queries import query
from .stream_queries import _damaged, _kafka_files, _kafka_rows

table = derive.table


def run_source(spark: SparkSession, path: str, gate: str, **fields) -> dict:
    """Run row of one configured source at ``path``."""
    lake = Lake(scratch_path(spark, "lake"))
    src = config.sources_from_rows(spark, [{"name": "s", "path": path, **fields}])
    row = ingest_sources(spark, src, lake, gate=gate).first().asDict()
    if row["status"] == "failed":
        raise RuntimeError(row["error"])
    return row


def stored(spark: SparkSession, row: dict) -> DataFrame:
    """All staged rows of a run, whichever side they went to."""
    return spark.read.parquet(row["staging_path"])


# --- JSON ---------------------------------------------------------------------------
@query("json_source_rows", """
SELECT doc_id, 'lang' AS key, lang AS value FROM documents WHERE doc_id % 3 = 0
UNION ALL SELECT doc_id, 'source', source FROM documents
UNION ALL SELECT doc_id, 'text', text FROM documents
UNION ALL SELECT doc_id, 'size', CASE WHEN doc_id % 100 <> 7 AND doc_id % 2 = 1 THEN CAST(n_chars AS VARCHAR) || '.5'
                                      ELSE CAST(n_chars AS VARCHAR) END FROM documents
""")
def q_json_source_rows(spark, sf):
    """JSON Lines and pretty-printed documents in one source. Keys vary
    by row and by file, and one key holds integers in some files and fractions
    in others; every (document, key, value) is stored."""
    root = scratch_path(spark, "docs json") + "/in put"
    d = table(spark, sf, "documents").withColumn("lang", F.when(F.col("doc_id") % 3 == 0, F.col("lang")))
    pretty = F.col("doc_id") % 100 == 7
    whole, half = F.col("n_chars"), F.col("n_chars") + F.lit(0.5)

    def out(rows, folder, size, **options):
        w = rows.select("doc_id", "lang", "source", "text", size.alias("size")).write.options(**options)
        w.json(f"{root}/{folder}")
    out(d.filter(~pretty & (F.col("doc_id") % 2 == 0)), "a", whole)
    out(d.filter(~pretty & (F.col("doc_id") % 2 == 1)), "b", half)
    out(d.filter(pretty), "c", whole, pretty="true", maxRecordsPerFile="1")
    rows = stored(spark, run_source(spark, root, "record"))
    value = [F.struct(F.lit(k).alias("key"), F.coalesce(F.col(k).cast("string") if k in rows.columns else F.lit(None),
                                                         F.col("_extra")[k]).alias("value"))
             for k in ("lang", "source", "size", "text")]
    long = rows.filter(F.size("_reasons") == 0).select("doc_id", F.explode(F.array(*value)).alias("kv"))
    # an unlisted text is kept as JSON text, with its quotes
    unquoted = F.when(F.col("kv.value").startswith('"'), F.get_json_object(F.concat(F.lit('{"v":'), F.col("kv.value"), F.lit("}")), "$.v"))
    return long.filter("kv.value IS NOT NULL").select("doc_id", "kv.key", F.coalesce(unquoted, "kv.value").alias("value"))


# --- CSV ----------------------------------------------------------------------------
CSV_COLS = ["conv_id", "turn", "role", "text"]


def _conversation_files(spark, sf) -> str:
    """Good, wide and tab-separated files in folders with a blank, ``%``, ``+`` and ``#``."""
    root = scratch_path(spark, "conv csv") + "/in"
    c = table(spark, sf, "conversations").select(*CSV_COLS)
    tables.write_csv(c.filter("conv_id % 4 < 2"), root + "/a good 5%")
    tables.write_csv(c.filter("conv_id % 4 = 2").withColumn("more", F.lit("x")), root + "/b wide+#")
    tables.write_csv(c.filter("conv_id % 4 = 3"), root + "/c tabs", sep="\t", extension="tsv")
    return root


def _csv_sql(gate: str, row_width: str) -> str:
    return f"""
SELECT '{gate}' AS gate, conv_id, turn, role, sha256(text) AS text_sha256,
       CASE WHEN conv_id % 4 = 2 THEN '{row_width}header_width' ELSE '' END AS reasons FROM conversations"""


@query("csv_source_rows", _csv_sql("record", "row_width|") + " UNION ALL" + _csv_sql("source", ""))
def q_csv_source_rows(spark, sf):
    """A5, C1, D1, D7 under both gates: values over several lines, files with
    another header width, CSV and TSV in one source; no row is split or lost."""
    root, out = _conversation_files(spark, sf), None
    for gate in ("record", "source"):
        rows = stored(spark, run_source(spark, root, gate)).select(
            F.lit(gate).alias("gate"), F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
            "role", F.sha2("text", 256).alias("text_sha256"), F.array_join("_reasons", "|").alias("reasons"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("csv_source_counts", """
SELECT 'record' AS gate, 'partial' AS status, count(*) AS record_count, count(*) FILTER (WHERE conv_id % 4 = 2) AS invalid_count
FROM conversations
UNION ALL SELECT 'source', 'quarantined', count(*), CAST(1 AS BIGINT) FROM conversations
""")
def q_csv_source_counts(spark, sf):
    """The run rows of both gates (the source gate counts bad files, of which one is written)."""
    root = scratch_path(spark, "conv csv") + "/in"
    c = table(spark, sf, "conversations").select(*CSV_COLS)
    tables.write_csv(c.filter("conv_id % 4 <> 2"), root + "/a good")
    # one bad file: its rows pass through one task, which is the case under test
    tables.write_csv(c.filter("conv_id % 4 = 2").withColumn("more", F.lit("x")).coalesce(1), root + "/b wide")
    rows = [run_source(spark, root, gate) | {"gate": gate} for gate in ("record", "source")]
    return spark.createDataFrame([(r["gate"], r["status"], r["record_count"], r["invalid_count"]) for r in rows],
                                 "gate string, status string, record_count bigint, invalid_count bigint")


@query("json_merged_fields", """
WITH r AS (
  SELECT o_orderkey % 5 AS k, CASE o_orderkey % 5 WHEN 0 THEN 'int' WHEN 1 THEN (CASE WHEN o_custkey % 2 = 0 THEN 'int' ELSE 'float' END)
    WHEN 2 THEN (CASE WHEN o_custkey % 97 = 0 THEN 'int' ELSE 'str' END) WHEN 3 THEN 'NoneType' ELSE 'bool' END AS t FROM orders),
g AS (SELECT k, list_sort(list(DISTINCT t)) AS ts FROM r GROUP BY k)
SELECT 'k' || k AS key, CASE WHEN len(ts) = 1 THEN ts[1] WHEN ts = ['float', 'int'] THEN 'float' ELSE 'any' END AS type_name FROM g
""")
def q_json_merged_fields(spark, sf):
    """C2 over every object of every file: each key's type holds all its values."""
    root = scratch_path(spark, "merged json") + "/in"
    o = table(spark, sf, "orders")
    fifth, even, rare = F.col("o_orderkey") % 5, F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 97 == 0
    parts = [(fifth == 0, "k0", F.col("o_custkey")), ((fifth == 1) & even, "k1", F.col("o_custkey")),
             ((fifth == 1) & ~even, "k1", F.col("o_custkey") + F.lit(0.5)), ((fifth == 2) & rare, "k2", F.col("o_custkey")),
             ((fifth == 2) & ~rare, "k2", F.col("o_orderpriority")), (fifth == 3, "k3", F.lit(None).cast("string")), (fifth == 4, "k4", even)]
    for i, (rows, key, value) in enumerate(parts):
        o.filter(rows).select(value.alias(key)).write.option("ignoreNullFields", False).json(f"{root}/{i}")
    row = run_source(spark, root, "record", options={"fieldsFrom": "all"})
    return spark.createDataFrame([(n, t) for _, n, t in row["fields"]], "key string, type_name string")


#: Column names as a source may have them: technical names of the stored rows, and two that differ in case only.
ODD_NAMES = {"reason": "o_orderstatus", "_run_id": "o_orderkey", "_reasons": "o_orderpriority", "_source_file": "o_custkey",
             "x": "o_orderkey + 1", "X": "o_custkey + 2"}


@contextlib.contextmanager
def _case_sensitive(spark):
    """Names that differ in case can be written (the library itself never needs this)."""
    before = spark.conf.get("spark.sql.caseSensitive")
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        yield
    finally:
        spark.conf.set("spark.sql.caseSensitive", before)


def _original_names(spark, row: dict) -> DataFrame:
    """Stored rows of a run under the source's names, as text (``name_0`` ... in the order of ``ODD_NAMES``)."""
    renamed = json.loads(row["metadata"].get("columns", "{}"))
    back = {v: k for k, v in renamed.items()}
    return stored(spark, row).select(*[F.col(f"`{back.get(n, n)}`").cast("string").alias(f"name_{i}") for i, n in enumerate(ODD_NAMES)])


@query("column_names", " UNION ALL ".join(
    f"SELECT '{fmt}' AS format, " + ", ".join(f"CAST({e} AS VARCHAR) AS name_{i}" for i, e in enumerate(ODD_NAMES.values()))
    + " FROM orders" for fmt in ("csv", "json")))
def q_column_names(spark, sf):
    """Sources whose columns are named like technical ones,
    or alike but for case, keep every value; the run row names the columns that are stored under another name."""
    root, out = scratch_path(spark, "names"), None
    with _case_sensitive(spark):
        o = table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in ODD_NAMES.items()])
        tables.write_csv(o, f"{root}/csv")
        tables.write_json(o, f"{root}/json")
    for fmt in ("csv", "json"):
        rows = _original_names(spark, run_source(spark, f"{root}/{fmt}", "record")).select(F.lit(fmt).alias("format"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("csv_column_order", "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders")
def q_csv_column_order(spark, sf):
    """A5: files of one source whose headers name the same columns in another order are read by name."""
    root = scratch_path(spark, "order csv") + "/in"
    cols = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]
    o = table(spark, sf, "orders").select(*cols)
    third = F.col("o_orderkey") % 3
    tables.write_csv(o.filter(third == 0), f"{root}/a")
    tables.write_csv(o.filter(third == 1).select(*cols[::-1]), f"{root}/b")
    # one value over two lines, so that these files are read in the other way
    two = F.concat_ws("\n", F.lit("two"), "o_orderpriority")
    tables.write_csv(o.filter(third == 2).select("o_orderstatus", two.alias("o_orderpriority"), "o_orderkey", "o_custkey"), f"{root}/c")
    rows = stored(spark, run_source(spark, root, "record"))
    return rows.select(*[F.col(c).cast("bigint").alias(c) for c in cols[:2]], "o_orderstatus",
                       F.regexp_replace("o_orderpriority", "^two\n", "").alias("o_orderpriority"))


@query("hinted_uri_source", "SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders")
def q_hinted_uri_source(spark, sf):
    """An explicit modality wins for a file URI with a hint word in it."""
    path = scratch_path(spark, "upstream topic") + "/orders"
    tables.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"), path)
    uri = path if "://" in path else "file://" + path
    rows = spark.read.parquet(run_source(spark, uri, "source", modality="structured")["lakehouse_path"])
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), "o_orderstatus", "o_orderpriority")


# --- other formats ------------------------------------------------------------------
@query("mixed_source_rows", """
SELECT o_orderkey, ['csv', 'json', 'xml', 'yaml', 'txt'][o_orderkey % 5 + 1] AS format, o_orderstatus FROM orders
""")
def q_mixed_source_rows(spark, sf):
    """A folder of CSV, JSON, XML, YAML and other files is stored
    whole: rows of the row formats, documents and bytes of the others."""
    root = scratch_path(spark, "mixed in") + "/in"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    part = lambda k: o.filter(F.col("o_orderkey") % 5 == k)
    line = F.concat_ws(" ", F.concat(F.col("o_orderkey"), F.lit(":")), "o_orderstatus")
    tables.write_csv(part(0), root + "/csv")
    part(1).write.json(root + "/json")
    part(2).write.option("rowTag", "order").option("rootTag", "orders").xml(root + "/xml")
    tables.write_csv(part(3).select(line), root + "/yaml", header=False, extension="yaml")
    part(4).select(line).write.text(root + "/txt")
    rows = spark.read.parquet(run_source(spark, root, "source", options={"rowTag": "order"})["lakehouse_path"])
    text = F.coalesce("document", F.col("content").cast("string"))
    lines = F.when(text.isNotNull(), F.split(F.btrim(text, F.lit("\n")), "\n")).otherwise(F.array(F.lit(None).cast("string")))
    ext = F.regexp_extract("_source_file", r"\.([a-z]+)$", 1)
    long = rows.select("o_orderkey", "o_orderstatus", ext.alias("format"), F.explode(lines).alias("line"))
    return long.select(F.coalesce(F.substring_index("line", ":", 1), F.col("o_orderkey").cast("string")).cast("bigint").alias("o_orderkey"),
                       "format", F.coalesce(F.substring_index("line", " ", -1), "o_orderstatus").alias("o_orderstatus"))


@query("binary_source_rows", "SELECT event_id, event_type FROM events")
def q_binary_source_rows(spark, sf):
    """A video source stores the bytes of its files."""
    root = scratch_path(spark, "video in") + "/in"
    e = table(spark, sf, "events").select(F.concat_ws(" ", "event_id", "event_type").alias("line"))
    tables.write_csv(e, root, header=False, extension="mp4")
    rows = spark.read.parquet(run_source(spark, root, "source", worker="video")["lakehouse_path"])
    line = F.explode(F.split(F.btrim(F.col("content").cast("string"), F.lit("\n")), "\n"))
    return rows.select(line.alias("line")).select(F.substring_index("line", " ", 1).cast("bigint").alias("event_id"),
                                                  F.substring_index("line", " ", -1).alias("event_type"))


#: The keys below cut every file; a lake does so above the bytes that one Spark value can hold.
CUT = {"rowBytes": 0, "chunkBytes": 4096}


@query("large_file_chunks", f"""
WITH d AS (SELECT COALESCE(doc_id, 0) AS id, md5(COALESCE(text, '')) AS h FROM documents),
f AS (SELECT id % 16 AS file, string_agg(id || ' ' || h || chr(10), '' ORDER BY id, h) AS s FROM d GROUP BY ALL),
c AS (SELECT file, strlen(s) AS size_bytes, s, unnest(range((strlen(s) + {CUT["chunkBytes"] - 1}) // {CUT["chunkBytes"]})) AS i FROM f)
SELECT file, size_bytes, count(*) AS n_chunks,
       sha256(string_agg(sha256(substr(s, i * {CUT["chunkBytes"]} + 1, {CUT["chunkBytes"]})), '' ORDER BY i)) AS digest, true AS complete
FROM c GROUP BY file, size_bytes
""")
def q_large_file_chunks(spark, sf):
    """Files stored in chunks of fixed size, told by the digest of their chunks' digests."""
    root = scratch_path(spark, "large video") + "/in"
    d = table(spark, sf, "documents").select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.md5(F.coalesce("text", F.lit(""))).alias("h"))
    d = d.withColumn("file", F.col("id") % 16)
    # a file is written by one task in its order, which is the case under test
    d = d.repartition(16, "file").sortWithinPartitions("file", "id", "h").select("file", F.concat_ws(" ", "id", "h").alias("line"))
    d.write.partitionBy("file").option("extension", "mp4").csv(root)
    rows = spark.read.parquet(run_source(spark, root, "source", worker="video", options=CUT)["lakehouse_path"])
    found = chunks.chunk_digests(rows.filter("content IS NOT NULL").withColumnRenamed("_offset", "offset"))
    return found.select(F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file"), "size_bytes", "n_chunks", "digest", "complete")


@query("large_text_lines", r"""
SELECT doc_id, doc_id % 16 AS file, sha256(replace(COALESCE(text, ''), chr(10), ' ')) AS text_sha256 FROM documents
""")
def q_large_text_lines(spark, sf):
    """Text files stored in chunks of whole lines; every line of every file is there once, whole."""
    root = scratch_path(spark, "large text") + "/in"
    line = F.concat(F.col("doc_id").cast("string"), F.lit("\t"), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit(" ")))
    d = table(spark, sf, "documents").select((F.col("doc_id") % 16).alias("file"), line.alias("line"))
    d.repartition(16, "file").write.partitionBy("file").text(root)
    rows = spark.read.parquet(run_source(spark, root, "source", worker="text", options=CUT)["lakehouse_path"])
    each = rows.select("path", F.explode(F.split(F.regexp_replace("text", r"\n\z", ""), "\n")).alias("line"))
    return each.select(F.substring_index("line", "\t", 1).cast("bigint").alias("doc_id"),
                       F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file"),
                       F.sha2(F.expr("substring(line, instr(line, '\t') + 1)"), 256).alias("text_sha256"))


# --- gates, rules -------------------------------------------------------------------
GATE_LIMIT = 499900


@query("gate_rows", f"""
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS source, o_totalprice > {GATE_LIMIT} AS bad FROM orders),
s AS (SELECT source, bool_or(bad) AS bad FROM o GROUP BY source)
SELECT o_orderkey, o.source, CASE WHEN s.bad THEN 'quarantined' ELSE 'stored' END AS side
FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source
""")
def q_gate_rows(spark, sf):
    """Rows of both sides of the source gate, rows without a source among them."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("source"))
    good, bad, _ = quality.source_gate(quality.apply_rules(o, [quality.in_range("o_totalprice", hi=GATE_LIMIT)]), "source")
    return good.select("o_orderkey", "source", F.lit("stored").alias("side")).unionByName(
        bad.select("o_orderkey", "source", F.lit("quarantined").alias("side")))


RULES = [{"range": "o_totalprice", "hi": 400000, "name": "price"}, {"domain": "o_orderstatus", "values": ["F", "O"], "name": "status"},
         {"pattern": "o_orderpriority", "regex": "^[1-4]", "name": "priority"}, {"unique": "o_orderkey"}]


@query("configured_rules", """
SELECT o_orderkey, concat_ws('|', CASE WHEN o_totalprice > 400000 THEN 'price' END,
       CASE WHEN o_orderstatus NOT IN ('F', 'O') THEN 'status' END,
       CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]') THEN 'priority' END) AS reasons, o_orderpriority
FROM orders
""")
def q_configured_rules(spark, sf):
    """D8, D9 from a source's options: values written with blanks around them
    and an all-blank line are cleaned, then the configured rules tag the rows."""
    root = scratch_path(spark, "orders csv") + "/in"
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                          F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit("\t")).alias("o_orderpriority"))
    o = o.withColumns({c: F.col(c).cast("string") for c in ("o_orderkey", "o_totalprice")})
    blank = spark.range(1).select(*[F.lit("  ").alias(c) for c in o.columns])
    w = o.unionByName(blank).write.option("header", True).option("escape", '"') \
        .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
    w.csv(root)
    rows = stored(spark, run_source(spark, root, "record", options={"rules": json.dumps(RULES), "clean": "true"}))
    return rows.select(F.col("o_orderkey").cast("bigint").alias("o_orderkey"), F.array_join("_reasons", "|").alias("reasons"), "o_orderpriority")


@query("stream_source_gate", """
SELECT 'quarantined' AS status, count(*) AS record_count,
       count(*) FILTER (WHERE event_type = 'error' OR event_type = 'click') AS invalid_count,
       CAST(0 AS BIGINT) AS n_exposed FROM events
""")
def q_stream_source_gate(spark, sf):
    """W7 with rules and the source gate: one rejected message of the run
    quarantines all of its rows."""
    (src, _) = _kafka_files(spark, sf, damaged=_damaged())
    rules = [{"domain": "fields['event_type']", "values": ["view", "purchase", "signup", "error"], "name": "type"}]
    kinds = [r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect()]  # a handful
    rules[0]["values"] = sorted(k for k in kinds if k != "click")
    row = run_source(spark, src, "source", modality="streaming", options={"format": "parquet", "rules": json.dumps(rules)})
    return spark.createDataFrame([(row["status"], row["record_count"], row["invalid_count"], int(row["lakehouse_path"] is not None))],
                                 "status string, record_count bigint, invalid_count bigint, n_exposed bigint")


def _stream_drops(spark, sf, drops, gates, options) -> DataFrame:
    """Rows of a stream that are readable after one run for each of ``drops``
    (conditions on ``events`` whose rows arrive before the run)."""
    src, lake = scratch_path(spark, "drops") + "/kafka", Lake(scratch_path(spark, "lake"))
    source = config.sources_from_rows(spark, [{"name": "s", "path": src, "modality": "streaming", "options": options}])
    for k, (drop, gate) in enumerate(zip(drops, gates)):
        _kafka_rows(table(spark, sf, "events").filter(drop)).write.mode("append").parquet(src)
        row = ingest_sources(spark, source, lake, run_id=f"run-{k}", gate=gate).first()
        if row["status"] == "failed":
            raise RuntimeError(row["error"])
    return read_current(spark, lake, "s")


@query("stream_gate_rows", """
SELECT event_id, event_type FROM events WHERE event_id % 3 <> 1 AND event_type <> 'click'
""")
def q_stream_gate_rows(spark, sf):
    """A stored, a refused (one kind of event is not allowed) and a
    stored run of one stream; the readable rows are those of the stored runs."""
    kinds = sorted(r[0] for r in table(spark, sf, "events").select("event_type").distinct().collect())  # a handful
    rules = [{"domain": "fields['event_type']", "values": [k for k in kinds if k != "click"], "name": "type"}]
    third, allowed = F.col("event_id") % 3, F.col("event_type") != "click"
    rows = _stream_drops(spark, sf, [(third == 0) & allowed, third == 1, (third == 2) & allowed], ["source"] * 3,
                         {"format": "parquet", "rules": json.dumps(rules)})
    return rows.select(F.col("fields")["event_id"].cast("bigint").alias("event_id"), F.col("fields")["event_type"].alias("event_type"))


@query("stream_unique", """
WITH e AS (SELECT event_id, user_id, CAST(value AS DECIMAL(12,2)) AS v, event_id % 2 AS run FROM events),
k AS (SELECT run, user_id, v, min(event_id) AS event_id FROM e GROUP BY ALL HAVING count(*) = 1)
SELECT event_id FROM k WHERE run = 0 OR NOT EXISTS (
  SELECT 1 FROM k f WHERE f.run = 0 AND f.user_id = k.user_id AND f.v = k.v)
""")
def q_stream_unique(spark, sf):
    """D9 on decoded fields of a stream: a key that occurs twice in a batch,
    or in the accepted rows of an earlier run, is rejected."""
    half = F.col("event_id") % 2
    rows = _stream_drops(spark, sf, [half == 0, half == 1], ["record"] * 2, {
        "format": "parquet", "rules": json.dumps([{"unique": ["fields['user_id']", "fields['value']"]}])})
    return rows.select(F.col("fields")["event_id"].cast("bigint").alias("event_id"))


#: Entries of one configuration document.
CONFIG_ENTRIES = 10_000


@query("config_sources", """
SELECT p_name || ' ' || p_partkey AS name, '/data/' || p_brand AS path, CASE WHEN p_partkey % 2 = 0 THEN 'structured' END AS modality,
       CASE WHEN p_partkey % 3 = 0 THEN 'batch' END AS load_mode, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_size AS VARCHAR) END AS limit_option
FROM part
""")
def q_config_sources(spark, sf):
    """A1: a JSON configuration, in as many documents as it takes, with a source for each part; what an entry leaves out is null,
    options of any type are text."""
    p, key = table(spark, sf, "part"), F.col("p_partkey")
    mode_key = config.MODE_KEY
    entry = F.struct(F.concat_ws(" ", "p_name", key).alias("name"), F.concat(F.lit("/data/"), "p_brand").alias("path"),
                     F.when(key % 2 == 0, F.lit("structured")).alias("modality"), F.when(key % 3 == 0, F.lit("batch")).alias(mode_key),
                     F.when(key % 5 == 0, F.struct(F.col("p_size").alias("limit"))).alias("options"))
    path = scratch_path(spark, "config")
    # a folder of documents, each with some thousand entries: a document is read whole by one task
    entries = p.select(entry.alias("e"))
    entries = entries.repartition(max(1, -(-entries.count() // CONFIG_ENTRIES)))
    documents = entries.groupBy(F.spark_partition_id().alias("part")).agg(F.collect_list("e").alias("sources"))
    documents.select("sources").write.option("maxRecordsPerFile", 1).json(path)
    got = config.load_sources(spark, path)
    return got.select("name", "path", "modality", "load_mode", F.col("options")["limit"].alias("limit_option"))


@query("run_phases", """
SELECT 'discover' AS phase, CAST(3 AS BIGINT) AS items UNION ALL SELECT 'stage', count(*) FROM orders
""")
def q_run_phases(spark, sf):
    """What each phase of a run handled (fields, records); seconds are measured beside it."""
    root, lake = scratch_path(spark, "phases") + "/in", Lake(scratch_path(spark, "lake"))
    tables.write_csv(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), root)
    ingest_sources(spark, config.sources_from_rows(spark, [{"name": "s", "path": root}]), lake)
    return lake.read_section(spark, "phases").filter("phase <> 'list' AND seconds >= 0").select("phase", "items")


@query("schema_versions_by_time", """
WITH e AS (SELECT event_type, event_id, ts, CAST(event_id % 7 < 3 AS INTEGER) AS sig FROM events),
c AS (SELECT *, sig IS DISTINCT FROM lag(sig) OVER w OR row_number() OVER w = 1 AS changed FROM e
      WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
SELECT event_id, changed, CAST(sum(CAST(changed AS INTEGER)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS version
FROM c
""")
def q_schema_versions_by_time(spark, sf):
    """C7 with a sparse order column (event time)."""
    e = table(spark, sf, "events").select("event_type", "event_id", F.struct("ts", "event_id").alias("at"),
                                          (F.col("event_id") % 7 < 3).cast("string").alias("sig"))
    v = schema.versions_by_change(e, "event_type", "at", "sig")
    return v.select("event_id", "changed", F.col("version").cast("bigint").alias("version"))
