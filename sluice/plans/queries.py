"""Driver query keys: each runs a real operator over the
driver tables (or data Spark derives from them) and has, where SQL can say
it, an independent DuckDB oracle over the same tables.

Conventions: every integer output is BIGINT, computed fractions are DOUBLE
from exact operations (bit-identical on both sides), no partially-NULL integers,
no wall-clock values, and computed columns carry the same alias on both
sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec
from ..functions.paths import (IMAGE_EXTENSIONS, SEMI_STRUCTURED_EXTENSIONS, STREAMING_HINT_PATTERN,
                               STRUCTURED_EXTENSIONS, VIDEO_EXTENSIONS, has_streaming_hint,
                               modality_of_extension, path_parts)
from ..functions.text import first_line, lines
from ..operators import catalog, profile, quality, route, schema
from ..sources.files import bounded_take
from . import derive

QUERIES: dict = {}
ORACLES: dict = {}


def query(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return deco


def _sql_list(values) -> str:
    return ", ".join("NULL" if v is None else f"'{v}'" for v in values)


table = derive.table
WS = r"[ \t\n\r\f\x0B]"
WS_EDGE = rf"^{WS}+|{WS}+\z"
STRUCT_SQL = _sql_list(STRUCTURED_EXTENSIONS)
SEMI_SQL = _sql_list(SEMI_STRUCTURED_EXTENSIONS)
IMAGE_SQL = _sql_list(IMAGE_EXTENSIONS)
VIDEO_SQL = _sql_list(VIDEO_EXTENSIONS)

# --- SQL twins of the derivation rules in derive.py ---------------------------
MANIFEST_CTE = f"""
manifest AS (
  SELECT source AS source_name, doc_id, n_chars AS size_bytes, text,
         '/lake/' || source || '/d' || CAST(doc_id % 3 AS VARCHAR) || '/doc_' || CAST(doc_id AS VARCHAR) || ext AS path,
         'doc_' || CAST(doc_id AS VARCHAR) || ext AS file_name,
         lower(ext) AS extension
  FROM (SELECT *, [{_sql_list(derive.EXT_CYCLE)}][((doc_id % 20) + (doc_id // 20) % ((doc_id % 20) % 5 + 1)) % {len(derive.EXT_CYCLE)} + 1] AS ext
        FROM documents) x
)"""

SOURCES_CTE = f"""
srcs AS (SELECT source AS name, CAST(substr(source, 4) AS INTEGER) AS k FROM (SELECT DISTINCT source FROM documents) s),
sources AS (
  SELECT name,
         CASE WHEN k % 8 = 3 THEN '/lake/upstream/' || name ELSE '/lake/' || name END AS path,
         CASE WHEN k % 6 = 5 THEN 'semi_structured' END AS modality,
         CASE WHEN k % 9 = 4 THEN 'stream' END AS load_mode,
         [{_sql_list(derive.WORKER_CYCLE)}][k % {len(derive.WORKER_CYCLE)} + 1] AS worker
  FROM srcs
)"""

ROUTED_CTE = f"""
flags AS (
  SELECT source_name, bool_or(extension IN ({STRUCT_SQL})) AS hs, bool_or(extension IN ({SEMI_SQL})) AS hsemi
  FROM manifest GROUP BY source_name
),
routed AS (
  SELECT s.name AS source, s.worker,
         COALESCE(s.modality,
                  CASE WHEN regexp_matches(lower(s.path), '{STREAMING_HINT_PATTERN}') THEN 'streaming'
                       WHEN f.hs THEN 'structured' WHEN f.hsemi THEN 'semi_structured'
                       ELSE 'unstructured' END) AS modality,
         s.load_mode AS explicit_mode
  FROM sources s LEFT JOIN flags f ON s.name = f.source_name
)"""

PAGE_PARTS_CTE = r"""
pn AS (SELECT page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1) AS file_name FROM pages),
pe AS (SELECT page_id, file_name, regexp_extract(file_name, '^.+(\.[^.]+)$', 1) AS suf FROM pn),
page_parts AS (
  SELECT page_id, file_name,
         CASE WHEN suf = '' THEN file_name ELSE regexp_replace(file_name, '\.[^.]+$', '') END AS stem,
         lower(suf) AS extension
  FROM pe
)"""


def _lang_key_sql(fields_by_lang, other):
    def key(pairs):
        return ",".join(sorted(f"{n}:{t}" for n, t in pairs))
    whens = " ".join(f"WHEN '{lang}' THEN '{key(p)}'" for lang, p in fields_by_lang.items())
    return f"CASE lang {whens} ELSE '{key(other)}' END"


def _lang_list_sql(fields_by_lang, other):
    def lst(pairs):
        return "[" + ", ".join(f"'{n}:{t}'" for n, t in pairs) + "]"
    whens = " ".join(f"WHEN '{lang}' THEN {lst(p)}" for lang, p in fields_by_lang.items())
    return f"CASE lang {whens} ELSE {lst(other)} END"


VERSIONS_CTE = f"""
att AS (
  SELECT source AS source_name, doc_id, lang, text,
         CASE WHEN n_chars > {derive.SEMI_STRUCTURED_MIN_CHARS} THEN 'semi_structured' ELSE 'structured' END AS modality,
         {_lang_key_sql(derive.LANG_FIELDS, derive.OTHER_LANG_FIELDS)} AS fields_key
  FROM documents
),
lagged AS (
  SELECT *, lag(modality || '|' || fields_key) OVER (PARTITION BY source_name ORDER BY doc_id) AS prev_sig
  FROM att
),
chg AS (SELECT *, (prev_sig IS NULL OR prev_sig <> modality || '|' || fields_key) AS changed FROM lagged),
versions AS (
  SELECT *, CAST(sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (
             PARTITION BY source_name ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS version
  FROM chg
)"""

RUNS_CTE = VERSIONS_CTE + f""",
runs0 AS (
  SELECT doc_id AS run_id, source_name, modality, version AS schema_version,
         CAST(len(string_split(text, chr(10))) AS BIGINT) AS record_count,
         CAST(len(list_filter(string_split(text, chr(10)), lambda l: regexp_replace(l, '{WS_EDGE}', '', 'g') = '')) AS BIGINT) AS invalid_count
  FROM versions
),
runs AS (
  SELECT *, greatest(record_count - invalid_count, 0) AS valid_count,
         CASE WHEN invalid_count = 0 THEN 'stored' ELSE 'quarantined' END AS status,
         '/lake/' || source_name AS source_path,
         '/staging/' || source_name || '/_v=' || CAST(run_id AS VARCHAR) AS staging_path,
         CASE WHEN invalid_count = 0 THEN '/lakehouse/t_' || source_name || '/_v=' || CAST(run_id AS VARCHAR) END AS lakehouse_path,
         CASE WHEN invalid_count > 0 THEN '/quarantine/' || source_name || '/_v=' || CAST(run_id AS VARCHAR) END AS quarantine_path
  FROM runs0
)"""


# ============================================================================
# A16 bounded take
# ============================================================================
@query("bounded_take", """
SELECT event_id, user_id, event_type, value FROM events ORDER BY event_id LIMIT 5
""")
def q_bounded_take(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value")
    return bounded_take(ev, 5, "event_id")


# ============================================================================
# B1, B2, B6 routing predicates and path parts
# ============================================================================
@query("path_parts", f"WITH {PAGE_PARTS_CTE.strip()} SELECT page_id, file_name, stem, extension FROM page_parts")
def q_path_parts(spark, sf):
    p = table(spark, sf, "pages").select("page_id", path_parts("url", url=True).alias("p"))
    return p.select("page_id", "p.file_name", "p.stem", "p.extension")


@query("modality_by_extension", f"""
WITH {PAGE_PARTS_CTE.strip()}, {MANIFEST_CTE.strip()},
items AS (
  SELECT 'page:' || CAST(page_id AS VARCHAR) AS item, extension FROM page_parts
  UNION ALL
  SELECT 'doc:' || CAST(doc_id AS VARCHAR) AS item, extension FROM manifest
)
SELECT item, extension,
       CASE WHEN extension IN ({STRUCT_SQL}) THEN 'structured'
            WHEN extension IN ({SEMI_SQL}) THEN 'semi_structured' ELSE 'unstructured' END AS modality
FROM items
""")
def q_modality_by_extension(spark, sf):
    pages = table(spark, sf, "pages").select(
        F.concat(F.lit("page:"), F.col("page_id").cast("string")).alias("item"),
        path_parts("url", url=True)["extension"].alias("extension"))
    docs = derive.document_manifest(table(spark, sf, "documents")).select(
        F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("item"), "extension")
    items = pages.unionByName(docs)
    return items.select("item", "extension", modality_of_extension(F.col("extension")).alias("modality"))


HINT_SUFFIX_SQL = ("CASE page_id % 6 WHEN 1 THEN '/Kafka/t1' WHEN 2 THEN '/upstream/x' "
                   "WHEN 4 THEN '/FlinkJobs' WHEN 5 THEN '/topics' ELSE '' END")


@query("streaming_hint", f"""
SELECT page_id, path, regexp_matches(lower(path), '{STREAMING_HINT_PATTERN}') AS is_streaming
FROM (SELECT page_id, url || {HINT_SUFFIX_SQL} AS path FROM pages) p
""")
def q_streaming_hint(spark, sf):
    pid = F.col("page_id") % 6
    suffix = (F.when(pid == 1, "/Kafka/t1").when(pid == 2, "/upstream/x").when(pid == 4, "/FlinkJobs")
              .when(pid == 5, "/topics").otherwise(""))
    p = table(spark, sf, "pages").select("page_id", F.concat("url", suffix).alias("path"))
    return p.select("page_id", "path", has_streaming_hint(F.col("path")).alias("is_streaming"))


# ============================================================================
# B3-B5 routing, C5 first file
# ============================================================================
def _routed(spark, sf):
    docs = table(spark, sf, "documents")
    return route.route_sources(derive.document_sources(docs), derive.document_manifest(docs))


@query("modality_precedence", f"""
WITH {MANIFEST_CTE.strip()}, {SOURCES_CTE.strip()}, {ROUTED_CTE.strip()}
SELECT source, modality FROM routed
""")
def q_modality_precedence(spark, sf):
    return _routed(spark, sf).select(F.col("name").alias("source"), "modality")


@query("load_mode", f"""
WITH {MANIFEST_CTE.strip()}, {SOURCES_CTE.strip()}, {ROUTED_CTE.strip()}
SELECT source, modality,
       COALESCE(explicit_mode, CASE WHEN modality = 'streaming' THEN 'stream' ELSE 'batch' END) AS load_mode
FROM routed
""")
def q_load_mode(spark, sf):
    return _routed(spark, sf).select(F.col("name").alias("source"), "modality", "load_mode")


@query("worker_route", f"""
WITH {MANIFEST_CTE.strip()}, {SOURCES_CTE.strip()}, {ROUTED_CTE.strip()}
SELECT source, modality,
       CASE WHEN worker IN ('image', 'video', 'text', 'streaming') THEN worker
            WHEN ends_with(worker, '_script') THEN 'unsupported'
            WHEN modality IN ('structured', 'semi_structured') THEN 'direct'
            WHEN modality = 'streaming' THEN 'streaming'
            ELSE 'text' END AS worker
FROM routed
""")
def q_worker_route(spark, sf):
    return _routed(spark, sf).select(F.col("name").alias("source"), "modality",
                                     F.col("worker_name").alias("worker"))


@query("first_file", f"""
WITH {MANIFEST_CTE.strip()}
SELECT source_name,
       COALESCE(min(path) FILTER (WHERE extension = '.csv'), min(path) FILTER (WHERE extension = '.tsv')) AS first_tabular,
       min(path) FILTER (WHERE extension = '.json') AS first_json
FROM manifest GROUP BY source_name
""")
def q_first_file(spark, sf):
    m = derive.document_manifest(table(spark, sf, "documents"))
    return route.first_files(m, {"first_tabular": (".csv", ".tsv"), "first_json": (".json",)})


@query("manifest_summary_synthetic", f"""
WITH {MANIFEST_CTE.strip()}
SELECT source_name, count(*) AS file_count, CAST(sum(size_bytes) AS BIGINT) AS size_bytes,
       array_to_string(list_sort(list_distinct(list(extension))), ',') AS extensions
FROM manifest GROUP BY source_name
""")
def q_manifest_summary_synthetic(spark, sf):
    m = derive.document_manifest(table(spark, sf, "documents"))
    s = route.manifest_summary(m)
    return s.select("source_name", "file_count", F.col("size_bytes").cast("bigint").alias("size_bytes"),
                    F.array_join("extensions", ",").alias("extensions"))


# ============================================================================
# C1 header fields, C2 JSON field types
# ============================================================================
@query("header_fields", f"""
WITH h AS (SELECT conv_id, turn, string_split(split_part(text, chr(10), 1), ',') AS cells FROM conversations),
c AS (SELECT conv_id, turn, unnest(cells) AS cell, unnest(range(0, len(cells))) AS pos FROM h),
n AS (SELECT conv_id, turn, pos,
             coalesce(nullif(regexp_replace(cell, '{WS_EDGE}', '', 'g'), ''), 'column_' || CAST(pos AS VARCHAR)) AS name
      FROM c)
SELECT conv_id, turn, CAST(min(pos) AS BIGINT) AS pos, name FROM n GROUP BY conv_id, turn, name
""")
def q_header_fields(spark, sf):
    conv = table(spark, sf, "conversations")
    cells = F.split(first_line(F.col("text")), ",", -1)
    f = conv.select("conv_id", "turn", F.explode(schema.header_fields(cells)).alias("f"))
    return f.select("conv_id", "turn", F.col("f.pos").cast("bigint").alias("pos"), F.col("f.name").alias("name"))


@query("json_field_types", """
SELECT k AS key,
       CASE json_type(props, '$."' || k || '"')
            WHEN 'BIGINT' THEN 'int' WHEN 'UBIGINT' THEN 'int' WHEN 'DOUBLE' THEN 'float'
            WHEN 'VARCHAR' THEN 'str' WHEN 'BOOLEAN' THEN 'bool' WHEN 'ARRAY' THEN 'list'
            WHEN 'OBJECT' THEN 'dict' WHEN 'NULL' THEN 'NoneType' END AS type_name,
       count(*) AS n
FROM (SELECT props, unnest(json_keys(props)) AS k FROM events WHERE json_type(props) = 'OBJECT') e
GROUP BY ALL
""")
def q_json_field_types(spark, sf):
    return schema.json_field_types(table(spark, sf, "events"), "props")


# ============================================================================
# C6-C9 schema registry
# ============================================================================
def _attempts(spark, sf):
    """Registration attempts without the document text (never shuffled)."""
    return derive.document_attempts(table(spark, sf, "documents")).drop("text", "lang")


def _versions(spark, sf, attempts=None):
    a = attempts if attempts is not None else _attempts(spark, sf)
    a = a.withColumn("_sig", schema.snapshot_signature(F.col("fields"), F.col("modality")))
    return schema.versions_by_change(a, "source_name", "attempt_id", "_sig")


@query("schema_versions", f"""
WITH {VERSIONS_CTE.strip()}
SELECT source_name, doc_id, changed, version FROM versions
""")
def q_schema_versions(spark, sf):
    v = _versions(spark, sf)
    return v.select("source_name", F.col("attempt_id").alias("doc_id"), "changed",
                    F.col("version").cast("bigint").alias("version"))


@query("schema_evolution", f"""
WITH {VERSIONS_CTE.strip()},
last AS (SELECT source_name, max(doc_id) AS doc_id FROM versions GROUP BY source_name)
SELECT v.source_name, v.changed AS evolved, v.version
FROM versions v JOIN last l ON v.source_name = l.source_name AND v.doc_id = l.doc_id
""")
def q_schema_evolution(spark, sf):
    """Live path: register all but each source's last attempt (batch form),
    then evolve the last attempt against that registry."""
    a = _attempts(spark, sf)
    last = a.groupBy("source_name").agg(F.max("attempt_id").alias("attempt_id"))
    discovered = a.join(last, ["source_name", "attempt_id"], "left_semi")
    history = a.join(last, ["source_name", "attempt_id"], "left_anti")
    registry = schema.registry_from_history(history)
    e = schema.evolve(discovered.select("source_name", "modality", "fields"), registry)
    return e.select("source_name", "evolved", F.col("version").cast("bigint").alias("version"))


@query("schema_latest", f"""
WITH {VERSIONS_CTE.strip()},
reg AS (SELECT * FROM versions WHERE changed),
mx AS (SELECT source_name, max(version) AS version FROM reg GROUP BY source_name)
SELECT r.source_name, r.version, r.modality, r.fields_key
FROM reg r JOIN mx ON r.source_name = mx.source_name AND r.version = mx.version
""")
def q_schema_latest(spark, sf):
    registry = schema.registry_from_history(_attempts(spark, sf))
    latest = schema.latest_versions(registry.select("source_name", "version", "modality", "fields"))
    return latest.select("source_name", F.col("version").cast("bigint").alias("version"), "modality",
                         schema.fields_key(F.col("fields")).alias("fields_key"))


@query("schema_diff", f"""
WITH {VERSIONS_CTE.strip()},
reg AS (SELECT source_name, version, lang FROM versions WHERE changed),
f AS (SELECT source_name, version, unnest({_lang_list_sql(derive.LANG_FIELDS, derive.OTHER_LANG_FIELDS)}) AS ft FROM reg),
cur AS (SELECT source_name, version, split_part(ft, ':', 1) AS name, split_part(ft, ':', 2) AS type FROM f),
prev AS (
  SELECT c.source_name, c.version + 1 AS version, c.name, c.type AS prev_type FROM cur c
  WHERE EXISTS (SELECT 1 FROM reg r WHERE r.source_name = c.source_name AND r.version = c.version + 1)
)
SELECT coalesce(c.source_name, p.source_name) AS source_name, coalesce(c.version, p.version) AS version,
       coalesce(c.name, p.name) AS name,
       CASE WHEN p.prev_type IS NULL THEN 'added' WHEN c.type IS NULL THEN 'removed' ELSE 'retyped' END AS change
FROM cur c FULL OUTER JOIN prev p ON c.source_name = p.source_name AND c.version = p.version AND c.name = p.name
WHERE coalesce(c.version, p.version) > 1
  AND (p.prev_type IS NULL OR c.type IS NULL OR c.type <> p.prev_type)
""")
def q_schema_diff(spark, sf):
    registry = schema.registry_from_history(_attempts(spark, sf))
    d = schema.schema_diff(registry.select("source_name", "version", "fields"))
    return d.select("source_name", F.col("version").cast("bigint").alias("version"), "name", "change")


# ============================================================================
# D5-D9 quality
# ============================================================================
@query("row_width", """
SELECT conv_id, turn, CAST(len(ls) AS BIGINT) AS n_lines,
       CAST(len(list_filter(ls, lambda l: len(string_split(l, ',')) < 3)) AS BIGINT) AS n_short,
       CAST(len(list_filter(ls, lambda l: len(string_split(l, ',')) > 3)) AS BIGINT) AS n_long
FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations) c
""")
def q_row_width(spark, sf):
    conv = table(spark, sf, "conversations")
    ls = lines(F.col("text"))

    def n_with(status):
        return F.size(F.filter(ls, lambda l: quality.width_status(F.size(F.split(l, ",", -1)), 3) == status))
    return conv.select("conv_id", "turn", F.size(ls).cast("bigint").alias("n_lines"),
                       n_with("short").cast("bigint").alias("n_short"),
                       n_with("long").cast("bigint").alias("n_long"))


LINEITEM_RULES_SQL = """concat_ws('|',
    CASE WHEN l.l_quantity > 45 THEN 'range:l_quantity' END,
    CASE WHEN l.l_discount > 0.08 THEN 'range:l_discount' END,
    CASE WHEN l.l_returnflag NOT IN ('N', 'R') THEN 'domain:l_returnflag' END,
    CASE WHEN l.l_linestatus NOT IN ('O', 'F') THEN 'domain:l_linestatus' END,
    CASE WHEN l.l_orderkey IS NULL THEN 'not_null:l_orderkey' END,
    CASE WHEN d.l_orderkey IS NOT NULL THEN 'unique:l_orderkey,l_linenumber' END)"""


def lineitem_rules():
    return [quality.in_range("l_quantity", hi=45), quality.in_range("l_discount", hi=0.08),
            quality.in_domain("l_returnflag", ["N", "R"]), quality.in_domain("l_linestatus", ["O", "F"]),
            quality.not_null("l_orderkey")]


@query("quality_rules", f"""
WITH d AS (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1),
t AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, {LINEITEM_RULES_SQL} AS reasons
  FROM lineitem l LEFT JOIN d ON l.l_orderkey = d.l_orderkey AND l.l_linenumber = d.l_linenumber
)
SELECT * FROM t WHERE reasons <> ''
""")
def q_quality_rules(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                                         "l_quantity", "l_discount", "l_returnflag", "l_linestatus")
    tagged = quality.apply_rules(li, lineitem_rules(), unique=["l_orderkey", "l_linenumber"])
    bad = tagged.filter(F.size(quality.REASONS) > 0)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                      F.array_join(quality.REASONS, "|").alias("reasons"))


ORDER_RULES_SQL = """concat_ws('|',
    CASE WHEN o_custkey IS NULL THEN 'not_null:o_custkey' END,
    CASE WHEN o_totalprice < 1000 OR o_totalprice > 450000 THEN 'range:o_totalprice' END,
    CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN 'domain:o_orderstatus' END,
    CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-5]-[A-Z ]+$') THEN 'pattern:o_orderpriority' END)"""


def order_rules():
    return [quality.not_null("o_custkey"), quality.in_range("o_totalprice", lo=1000, hi=450000),
            quality.in_domain("o_orderstatus", ["O", "F"]),
            quality.matches("o_orderpriority", r"^[1-5]-[A-Z ]+$")]


@query("record_gate", f"""
SELECT reasons, count(*) AS n FROM (SELECT {ORDER_RULES_SQL} AS reasons FROM orders) o GROUP BY reasons
""")
def q_record_gate(spark, sf):
    tagged = quality.apply_rules(table(spark, sf, "orders"), order_rules())
    valid, invalid = quality.record_gate(tagged)
    v = valid.select(F.lit("").alias("reasons"))
    i = invalid.select(F.array_join(quality.REASONS, "|").alias("reasons"))
    return v.unionByName(i).groupBy("reasons").agg(F.count(F.lit(1)).alias("n"))


SOURCE_GATE_LIMIT = 499900


@query("source_gate", f"""
SELECT o_orderpriority AS source,
       CASE WHEN count(*) FILTER (WHERE o_totalprice > {SOURCE_GATE_LIMIT}) = 0 THEN 'stored' ELSE 'quarantined' END AS status,
       count(*) AS record_count,
       count(*) FILTER (WHERE o_totalprice > {SOURCE_GATE_LIMIT}) AS invalid_count,
       greatest(count(*) - count(*) FILTER (WHERE o_totalprice > {SOURCE_GATE_LIMIT}), 0) AS valid_count
FROM orders GROUP BY o_orderpriority
""")
def q_source_gate(spark, sf):
    tagged = quality.apply_rules(table(spark, sf, "orders").select("o_orderpriority", "o_totalprice"),
                                 [quality.in_range("o_totalprice", hi=SOURCE_GATE_LIMIT)])
    s = quality.source_gate_summary(tagged, "o_orderpriority")
    return s.select(F.col("o_orderpriority").alias("source"), "status", "record_count",
                    "invalid_count", "valid_count")


@query("clean_rows", f"""
WITH c AS (
  SELECT nullif(regexp_replace(text, '{WS_EDGE}', '', 'g'), '') AS text,
         nullif(regexp_replace(lang, '{WS_EDGE}', '', 'g'), '') AS lang
  FROM documents
),
d AS (SELECT DISTINCT text, lang FROM c WHERE text IS NOT NULL OR lang IS NOT NULL)
SELECT sha256(text) AS text_sha256, lang, CAST(length(text) AS BIGINT) AS n_chars FROM d
""")
def q_clean_rows(spark, sf):
    c = quality.clean_rows(table(spark, sf, "documents").select("text", "lang"), dedupe=True)
    return c.select(F.sha2("text", 256).alias("text_sha256"), "lang",
                    F.length("text").cast("bigint").alias("n_chars"))


@query("image_rule", f"""
WITH {MANIFEST_CTE.strip()}
SELECT source_name, count(*) AS n_files,
       count(*) FILTER (WHERE extension NOT IN ({IMAGE_SQL}) AND extension <> '.csv') AS n_invalid
FROM manifest GROUP BY source_name
""")
def q_image_rule(spark, sf):
    m = derive.document_manifest(table(spark, sf, "documents"))
    return m.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(quality.image_file_invalid(F.col("extension"))).alias("n_invalid"))


@query("video_rule", f"""
WITH {MANIFEST_CTE.strip()}
SELECT source_name, count(*) AS n_files,
       count(*) FILTER (WHERE extension NOT IN ({VIDEO_SQL})) AS n_invalid
FROM manifest GROUP BY source_name
""")
def q_video_rule(spark, sf):
    m = derive.document_manifest(table(spark, sf, "documents"))
    return m.groupBy("source_name").agg(
        F.count(F.lit(1)).alias("n_files"),
        F.count_if(quality.video_file_invalid(F.col("extension"))).alias("n_invalid"))


# ============================================================================
# P1-P5 counts and profiles
# ============================================================================
@query("record_counts", rf"""
WITH {MANIFEST_CTE.strip()},
r AS (SELECT *, greatest(len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) - 1, 0) AS csv_rows FROM manifest)
SELECT source_name,
       CAST(CASE WHEN bool_or(extension IN ('.csv', '.tsv')) THEN sum(csv_rows) FILTER (WHERE extension IN ('.csv', '.tsv'))
            ELSE count(*) END AS BIGINT) AS record_count,
       CASE WHEN bool_or(extension IN ('.csv', '.tsv')) THEN 'rows' ELSE 'files' END AS count_unit
FROM r GROUP BY source_name
""")
def q_record_counts(spark, sf):
    m = derive.document_manifest(table(spark, sf, "documents"))
    m = m.withColumn("csv_rows", profile.text_data_rows(F.col("text")))
    return profile.record_counts(m, "csv_rows")


@query("profile_counts", """
SELECT 'orders' AS source_name, 'structured' AS modality, 'batch' AS load_mode, count(*) AS record_count,
       count(*) FILTER (WHERE o_totalprice > 450000) AS invalid_count,
       greatest(count(*) - count(*) FILTER (WHERE o_totalprice > 450000), 0) AS valid_count FROM orders
UNION ALL
SELECT 'lineitem', 'structured', 'batch', count(*), count(*) FILTER (WHERE l_discount > 0.08),
       greatest(count(*) - count(*) FILTER (WHERE l_discount > 0.08), 0) FROM lineitem
UNION ALL
SELECT 'events', 'structured', 'batch', count(*), count(*) FILTER (WHERE value > 400),
       greatest(count(*) - count(*) FILTER (WHERE value > 400), 0) FROM events
""")
def q_profile_counts(spark, sf):
    specs = [("orders", F.col("o_totalprice") > 450000), ("lineitem", F.col("l_discount") > 0.08),
             ("events", F.col("value") > 400)]
    out = None
    for name, bad in specs:
        p = table(spark, sf, name).agg(*profile.profile_exprs(bad)).select(
            F.lit(name).alias("source_name"), F.lit("structured").alias("modality"),
            F.lit("batch").alias("load_mode"), "record_count", "invalid_count", "valid_count")
        out = p if out is None else out.unionByName(p)
    return out


@query("load_rate", """
SELECT event_type, count(*) AS records,
       (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000 AS span_seconds,
       count(*) * 1000000 / (epoch_us(max(ts)) - epoch_us(min(ts))) AS records_per_second
FROM events GROUP BY event_type
""")
def q_load_rate(spark, sf):
    return profile.load_rate(table(spark, sf, "events"), ["event_type"], "ts")


ORDER_PROFILE_COLS = [("o_orderkey", "num"), ("o_custkey", "num"), ("o_orderstatus", "str"),
                      ("o_totalprice", "num"), ("o_orderdate", "ts"), ("o_orderpriority", "str")]


def _column_profile_sql():
    parts = []
    for c, kind in ORDER_PROFILE_COLS:
        num = f"CAST(min({c}) AS DOUBLE)", f"CAST(max({c}) AS DOUBLE)"
        txt = f"CAST(min({c}) AS VARCHAR)", f"CAST(max({c}) AS VARCHAR)"
        ln = f"CAST(min(length(CAST({c} AS VARCHAR))) AS BIGINT)", f"CAST(max(length(CAST({c} AS VARCHAR))) AS BIGINT)"
        nulls_num = "CAST(NULL AS DOUBLE)"
        nulls_txt = "CAST(NULL AS VARCHAR)"
        mn, mx = num if kind == "num" else (nulls_num, nulls_num)
        tn, tx = txt if kind != "num" else (nulls_txt, nulls_txt)
        ln0, ln1 = ln
        parts.append(
            f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_null, "
            f"count(DISTINCT {c}) AS n_distinct, {mn} AS min_num, {mx} AS max_num, {tn} AS min_text, "
            f"{tx} AS max_text, {ln0} AS min_len, {ln1} AS max_len FROM orders")
    return "\nUNION ALL\n".join(parts)


@query("column_profile", _column_profile_sql())
def q_column_profile(spark, sf):
    o = table(spark, sf, "orders")
    return profile.column_profile(o, [c for c, _ in ORDER_PROFILE_COLS], exact=True)


MERGED_COLS = ("o_custkey", "o_totalprice", "o_orderstatus", "o_orderpriority")
MERGED_RANGE = "o_orderkey % 8 BETWEEN 2 AND 5"


def _merged_sql():
    parts = []
    for c in MERGED_COLS:
        text = c in ("o_orderstatus", "o_orderpriority")
        num, top = ("NULL::DOUBLE", "NULL::DOUBLE"), "NULL::VARCHAR"
        if text:
            top = (f"(SELECT string_agg(v || ':' || k, '|' ORDER BY k DESC, v) FROM (SELECT {c} AS v, count(*) AS k FROM orders "
                   f"WHERE {MERGED_RANGE} AND {c} IS NOT NULL GROUP BY {c}) t)")
        else:
            num = f"min({c})::DOUBLE", f"max({c})::DOUBLE"
        parts.append(f"SELECT '{c}' AS column_name, count(*) AS n, count(*) - count({c}) AS n_null, {num[0]} AS min_num, {num[1]} AS max_num, "
                     f"{top} AS top, true AS distinct_close, true AS quantiles_close FROM orders WHERE {MERGED_RANGE}")
    return "\nUNION ALL\n".join(parts)


@query("merged_column_statistics", _merged_sql())
def q_merged_column_statistics(spark, sf):
    """P5 of a range of versions from their stored sketches. Estimates are held against the exact numbers:
    distinct values within 5 %, the rank of each quantile within 2 % of the rows."""
    from ..operators import sketches
    from ..session import scratch_path
    o, ranks = table(spark, sf, "orders").withColumn("version", F.col("o_orderkey") % 8), (0.25, 0.5, 0.75)
    path = scratch_path(spark, "column statistics")
    sketches.column_sketches(o, MERGED_COLS, by=["version"]).write.parquet(path)
    merged = sketches.statistics(sketches.merge_sketches(spark.read.parquet(path).filter("version BETWEEN 2 AND 5")), ranks, 100)
    # a row a column of estimates reaches the driver; the exact numbers of the same rows are one aggregate
    cuts = {r["column_name"]: r["quantiles"] for r in merged.select("column_name", "quantiles").collect() if r["quantiles"]}
    rows = o.filter(MERGED_RANGE)
    below = [F.array(*[F.count_if(F.col(c) < F.lit(q)) for q in qs]).alias(f"lt_{c}") for c, qs in cuts.items()]
    upto = [F.array(*[F.count_if(F.col(c) <= F.lit(q)) for q in qs]).alias(f"le_{c}") for c, qs in cuts.items()]
    exact = rows.agg(*[F.countDistinct(c).alias(f"d_{c}") for c in MERGED_COLS], *below, *upto, *[F.count(c).alias(f"n_{c}") for c in cuts])

    def close(c):
        ok = F.lit(True)
        for i, r in enumerate(ranks if c in cuts else ()):
            ok = ok & (F.col(f"lt_{c}")[i] <= (r + 0.02) * F.col(f"n_{c}")) & (F.col(f"le_{c}")[i] >= (r - 0.02) * F.col(f"n_{c}"))
        return ok
    told = exact.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("d"), close(c).alias("quantiles_close"))
                                           for c in MERGED_COLS])))
    found = merged.join(F.broadcast(told), "column_name")  # a row a column
    # most frequent first, ties by value
    ordered = F.array_sort(F.transform("top", lambda x: F.struct((-x["count"]).alias("k"), x["item"].alias("item"))))
    top = F.array_join(F.transform(ordered, lambda x: F.concat(x["item"], F.lit(":"), (-x["k"]).cast("string"))), "|")
    return found.select("column_name", "n", "n_null", "min_num", "max_num", F.when(F.col("min_num").isNull(), top).alias("top"),
                        (F.abs(F.col("n_distinct") - F.col("d")) <= 0.05 * F.col("d")).alias("distinct_close"), "quantiles_close")


# ============================================================================
# K1, K3, K5, K6, K7, S9 catalog
# ============================================================================
def _runs(spark, sf):
    a = derive.with_run_counts(derive.document_attempts(table(spark, sf, "documents")).drop("lang"))
    return derive.document_runs(_versions(spark, sf, a))


RUN_ROW_SCHEMA = ("run_id bigint, source string, status string, modality string, load_mode string, "
                  "schema_version int, record_count bigint, invalid_count bigint, valid_count bigint, "
                  "output_path string, error string")


@query("run_summary", f"""
WITH {RUNS_CTE.strip()}
SELECT run_id, source_name AS source, status, modality, schema_version, record_count, invalid_count, valid_count,
       CASE WHEN status = 'stored' THEN lakehouse_path ELSE quarantine_path END AS output_path
FROM runs
""")
def q_run_summary(spark, sf):
    """K7 rows, written as the run summary file (S9, JSON Lines) and read back."""
    from ..session import scratch_path
    from ..sinks import tables
    path = scratch_path(spark, "run-summary") + "/runs"
    tables.write_run_summary(catalog.run_rows(_runs(spark, sf)), path)
    r = spark.read.schema(RUN_ROW_SCHEMA).json(path)
    return r.select("run_id", "source", "status", "modality", F.col("schema_version").cast("bigint")
                    .alias("schema_version"), "record_count", "invalid_count", "valid_count", "output_path")


@query("dataset_upsert", f"""
WITH {RUNS_CTE.strip()},
log AS (
  SELECT source_name, run_id, staging_path, schema_version, modality, CAST(NULL AS VARCHAR) AS lakehouse_path, 0 AS seq FROM runs
  UNION ALL
  SELECT source_name, run_id, staging_path, schema_version, modality, lakehouse_path, 1 AS seq FROM runs WHERE status = 'stored'
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_name ORDER BY run_id DESC, seq DESC) AS rn FROM log)
SELECT source_name, run_id, staging_path, schema_version, modality, lakehouse_path FROM ranked WHERE rn = 1
""")
def q_dataset_upsert(spark, sf):
    latest = catalog.latest_datasets(catalog.dataset_log(_runs(spark, sf)))
    return latest.select("source_name", "run_id", "staging_path",
                         F.col("schema_version").cast("bigint").alias("schema_version"), "modality", "lakehouse_path")


@query("exposed_datasets", f"""
WITH {RUNS_CTE.strip()},
e AS (SELECT source_name, max(run_id) FILTER (WHERE status = 'stored') AS exposed_run FROM runs GROUP BY source_name)
SELECT e.source_name, 'available' AS status, 'lakehouse_table_path' AS access_mode, r.lakehouse_path, e.exposed_run,
       CAST((SELECT min(q.run_id) FROM runs q WHERE q.source_name = e.source_name AND q.status = 'quarantined'
          AND q.run_id > e.exposed_run) AS VARCHAR) AS stale_since_run
FROM e JOIN runs r ON r.source_name = e.source_name AND r.run_id = e.exposed_run
""")
def q_exposed_datasets(spark, sf):
    e = catalog.exposed_datasets(_runs(spark, sf))
    # a nullable run id is emitted as text (no partially-NULL integer columns)
    return e.withColumn("stale_since_run", F.col("stale_since_run").cast("string"))


@query("lineage_edges", f"""
WITH {RUNS_CTE.strip()},
e AS (
  SELECT run_id, source_name, source_path AS from_path, staging_path AS to_path, 'route_to_temporary_staging' AS operation FROM runs
  UNION ALL
  SELECT run_id, source_name, staging_path, lakehouse_path, 'store_validated_data_in_lakehouse' FROM runs WHERE status = 'stored'
  UNION ALL
  SELECT run_id, source_name, staging_path, quarantine_path, 'quarantine:schema_or_quality_violation' FROM runs WHERE status = 'quarantined'
)
SELECT sha256(concat_ws('|', CAST(run_id AS VARCHAR), source_name, operation, from_path, to_path)) AS lineage_id,
       run_id, source_name, from_path, to_path, operation
FROM e
""")
def q_lineage_edges(spark, sf):
    e = catalog.lineage_edges(_runs(spark, sf))
    return e.select("lineage_id", "run_id", "source_name", "from_path", "to_path", "operation")


@query("text_entities", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars,
       CAST(len(list_filter(regexp_split_to_array(text, '{WS}+'), lambda t: t <> '')) AS BIGINT) AS n_words,
       CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines
FROM documents
""")
def q_text_entities(spark, sf):
    return catalog.text_entities(table(spark, sf, "documents"), "text", keys=["doc_id"])


# ============================================================================
# G1-G3 codec
# ============================================================================
TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss.SSSSSS"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S.%f"


def event_message(ev: DataFrame, *keep) -> DataFrame:
    """Events as ``k:v`` messages (G1); the timestamp carries colons.
    ``keep`` names further columns to carry along in the same projection."""
    return ev.select("event_id", *keep, codec.kv_encode(
        ("event_id", F.col("event_id")),
        ("ts", F.date_format("ts", TS_FMT_SPARK)),
        ("user_id", F.col("user_id")),
        ("event_type", F.col("event_type")),
        ("value", F.col("value").cast("decimal(12,2)"))).alias("message"))


EVENT_MESSAGE_SQL = (f"'event_id:' || CAST(event_id AS VARCHAR) || ',ts:' || strftime(ts, '{TS_FMT_SQL}') || "
                     "',user_id:' || CAST(user_id AS VARCHAR) || ',event_type:' || event_type || "
                     "',value:' || CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)")


@query("kv_encode", f"SELECT event_id, {EVENT_MESSAGE_SQL} AS message FROM events")
def q_kv_encode(spark, sf):
    return event_message(table(spark, sf, "events"))


EVENT_KINDS = "event_id:int,ts:str,user_id:int,event_type:str,value:float"


def decode_events(msgs: DataFrame) -> DataFrame:
    d = codec.decode_messages(msgs, "message", "d")
    return d.select(codec.kv_get("d", "event_id", "int").alias("event_id"),
                    codec.kv_get("d", "ts").alias("ts"),
                    codec.kv_get("d", "user_id", "int").alias("user_id"),
                    codec.kv_get("d", "event_type").alias("event_type"),
                    codec.kv_get("d", "value", "float").alias("value"),
                    codec.kv_kinds("d").alias("kinds"))


@query("kv_decode", f"""
SELECT event_id, strftime(ts, '{TS_FMT_SQL}') AS ts, user_id, event_type,
       CAST(CAST(value AS DECIMAL(12,2)) AS DOUBLE) AS value, '{EVENT_KINDS}' AS kinds
FROM events
""")
def q_kv_decode(spark, sf):
    return decode_events(event_message(table(spark, sf, "events")))


@query("line_tokens", f"""
WITH t AS (SELECT lang, unnest(regexp_split_to_array(text, '{WS}+')) AS tok FROM documents)
SELECT lang, count(*) FILTER (WHERE tok <> '') AS n_tokens,
       count(DISTINCT tok) FILTER (WHERE tok <> '') AS n_distinct_tokens
FROM t GROUP BY lang
""")
def q_line_tokens(spark, sf):
    docs = table(spark, sf, "documents").select("lang", F.explode(lines(F.col("text"))).alias("line"))
    toks = docs.select("lang", F.explode(codec.line_tokens(F.col("line"))).alias("tok"))
    return toks.groupBy("lang").agg(F.count(F.lit(1)).alias("n_tokens"),
                                    F.countDistinct("tok").alias("n_distinct_tokens"))
