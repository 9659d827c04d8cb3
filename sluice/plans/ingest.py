"""The orchestrated run as Spark jobs.

Per source: route (B3-B5) -> discover schema (C1/C2/C3/C4) -> version it
(C6/C7) -> build ONE read plan for the whole source -> tag rows with rule
reasons -> write the staged version once, partitioned by row state, with
counts observed in the same pass (P2) -> gate (D5 source / D6 record): the
run row names the curated and quarantine partitions of that version -> write
catalog rows (K1-K5, K7). Stream sources run as availableNow streaming
queries through the same gate (W7).

The driver only sees per-source summaries (counts, paths); row data never
passes through it. Tables live under ``root`` (a shared folder)."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import stored_names
from ..functions.paths import extension, file_name, source_file
from ..operators import catalog, profile, quality, route, schema, sketches
from ..operators.joins import join_small, persist_fresh, released
from ..operators.schema import header_fields
from ..sinks import tables
from ..sources import chunks, files, headers, jsontext, quoted, readers

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.StringType()), T.StructField("source_name", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("modality", T.StringType()),
    T.StructField("load_mode", T.StringType()), T.StructField("worker", T.StringType()),
    T.StructField("schema_version", T.IntegerType()), T.StructField("record_count", T.LongType()),
    T.StructField("invalid_count", T.LongType()), T.StructField("valid_count", T.LongType()),
    T.StructField("processing_time_seconds", T.DoubleType()),
    T.StructField("rate_records_per_second", T.DoubleType()),
    T.StructField("source_path", T.StringType()), T.StructField("staging_path", T.StringType()),
    T.StructField("lakehouse_path", T.StringType()), T.StructField("quarantine_path", T.StringType()),
    T.StructField("error", T.StringType()),
    T.StructField("target_table", T.StringType()),
    T.StructField("fields", schema.FIELDS_TYPE),
    T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
])


_LAST_RUN = [0]
_RUN_LOCK = threading.Lock()


def new_run_id() -> str:
    """Id that sorts by start: UTC to the microsecond, strictly rising inside a
    driver (also when its clock steps back), then random digits against
    another driver's run of the same microsecond."""
    with _RUN_LOCK:
        now = _LAST_RUN[0] = max(time.time_ns() // 1000, _LAST_RUN[0] + 1)
    stamp = time.strftime("%Y%m%dT%H%M%S", time.gmtime(now // 1_000_000))
    return f"{stamp}{now % 1_000_000:06d}Z-{uuid.uuid4().hex[:8]}"


class Lake:
    """Folder layout of one lake.

    ``tables/<source>/_v=<run>/_row_state=valid|invalid`` holds each run's
    staged rows, written once. The curated table of a run is its ``valid``
    partition and the quarantine its ``invalid`` partition (or, when the
    source gate fails, the whole version): the run row names them, so
    nothing is copied a second time. ``catalog/<section>/_run=<run>/...``
    holds the append-only catalog and ``streams/`` the stream outputs."""

    def __init__(self, root: str, fmt: str = "parquet"):
        self.root = root.rstrip("/")
        self.fmt = fmt

    @property
    def tables(self):
        return f"{self.root}/tables"

    def section(self, name: str) -> str:
        return f"{self.root}/catalog/{name}"

    def run_leaf(self, name: str, run_id: str, source_name: str | None = None) -> str:
        """Each run (and source) owns one leaf folder of a catalog section:
        concurrent writers never share an output folder and a retried run
        overwrites only its own rows. The section root reads all leaves."""
        leaf = f"{self.section(name)}/_run={run_id}"
        return leaf if source_name is None else f"{leaf}/_source={source_name}"

    def write_leaf(self, df: DataFrame, name: str, run_id: str, source_name: str | None = None) -> None:
        df.write.mode("overwrite").format(self.fmt).save(self.run_leaf(name, run_id, source_name))

    def read_section(self, spark: SparkSession, name: str):
        if not files.path_exists(spark, self.section(name)):
            return None
        try:
            return spark.read.format(self.fmt).load(self.section(name))
        except AnalysisException as e:
            if e.getCondition() == "UNABLE_TO_INFER_SCHEMA":  # a first writer is still at work: no rows yet
                return None
            raise


def ingest_frame(spark: SparkSession, df: DataFrame, lake: Lake, source_name: str, run_id: str,
                 rules=(), unique=None, gate: str = "record", target_table: str | None = None,
                 modality: str = "structured", load_mode: str = "batch", worker: str = "direct",
                 schema_version: int | None = None, source_path: str | None = None,
                 extra_invalid: int = 0, invalid_override: int | None = None,
                 record_override: int | None = None, extra_records: int = 0, counted=None) -> dict:
    """Stage, gate and store one source's rows in ONE write. Returns the run row.

    ``gate="record"``: valid rows -> curated, invalid rows -> quarantine.
    ``gate="source"``: any invalid row quarantines every row of the source.
    The counts come from the write itself (``observe``); the gate decides
    which partitions of the written version the run row names. ``counted``
    (a boolean column) says which rows are records, where not all are.
    """
    t0 = time.time()
    own = ("_reasons", "_run_id", "_row_state")
    if {c.lower() for c in df.columns} & set(own):
        df = df.toDF(*stored_names(df.columns, own))
    tagged = quality.apply_rules(df, rules, unique=unique)
    tagged = tagged.withColumn("_run_id", F.lit(run_id)).withColumn(
        "_row_state", F.when(F.size(quality.REASONS) == 0, F.lit("valid")).otherwise(F.lit("invalid")))
    watched, obs = profile.observed(tagged, f"stage_{source_name}_{run_id}".replace("-", "_"), counted=counted)
    staging_path = tables.write_version(watched, lake.tables, source_name, run_id, lake.fmt,
                                        partition_by=["_row_state"])
    counts = obs.get
    rows = int(counts.get("row_count", counts.get("record_count", 0)))
    # record_override: a count in other units (files, E6); extra_records:
    # files counted as records without yielding rows (unreadable, E11)
    records = int(counts.get("record_count", 0))
    rec = (int(record_override) if record_override is not None else records) + int(extra_records)
    row_inv = int(counts.get("invalid_count", 0))
    # extra_invalid: file-level problems that yield no row (zero-byte files);
    # invalid_override: a count in other units (bad files under the source gate)
    inv = int(invalid_override) if invalid_override is not None else row_inv + int(extra_invalid)
    counts = {"record_count": rec, "invalid_count": inv}
    valid_part, invalid_part = f"{staging_path}/_row_state=valid", f"{staging_path}/_row_state=invalid"
    lakehouse_path = quarantine_path = None
    if gate == "source":
        if rows == 0:
            status = "empty"
        elif inv == 0:
            status, lakehouse_path = "stored", valid_part
        else:
            status, quarantine_path = "quarantined", staging_path
    else:
        status = "empty" if rec == 0 else ("stored" if inv == 0 else "partial")
        if rows - row_inv > 0:
            lakehouse_path = valid_part
        if row_inv > 0:
            quarantine_path = invalid_part
    seconds = time.time() - t0
    prof = profile.profile_row(counts, seconds)
    return {
        "run_id": run_id, "source_name": source_name, "status": status, "modality": modality,
        "load_mode": load_mode, "worker": worker, "schema_version": schema_version,
        "record_count": prof["record_count"], "invalid_count": prof["invalid_count"],
        "valid_count": prof["valid_count"], "processing_time_seconds": prof["processing_time_seconds"],
        "rate_records_per_second": prof["rate_records_per_second"],
        "source_path": source_path or source_name, "staging_path": staging_path, "target_table": target_table or source_name,
        "lakehouse_path": lakehouse_path, "quarantine_path": quarantine_path, "error": None,
    }


def record_run(spark: SparkSession, lake: Lake, run_rows: list[dict]) -> DataFrame:
    """Append the run rows and their catalog consequences (K1, K3, K4, K5,
    K7). These frames hold one row per source, never data rows."""
    runs = spark.createDataFrame([tuple(r.get(f.name) for f in RUN_SCHEMA.fields) for r in run_rows], RUN_SCHEMA)
    run_ids = sorted({r["run_id"] for r in run_rows})
    rid = run_ids[0] if len(run_ids) == 1 else "mixed-" + uuid.uuid4().hex[:8]
    lake.write_leaf(runs, "runs", rid)
    lake.write_leaf(catalog.lineage_edges(runs.filter(F.col("staging_path").isNotNull())), "lineage", rid)
    lake.write_leaf(catalog.dataset_log(runs), "datasets", rid)
    lake.write_leaf(runs.select("run_id", "source_name", "modality", "load_mode", "record_count",
                                   "invalid_count", "valid_count", "processing_time_seconds",
                                   "rate_records_per_second"), "profiles", rid)
    return runs


def exposed(spark: SparkSession, lake: Lake) -> DataFrame | None:
    """K5 view over the run table."""
    runs = lake.read_section(spark, "runs")
    return None if runs is None else catalog.exposed_datasets(runs)


def register_views(spark: SparkSession, lake: Lake) -> list[str]:
    """K5 application layer: one temporary view per exposed dataset, named by
    its target table, over its current version - queryable with SQL."""
    runs = lake.read_section(spark, "runs")
    if runs is None:
        return []
    view = exposed(spark, lake)
    names = runs.groupBy("source_name").agg(F.max_by("target_table", "run_id").alias("target_table"))
    rows = view.join(names, "source_name").select("source_name", "target_table", "lakehouse_path").collect()  # one per source
    for r in rows:
        _version(spark, lake, r["source_name"], r["lakehouse_path"]).createOrReplaceTempView(r["target_table"])
    return sorted(r["target_table"] for r in rows)


def _version(spark: SparkSession, lake: Lake, source_name: str, path: str) -> DataFrame:
    """Rows of a source's exposed version; a stream's are those of all its accepted runs."""
    from ..streaming import commits
    if path.startswith(f"{commits.root_of(lake, source_name)}/"):
        return commits.snapshot(spark, lake, source_name)
    return spark.read.format(lake.fmt).load(path)


def read_current(spark: SparkSession, lake: Lake, source_name: str) -> DataFrame:
    """The exposed (current) curated version of a source: the lakehouse
    version of its newest stored run (a later quarantined run leaves it
    exposed, E17), for a stream the rows of all its accepted runs. Run ids sort by their time prefix."""
    view = exposed(spark, lake)
    row = None if view is None else view.filter(F.col("source_name") == source_name).first()
    if row is None or not row["lakehouse_path"]:
        raise LookupError(f"no stored version of {source_name!r}")
    return _version(spark, lake, source_name, row["lakehouse_path"])


def _store_statistics(spark: SparkSession, lake: Lake, row: dict) -> None:
    """P5: the mergeable statistics of the rows a run stored (option ``statistics``), read once when they are written."""
    if not row.get("lakehouse_path"):
        return
    df = spark.read.format(lake.fmt).load(row["lakehouse_path"])
    cols = [c for c in df.columns if c not in RESERVED and c not in TECHNICAL]
    if cols:
        states = sketches.column_sketches(df, cols).select(F.lit(row["source_name"]).alias("source_name"), F.lit(row["run_id"]).alias("run_id"), "*")
        lake.write_leaf(states, "column_statistics", row["run_id"], row["source_name"])


def version_statistics(spark: SparkSession, lake: Lake, source_name: str, first_run: str | None = None,
                       last_run: str | None = None, ranks=(0.25, 0.5, 0.75), top: int = 5) -> DataFrame:
    """P5 over the versions of a range of runs (ids sort by time; both ends included), from stored
    sketches alone: no data is read again."""
    states = lake.read_section(spark, "column_statistics")
    if states is not None:
        states = states.filter(F.col("source_name") == source_name)
        states = states.filter(F.col("run_id") >= first_run) if first_run else states
        states = states.filter(F.col("run_id") <= last_run) if last_run else states
    if states is None or states.isEmpty():
        raise LookupError(f"no stored statistics of {source_name!r} in these runs")
    return sketches.statistics(sketches.merge_sketches(states), ranks, top)


# --- file sources ---------------------------------------------------------------

#: Columns the readers add; they are no data of the source.
TECHNICAL = ("_source_file", "_corrupt", "_raw", "_extra", "_issue", "_file_reason", "path", "size_bytes", "modificationTime",
             "length", "issue", "_file_issue", "_chunk", "_offset")
#: Columns of a stored row that are no data. A data column of such a name (in any case), or of the name of an
#: earlier column in another case, is stored with a number behind its name; the run's ``metadata.columns`` says so.
RESERVED = ("_source_file", "_corrupt", "_raw", "_extra", "_issue", "_file_reason", "_file_issue", "_reasons", "_run_id", "_row_state",
            "_chunk", "_offset")
FILE_REASONS = ("header_width", "duplicate_header", "header_order", "header_names", "empty_file", "unreadable")
NO_ROW_REASONS = ("empty_file", "unreadable")   # files that yield no data row


def discover_fields(spark: SparkSession, path: str, manifest: DataFrame, modality: str, options: dict | None = None):
    """The source's fields from its first readable file (C5) that
    holds a record; zero-byte files and files without a header are left out of
    discovery and counted invalid instead (E10, E11), whatever the listing
    order. ``options.fieldsFrom = all`` takes the fields of every JSON object of
    the source instead of the first one's, each with the type that holds all its values."""
    if modality == "streaming":
        return schema.STREAM_FIELDS
    if modality not in ("structured", "semi_structured"):
        return schema.FILE_ENTITY_FIELDS
    present = {r[0] for r in manifest.filter(F.col("size_bytes") > 0).select("extension").distinct().collect()}
    if modality == "structured":
        for ext in (".csv", ".tsv"):
            if ext not in present:
                continue
            # one aggregate row a file, the smallest path of those with a header
            heads = headers.first_records(spark, path, (ext,)).filter(F.col("cells").isNotNull() | F.col("broken"))
            row = heads.agg(F.min_by(F.struct("file_path", "cells", "broken"), "file_path").alias("h")).first()["h"]
            if row is None:
                continue
            cells = headers.header_of(spark, row["file_path"], readers.sep_for(ext), True) if row["broken"] else row["cells"]
            one = spark.createDataFrame([(cells,)], "cells array<string>").select(schema.header_fields(F.col("cells")).alias("f"))
            return [(f["name"], "string") for f in one.first()["f"]]
        return schema.UNKNOWN_FIELDS
    if ".json" not in present:
        return schema.UNKNOWN_FIELDS
    whole = str(_opt(options, "fieldsFrom", "first")).lower() == "all"
    # the first value of the first file that holds an object: mostly of the first file, which is looked at alone
    head = manifest.filter((F.col("extension") == ".json") & (F.col("size_bytes") > 0)).agg(F.min("path")).first()[0]
    for place in (headers.literal(head), path):
        docs = jsontext.json_documents(spark, place).filter(jsontext.fields_of("v").isNotNull())
        # keys in the order of the text; a list's elements share a text, whose first one they follow
        order = F.coalesce(F.json_object_keys("_text"), F.json_object_keys(F.get_json_object("_text", "$[0]")))
        first = docs.select("_source_file", "_at", "v", "_text").orderBy("_source_file", "_at").limit(1) \
            .select("_source_file", "_at", F.to_json("v").alias("doc"), order.alias("order"))
        found = first.collect()
        if found:
            break
    else:
        return schema.UNKNOWN_FIELDS
    order = {k: i for i, k in enumerate(found[0]["order"] or [])}
    if whole:
        keys = schema.merged_key_types(jsontext.json_documents(spark, path), "v").collect()  # a row a key
    else:
        keys = schema.json_key_types(spark.createDataFrame(found, first.schema), "doc").collect()
    return [(r["key"], r["type_name"]) for r in sorted(keys, key=lambda r: (order.get(r["key"], len(order)), r["key"]))] or schema.UNKNOWN_FIELDS


def _opt(options: dict | None, key: str, default=None):
    options = options or {}
    return options.get(key, options.get(key.lower(), default))


def _truthy(v) -> bool:
    return str(v).lower() in ("1", "true", "yes")


def source_frame(spark: SparkSession, path: str, manifest: DataFrame, worker: str, fields,
                 options: dict | None = None) -> tuple:
    """The read plan, rules and file-level problems of one routed source: one
    scan per format over the whole source folder (not one job per file), all
    formats of a folder in one frame. Returns ``(df, rules, file_issues)``;
    ``file_issues`` counts CSV/TSV files by header reason (None when there is no
    such file)."""
    if worker == "text":
        return (*text_documents(spark, path, manifest, _truthy(_opt(options, "checkUtf8", "false")), options), None)
    if worker == "image":
        return (*image_rows(spark, path, manifest, options), None)
    if worker == "video":
        return (*video_rows(spark, path, manifest, options), None)
    present = {r[0] for r in manifest.select("extension").distinct().collect()}
    names = [n for n, _ in fields]
    frames, rules, issues = [], [], None
    if present & {".csv", ".tsv"}:
        df, own, issues = delimited_rows(spark, path, manifest, [] if names == ["unknown"] else names, present, options)
        frames.append(df)
        rules += own
    if ".json" in present:
        # beside csv/tsv files the source's schema is theirs; the JSON values have fields of their own
        own_fields = discover_fields(spark, path, manifest, "semi_structured", options) if present & {".csv", ".tsv"} else fields
        df, own = json_rows(spark, path, own_fields)
        frames.append(df)
        rules += own
    if ".parquet" in present:
        frames.append(readers.read_parquet(spark, path, merge_schema=True, recursive=True, reserved=RESERVED))
    if ".xml" in present:
        row_tag = _opt(options, "rowTag")
        frames.append(readers.read_xml(spark, path, row_tag, glob=headers.GLOBS[".xml"]) if row_tag
                      else _documents(spark, path, headers.GLOBS[".xml"]))
    if present & {".yaml", ".yml"}:
        frames.append(readers.read_yaml_documents(spark, path))
    if ".delta" in present or path.rstrip("/").lower().endswith(".delta"):
        frames.append(readers.read_table(spark, path, "delta"))  # fails the source where its connector is absent
    others = sorted(present - {".csv", ".tsv", ".json", ".parquet", ".xml", ".yaml", ".yml", ".delta"})
    if others:  # whatever else lies in the folder is stored too, as bytes
        rest = _file_bytes(spark, path, manifest, others, options)
        frames.append(rest.select(F.col("path").alias("_source_file"), "length", "content", F.col("issue").alias("_issue"),
                                  *[c for c in CHUNK_COLUMNS if c in rest.columns]))
        rules.append((files.TOO_LARGE, F.col("_issue") == files.TOO_LARGE))
    if any(e in present for e in (".xml", ".yaml", ".yml")):
        rules.append(("unreadable", F.col("_issue") == "unreadable"))
        frames = [f if "_issue" in f.columns else f.withColumn("_issue", F.lit(None).cast("string")) for f in frames]
    return union_all(frames), rules, issues


#: Columns of chunk rows; a source has them only where it has a file above the row bound.
CHUNK_COLUMNS = ("_chunk", "_offset")


def _row_bytes(options: dict | None) -> int:
    return int(_opt(options, "rowBytes", files.MAX_ROW_BYTES))


def _large(manifest: DataFrame, options: dict | None, extensions=None) -> bool:
    """Whether a file of the source is stored in chunks: one above ``rowBytes`` (the most a
    Spark value holds), unless ``largeFiles = refuse`` gives it a reason instead."""
    if str(_opt(options, "largeFiles", "chunks")).lower() == "refuse":
        return False
    found = manifest.filter(F.col("size_bytes") > _row_bytes(options))
    return not (found.filter(F.col("extension").isin(*extensions)) if extensions else found).isEmpty()


def _chunked(spark: SparkSession, path: str, options: dict | None, **how) -> DataFrame:
    return chunks.file_chunks(spark, path, above=_row_bytes(options),
                              chunk_bytes=int(_opt(options, "chunkBytes", chunks.CHUNK_BYTES)), **how) \
        .withColumnsRenamed({"chunk": "_chunk", "offset": "_offset"})


def _file_bytes(spark: SparkSession, path: str, manifest: DataFrame, extensions, options: dict | None) -> DataFrame:
    """The bytes of files: a row each, or a row a chunk above the row bound."""
    rows = files.read_binary(spark, path, with_content=True, extensions=extensions, max_content_bytes=_row_bytes(options))
    if not _large(manifest, options, extensions):
        return rows
    cut = _chunked(spark, path, options, extensions=extensions).withColumnRenamed("size_bytes", "length")
    return rows.filter(F.col("length") <= _row_bytes(options)).unionByName(cut, allowMissingColumns=True)


def _documents(spark: SparkSession, path: str, glob: str) -> DataFrame:
    d = files.read_text_documents(spark, path, glob=glob)
    return d.select(F.col("path").alias("_source_file"), F.col("text").alias("document"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Rows of frames with different columns. A column of different types (or
    whose names differ in case only) is text in all of them."""
    if len(frames) == 1:
        return frames[0]
    types: dict = {}
    for f in frames:
        for n, t in f.dtypes:
            types.setdefault(n.lower(), (n, set()))[1].add(t)
    out = None
    for f in frames:
        cols = []
        for n, t in f.dtypes:
            name, seen = types[n.lower()]
            c = F.col(f"`{n}`")
            if len(seen) > 1:
                c = F.to_json(c) if t.startswith(("array", "map", "struct", "variant")) else c.cast("string")
            cols.append(c.alias(name))
        f = f.select(*cols)
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def delimited_rows(spark: SparkSession, path: str, manifest: DataFrame, names: list[str], present: set,
                   options: dict | None = None) -> tuple:
    """Rows of a folder's CSV and TSV files with their file's
    header reason. Files with a quote left open on some line are read by ``sources.quoted`` (records are cut in
    splits), the others by Spark's line-wise reader; ``options.multiLine`` ``true``
    reads all whole-record (a task a file), ``false`` is the user's promise that no value runs over a line end.
    A file whose header has the source's names in another order is read by name, not by position.
    Files without a data row to tag are counted by their reason; if no file
    has a readable header, each file is a row with its reason."""
    wanted = str(_opt(options, "multiLine", "auto")).lower()
    strict = _truthy(_opt(options, "checkHeaderNames", "false"))
    checks = persist_fresh(quality.header_checks(spark, path, manifest, len(names), names))
    # names and their order are looked at in any case; they reject a file only on request
    named = ("header_order", "header_names")
    reason = F.col("reason") if strict else F.when(~F.col("reason").isin(*named), F.col("reason"))
    moved = F.when(F.col("reason") == "header_order", F.transform(F.array(*[F.lit(n) for n in names]), lambda n: F.array_position(
        F.transform(header_fields(F.col("cells")), lambda f: f["name"]), n).cast("int"))) if names else F.lit(None).cast("array<int>")
    files = persist_fresh(checks.select(F.col("file_path").alias("_source_file"), reason.alias("_file_reason"), moved.alias("_moved"),
                                        F.col("multi_line").alias("_multi")).filter("_file_reason IS NOT NULL OR _moved IS NOT NULL OR _multi"))
    facts = files.groupBy("_file_reason", F.col("_moved").isNotNull().alias("moved"), "_multi").agg(F.count(F.lit(1)).alias("n")).collect()
    issues: dict = {}
    for r in facts:
        if r["_file_reason"] is not None:
            issues[r["_file_reason"]] = issues.get(r["_file_reason"], 0) + int(r["n"])
    rules = [quality.row_width("_corrupt")] + [(r, F.col("_file_reason") == r) for r in FILE_REASONS]
    if not names:
        df = files.filter("_file_reason IS NOT NULL").select("_source_file", F.lit(None).cast("string").alias("_corrupt"), "_file_reason")
        return df, rules, issues
    over = checks.filter("multi_line").select("uri") if wanted == "auto" else None
    some = over is not None and any(r["_multi"] for r in facts)
    columns = stored_names(names, RESERVED)
    frames = []
    for ext in (".csv", ".tsv"):
        if ext not in present:
            continue
        sep, glob = readers.sep_for(ext), headers.GLOBS[ext]
        if not some:
            frames.append(readers.read_csv(spark, path, columns, sep=sep, path_glob=glob, multi_line=wanted == "true"))
        else:
            frames.append(readers.read_csv(spark, path, columns, sep=sep, path_glob=glob, keep=lambda d: headers.chosen(d, over, keep=False)))
            frames.append(quoted.read_quoted_csv(spark, path, columns, sep, glob, lambda d: headers.chosen(d, over)))
    df = frames[0]
    for f in frames[1:]:
        df = df.unionByName(f)
    if not any(r["moved"] or r["_file_reason"] for r in facts):
        return df.withColumn("_file_reason", F.lit(None).cast("string")), rules, issues
    df = join_small(df, files.drop("_multi"), "_source_file", "left")
    if any(r["moved"] for r in facts):
        cells = F.array(*[F.col(f"`{c}`") for c in columns])
        df = df.select(*[F.when(F.col("_moved").isNull(), F.col(f"`{c}`")).otherwise(F.get(cells, F.col("_moved")[i] - 1)).alias(c)
                         for i, c in enumerate(columns)], "_corrupt", "_source_file", "_file_reason")
    return df.drop("_moved"), rules, issues


# Python type names of discovered JSON fields -> column types (lists and
# objects stay JSON text).
PY_TO_SPARK = {"str": "string", "int": "bigint", "float": "double", "bool": "boolean",
               "list": "string", "dict": "string", "NoneType": "string", "any": "string"}
#: Kinds of values that a column of a kind holds; any other value goes to ``_extra``.
HOLDS = {"int": ("int",), "float": ("float", "int"), "str": ("str",), "bool": ("bool",), "list": ("list",), "dict": ("dict",),
         "NoneType": ("str", "int", "float", "bool", "list", "dict"), "any": ("str", "int", "float", "bool", "list", "dict")}


def json_rows(spark: SparkSession, path: str, fields) -> tuple:
    """One row per JSON value of the source's files. Discovered fields are
    typed columns; every other key, and every value its column cannot hold, is
    kept as JSON text in ``_extra`` (map). Values that are no object, and texts
    that are no JSON (reason ``json_parse``), are kept in ``_raw``."""
    docs = jsontext.json_documents(spark, path)
    listed = [(n, t) for n, t in fields if (n, t) != schema.UNKNOWN_FIELDS[0]]
    stored = stored_names([n for n, _ in listed], RESERVED)
    docs = docs.withColumn("_m", jsontext.fields_of("v"))
    is_object = F.col("_m").isNotNull()

    # each listed value, its type and its kind are looked up once a row
    docs = docs.select("*", *[F.col("_m")[F.lit(n)].alias(f"_v{i}") for i, (n, _) in enumerate(listed)])
    docs = docs.select("*", *[F.schema_of_variant(f"_v{i}").alias(f"_t{i}") for i in range(len(listed))])
    docs = docs.select("*", *[schema.variant_type_to_py(F.col(f"_t{i}")).alias(f"_k{i}") for i in range(len(listed))])

    def held(i, type_name):
        value, own = F.col(f"_v{i}"), F.col(f"_k{i}")
        if type_name in ("list", "dict"):
            plain = F.to_json(value)
        elif type_name in ("NoneType", "any"):
            plain = F.when(own == "str", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
        else:
            plain = F.try_variant_get(value, "$", PY_TO_SPARK.get(type_name, "string"))
        return F.when(own.isin(*HOLDS.get(type_name, ("str",))), plain)

    docs = docs.select("*", *[held(i, t).alias(f"_c{i}") for i, (_, t) in enumerate(listed)])
    columns = [F.col(f"_c{i}").alias(c) for i, c in enumerate(stored)]
    names = [n for n, _ in listed]
    refused = [F.when(F.col(f"_c{i}").isNull() & (F.col(f"_k{i}") != "NoneType"), F.lit(n)) for i, n in enumerate(names)]
    if listed:
        # a key is left over if it is not listed, or its column cannot hold its value
        docs = docs.withColumn("_refused", F.array_compact(F.array(*refused)))
        some = (F.size(F.map_keys("_m")) != F.size(F.filter(F.map_keys("_m"), lambda k: k.isin(*names)))) | (F.size("_refused") > 0)
        over = F.when(some, F.map_filter("_m", lambda k, x: ~k.isin(*names) | F.array_contains("_refused", k)))
    else:
        over = F.col("_m")
    extra = F.transform_values(over, lambda k, x: F.to_json(x))
    df = docs.select(*columns, F.when(F.size(extra) > 0, extra).alias("_extra"),
                     F.when(F.col("v").isNotNull() & ~is_object, F.to_json("v")).otherwise(F.col("_raw")).alias("_raw"),
                     F.col("v").isNull().alias("_issue"), "_source_file")
    df = df.withColumn("_issue", F.when(F.col("_issue"), F.lit("json_parse")))
    return df, [("json_parse", F.col("_issue") == "json_parse")]


def text_documents(spark: SparkSession, path: str, manifest: DataFrame, check_utf8: bool = False, options: dict | None = None):
    """Text worker rows: one row per file (a file is a record, as in the
    reference). Reasons: ``unreadable`` for a non-empty file that gave no text
    (D2, I/O or codec failure) and, opt-in, ``bad_utf8`` when the text is not valid UTF-8 (E12). A file that no Spark
    value can hold is stored in chunks of whole lines (``_chunk``, ``_offset``); ``too_large_for_row`` is
    left for those that cannot be cut (:mod:`sluice.sources.chunks`)."""
    most = _row_bytes(options)
    docs = files.read_text_documents(spark, path, ignore_corrupt=True, max_bytes=most).withColumn("_file_issue", F.lit(None).cast("string"))
    if _large(manifest, options):
        cut = _chunked(spark, path, options, by_line=True)
        cut = cut.select("path", F.col("content").cast("string").alias("text"), "size_bytes", F.col("issue").alias("_file_issue"), *CHUNK_COLUMNS)
        docs = docs.unionByName(cut, allowMissingColumns=True)
        manifest = manifest.filter(F.col("size_bytes") <= most)
    # files that give no text row: empty (readable), unreadable, too large
    issue = F.when(F.col("size_bytes") > most, F.lit(files.TOO_LARGE)) \
        .when(F.col("size_bytes") > 0, F.lit("unreadable"))
    missing = manifest.select("path", "size_bytes").join(docs.select("path"), "path", "left_anti") \
        .select("path", F.when(F.col("size_bytes") == 0, F.lit("")).alias("text"), "size_bytes", issue.alias("_file_issue"))
    rows = docs.unionByName(missing, allowMissingColumns=True)
    rules = [(r, F.col("_file_issue") == r) for r in ("unreadable", files.TOO_LARGE)]
    if check_utf8:
        rules.append(("bad_utf8", ~F.is_valid_utf8(F.col("text"))))
    return rows, rules


def image_rows(spark: SparkSession, path: str, manifest: DataFrame, options: dict | None = None) -> tuple:
    """Image worker rows (A11, D3): decoded images of the folder; other files
    as rows without pixels, valid only for CSV side files (E13).
    ``options.decode`` also rejects images that do not decode;
    ``options.content = paths`` stores the listing alone."""
    rules = [("extension", quality.image_file_invalid(F.col("extension")))]
    listed = manifest.select("source_name", "path", "file_name", "extension", "size_bytes")
    if str(_opt(options, "content", "bytes")).lower() == "paths":
        return listed, rules
    ext = extension(file_name(F.col("path")))
    size = manifest.select("path", "size_bytes", "source_name")
    images = join_small(files.read_images(spark, path), persist_fresh(size), "path", "left") \
        .withColumn("file_name", file_name(F.col("path"))).withColumn("extension", ext)
    # files of other kinds, and image files that gave no row (empty ones)
    rest = listed.filter(~F.col("extension").isin(*files.IMAGE_EXTENSIONS) | (F.col("size_bytes") == 0))
    rest = rest.withColumn("width", F.when(F.col("extension").isin(*files.IMAGE_EXTENSIONS), F.lit(-1)))
    if _truthy(_opt(options, "decode", "false")):
        rules.append(("undecodable", F.col("width") < 0))
    return images.unionByName(rest, allowMissingColumns=True), rules


def video_rows(spark: SparkSession, path: str, manifest: DataFrame, options: dict | None = None) -> tuple:
    """Video worker rows (A12, D4): the bytes of video files; other files as
    rows without bytes, invalid by extension. A file that no Spark value can
    hold is stored in chunks (``_chunk``, ``_offset``), or with ``largeFiles = refuse`` quarantined
    (``too_large_for_row``); ``options.content = paths`` stores the listing alone."""
    rules = [("extension", quality.video_file_invalid(F.col("extension"))),
             (files.TOO_LARGE, F.col("issue") == files.TOO_LARGE)]
    listed = manifest.select("source_name", "path", "file_name", "extension", "size_bytes")
    if str(_opt(options, "content", "bytes")).lower() == "paths":
        return listed, rules[:1]
    name = file_name(F.col("path"))
    videos = _file_bytes(spark, path, manifest, files.VIDEO_EXTENSIONS, options).withColumn("file_name", name) \
        .withColumn("extension", extension(name)).withColumnRenamed("length", "size_bytes")
    rest = listed.filter(~F.col("extension").isin(*files.VIDEO_EXTENSIONS) | (F.col("size_bytes") == 0))
    return videos.unionByName(rest, allowMissingColumns=True), rules


def ingest_sources(spark: SparkSession, sources: DataFrame, lake: Lake, run_id: str | None = None,
                   gate: str = "source", max_parallel: int = 4) -> DataFrame:
    """Run every configured source. Sources are independent, so up to
    ``max_parallel`` of them submit their Spark jobs concurrently from driver
    threads (the scheduler shares the executors). A failing source yields a
    ``failed`` run row and the others go on."""
    from concurrent.futures import ThreadPoolExecutor

    run_id = run_id or new_run_id()
    srcs = [s.asDict() for s in sources.collect()]  # one row per configured source
    names = [s["name"] for s in srcs]
    dup = sorted({n for n in names if names.count(n) > 1})
    if dup:  # two sources would write the same version folders
        raise ValueError(f"source names must be unique in a run: {dup}")

    def one(src):
        try:
            with released():  # the derived small sides of this source go with it
                return _ingest_one(spark, src, lake, run_id, gate)
        except Exception as e:  # noqa: BLE001 - recorded as a failed run
            return {"run_id": run_id, "source_name": src["name"], "status": "failed",
                    "source_path": src["path"], "error": f"{type(e).__name__}: {e}"}
    if max_parallel > 1 and len(srcs) > 1:
        with ThreadPoolExecutor(max_workers=max_parallel) as pool:
            rows = list(pool.map(one, srcs))
    else:
        rows = [one(s) for s in srcs]
    return record_run(spark, lake, rows)


_EMPTY_MANIFEST = ("source_name string, path string, file_name string, extension string, "
                   "size_bytes bigint, modified timestamp")


def _ingest_one(spark, src: dict, lake: Lake, run_id: str, gate: str) -> dict:
    """One source of a run -> its run row."""
    row = _ingest_one_inner(spark, src, lake, run_id, gate)
    row.setdefault("target_table", src.get("target_table") or src["name"])
    return row


def _metadata(src: dict, routed, modality: str, worker: str, fields=()) -> dict:
    """K1 dataset metadata: what the reference kept per source, as text. ``columns``
    (JSON, stored name -> the source's) lists the columns that are stored under another name."""
    import json
    md = {"source_path": src["path"], "exists": str(routed["file_count"] is not None).lower(),
          "modality": modality, "worker": worker, "options": json.dumps(src.get("options") or {}, sort_keys=True)}
    if routed["file_count"] is not None:
        md.update(size_bytes=str(routed["size_bytes"]), file_count=str(routed["file_count"]),
                  extensions=json.dumps(list(routed["extensions"] or [])))
    names = [n for n, _ in fields] if worker == "direct" else []
    other = {c: n for c, n in zip(stored_names(names, RESERVED), names) if c != n}
    if other:
        md["columns"] = json.dumps(other, sort_keys=True)
    return md


#: Schemes of paths that name a stream endpoint, not files.
STREAM_SCHEMES = ("kafka", "flink", "socket")


def _list_files(spark, path: str, name: str) -> DataFrame | None:
    """The source's files; None for a stream endpoint or a path that does not
    exist (E3). Any other listing failure is raised."""
    if path.split("://", 1)[0].lower() in STREAM_SCHEMES and "://" in path:
        return None
    return files.file_manifest(spark, path, name) if files.path_exists(spark, path) else None


def _ingest_one_inner(spark, src: dict, lake: Lake, run_id: str, gate: str) -> dict:
    """List once, route, discover and version the schema; then ingest."""
    path, name = src["path"], src["name"]
    phases = _Phases()
    listed = _list_files(spark, path, name)
    if listed is None:
        manifest = spark.createDataFrame([], _EMPTY_MANIFEST)
    else:
        # K2's table is the stored listing; every later step reads it instead of listing again
        lake.write_leaf(catalog.file_entities(listed, run_id), "files", run_id, name)
        manifest = spark.read.format(lake.fmt).load(lake.run_leaf("files", run_id, name)) \
            .select("source_name", F.col("file_path").alias("path"), "file_name", "extension", "size_bytes")
    one = spark.createDataFrame([(name, path, src.get("modality"), src.get("load_mode"),
                                  src.get("worker"))], "name string, path string, modality string, "
                                                       "load_mode string, worker string")
    routed = route.route_sources(one, manifest).first()
    phases.done("list", routed["file_count"] or 0)
    modality, mode, worker = routed["modality"], routed["load_mode"], routed["worker_name"]
    if worker == "unsupported":
        return {"run_id": run_id, "source_name": name, "status": "failed", "modality": modality, "load_mode": mode,
                "worker": worker, "record_count": 0, "invalid_count": 0, "valid_count": 0, "source_path": path,
                "error": f"worker {src.get('worker')!r} is not supported"}
    fields = discover_fields(spark, path, manifest, modality, src.get("options"))
    version = register_schema(spark, lake, name, modality, fields, run_id)
    phases.done("discover", len(fields))
    row = _route_and_ingest(spark, src, lake, run_id, gate, manifest, routed, modality, mode, worker,
                            fields, version)
    phases.done("stage", row["record_count"] or 0)
    if _truthy(_opt(src.get("options"), "statistics", "false")):
        _store_statistics(spark, lake, row)
        phases.done("statistics", row["valid_count"] or 0)
    row.update({"fields": [(i, n, t) for i, (n, t) in enumerate(fields)], "metadata": _metadata(src, routed, modality, worker, fields)})
    phases.write(spark, lake, name, run_id)
    return row


class _Phases:
    """P4 for batch jobs: seconds and items (files, fields, records) of each phase of one source's run."""

    def __init__(self):
        self.rows, self.since = [], time.time()

    def done(self, phase: str, items: int) -> None:
        now = time.time()
        self.rows.append((phase, int(items), now - self.since))
        self.since = now

    def write(self, spark, lake: Lake, source_name: str, run_id: str) -> None:
        df = spark.createDataFrame([(source_name, run_id, i, *r) for i, r in enumerate(self.rows)],
                                   "source_name string, run_id string, seq int, phase string, items bigint, seconds double")
        lake.write_leaf(df.coalesce(1), "phases", run_id, source_name)


def _route_and_ingest(spark, src, lake, run_id, gate, manifest, routed, modality, mode, worker, fields, version):
    """Streams run as streaming queries; files as one staged batch read."""
    path, options = src["path"], src.get("options")
    if modality == "streaming" and (path.startswith(("kafka://", "socket://")) or routed["file_count"] is not None):
        return ingest_stream(spark, src, lake, run_id, modality, mode, worker, version, gate)
    if modality == "streaming" or routed["file_count"] is None:
        # nothing to read (no such folder, or a stream endpoint we cannot open)
        return {"run_id": run_id, "source_name": src["name"], "status": "empty", "modality": modality,
                "load_mode": mode, "worker": worker, "schema_version": version,
                "record_count": 0, "invalid_count": 0, "valid_count": 0, "source_path": path}
    _catalog_entities(spark, lake, src["name"], run_id, manifest, worker, path)
    df, rules, file_issues = source_frame(spark, path, manifest, worker, fields, options)
    own_rules, unique = quality.rules_from_config(_opt(options, "rules"))
    if _truthy(_opt(options, "clean", "false")):
        df = quality.clean_rows(df, dedupe=_truthy(_opt(options, "dedupe", "false")),
                                technical=[c for c in df.columns if c in TECHNICAL])
    extra, override, records, extra_records, counted = 0, None, None, 0, None
    if worker == "direct" and file_issues is None and gate == "source":
        records = routed["file_count"]  # E6: without csv/tsv the reference counts files
    if file_issues is not None:
        tabular = extension(file_name(F.col("_source_file"))).isin(".csv", ".tsv")
        if gate == "source":
            # the reference's numbers (E6-E8): csv/tsv rows are records, their files are
            # checked, their width is not; invalid counts bad files, rows keep their file's reason
            rules = [r for r in rules if r[0] != "row_width"]
            own = own_rules or unique or any(r[0] in ("json_parse", "unreadable") for r in rules[len(FILE_REASONS):])
            override = sum(file_issues.values()) if not own else None
            if own:  # rows that other rules reject count beside the bad files
                extra = sum(n for r, n in file_issues.items() if r in NO_ROW_REASONS) if fields != schema.UNKNOWN_FIELDS else 0
            # An unreadable file is one record (and one invalid)
            extra_records = file_issues.get("unreadable", 0)
            counted = tabular
        elif fields != schema.UNKNOWN_FIELDS:
            extra = sum(n for r, n in file_issues.items() if r in NO_ROW_REASONS)
    if worker in ("text", "video") and set(CHUNK_COLUMNS) <= set(df.columns):
        counted = F.coalesce(F.col("_offset") == 0, F.lit(True))  # a file is a record, in however many chunks
    return ingest_frame(spark, df, lake, src["name"], run_id, rules=rules + own_rules, unique=unique, gate=gate,
                        target_table=src.get("target_table"), modality=modality, load_mode=mode,
                        worker=worker, schema_version=version, source_path=path,
                        extra_invalid=extra, invalid_override=override, record_override=records,
                        extra_records=extra_records, counted=counted)


def _catalog_entities(spark, lake: Lake, source_name: str, run_id: str, manifest: DataFrame,
                      worker: str, path: str) -> None:
    """K6 text and log entities of one source run (K2 is the stored listing)."""
    lake.write_leaf(catalog.log_entities(manifest).withColumn("run_id", F.lit(run_id)), "logs", run_id, source_name)
    if worker == "text":
        txt = catalog.text_file_entities(spark, path, manifest).select(
            F.lit(source_name).alias("source_name"), F.lit(run_id).alias("run_id"), "*")
        lake.write_leaf(txt, "text_data", run_id, source_name)


def ingest_stream(spark: SparkSession, src: dict, lake: Lake, run_id: str, modality: str = "streaming",
                  mode: str = "stream", worker: str = "streaming", version: int | None = None,
                  gate: str = "record") -> dict:
    """W7 from the orchestrator: a stream source runs as an ``availableNow``
    Structured Streaming query through the decode -> gate -> curated /
    quarantine / dead-letter writer. The checkpoint lives in the lake, so the
    next run resumes after the last committed batch (W5) instead of re-reading.

    ``kafka://host:port/topic`` reads Kafka (connector required); a folder is
    read as text lines (``options.format = text``, default) or as files of
    Kafka-shaped rows (``parquet`` / ``json``). ``options.maxFilesPerTrigger``
    / ``maxOffsetsPerTrigger`` throttle (W3); ``minPartitions`` spreads a hot
    topic partition over several tasks. ``socket://host:port`` reads lines from
    a socket. ``options.rules`` (D9, on ``fields['key']``) tag decoded rows; a uniqueness rule also
    looks at the curated rows of earlier batches and accepted runs (``options.uniqueWithin``, e.g. ``7
    days``, forgets older batches). Under the source gate one row that a rule rejects quarantines all
    of the run's rows (dead letters alone do not: they hold no row).

    Each run writes to its own folder and commits its batches (``streaming.commits``): the run row names that
    folder, readers see the batches of accepted runs only, and keys of a refused run are free again."""
    from ..streaming import commits, jobs
    from ..streaming import sources as ssrc
    t0 = time.time()
    path, name, opts = src["path"], src["name"], src.get("options") or {}
    out = f"{commits.root_of(lake, name)}/_run={run_id}"
    ckpt = f"{lake.root}/_checkpoints/{name}"
    fmt = str(_opt(opts, "format", "text")).lower()
    max_files = _opt(opts, "maxFilesPerTrigger")
    max_files = int(max_files) if max_files else None
    if path.startswith("kafka://"):
        host_port, _, topic = path[len("kafka://"):].partition("/")
        max_off = _opt(opts, "maxOffsetsPerTrigger")
        min_parts = _opt(opts, "minPartitions")
        try:
            stream = ssrc.kafka_stream(spark, host_port, topic, group_id=_opt(opts, "group.id"),
                                       max_offsets_per_trigger=int(max_off) if max_off else None,
                                       min_partitions=int(min_parts) if min_parts else None)
        except ssrc.ConnectorMissing as e:
            return {"run_id": run_id, "source_name": name, "status": "failed", "modality": modality,
                    "load_mode": mode, "worker": worker, "schema_version": version,
                    "record_count": 0, "invalid_count": 0, "valid_count": 0, "source_path": path,
                    "error": str(e)}
    elif path.startswith("socket://"):
        host, _, port = path[len("socket://"):].partition(":")
        stream = ssrc.socket_stream(spark, host, int(port))
    elif fmt == "text":
        stream = ssrc.text_line_stream(spark, path, max_files_per_trigger=max_files)
    else:
        stream = ssrc.kafka_shaped_file_stream(spark, path, max_files_per_trigger=max_files, fmt=fmt)
    stats: dict = {}
    rules, unique = quality.rules_from_config(_opt(opts, "rules"))
    commits.adopt(spark, lake, name, run_id)
    within = _opt(opts, "uniqueWithin")
    fn = jobs.batch_writer(
        out, jobs.generic_projection, rules=rules, unique=unique, fmt=lake.fmt, stats=stats,
        seen=lambda query, batch: commits.seen_keys(spark, lake, name, run_id, query, batch, within),
        committed=lambda query, batch, counts: commits.commit(spark, lake, name, run_id, query, batch, counts))
    jobs.foreach_batch_stream(stream, fn, ckpt)
    _record_progress(spark, lake, name, run_id, stats.get("progress", []))
    own = commits.totals(spark, lake, name, run_id)  # adopted batches included
    rec, bad = own["records"], own["dead_letters"] + own["invalid"]
    seconds = time.time() - t0
    prof = profile.profile_row({"record_count": rec, "invalid_count": bad}, seconds)
    refuse = gate == "source" and own["invalid"] > 0
    status = "empty" if rec == 0 else ("stored" if bad == 0 else ("quarantined" if refuse else "partial"))
    good, dead, wrong = (f"{out}/_row_state={side}" for side in ("curated", "dead_letter", "quarantine"))
    refused = out if status == "quarantined" else (dead if own["dead_letters"] else wrong) if bad else None
    return {"run_id": run_id, "source_name": name, "status": status, "modality": modality,
            "load_mode": mode, "worker": worker, "schema_version": version,
            "record_count": prof["record_count"], "invalid_count": prof["invalid_count"],
            "valid_count": prof["valid_count"], "processing_time_seconds": seconds,
            "rate_records_per_second": prof["rate_records_per_second"],
            "source_path": path, "staging_path": out if rec else None,
            "lakehouse_path": good if rec - bad > 0 and status != "quarantined" else None,
            "quarantine_path": refused, "error": None}


PROGRESS_SCHEMA = ("batch_id bigint, num_input_rows bigint, input_rows_per_second double, "
                   "processed_rows_per_second double, duration_ms bigint")


def _record_progress(spark, lake: Lake, source_name: str, run_id: str, progress: list) -> None:
    """P4 for streams: one row per micro-batch, as the batch writer counted
    and timed it (nothing depends on how many reports Spark keeps)."""
    if not progress:
        return
    data = [(int(b), int(n), n / t if t > 0 else 0.0, n / t if t > 0 else 0.0, int(t * 1000)) for b, n, t in progress]
    df = spark.createDataFrame(data, PROGRESS_SCHEMA).select(
        F.lit(source_name).alias("source_name"), F.lit(run_id).alias("run_id"), "*")
    lake.write_leaf(df, "stream_progress", run_id, source_name)


#: Seconds that a claimed schema version is waited for before it counts as given up.
CLAIM_SECONDS = 30.0
REGISTRY_SCHEMA = T.StructType([T.StructField("source_name", T.StringType()), T.StructField("modality", T.StringType()),
                                T.StructField("fields", schema.FIELDS_TYPE), T.StructField("version", T.IntegerType()),
                                T.StructField("run_id", T.StringType())])


def register_schema(spark: SparkSession, lake: Lake, source_name: str, modality: str, fields, run_id: str,
                    claim_seconds: float = CLAIM_SECONDS) -> int:
    """C6/C7 live: compare with the latest registered version and append a
    new version when the fields (order-free) or the modality changed.

    Drivers do not share a lock: a version is claimed by creating a file that must not exist yet. Where
    another run was first, its row is waited for and compared with anew, so two runs of the same
    schema share a version and two different ones never do. A claim whose row does not come within
    ``claim_seconds`` (its driver was lost) is passed over; version numbers then have a gap."""
    row = [(i, n, t) for i, (n, t) in enumerate(fields)]
    discovered = spark.createDataFrame([(source_name, modality, row)], T.StructType(REGISTRY_SCHEMA.fields[:3]))
    passed, waited, since = 0, None, 0.0
    while True:
        registry = lake.read_section(spark, "schema_registry")
        if registry is None:
            registry = spark.createDataFrame([], T.StructType(REGISTRY_SCHEMA.fields[:4]))
        e = schema.evolve(discovered, registry).first()
        version = int(e["version"])
        if not e["evolved"]:
            return version
        version = max(version, passed + 1)
        claim = f"{lake.root}/catalog/_claims/{hashlib.sha256(source_name.encode()).hexdigest()[:32]}/{version}"
        if files.create_exclusive(spark, claim):
            one = spark.createDataFrame([(source_name, modality, row, version, run_id)], REGISTRY_SCHEMA)
            lake.write_leaf(one, "schema_registry", run_id, source_name)
            return version
        if waited != version:
            waited, since = version, time.time()
        elif time.time() - since > claim_seconds:
            passed = version
        time.sleep(0.2)


__all__ = ["Lake", "ingest_frame", "ingest_sources", "record_run", "register_schema", "new_run_id",
           "read_current", "exposed", "register_views"]
