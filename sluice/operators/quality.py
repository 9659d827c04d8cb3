"""Validation, cleaning and gating.

A *rule* is ``(reason, violated)`` where ``violated`` is a boolean Column
(NULL counts as not violated). Rules become one ``_reasons array<string>``
column in a single projection, evaluated in the same whole-stage codegen
stage as the scan. Only the uniqueness rule needs a shuffle: an
aggregate of the key (partial aggregation first) joined back - broadcast
when the duplicate list is measured small, else a shuffle join in which AQE
splits a skewed key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import fresh_name
from ..functions.paths import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from ..functions.text import blank_to_null, py_strip
from .joins import join_small, persist_fresh
from .schema import header_fields

REASONS = "_reasons"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ref(name: str) -> Column:
    """A rule's column: a name, or a field access such as ``fields['key']``."""
    return F.expr(name) if "[" in name else F.col(name)


# --- rule constructors (D9) --------------------------------------------------

def not_null(col: str, name: str | None = None):
    return (name or f"not_null:{col}", _ref(col).isNull())


def in_range(col: str, lo=None, hi=None, name: str | None = None, text: bool = False):
    c = _ref(col)
    if text:  # a text column: values that are no number are the castable rule's matter
        c = c.try_cast("double")
    bad = F.lit(False)
    if lo is not None:
        bad = bad | (c < F.lit(lo))
    if hi is not None:
        bad = bad | (c > F.lit(hi))
    return (name or f"range:{col}", bad)


def in_domain(col: str, values, name: str | None = None):
    return (name or f"domain:{col}", ~_ref(col).isin(*values))


def castable(col: str, type_name: str, name: str | None = None):
    c = _ref(col)
    return (name or f"castable:{col}", c.isNotNull() & c.try_cast(type_name).isNull())


def matches(col: str, pattern: str, name: str | None = None):
    return (name or f"pattern:{col}", ~_ref(col).rlike(pattern))


def row_width(corrupt_col: str = "_corrupt", name: str = "row_width"):
    """A PERMISSIVE CSV read with the expected-width schema fills the
    corrupt column for short *and* long rows."""
    return (name, F.col(corrupt_col).isNotNull())


def width_status(n_cells, expected: int) -> Column:
    """D7 on an already split row: ``ok``, ``short`` or ``long``."""
    n = _c(n_cells)
    return (F.when(n == expected, F.lit("ok")).when(n < expected, F.lit("short"))
            .otherwise(F.lit("long")))


def rules_from_config(text: str | None) -> tuple[list, list | None]:
    """D9 from a source's options: ``(rules, unique key)`` of a JSON list such as
    ``[{"not_null": "a"}, {"range": "a", "lo": 0, "hi": 9}, {"domain": "a",
    "values": ["x"]}, {"castable": "a", "type": "int"}, {"pattern": "a",
    "regex": "^x"}, {"unique": ["a", "b"]}]``; ``name`` names a rule's reason."""
    import json
    makers = {"not_null": lambda r, c: not_null(c, r.get("name")),
              "range": lambda r, c: in_range(
                  c, r.get("lo"), r.get("hi"), r.get("name"),
                  text=not any(isinstance(v, str) for v in (r.get("lo"), r.get("hi")))),
              "domain": lambda r, c: in_domain(c, r["values"], r.get("name")),
              "castable": lambda r, c: castable(c, r["type"], r.get("name")),
              "pattern": lambda r, c: matches(c, r["regex"], r.get("name"))}
    rules, unique = [], None
    for r in json.loads(text) if text else []:
        kind = next((k for k in r if k in makers or k == "unique"), None)
        if kind is None:
            raise ValueError(f"unknown rule {r}: one of {sorted([*makers, 'unique'])}")
        if kind == "unique":
            unique = [r["unique"]] if isinstance(r["unique"], str) else list(r["unique"])
        else:
            rules.append(makers[kind](r, r[kind]))
    return rules, unique


def reasons_column(rules) -> Column:
    """All violated rule names of a row, in rule order. ``array_except`` with
    a NULL drops the rules that passed and, unlike a lambda filter, stays in
    whole-stage codegen."""
    if not rules:
        return F.array().cast("array<string>")
    hits = F.array(*[F.when(F.coalesce(v, F.lit(False)), F.lit(n)) for n, v in rules])
    return F.array_except(hits, F.array(F.lit(None).cast("string")))


def key_digest(keys) -> Column:
    """One digest of a row's key: columns or field accesses such as
    ``fields['id']``; null where a part is null."""
    parts = [_ref(k) for k in keys]
    known = parts[0].isNotNull()
    for p in parts[1:]:
        known = known & p.isNotNull()
    named = F.struct(*[p.alias(f"k{i}") for i, p in enumerate(parts)])
    return F.when(known, F.unhex(F.sha2(F.to_json(named), 256)))


def with_unique_flag(df: DataFrame, keys, flag: str = "_dup", seen: DataFrame | None = None) -> DataFrame:
    """Uniqueness (D9): ``flag`` is true on every row whose key occurs more
    than once, or occurs in ``seen`` (a frame of the same key columns). ``keys`` are columns or field
    accesses. Keys with a NULL part never collide (SQL UNIQUE semantics).
    Key counts aggregate map-side first (a hot key collapses before the
    shuffle, and before the keys meet the seen ones); the list of refused keys is broadcast
    when its measured size allows, otherwise joined with a shuffle."""
    names = []
    for k in keys:
        names.append(fresh_name([*df.columns, *names], "_unique") if "[" in k else k)
    keyed = df.select("*", *[_ref(k).alias(n) for k, n in zip(keys, names) if k != n])
    counts = keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    refused = counts.filter(F.col("_n") > 1).select(*names)
    if seen is not None:
        refused = refused.unionByName(counts.select(*names).join(seen, names, "left_semi")).distinct()
    out = join_small(keyed, refused.withColumn(flag, F.lit(True)), names, "left")
    return out.withColumn(flag, F.coalesce(F.col(flag), F.lit(False))).select(*df.columns, flag)


def apply_rules(df: DataFrame, rules=(), unique=None, unique_name: str | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Tag every row with ``_reasons`` (empty = valid). ``seen`` holds keys
    that were stored before (see :func:`with_unique_flag`)."""
    rules = list(rules)
    flag = fresh_name(df.columns, "_dup")
    if unique:
        keys = list(unique)
        df = with_unique_flag(df, keys, flag, seen)
        rules.append((unique_name or f"unique:{','.join(keys)}", F.col(flag)))
    out = df.withColumn(REASONS, reasons_column(rules))
    return out.drop(flag) if unique else out


def record_gate(tagged: DataFrame):
    """Split tagged rows into (valid, invalid). Both sides read the same
    tagged plan; callers persist it (staging) once and split the stored copy."""
    ok = F.size(F.col(REASONS)) == 0
    return tagged.filter(ok).drop(REASONS), tagged.filter(~ok)


def source_gate_summary(tagged: DataFrame, source_col: str) -> DataFrame:
    """Per source record/invalid/valid counts and the gate decision: any
    invalid record sends the whole source to quarantine."""
    bad = F.size(F.col(REASONS)) > 0
    s = tagged.groupBy(source_col).agg(
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(bad).alias("invalid_count"))
    s = s.withColumn("valid_count", F.greatest(F.col("record_count") - F.col("invalid_count"), F.lit(0)))
    return s.withColumn("status", F.when(F.col("invalid_count") == 0, F.lit("stored"))
                        .otherwise(F.lit("quarantined")))


def source_gate(tagged: DataFrame, source_col: str):
    """D5 rows: (stored rows, quarantined rows, summary). Every row meets its
    source's decision by a null-safe join - rows without a source are a source
    of their own - which is a broadcast where the summary is measured small
    and otherwise a shuffle join whose skewed sources are split."""
    summary = persist_fresh(source_gate_summary(tagged, source_col))
    verdict = summary.select(F.col(source_col).alias("_gate_source"), F.col("status").alias("_gate_status"))
    j = join_small(tagged, verdict, F.col(source_col).eqNullSafe(F.col("_gate_source")), "inner")
    return (j.filter(F.col("_gate_status") == "stored").select(*tagged.columns),
            j.filter(F.col("_gate_status") == "quarantined").select(*tagged.columns), summary.drop("_sluice_call"))


# --- cleaning (D8) --------------------------------------------------------------

def clean_rows(df: DataFrame, dedupe: bool = False, string_cols=None, technical=()) -> DataFrame:
    """Strip strings, blank -> NULL, drop rows with every column NULL, and
    optionally drop exact duplicates (partial aggregation, so a repeated row
    collapses before the shuffle). ``technical`` columns (file name, parse
    state) are left as they are and decide nothing."""
    data = [c for c in df.columns if c not in technical]
    string_cols = string_cols if string_cols is not None else [
        f.name for f in df.schema.fields if f.dataType.simpleString() == "string" and f.name in data]
    out = df.select(*[blank_to_null(F.col(c)).alias(c) if c in string_cols else F.col(c)
                      for c in df.columns])
    if data:
        out = out.filter(F.greatest(*[F.col(c).isNotNull() for c in data])
                         if len(data) > 1 else F.col(data[0]).isNotNull())
    return out.dropDuplicates(data if technical else None) if dedupe else out


# --- file rules (D1-D4) --------------------------------------------------------

def image_file_invalid(ext) -> Column:
    """D3: not an image extension and not a ``.csv`` side file."""
    e = _c(ext)
    return ~e.isin(*IMAGE_EXTENSIONS) & (e != ".csv")


def video_file_invalid(ext) -> Column:
    """Not a video extension."""
    return ~_c(ext).isin(*VIDEO_EXTENSIONS)


def header_checks(spark, path: str, manifest: DataFrame, expected_width: int, expected_names=None) -> DataFrame:
    """Per CSV/TSV file of the manifest ``(file_path, uri, reason, cells,
    multi_line)``; reason NULL when the header is fine, else ``empty_file``
    (E10), ``unreadable`` (E11), ``header_width`` (cell count differs from the
    expected schema, E7) or ``duplicate_header`` (names collapse, E9). Opt-in
    with ``expected_names``: ``header_order`` (same names, other order - read by
    position it would shift columns) and ``header_names`` (other names of
    the same width). One line scan of the files; see ``sources.headers``."""
    from ..sources.headers import first_records, quoted_headers
    # one row a file: small beside the data, and used by the gate several times
    heads = persist_fresh(first_records(spark, path)).drop("_sluice_call")
    broken = heads.filter("broken")
    cells = F.col("cells")
    found = heads
    extensions = [r[0] for r in broken.select("extension").distinct().collect()]
    if extensions:
        read = None
        for ext in extensions:
            part = quoted_headers(spark, path, ext, broken.filter(F.col("extension") == ext), expected_width)
            read = part if read is None else read.unionByName(part)
        found = heads.join(read.select("uri", F.col("cells").alias("_quoted")), "uri", "left")
        cells = F.coalesce(F.col("cells"), F.col("_quoted"))
    found = found.select("file_path", "uri", cells.alias("cells"), "multi_line", "broken")
    listed = manifest.filter(F.col("extension").isin(".csv", ".tsv")).select(F.col("path").alias("file_path"), "size_bytes")
    h = listed.join(found, "file_path", "left")
    n_cells = F.size(F.col("cells"))
    named = header_fields(F.col("cells"))
    n_named = F.size(named)
    ok = F.col("cells").isNotNull()
    reason = (F.when(F.col("size_bytes") == 0, F.lit("empty_file"))
              .when(F.col("multi_line").isNull(), F.lit("unreadable"))
              .when(F.col("broken") & ~ok, F.lit("header_width"))
              .when(~ok, F.lit("empty_file"))
              .when(n_cells != expected_width, F.lit("header_width"))
              .when(n_named < n_cells, F.lit("duplicate_header")))
    if expected_names:
        got = F.transform(named, lambda f: f["name"])
        want = F.array(*[F.lit(n) for n in expected_names])
        reason = (reason.when(ok & (F.array_sort(got) != F.array_sort(want)), F.lit("header_names"))
                  .when(ok & (got != want), F.lit("header_order")))
    return h.select("file_path", "uri", reason.alias("reason"), "cells", F.coalesce("multi_line", F.lit(False)).alias("multi_line"))
