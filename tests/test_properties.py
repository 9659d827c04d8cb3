"""Properties on generated inputs for header naming (C1), path parts
"""

import pathlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sluice.functions import paths
from sluice.operators import route, schema

_CELL = st.text(alphabet=" \tab_xy", max_size=4)


def _expected_fields(cells):
    """Dict semantics: stripped name or column_<i>; a repeated name keeps its
    first position."""
    seen = {}
    for i, c in enumerate(cells):
        name = c.strip(" \t\n\r\f\x0b") or f"column_{i}"
        seen.setdefault(name, i)
    return [(pos, name) for name, pos in sorted(seen.items(), key=lambda kv: kv[1])]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(_CELL, min_size=1, max_size=6), min_size=1, max_size=5))
def test_header_fields_property(spark, headers):
    df = spark.createDataFrame([(i, h) for i, h in enumerate(headers)], "i int, cells array<string>")
    got = {r["i"]: [(f["pos"], f["name"]) for f in r["f"]]
           for r in df.select("i", schema.header_fields(F.col("cells")).alias("f")).collect()}
    assert got == {i: _expected_fields(h) for i, h in enumerate(headers)}


_NAME = st.text(alphabet="ab.XY_", min_size=1, max_size=7).filter(lambda n: n not in (".", ".."))  # not file names


@settings(max_examples=10, deadline=None)
@given(st.lists(_NAME, min_size=1, max_size=10))
def test_path_parts_property(spark, names):
    df = spark.createDataFrame([(f"/d/{n}",) for n in names], "p string")
    rows = df.select("p", paths.path_parts("p").alias("x")).collect()
    for r in rows:
        p = pathlib.PurePosixPath(r["p"])
        assert (r["x"]["file_name"], r["x"]["stem"], r["x"]["extension"]) == (p.name, p.stem, p.suffix.lower())


_EXT = st.sampled_from([".csv", ".PARQUET", ".json", ".yml", ".png", ".mp4", ".txt", ".bin", ""])


def _expected_modality(exts):
    exts = {e.lower() for e in exts}
    if exts & {".csv", ".tsv", ".parquet", ".delta"}:
        return "structured"
    if exts & {".json", ".xml", ".yaml", ".yml"}:
        return "semi_structured"
    return "unstructured"


@settings(max_examples=10, deadline=None)
@given(st.lists(st.lists(_EXT, min_size=0, max_size=5), min_size=1, max_size=6))
def test_directory_precedence_property(spark, dirs):
    from sluice.sources import config
    sources = config.sources_from_rows(spark, [{"name": f"s{i}", "path": f"/lake/s{i}"} for i in range(len(dirs))])
    rows = [(f"s{i}", f"/lake/s{i}/f{j}{e}", e.lower(), 1) for i, exts in enumerate(dirs) for j, e in enumerate(exts)]
    manifest = spark.createDataFrame(rows, "source_name string, path string, extension string, size_bytes bigint")
    got = {r["name"]: r["modality"] for r in route.route_sources(sources, manifest).collect()}
    assert got == {f"s{i}": _expected_modality(exts) for i, exts in enumerate(dirs)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet="ab:,.1 ", max_size=10), min_size=1, max_size=12))
def test_decoder_property(spark, msgs):
    from sluice.functions import codec
    from test_functions import plain_decode
    df = spark.createDataFrame([(m,) for m in msgs], "m string")
    for r in codec.decode_messages(df, "m", "d").collect():
        assert r["d"]["fields"] == plain_decode(r["m"]), r["m"]


_VAL = st.one_of(st.none(), st.text(alphabet=" \tab", max_size=3))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(_VAL, _VAL), min_size=1, max_size=20))
def test_clean_rows_property(spark, rows):
    from sluice.operators import quality

    def clean(v):
        if v is None:
            return None
        v = v.strip(" \t\n\r\f\x0b")
        return v or None
    expected = {(clean(a), clean(b)) for a, b in rows} - {(None, None)}
    df = spark.createDataFrame(rows, "a string, b string")
    got = [tuple(r) for r in quality.clean_rows(df, dedupe=True).collect()]
    assert len(got) == len(set(got)) and set(got) == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", "c"]), st.integers(1, 30),
                          st.sampled_from(["stored", "quarantined", "partial"])),
                min_size=1, max_size=25, unique_by=lambda r: (r[0], r[1])))
def test_exposure_property(spark, history):
    """The exposed version is the newest run that wrote a curated
    table; stale_since_run is the first quarantined run after it."""
    from sluice.operators import catalog
    rows = [(f"r{n:03d}", s, st_, f"/lh/{s}/{n}" if st_ != "quarantined" else None,
             f"/q/{s}/{n}" if st_ != "stored" else None) for s, n, st_ in history]
    runs = spark.createDataFrame(rows, "run_id string, source_name string, status string, "
                                       "lakehouse_path string, quarantine_path string")
    got = {r["source_name"]: (r["exposed_run"], r["lakehouse_path"], r["stale_since_run"])
           for r in catalog.exposed_datasets(runs).collect()}
    expected = {}
    for s in {h[0] for h in history}:
        mine = sorted((rid, st_, lh) for rid, src, st_, lh, _ in rows if src == s)
        good = [(rid, lh) for rid, st_, lh in mine if lh is not None]
        if not good:
            continue
        last_rid, last_lh = good[-1]
        later_q = [rid for rid, st_, _ in mine if st_ == "quarantined" and rid > last_rid]
        expected[s] = (last_rid, last_lh, later_q[0] if later_q else None)
    assert got == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["s1", "s2", "s3"]), st.sampled_from([".csv", ".tsv", ".json", ".png"]),
                          st.integers(0, 9)), min_size=1, max_size=20))
def test_record_counts_property(spark, files_):
    """A source with csv/tsv files counts their data rows (others
    are ignored); a source without counts files."""
    from sluice.operators import profile
    rows = [(s, f"/l/{s}/f{i}{e}", e, r) for i, (s, e, r) in enumerate(files_)]
    m = spark.createDataFrame(rows, "source_name string, path string, extension string, csv_rows bigint")
    got = {r["source_name"]: (r["record_count"], r["count_unit"]) for r in profile.record_counts(m).collect()}
    expected = {}
    for s in {f[0] for f in files_}:
        mine = [(e, r) for src, e, r in files_ if src == s]
        tab = [r for e, r in mine if e in (".csv", ".tsv")]
        expected[s] = (sum(tab), "rows") if tab else (len(mine), "files")
    assert got == expected
