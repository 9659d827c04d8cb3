"""The orchestrated run over a fixture lake."""

import os

from pyspark.sql import functions as F

from sluice.operators import catalog
from sluice.plans.ingest import Lake, ingest_sources
from sluice.sources import config

from conftest import png_bytes, write

HEADER = "timestamp,acc_x,acc_y,acc_z\n"
ROWS = "t1,1,2,3\nt2,4,5,6\nt3,7,8,9\n"


def _fixture(root):
    write(f"{root}/good/a.csv", HEADER + ROWS)
    write(f"{root}/good/sub/a.csv", HEADER + ROWS)
    write(f"{root}/good/notes.json", '{"note": "beside the csv files"}')      # mixed folder (E2, E6)
    write(f"{root}/bad/a.csv", HEADER + ROWS)
    write(f"{root}/bad/narrow.csv", "timestamp,acc_x\nt,1\n")
    write(f"{root}/hasempty/a.csv", HEADER + ROWS)
    write(f"{root}/hasempty/z.csv", "")
    write(f"{root}/json/a.json", '[{"k": 1, "v": "x"}, {"k": 2, "v": "y"}]')
    write(f"{root}/text/a.txt", "one\ntwo\n")
    write(f"{root}/text/b.md", "# t\n")
    write(f"{root}/text/empty.log", "")
    write(f"{root}/img/a.png", png_bytes(2, 2))
    write(f"{root}/img/x.txt", "not allowed")
    write(f"{root}/vid/a.mp4", os.urandom(32))


def _sources(spark, root):
    return config.sources_from_rows(spark, [
        {"name": "good", "path": f"{root}/good", "target_table": "good_t"},
        {"name": "bad", "path": f"{root}/bad"},
        {"name": "hasempty", "path": f"{root}/hasempty"},
        {"name": "json", "path": f"{root}/json"},
        {"name": "text", "path": f"{root}/text"},
        {"name": "img", "path": f"{root}/img", "worker": "image"},
        {"name": "vid", "path": f"{root}/vid", "worker": "video"},
        {"name": "kafka", "path": "kafka://localhost:9092/csv_topic", "worker": "streaming"},
        {"name": "missing", "path": f"{root}/nothing_here"},
    ])


def test_orchestrated_run(spark, tmp_path):
    root = str(tmp_path / "data")
    _fixture(root)
    lake = Lake(str(tmp_path / "lake"))
    runs = ingest_sources(spark, _sources(spark, root), lake, run_id="r1", gate="source")
    got = {r["source_name"]: r for r in runs.collect()}
    assert got["good"]["status"] == "stored" and got["good"]["record_count"] == 6
    assert got["good"]["modality"] == "structured" and got["good"]["worker"] == "direct"
    assert got["bad"]["status"] == "quarantined"
    # the reference's numbers under the source gate (E8): 4 data rows, 1 invalid file
    assert (got["bad"]["record_count"], got["bad"]["invalid_count"], got["bad"]["valid_count"]) == (4, 1, 3)
    assert got["hasempty"]["status"] == "quarantined"              # empty_file (E10)
    assert got["json"]["modality"] == "semi_structured" and got["json"]["status"] == "stored"
    assert got["text"]["worker"] == "text" and got["text"]["record_count"] == 3   # zero-byte file counts
    assert got["text"]["status"] == "stored"
    assert got["img"]["status"] == "quarantined" and got["img"]["invalid_count"] == 1
    assert got["vid"]["status"] == "stored"
    assert got["kafka"]["modality"] == "streaming"
    assert got["kafka"]["status"] == "failed" and "connector" in got["kafka"]["error"]   # no broker jar here
    assert got["missing"]["modality"] == "unstructured" and got["missing"]["status"] == "empty"
    curated = spark.read.parquet(got["good"]["lakehouse_path"])
    assert curated.filter("note IS NULL").count() == 6 and "_source_file" in curated.columns
    assert [r["note"] for r in curated.filter("note IS NOT NULL").collect()] == ["beside the csv files"]   # stored, not counted (E6)
    assert got["good"]["lakehouse_path"].endswith("/tables/good/_v=r1/_row_state=valid")   # no second copy
    q = spark.read.parquet(got["bad"]["quarantine_path"])
    reasons = {x for r in q.select("_reasons").collect() for x in r[0]}
    assert "header_width" in reasons
    # catalog sections
    lineage = spark.read.parquet(lake.section("lineage"))
    ops = {(r["source_name"], r["operation"]) for r in lineage.collect()}
    assert ("good", "store_validated_data_in_lakehouse") in ops
    assert ("bad", "quarantine:schema_or_quality_violation") in ops
    exposed = {r["source_name"] for r in catalog.exposed_datasets(spark.read.parquet(lake.section("runs"))).collect()}
    assert {"good", "json", "text", "vid"} <= exposed and "bad" not in exposed
    reg = {r["source_name"]: r["version"] for r in spark.read.parquet(lake.section("schema_registry")).collect()}
    assert reg["good"] == 1
    ents = spark.read.parquet(lake.section("files"))
    assert ents.filter((F.col("source_name") == "good") & (F.col("run_id") == "r1")).count() == 3
    assert {r["content_type"] for r in ents.filter(F.col("source_name") == "img").collect()} == {
        "image/png", "text/plain"}
    txt = {r["path"].rsplit("/", 1)[-1]: r for r in spark.read.parquet(lake.section("text_data")).collect()}
    assert (txt["a.txt"]["n_lines"], txt["a.txt"]["n_words"], txt["a.txt"]["n_chars"]) == (2, 2, 6)
    prof = {r["source_name"]: r for r in spark.read.parquet(lake.section("profiles")).collect()}
    assert prof["good"]["valid_count"] == 6 and prof["good"]["processing_time_seconds"] > 0


def test_rerun_reuses_then_evolves_schema(spark, tmp_path):
    root = str(tmp_path / "data")
    write(f"{root}/good/a.csv", HEADER + ROWS)
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "good", "path": f"{root}/good"}])
    r1 = ingest_sources(spark, src, lake, run_id="r1").first()
    r2 = ingest_sources(spark, src, lake, run_id="r2").first()
    assert (r1["schema_version"], r2["schema_version"]) == (1, 1)
    write(f"{root}/good/a.csv", "timestamp,acc_x,acc_y,acc_z,acc_w\nt,1,2,3,4\n")
    r3 = ingest_sources(spark, src, lake, run_id="r3").first()
    assert r3["schema_version"] == 2
    reg = spark.read.parquet(lake.section("schema_registry"))
    assert sorted(r["version"] for r in reg.collect()) == [1, 2]
    latest = catalog.latest_datasets(spark.read.parquet(lake.section("datasets")))
    row = latest.filter(F.col("run_id") == "r3").first()
    assert row["entity_type"] == "Dataset" and row["lakehouse_path"].endswith("/_v=r3/_row_state=valid")
    assert [f["name"] for f in row["fields"]] == ["timestamp", "acc_x", "acc_y", "acc_z", "acc_w"]
    assert row["metadata"]["file_count"] == "1" and row["metadata"]["extensions"] == '[".csv"]'
    assert row["updated_at"] is not None


def test_record_gate_run(spark, tmp_path):
    root = str(tmp_path / "data")
    write(f"{root}/rag/a.csv", HEADER + "t1,1,2\n" + "t2,1,2,3\n" + "t3,1,2,3,4\n")
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "rag", "path": f"{root}/rag"}])
    r = ingest_sources(spark, src, lake, run_id="r1", gate="record").first()
    assert (r["status"], r["record_count"], r["invalid_count"], r["valid_count"]) == ("partial", 3, 2, 1)
    assert spark.read.parquet(r["lakehouse_path"]).count() == 1
    assert spark.read.parquet(r["quarantine_path"]).count() == 2


def test_parquet_json_xml_sources_are_read(spark, tmp_path):
    root = str(tmp_path / "data")
    spark.range(5).withColumnRenamed("id", "k").write.parquet(f"{root}/pq/part")
    write(f"{root}/js/a.json", '{"k": 1, "v": "x"}\n{"k": 2, "v": "y"}\nnot json\n')
    write(f"{root}/xml/a.xml", "<r><row><a>1</a></row><row><a>2</a></row></r>")
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [
        {"name": "pq", "path": f"{root}/pq"},
        {"name": "js", "path": f"{root}/js"},
        {"name": "xml", "path": f"{root}/xml", "options": {"rowTag": "row"}},
    ])
    got = {r["source_name"]: r for r in ingest_sources(spark, src, lake, run_id="r1", gate="record").collect()}
    assert (got["pq"]["status"], got["pq"]["record_count"]) == ("stored", 5)
    assert (got["js"]["record_count"], got["js"]["invalid_count"]) == (3, 1)      # unparsable line
    assert got["xml"]["modality"] == "semi_structured" and got["xml"]["record_count"] == 2


def test_stream_source_runs_and_resumes(spark, tmp_path):
    """A streaming source (path with a hint word) is ingested by a real
    availableNow query; the next run resumes from the lake's checkpoint."""
    root = str(tmp_path / "data" / "stream_in")
    write(f"{root}/a.txt", "a:1,b:x\nbroken\nc:2.5\n")
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "s", "path": root}])
    r1 = ingest_sources(spark, src, lake, run_id="r1").first()
    assert (r1["modality"], r1["worker"], r1["record_count"], r1["invalid_count"]) == ("streaming", "streaming", 3, 1)
    assert r1["status"] == "partial"
    curated = spark.read.parquet(r1["lakehouse_path"])
    assert sorted(r["json"] for r in curated.collect()) == ['{"a":1,"b":"x"}', '{"c":2.5}']
    assert spark.read.parquet(lake.section("files")).filter(F.col("source_name") == "s").count() == 1
    prog = spark.read.parquet(lake.section("stream_progress")).collect()
    assert sum(p["num_input_rows"] for p in prog) == 3 and all(p["source_name"] == "s" for p in prog)
    write(f"{root}/b.txt", "d:4\n")
    r2 = ingest_sources(spark, src, lake, run_id="r2").first()
    assert (r2["record_count"], r2["status"]) == (1, "stored")            # only the new file
    r3 = ingest_sources(spark, src, lake, run_id="r3").first()
    assert r3["status"] == "empty"


def test_auto_media_routing(spark):
    from sluice.operators import route
    sources = config.sources_from_rows(spark, [{"name": "img", "path": "/x/img"}, {"name": "vid", "path": "/x/vid"},
                                               {"name": "doc", "path": "/x/doc"}])
    manifest = spark.createDataFrame(
        [("img", "/x/img/a.png", ".png", 1), ("vid", "/x/vid/a.mp4", ".mp4", 1), ("doc", "/x/doc/a.txt", ".txt", 1)],
        "source_name string, path string, extension string, size_bytes bigint")
    plain = {r["name"]: r["worker_name"] for r in route.route_sources(sources, manifest).collect()}
    auto = {r["name"]: r["worker_name"] for r in route.route_sources(sources, manifest, auto_media=True).collect()}
    assert plain == {"img": "text", "vid": "text", "doc": "text"}          # E5: reference default
    assert auto == {"img": "image", "vid": "video", "doc": "text"}


def test_load_dataset_like_the_scripts(spark, tmp_path):
    from sluice.plans.loads import load_dataset
    root = str(tmp_path / "ds")
    for i in range(3):
        write(f"{root}/p{i}/f{i}.csv", HEADER + ROWS)
    write(f"{root}/img/a.png", png_bytes(2, 2))
    write(f"{root}/img/b.png", png_bytes(3, 1))
    r = load_dataset(spark, root, str(tmp_path / "t_csv"), "csv")
    assert r["records"] == 12                                  # headerless: 3 headers counted as data
    r2 = load_dataset(spark, root, str(tmp_path / "t_csv2"), "csv", first_files=2)
    assert r2["records"] == 8
    r3 = load_dataset(spark, root, str(tmp_path / "t_img"), "image")
    assert r3["records"] == 2 and spark.read.parquet(r3["target"]).agg(F.sum("width")).first()[0] == 5
    import pytest
    with pytest.raises(Exception):
        load_dataset(spark, root, str(tmp_path / "t_csv"), "csv")   # create-only (S4)


def test_text_source_with_a_file_no_value_can_hold(spark, tmp_path, monkeypatch):
    from sluice.sources import files
    root = str(tmp_path / "data" / "logs")
    write(f"{root}/small.txt", "a b\n")
    write(f"{root}/big.log", "word " * 200 + "\n")
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "t", "path": root, "options": {"largeFiles": "refuse"}}])
    monkeypatch.setattr(files, "MAX_ROW_BYTES", 100)
    monkeypatch.setattr(files.read_text_documents, "__defaults__", (False, None, 100))
    r = ingest_sources(spark, src, lake, run_id="r1", gate="record").first()
    assert (r["record_count"], r["invalid_count"], r["status"]) == (2, 1, "partial")
    q = spark.read.parquet(r["quarantine_path"]).collect()
    assert q[0]["path"].endswith("big.log") and list(q[0]["_reasons"]) == ["too_large_for_row"]
    ents = {x["path"].rsplit("/", 1)[-1]: x for x in spark.read.parquet(lake.section("text_data")).collect()}
    assert ents["big.log"]["n_words"] == 200                               # counted line by line


def test_text_source_unreadable_and_bad_utf8(spark, tmp_path):
    import gzip
    root = str(tmp_path / "data" / "docs")
    write(f"{root}/ok.txt", "fine\n")
    write(f"{root}/bytes.txt", b"bad \xff byte\n")
    write(f"{root}/good.txt.gz", gzip.compress(b"zipped\n"))
    write(f"{root}/broken.txt.gz", b"\x1f\x8b\x08\x00garbage")
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "d", "path": root, "worker": "text"}])
    r = ingest_sources(spark, src, lake, run_id="r1", gate="record").first()
    assert (r["record_count"], r["invalid_count"]) == (4, 1)                 # E12: bad bytes are readable
    q = spark.read.parquet(r["quarantine_path"]).collect()
    assert [(x["path"].rsplit("/", 1)[-1], list(x["_reasons"])) for x in q] == [("broken.txt.gz", ["unreadable"])]
    src2 = config.sources_from_rows(spark, [{"name": "d2", "path": root, "worker": "text",
                                             "options": {"checkUtf8": "true"}}])
    r2 = ingest_sources(spark, src2, lake, run_id="r2", gate="record").first()
    assert r2["invalid_count"] == 2                                          # opt-in bad_utf8


def test_read_current_keeps_last_good_version(spark, tmp_path):
    from sluice.plans.ingest import read_current
    root = str(tmp_path / "data")
    write(f"{root}/s/a.csv", HEADER + ROWS)
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "s", "path": f"{root}/s"}])
    ingest_sources(spark, src, lake, run_id="20260101T000000-a")
    write(f"{root}/s/b.csv", "x,y\n1,2\n")                           # a bad file: the next run is quarantined
    r2 = ingest_sources(spark, src, lake, run_id="20260102T000000-b").first()
    assert r2["status"] == "quarantined"
    cur = read_current(spark, lake, "s")
    assert cur.count() == 3                                                # still the first run's rows (E17)



def test_command_line_run(spark, tmp_path, capsys):
    import json as _json

    from sluice.__main__ import main
    root = str(tmp_path / "data")
    write(f"{root}/good/a.csv", HEADER + ROWS)
    cfg = write(str(tmp_path / "cfg.json"), _json.dumps({"sources": [{"name": "good", "path": f"{root}/good"}]}))
    assert main(["--config", cfg, "--lake", str(tmp_path / "lake"), "--summary", str(tmp_path / "summary")]) == 0
    out = [_json.loads(line) for line in capsys.readouterr().out.splitlines() if line.startswith("{")]
    assert out[0]["source_name"] == "good" and out[0]["status"] == "stored" and out[0]["record_count"] == 3
    assert spark.read.json(str(tmp_path / "summary")).count() == 1


def test_exposed_tables_become_views(spark, tmp_path):
    from sluice.plans.ingest import register_views
    root = str(tmp_path / "data")
    write(f"{root}/good/a.csv", HEADER + ROWS)
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "good", "path": f"{root}/good", "target_table": "sensor_data"}])
    ingest_sources(spark, src, lake, run_id="r1")
    assert register_views(spark, lake) == ["sensor_data"]
    assert spark.sql("SELECT count(*) AS n FROM sensor_data WHERE acc_x > '1'").first()["n"] == 2



def test_table_versions_and_message_rows(spark, tmp_path):
    from sluice.sinks import tables
    from sluice.sources import readers
    from sluice.streaming.jobs import message_rows
    root = str(tmp_path / "data")
    write(f"{root}/good/a.csv", HEADER + ROWS)
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "good", "path": f"{root}/good"}])
    ingest_sources(spark, src, lake, run_id="r1")
    write(f"{root}/good/b.csv", HEADER + "t9,1,1,1\n")
    ingest_sources(spark, src, lake, run_id="r2")
    allv = tables.read_versions(spark, lake.tables, "good").filter(F.col("_row_state") == "valid")
    assert {r["_v"]: r["n"] for r in allv.groupBy("_v").agg(F.count("*").alias("n")).collect()} == {"r1": 3, "r2": 4}
    assert tables.current_version(allv, "r2").count() == 4 and "_v" not in tables.current_version(allv, "r2").columns
    assert readers.read_table(spark, tables.version_path(lake.tables, "good", "r1")).count() == 3
    msgs = message_rows(spark.createDataFrame([(1, "x")], "a bigint, b string"), ["a", "b"], key_col="a")
    assert [tuple(r) for r in msgs.collect()] == [("1", "a:1,b:x")]


def test_many_sources_in_parallel(spark, tmp_path):
    root = str(tmp_path / "data")
    rows = []
    for i in range(8):
        write(f"{root}/s{i}/a.csv", HEADER + ROWS * (i + 1))
        rows.append({"name": f"s{i}", "path": f"{root}/s{i}"})
    lake = Lake(str(tmp_path / "lake"))
    runs = ingest_sources(spark, config.sources_from_rows(spark, rows), lake, run_id="r1", max_parallel=4)
    got = {r["source_name"]: (r["status"], r["record_count"]) for r in runs.collect()}
    assert got == {f"s{i}": ("stored", 3 * (i + 1)) for i in range(8)}
    for section in ("runs", "profiles", "datasets", "schema_registry"):
        names = [r["source_name"] for r in spark.read.parquet(lake.section(section)).select("source_name").collect()]
        assert sorted(set(names)) == [f"s{i}" for i in range(8)], section
    assert spark.read.parquet(lake.section("schema_registry")).count() == 8


def test_ragged_rows_pass_the_source_gate(spark, tmp_path):
    """FIXTURES ragged.csv: a good header with one short and one long row is
    valid under the source gate (files are checked, rows are not) and has 2
    quarantined rows under the record gate."""
    root = str(tmp_path / "data")
    write(f"{root}/rag/ragged.csv", HEADER + "t1,1,2\n" + "t2,1,2,3,4\n" + "t3,1,2,3\n")
    src = config.sources_from_rows(spark, [{"name": "rag", "path": f"{root}/rag"}])
    r1 = ingest_sources(spark, src, Lake(str(tmp_path / "lake1")), run_id="r1", gate="source").first()
    assert (r1["status"], r1["record_count"], r1["invalid_count"]) == ("stored", 3, 0)
    r2 = ingest_sources(spark, src, Lake(str(tmp_path / "lake2")), run_id="r1", gate="record").first()
    assert (r2["status"], r2["invalid_count"], r2["valid_count"]) == ("partial", 2, 1)



def test_duplicate_source_names_are_rejected(spark, tmp_path):
    import pytest
    src = config.sources_from_rows(spark, [{"name": "x", "path": "/a"}, {"name": "x", "path": "/b"}])
    with pytest.raises(ValueError, match="unique"):
        ingest_sources(spark, src, Lake(str(tmp_path / "lake")))


def test_json_source_counts_files_under_source_gate_and_reads_with_discovered_schema(spark, tmp_path):
    root = str(tmp_path / "data")
    write(f"{root}/j/a.json", '[{"k": 1, "v": "x", "tags": ["p"]}, {"k": 2, "v": "y", "tags": []}]')
    write(f"{root}/j/b.json", '[{"k": 3, "v": "z", "tags": null}]')
    src = config.sources_from_rows(spark, [{"name": "j", "path": f"{root}/j", "options": {"multiLine": "true"}}])
    r1 = ingest_sources(spark, src, Lake(str(tmp_path / "l1")), run_id="r1", gate="source").first()
    assert (r1["status"], r1["record_count"], r1["invalid_count"]) == ("stored", 2, 0)     # E6: files
    r2 = ingest_sources(spark, src, Lake(str(tmp_path / "l2")), run_id="r1", gate="record").first()
    assert (r2["record_count"], r2["invalid_count"]) == (3, 0)                            # rows
    cur = spark.read.parquet(r2["lakehouse_path"])
    assert dict(cur.dtypes)["k"] == "bigint" and sorted(r["k"] for r in cur.collect()) == [1, 2, 3]


def test_load_dataset_binary_videos(spark, tmp_path):
    import os as _os

    from sluice.plans.loads import load_dataset
    root = str(tmp_path / "vids")
    for i in range(4):
        write(f"{root}/c{i}/v{i}.mp4", _os.urandom(16 + i))
    write(f"{root}/notes.txt", "not a video")
    r = load_dataset(spark, root, str(tmp_path / "t_all"), "binary")
    assert r["records"] == 4
    t = spark.read.parquet(r["target"])
    assert sorted(x["length"] for x in t.collect()) == [16, 17, 18, 19]
    r2 = load_dataset(spark, root, str(tmp_path / "t_two"), "binary", first_files=2)
    assert r2["records"] == 2


def _run(spark, tmp_path, rows, gate="record", name="lake"):
    lake = Lake(str(tmp_path / name))
    return lake, {r["source_name"]: r for r in ingest_sources(spark, config.sources_from_rows(spark, rows), lake, gate=gate).collect()}


def test_json_keeps_every_key_and_value(spark, tmp_path):
    root = str(tmp_path / "j")
    write(f"{root}/a.json", '{"k": 1, "v": "x"}\n{"k": 1.5, "w": [1, 2]}\n')
    write(f"{root}/b.json", '{\n "k": 7,\n "z": {"q": null}\n}\n')
    write(f"{root}/c.json", '[{"k": 2}, 5, "text"]')
    write(f"{root}/d.json", '{"k": 3}\nnot json\n{"k": 8}{"k": 9}\n')      # two values on a line are no value
    _, got = _run(spark, tmp_path, [{"name": "j", "path": root}])
    r = got["j"]
    assert (r["status"], r["record_count"], r["invalid_count"]) == ("partial", 9, 2)
    rows = spark.read.parquet(r["staging_path"]).collect()
    assert sorted((x["k"], x["v"], str(x["_extra"]), x["_raw"]) for x in rows if x["k"] is not None) == [
        (1, "x", "None", None), (2, None, "None", None), (3, None, "None", None), (7, None, "{'z': '{\"q\":null}'}", None)]
    rest = {(x["_raw"], str(dict(x["_extra"] or {}))) for x in rows if x["k"] is None}
    assert rest == {(None, "{'k': '1.5', 'w': '[1,2]'}"), ("5", "{}"), ('"text"', "{}"), ("not json", "{}"), ('{"k": 8}{"k": 9}', "{}")}
    bad = spark.read.parquet(r["quarantine_path"]).collect()
    assert sorted((x["_raw"], list(x["_reasons"])) for x in bad) == [("not json", ["json_parse"]), ('{"k": 8}{"k": 9}', ["json_parse"])]
    _, got = _run(spark, tmp_path, [{"name": "j", "path": root}], gate="source", name="lake2")
    assert (got["j"]["status"], got["j"]["record_count"], got["j"]["invalid_count"]) == ("quarantined", 4, 2)


def test_quoted_newlines_stay_one_record(spark, tmp_path):
    root = str(tmp_path / "c")
    write(f"{root}/a.csv", 'id,t\n1,"x\ny"\n2,z\n')
    write(f"{root}/b.csv", "id,t\n3,plain\n")
    write(f"{root}/c.csv", '"id","t"\n4,"a ""quoted"" one"\n')
    write(f"{root}/d.csv", '"id","t\nu"\n5,v\n')
    for gate in ("record", "source"):
        _, got = _run(spark, tmp_path, [{"name": "c", "path": root}], gate=gate, name="lake-" + gate)
        assert (got["c"]["status"], got["c"]["record_count"], got["c"]["invalid_count"]) == ("stored", 5, 0)
        rows = spark.read.parquet(got["c"]["lakehouse_path"]).collect()
        assert sorted((r["id"], r["t"]) for r in rows) == [("1", "x\ny"), ("2", "z"), ("3", "plain"), ("4", 'a "quoted" one'), ("5", "v")]


def test_no_listing_is_stored_for_rows(spark, tmp_path):
    import gzip
    root = str(tmp_path / "n")
    write(f"{root}/long/a.csv", "x" * 200000 + ",b\n1,2\n")
    write(f"{root}/blank/a.csv", "\n\n")
    write(f"{root}/broken/a.csv", "")
    _, got = _run(spark, tmp_path, [{"name": n, "path": f"{root}/{n}"} for n in ("long", "blank", "broken")])
    assert (got["long"]["status"], got["long"]["record_count"]) == ("stored", 1)
    assert "x" * 200000 in spark.read.parquet(got["long"]["lakehouse_path"]).columns
    for n in ("blank", "broken"):
        rows = spark.read.parquet(got[n]["quarantine_path"]).collect()
        assert got[n]["lakehouse_path"] is None and [list(r["_reasons"]) for r in rows] == [["empty_file"]]
    assert gzip  # compressed text is covered by the text tests


def test_hint_words_and_explicit_modality(spark, tmp_path):
    root = str(tmp_path / "upstream topic")
    write(f"{root}/a.csv", HEADER + ROWS)
    _, got = _run(spark, tmp_path, [{"name": "u", "path": "file://" + root, "modality": "structured"}])
    assert (got["u"]["status"], got["u"]["record_count"], got["u"]["modality"]) == ("stored", 3, "structured")


def test_media_sources_store_their_data(spark, tmp_path):
    root = str(tmp_path / "m")
    write(f"{root}/img/a b.png", png_bytes(2, 2))
    write(f"{root}/img/bad.png", b"no image")
    write(f"{root}/img/attr.csv", "id\n1\n")
    write(f"{root}/vid/a.mp4", b"12345")
    lake, got = _run(spark, tmp_path, [
        {"name": "img", "path": f"{root}/img", "worker": "image"}, {"name": "vid", "path": f"{root}/vid", "worker": "video"},
        {"name": "strict", "path": f"{root}/img", "worker": "image", "options": {"decode": "true"}},
        {"name": "paths", "path": f"{root}/vid", "worker": "video", "options": {"content": "paths"}}])
    rows = {r["file_name"]: r for r in spark.read.parquet(got["img"]["lakehouse_path"]).collect()}
    assert (rows["a b.png"]["width"], rows["bad.png"]["width"], rows["attr.csv"]["width"]) == (2, -1, None)
    assert bytes(spark.read.parquet(got["vid"]["lakehouse_path"]).first()["content"]) == b"12345"
    assert (got["strict"]["record_count"], got["strict"]["invalid_count"]) == (3, 1)
    assert "content" not in spark.read.parquet(got["paths"]["lakehouse_path"]).columns
    phases = spark.read.parquet(lake.section("phases")).filter("source_name = 'img'").orderBy("seq").collect()
    assert [p["phase"] for p in phases] == ["list", "discover", "stage"] and phases[2]["items"] == 3


def test_yaml_xml_and_script_workers(spark, tmp_path):
    root = str(tmp_path / "y")
    write(f"{root}/y/a.yaml", "a: 1\n")
    write(f"{root}/y/b.YML", "b: 2\n")
    write(f"{root}/x/a.xml", "<r><i>1</i></r>")
    write(f"{root}/s/a.csv", HEADER + ROWS)
    _, got = _run(spark, tmp_path, [{"name": "y", "path": f"{root}/y"}, {"name": "x", "path": f"{root}/x"},
                                    {"name": "s", "path": f"{root}/s", "worker": "old_script"}])
    docs = {r["document"] for r in spark.read.parquet(got["y"]["lakehouse_path"]).collect()}
    assert docs == {"a: 1\n", "b: 2\n"}
    assert spark.read.parquet(got["x"]["lakehouse_path"]).first()["document"] == "<r><i>1</i></r>"
    assert got["s"]["status"] == "failed" and "old_script" in got["s"]["error"] and got["s"]["staging_path"] is None


def test_rules_and_cleaning_from_options(spark, tmp_path):
    root = str(tmp_path / "r")
    write(f"{root}/a.csv", "id,v,c\n1, 5 ,x\n2,50,x\n3,abc,y\n3,7,\n , , \n")
    rules = ('[{"range": "v", "lo": 1, "hi": 10}, {"castable": "v", "type": "int"}, {"not_null": "c", "name": "no_c"}, {"unique": "id"}]')
    options = {"rules": rules, "clean": "true"}
    _, got = _run(spark, tmp_path, [{"name": "r", "path": root, "options": options}])
    rows = sorted((x["id"], x["v"], x["c"], tuple(x["_reasons"])) for x in spark.read.parquet(got["r"]["staging_path"]).fillna("").collect())
    assert rows == [("1", "5", "x", ()), ("2", "50", "x", ("range:v",)), ("3", "7", "", ("no_c", "unique:id")),
                    ("3", "abc", "y", ("castable:v", "unique:id"))]
    _, got = _run(spark, tmp_path, [{"name": "r", "path": root, "options": options}], gate="source", name="l2")
    assert (got["r"]["status"], got["r"]["record_count"], got["r"]["invalid_count"]) == ("quarantined", 4, 3)
    import pytest

    from sluice.operators import quality
    with pytest.raises(ValueError):
        quality.rules_from_config('[{"nonsense": "a"}]')


def test_run_ids_rise(monkeypatch):
    from sluice.plans import ingest
    ids = [ingest.new_run_id() for _ in range(2000)]
    assert ids == sorted(ids) and len({i.split("-")[0] for i in ids}) == 2000
    monkeypatch.setattr(ingest.time, "time_ns", lambda: 0)              # a clock that jumps back
    assert ingest.new_run_id() > ids[-1]


def test_stream_rules_and_source_gate(spark, tmp_path):
    root = str(tmp_path / "stream_in")
    write(f"{root}/a.txt", "a:1,b:x\nbroken\na:9\n")
    rows = [{"name": "s", "path": root, "options": {"rules": '[{"range": "fields[\'a\']", "hi": 5, "name": "a"}]'}}]
    lake, got = _run(spark, tmp_path, rows, gate="source")
    assert (got["s"]["status"], got["s"]["record_count"], got["s"]["invalid_count"], got["s"]["lakehouse_path"]) == ("quarantined", 3, 2, None)
    _, got = _run(spark, tmp_path, rows, gate="record", name="l2")
    assert (got["s"]["status"], got["s"]["invalid_count"]) == ("partial", 2)
    sides = spark.read.parquet(got["s"]["staging_path"]).groupBy("_row_state").count().collect()
    assert {r["_row_state"]: r["count"] for r in sides} == {"curated": 1, "quarantine": 1, "dead_letter": 1}
