"""Catalog operators on a hand-made run history."""

from pyspark.sql import functions as F

from sluice.operators import catalog

RUNS = "run_id string, source_name string, status string, source_path string, staging_path string, " \
       "lakehouse_path string, quarantine_path string, error string, schema_version int, modality string, " \
       "load_mode string, record_count bigint, invalid_count bigint, valid_count bigint"


def _runs(spark):
    rows = [
        ("r1", "a", "stored", "/in/a", "/st/a/1", "/lh/a/1", None, None, 1, "structured", "batch", 3, 0, 3),
        ("r2", "a", "quarantined", "/in/a", "/st/a/2", None, "/q/a/2", None, 1, "structured", "batch", 3, 1, 2),
        ("r3", "a", "quarantined", "/in/a", "/st/a/3", None, "/q/a/3", "bad_header", 2, "structured", "batch", 3, 3, 0),
        ("r1", "b", "partial", "/in/b", "/st/b/1", "/lh/b/1", "/q/b/1", None, 1, "structured", "batch", 5, 2, 3),
        ("r1", "c", "quarantined", "/in/c", "/st/c/1", None, "/q/c/1", None, 1, "unstructured", "batch", 1, 1, 0),
    ]
    return spark.createDataFrame(rows, RUNS)


def test_lineage_edges_follow_written_paths(spark):
    e = {(r["source_name"], r["run_id"], r["operation"]) for r in catalog.lineage_edges(_runs(spark)).collect()}
    assert ("b", "r1", "store_validated_data_in_lakehouse") in e and ("b", "r1", "quarantine:schema_or_quality_violation") in e
    assert ("a", "r3", "quarantine:bad_header") in e
    assert sum(1 for x in e if x[2] == "route_to_temporary_staging") == 5
    ids = [r["lineage_id"] for r in catalog.lineage_edges(_runs(spark)).collect()]
    assert len(ids) == len(set(ids)) == 11            # 5 staging + 2 store + 4 quarantine edges


def test_latest_dataset_is_last_write(spark):
    latest = {r["source_name"]: r for r in catalog.latest_datasets(catalog.dataset_log(_runs(spark))).collect()}
    assert latest["a"]["run_id"] == "r3" and latest["a"]["lakehouse_path"] is None
    assert latest["b"]["lakehouse_path"] == "/lh/b/1"          # the second write of a stored run wins


def test_exposure_keeps_last_good_version(spark):
    ex = {r["source_name"]: r for r in catalog.exposed_datasets(_runs(spark)).collect()}
    assert ex["a"]["lakehouse_path"] == "/lh/a/1" and ex["a"]["stale_since_run"] == "r2"   # E17
    assert ex["b"]["stale_since_run"] is None and "c" not in ex
    assert ex["a"]["status"] == "available" and ex["a"]["access_mode"] == "lakehouse_table_path"


def test_run_rows_pick_the_output_path(spark):
    rows = {(r["source"], r["run_id"]): r["output_path"] for r in catalog.run_rows(_runs(spark)).collect()}
    assert rows[("a", "r1")] == "/lh/a/1" and rows[("a", "r2")] == "/q/a/2"


def test_file_entities_and_optional_cap(spark):
    m = spark.createDataFrame([("s", f"/d/f{i:02d}.PNG", 10 + i) for i in range(12)],
                              "source_name string, path string, size_bytes bigint")
    ents = catalog.file_entities(m, "r1")
    assert ents.count() == 12 and ents.filter(F.col("content_type") == "image/png").count() == 12
    capped = [r["file_path"] for r in catalog.file_entities(m, "r1", limit=5).collect()]
    assert sorted(capped) == [f"/d/f{i:02d}.PNG" for i in range(5)]      # first files by path (E16)
