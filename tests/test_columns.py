"""Column names that clash with technical ones or differ in case only; headers in another order."""
import json

import pytest

from conftest import write
from sluice.functions.names import stored_names
from sluice.plans.ingest import RESERVED, Lake, ingest_sources, read_current
from sluice.sources import config


def _run(spark, tmp_path, gate="record", **options):
    src = config.sources_from_rows(spark, [{"name": "s", "path": str(tmp_path / "in"), "options": options}])
    lake = Lake(str(tmp_path / "lake"))
    return lake, ingest_sources(spark, src, lake, run_id="r1", gate=gate).first()


def test_stored_names():
    assert stored_names(["x", "X", "x_2", "reason", "_RUN_ID"], RESERVED) == ["x", "X_3", "x_2", "reason", "_RUN_ID_2"]
    assert stored_names(["a", "b"], RESERVED) == ["a", "b"]


@pytest.mark.parametrize("kind", ["csv", "json", "parquet"])
def test_values_of_clashing_columns(spark, tmp_path, kind):
    names = ["reason", "_reasons", "_run_id", "_source_file", "_corrupt", "_row_state", "_issue", "x"] + ["X"] * (kind != "parquet")
    values = [f"v{i}" for i in range(len(names))]
    if kind == "csv":
        write(str(tmp_path / "in" / "a.csv"), ",".join(names) + "\n" + ",".join(values) + "\n")
    elif kind == "json":
        write(str(tmp_path / "in" / "a.json"), json.dumps(dict(zip(names, values))) + "\n")
    else:
        spark.createDataFrame([tuple(values)], names).write.parquet(str(tmp_path / "in"))
    lake, row = _run(spark, tmp_path)
    assert (row["status"], row["record_count"], row["invalid_count"]) == ("stored", 1, 0)
    got = read_current(spark, lake, "s").first().asDict()
    back = {v: k for k, v in json.loads(row["metadata"].get("columns", "{}")).items()} if kind != "parquet" else \
        dict(zip(names, stored_names(names, RESERVED)))
    assert [got[back.get(n, n)] for n in names] == values
    assert got["_run_id"] == "r1" and got["_source_file"].endswith(f".{kind}") and list(got["_reasons"]) == []


def test_reordered_headers(spark, tmp_path):
    write(str(tmp_path / "in" / "a.csv"), "x,y,z\n1,2,3\n")
    write(str(tmp_path / "in" / "b.csv"), "z,x,y\n30,10,20\nshort\n")
    write(str(tmp_path / "in" / "c.csv"), 'y,z,x\n"2\n00",300,100\n')
    write(str(tmp_path / "in" / "d.csv"), "x,y\n7,8\n")
    lake, row = _run(spark, tmp_path)
    rows = {tuple(r[c] for c in "xyz"): list(r["_reasons"]) for r in spark.read.parquet(row["staging_path"]).collect()}
    assert rows[("1", "2", "3")] == [] and rows[("10", "20", "30")] == [] and rows[("100", "2\n00", "300")] == []
    assert sorted(map(tuple, rows.values()))[-1] == ("row_width", "header_width")
    assert (row["record_count"], row["invalid_count"]) == (5, 2)
    _, strict = _run(spark, tmp_path, checkHeaderNames="true")
    assert strict["invalid_count"] == 4
