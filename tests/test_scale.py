"""Inputs that queries build, and work a row, at scale."""
import glob
import json

import pytest
from pyspark.sql import functions as F

from conftest import write
from sluice.plans import source_queries
from sluice.plans.ingest import json_rows
from sluice.sources import jsontext


@pytest.mark.parametrize("n", [0, 1, 37])
def test_configuration_of_several_documents(spark, tmp_path, monkeypatch, n):
    monkeypatch.setattr(source_queries, "CONFIG_ENTRIES", 5)
    monkeypatch.setattr(source_queries, "scratch_path", lambda s, label: str(tmp_path / label))
    rows = [(i, f"part {i}", f"Brand#{i}", i % 4) for i in range(n)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = source_queries.q_config_sources(spark, str(tmp_path)).collect()
    want = [(f"part {i} {i}", f"/data/Brand#{i}", None if i % 2 else "structured", None if i % 3 else "batch", None if i % 5 else str(i % 4))
            for i in range(n)]
    assert sorted(map(tuple, got)) == sorted(want)
    sizes = []
    for f in glob.glob(str(tmp_path / "config" / "*.json")):
        text = open(f).read()
        sizes += [len(json.loads(text)["sources"])] if text.strip() else []  # one document a file
    assert sum(sizes) == n and max(sizes, default=0) <= 10 and len(sizes) >= -(-n // 10)


def test_json_text_is_parsed_once(spark, tmp_path):
    write(str(tmp_path / "a.json"), '{"a": 1, "b": "x"}\n{"a": 2.5, "c": [1], "b": null}\n[{"a": 3}, 7]\n "s"\n{}\nno\n')
    df, _ = json_rows(spark, str(tmp_path), [("a", "int"), ("b", "str")])
    got = sorted(((r["a"], r["b"], r["_extra"], r["_raw"], r["_issue"]) for r in df.collect()), key=str)
    assert got == sorted([(1, "x", None, None, None), (None, None, {"a": "2.5", "c": "[1]"}, None, None), (3, None, None, None, None),
                          (None, None, None, "7", None), (None, None, None, '"s"', None), (None, None, None, None, None),
                          (None, None, None, "no", "json_parse")], key=str)
    plan = spark.range(1).select(jsontext.parse_whole(F.concat(F.lit('{"a":1}'), F.col("id").cast("string"))).alias("v")) \
        ._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().replace("_", "").count("parsejson") == 1, plan
