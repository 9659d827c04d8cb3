"""Plan-shape regression tests for the scale properties the design relies on."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from sluice.operators import quality
from sluice.sources import files

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("key", ["path_parts", "text_entities", "kv_encode", "kv_decode", "row_width", "header_fields"])
def test_per_row_keys_do_not_shuffle(spark, key):
    p = plan(entry.queries()[key](spark, SF))
    assert "Exchange" not in p, p


def test_scan_prunes_columns(spark):
    p = plan(entry.queries()["path_parts"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in p or "page_id" in p and "html" not in p


def test_listing_never_reads_content(spark):
    m = files.file_manifest(spark, SF, "s")
    scans = [line for line in plan(m.select("path", "size_bytes")).splitlines() if "FileScan binaryFile" in line]
    assert scans and all("content" not in line.split("ReadSchema:")[-1] for line in scans)


def test_headers_come_from_one_aggregated_scan(spark, tmp_path):
    from sluice.sources import headers
    d = tmp_path / "c"
    os.makedirs(d)
    (d / "a.csv").write_text("a,b\n1,2\n")
    p = plan(headers.first_records(spark, str(d), (".csv",)))
    assert p.count("FileScan text") == 1 and "Python" not in p and "Pandas" not in p
    assert "partial_min_by" in p                                 # one row a file before the shuffle


def test_message_decode_is_codegen(spark):
    from pyspark.sql import functions as F

    from sluice.functions import codec
    df = spark.read.parquet(f"{SF}/events.parquet").select(F.col("props").alias("m"))
    p = plan(df.select(codec.kv_get(codec.kv_decode("m"), "k", "int")))
    assert "lambda" not in p and "str_to_map" in p


def test_duplicate_keys_are_broadcast_and_big_side_not_shuffled(spark):
    li = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity")
    t = quality.apply_rules(li, [quality.in_range("l_quantity", hi=45)], unique=["l_orderkey", "l_linenumber"])
    lines = plan(t).splitlines()
    j = next(i for i, line in enumerate(lines) if "BroadcastHashJoin" in line)
    # the streamed (big) side is the parquet scan itself, directly under the join
    assert "FileScan parquet" in lines[j + 1] and "l_quantity" in lines[j + 1], "\n".join(lines)


def test_json_keys_explode_without_join(spark):
    p = plan(entry.queries()["json_field_types"](spark, SF))
    assert "Generate" in p and "Join" not in p


def test_rules_projection_is_codegen(spark):
    from sluice.plans.queries import order_rules
    t = quality.apply_rules(spark.read.parquet(f"{SF}/orders.parquet"), order_rules())
    lines = [line for line in plan(t).splitlines() if "array_except" in line]
    assert lines and all(line.lstrip(" +-:").startswith("*(") for line in lines), plan(t)
