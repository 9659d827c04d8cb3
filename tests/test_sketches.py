"""Mergeable column statistics against the rows they describe."""
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import write
from sluice.operators import sketches
from sluice.plans.ingest import Lake, ingest_sources, version_statistics
from sluice.sources import config


def test_merged_equals_one_pass(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i % 7, None if i % 11 == 0 else rng.gauss(0, 100), rng.choice("aab") if i % 5 else None, f"k{rng.randint(0, 9000)}") for i in range(20_000)]
    df = spark.createDataFrame(rows, "v int, x double, s string, k string")
    path = str(tmp_path / "states")
    sketches.column_sketches(df, by=["v"]).write.parquet(path)
    kept = [r for r in rows if 2 <= r[0] <= 4]
    merged = sketches.merge_sketches(spark.read.parquet(path).filter("v BETWEEN 2 AND 4"))
    got = {r["column_name"]: r for r in sketches.statistics(merged, ranks=(0.1, 0.5, 0.9), top=2).collect()}
    once = {r["column_name"]: r for r in sketches.statistics(sketches.column_sketches(df.filter("v BETWEEN 2 AND 4").drop("v"))).collect()}
    for i, name in ((1, "x"), (2, "s"), (3, "k")):
        values = [r[i] for r in kept if r[i] is not None]
        r = got[name]
        assert (r["n"], r["n_null"]) == (len(kept), len(kept) - len(values)) == (once[name]["n"], once[name]["n_null"])
        assert abs(r["n_distinct"] - len(set(values))) <= 0.04 * len(set(values))
        assert (r["min_num"], r["max_num"]) == ((min(values), max(values)) if name == "x" else (None, None))
        assert (r["min_text"], r["max_text"]) == ((None, None) if name == "x" else (min(values), max(values)))
    xs = sorted(r[1] for r in kept if r[1] is not None)
    for rank, q in zip((0.1, 0.5, 0.9), got["x"]["quantiles"]):
        assert abs(sum(x <= q for x in xs) / len(xs) - rank) < 0.02
    assert got["s"]["quantiles"] is None
    assert [(t["item"], t["count"]) for t in got["s"]["top"]] == Counter(r[2] for r in kept if r[2]).most_common(2)


def test_empty_null_and_nested_columns(spark):
    df = spark.createDataFrame([(None, [1, 2], "2024-01-02"), (None, [1, 2], None)], "z double, a array<int>, d string").withColumn("d", F.to_date("d"))
    states = sketches.column_sketches(df)
    for frame, n in ((states, 2), (sketches.merge_sketches(states.unionByName(sketches.column_sketches(df.limit(0)))), 2),
                     (sketches.column_sketches(df.limit(0)), 0)):
        got = {r["column_name"]: r for r in sketches.statistics(frame).collect()}
        assert {r["n"] for r in got.values()} == {n}
        assert got["z"]["quantiles"] is None and got["z"]["n_distinct"] == 0 and got["z"]["top"] == []
        assert got["a"]["n_distinct"] == (1 if n else 0)
        assert got["d"]["max_num"] == (19724 * 86400 if n else None)
    with pytest.raises(ValueError):
        sketches.column_sketches(df.select("z"), by=["z"])


def test_statistics_of_a_range_of_runs(spark, tmp_path):
    lake = Lake(str(tmp_path / "lake"))
    for k, n in enumerate((10, 20, 30)):
        write(f"{tmp_path}/in{k}/a.csv", "x,n\n" + "".join(f"v{i},{k}\n" for i in range(n)))
        src = config.sources_from_rows(spark, [{"name": "s", "path": f"{tmp_path}/in{k}", "options": {"statistics": "true"}},
                                               {"name": "other", "path": f"{tmp_path}/in{k}"}])
        ingest_sources(spark, src, lake, run_id=f"r{k}")
    def read(**span):
        return {r["column_name"]: r for r in version_statistics(spark, lake, "s", **span).collect()}
    assert (read()["x"]["n"], read()["x"]["n_distinct"]) == (60, 30)
    got = read(first_run="r1", last_run="r1")
    assert set(got) == {"x", "n"} and (got["x"]["n"], got["x"]["max_text"]) == (20, "v9")
    assert [tuple(t) for t in read(last_run="r1")["n"]["top"]] == [("1", 20), ("0", 10)]
    with pytest.raises(LookupError):
        version_statistics(spark, lake, "other")
