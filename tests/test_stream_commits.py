"""Runs of a stream are isolated; uniqueness holds across batches and runs."""
import glob
import json
import os

import pytest
from pyspark.sql import functions as F

from conftest import write
from sluice.plans.ingest import Lake, ingest_sources, read_current, record_run, register_views
from sluice.sources import config
from sluice.streaming import commits, jobs


class Stream:
    def __init__(self, spark, tmp_path, rules=None, **options):
        self.spark, self.root, self.lake = spark, str(tmp_path / "stream_in"), Lake(str(tmp_path / "lake"))
        if rules:
            options["rules"] = json.dumps(rules)
        self.src = config.sources_from_rows(spark, [{"name": "s", "path": self.root, "options": options}])

    def run(self, run_id, files, gate="source"):
        for name, text in files.items():
            write(f"{self.root}/{name}", text)
        return ingest_sources(self.spark, self.src, self.lake, run_id=run_id, gate=gate).first()

    def current(self):
        return sorted(json.loads(r["json"])["id"] for r in read_current(self.spark, self.lake, "s").collect())

    def own(self, run_id):
        return sorted(json.loads(r["json"])["id"] for r in commits.snapshot(self.spark, self.lake, "s", only_run=run_id).collect())


def test_refused_runs_are_never_readable(spark, tmp_path):
    s = Stream(spark, tmp_path, [{"range": "fields['id']", "hi": 100}])
    r1 = s.run("r1", {"a.txt": "id:1\nid:2\n"})
    r2 = s.run("r2", {"b.txt": "id:3\nid:500\n"})
    assert (r1["status"], r2["status"], r2["lakehouse_path"]) == ("stored", "quarantined", None)
    assert s.current() == [1, 2]
    refused = spark.read.parquet(r2["quarantine_path"])
    assert sorted(json.loads(r["json"])["id"] for r in refused.collect()) == [3, 500]       # its own rows only
    r3 = s.run("r3", {"c.txt": "id:4\nnothing\n"})
    assert (r3["status"], r3["record_count"], r3["invalid_count"]) == ("partial", 2, 1)      # a dead letter refuses nothing
    assert s.current() == [1, 2, 4] and s.own("r2") == [] and s.own("r3") == [4]
    assert [json.loads(r["json"])["id"] for r in commits.snapshot(spark, s.lake, "s", up_to_run="r1").collect()] == [1, 2]
    assert spark.read.parquet(r3["lakehouse_path"]).count() == 1
    assert register_views(spark, s.lake) == ["s"] and spark.sql("SELECT * FROM s").count() == 3
    assert set(read_current(spark, s.lake, "s").columns) == {"value", "fields", "json"}


def test_replayed_batch_belongs_to_the_run_that_replays_it(spark, tmp_path):
    s = Stream(spark, tmp_path)
    s.run("r1", {"a.txt": "id:1\n"})
    s.run("r2", {"b.txt": "id:2\n"})
    last = max(glob.glob(f"{s.lake.root}/_checkpoints/s/commits/[0-9]*"), key=lambda p: int(os.path.basename(p)))
    for p in (last, os.path.join(os.path.dirname(last), f".{os.path.basename(last)}.crc")):
        if os.path.exists(p):
            os.remove(p)  # the sink wrote, the stream's own commit was lost
    r3 = s.run("r3", {"c.txt": "id:3\n"})
    assert s.current() == [1, 2, 3]
    assert r3["record_count"] == 2 and s.own("r3") == [2, 3] and s.own("r2") == []


def test_batches_without_a_verdict_are_adopted(spark, tmp_path):
    s = Stream(spark, tmp_path, [{"range": "fields['id']", "hi": 100}])
    s.run("r1", {"a.txt": "id:1\n"})
    # a driver is lost after its batches are committed and before its run row is written
    from sluice.plans import ingest
    write(f"{s.root}/b.txt", "id:2\n")
    src = s.src.first().asDict()
    ingest.ingest_stream(spark, src, s.lake, "r2", gate="source")
    assert s.current() == [1]
    r3 = s.run("r3", {"c.txt": "id:3\n"})
    assert (r3["status"], r3["record_count"]) == ("stored", 2) and s.current() == [1, 2, 3] and s.own("r3") == [2, 3]
    # the next run judges what it adopts
    write(f"{s.root}/d.txt", "id:900\n")
    ingest.ingest_stream(spark, src, s.lake, "r4", gate="source")
    r5 = s.run("r5", {"e.txt": "id:5\n"})
    assert (r5["status"], r5["record_count"], r5["invalid_count"]) == ("quarantined", 2, 1) and s.current() == [1, 2, 3]


def test_lost_checkpoint_replaces_nothing(spark, tmp_path):
    s = Stream(spark, tmp_path, [{"unique": "fields['id']"}])
    s.run("r1", {"a.txt": "id:1\nid:2\n"})
    os.rename(f"{s.lake.root}/_checkpoints/s", f"{s.lake.root}/_checkpoints/lost")
    r2 = s.run("r2", {"b.txt": "id:3\n"}, gate="record")  # reads everything anew, batch ids begin at 0
    assert s.current() == [1, 2, 3] and (r2["record_count"], r2["invalid_count"]) == (3, 2)


@pytest.mark.parametrize("rule", ["fields['id']", ["fields['id']", "fields['v']"]])
def test_uniqueness_across_batches_and_runs(spark, tmp_path, rule):
    s = Stream(spark, tmp_path, [{"unique": rule}, {"range": "fields['id']", "hi": 100}], maxFilesPerTrigger="1")
    r1 = s.run("r1", {"a.txt": "id:1,v:a\nid:2,v:a\nid:2,v:a\nv:b\nv:b\n", "b.txt": "id:1,v:a\nid:3,v:a\n"}, gate="record")
    assert (r1["record_count"], r1["invalid_count"], r1["status"]) == (7, 3, "partial")
    got = lambda: sorted(r["json"] for r in read_current(spark, s.lake, "s").collect())
    first = got()
    assert first.count('{"v":"b"}') == 2 and sum('"id":1' in x for x in first) == 1 and sum('"id":2' in x for x in first) == 0
    r2 = s.run("r2", {"c.txt": "id:3,v:a\nid:4,v:a\n", "d.txt": "broken\nid:5,v:a\n"}, gate="record")
    assert (r2["record_count"], r2["invalid_count"]) == (4, 2) and len(got()) == len(first) + 2
    # keys of a refused run are free again
    r3 = s.run("r3", {"e.txt": "id:6,v:a\nid:777,v:a\n"}, gate="source")
    r4 = s.run("r4", {"f.txt": "id:6,v:a\n"}, gate="source")
    assert (r3["status"], r4["status"]) == ("quarantined", "stored")


def test_uniqueness_within_an_interval(spark, tmp_path):
    s = Stream(spark, tmp_path, [{"unique": "fields['id']"}], uniqueWithin="0 seconds")
    s.run("r1", {"a.txt": "id:1\n"})
    assert s.run("r2", {"b.txt": "id:1\n"})["status"] == "stored" and s.current() == [1, 1]


def test_hot_key_is_one_row_where_keys_meet(spark):
    from sluice.operators import quality
    df = spark.range(1000).select((F.when(F.col("id") < 900, 7).otherwise(F.col("id"))).alias("k"))
    seen = spark.createDataFrame([(950,)], "k long")
    t = quality.apply_rules(df, unique=["k"], seen=seen)
    assert t.filter(F.size("_reasons") > 0).count() == 901


def test_run_row_is_needed_for_exposure(spark, tmp_path):
    s = Stream(spark, tmp_path)
    from sluice.plans import ingest
    write(f"{s.root}/a.txt", "id:1\n")
    row = ingest.ingest_stream(spark, s.src.first().asDict(), s.lake, "r1", gate="source")
    with pytest.raises(LookupError):
        read_current(spark, s.lake, "s")
    record_run(spark, s.lake, [row])
    assert s.current() == [1]
    assert jobs.SIDES == ("curated", "quarantine", "dead_letter")
