"""JSON files read in splits, and fields over all objects."""
import json
import random

import pytest
from pyspark.sql import functions as F

from conftest import write
from sluice.plans.ingest import Lake, ingest_sources, read_current
from sluice.operators import joins
from sluice.sources import config, headers, jsontext, quoted, readers


def _values(spark, path):
    rows = jsontext.json_documents(spark, path).select(F.to_json("v").alias("v"), "_raw").collect()
    return sorted(json.dumps(json.loads(r["v"]), sort_keys=True) if r["v"] is not None else f"bad {r['_raw']}" for r in rows)


def _value(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.4:
        return rng.choice([1, 2.5, None, True, "a]b", 'q"}{', "x\\ny", "[,", ""])
    if kind < 0.7:
        return {rng.choice("abcd"): _value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    return [_value(rng, depth + 1) for _ in range(rng.randint(0, 3))]


@pytest.fixture
def small_splits(spark):
    names = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_shapes_in_small_splits(spark, tmp_path, small_splits):
    rng, want = random.Random(4), []
    for k in range(12):
        docs = [_value(rng) for _ in range(rng.randint(1, 6))]
        docs = [d for d in docs if isinstance(d, dict)] or [{"only": k}]
        shape = k % 4
        if shape == 0:      # JSON Lines
            text, each = "\n".join(map(json.dumps, docs)), docs
        elif shape == 1:    # one pretty-printed list
            text, each = json.dumps(docs, indent=rng.choice([0, 1, 3])), docs
        elif shape == 2:    # documents behind each other
            text, each = "\n".join(json.dumps(d, indent=2) for d in docs) + "\n\n", docs
        else:               # a list with several elements on a line
            text, each = "[" + ",\n".join(json.dumps(docs[i:i + 2])[1:-1] for i in range(0, len(docs), 2)) + "]", docs
        write(str(tmp_path / f"f{k}.json"), text)
        want += [json.dumps(d, sort_keys=True) for d in each]
    assert _values(spark, str(tmp_path)) == sorted(want)


def test_damaged_values_take_no_others_with_them(spark, tmp_path):
    write(str(tmp_path / "a.json"), '{"k": 1}\nnot json\n{"k": 8}{"k": 9}\n{"k": 2}\n')
    write(str(tmp_path / "b.json"), '{"k": 3}\n{"k": [4\n{"k": 5}\n{"k": 6}]\n{"k": 7}\n')
    write(str(tmp_path / "c.json"), '{"k": 10\n{"k": 11}\n')
    assert _values(spark, str(tmp_path)) == sorted(
        ['{"k": 1}', '{"k": 2}', "bad not json", 'bad {"k": 8}{"k": 9}', '{"k": 3}', '{"k": 5}', '{"k": 7}', 'bad {"k": [4', 'bad {"k": 6}]',
         'bad {"k": 10', '{"k": 11}'])


def test_one_list_in_many_tasks(spark, tmp_path):
    docs = [{"id": i, "text": "x]" * 20, "in": {"a": [i]}} for i in range(3000)]
    write(str(tmp_path / "a.json"), json.dumps(docs, indent=1))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
        rows = jsontext.json_documents(spark, str(tmp_path)).select(F.spark_partition_id().alias("p"), F.to_json("v").alias("v")).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["p"] for r in rows}) >= 6
    assert sorted(json.loads(r["v"])["id"] for r in rows) == list(range(3000))


def test_whole_values_only(spark):
    texts = ["1", "[1]", '{"a":1}', "1,2", "[1]]", '{"a":1},"w":[2', "", " ", "[1],[2", "null", '"x', "1]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", jsontext.parse_whole("t").isNotNull().alias("ok"))
    assert [r["t"] for r in df.collect() if r["ok"]] == ["1", "[1]", '{"a":1}', "null"]


def test_fields_of_all_objects(spark, tmp_path):
    write(str(tmp_path / "in" / "a.json"), '{"b": 1, "a": "x", "n": null}\n{"b": 2.5, "c": true}\n')
    write(str(tmp_path / "in" / "b.json"), '[{"a": 5, "d": [1]},\n {"c": false, "n": null}]\n')
    lake = Lake(str(tmp_path / "lake"))
    src = config.sources_from_rows(spark, [{"name": "s", "path": str(tmp_path / "in"), "options": {"fieldsFrom": "all"}}])
    row = ingest_sources(spark, src, lake, run_id="r1", gate="record").first()
    assert [(f["name"], f["type"]) for f in row["fields"]] == [
        ("b", "float"), ("a", "any"), ("n", "NoneType"), ("c", "bool"), ("d", "list")]
    got = sorted([str(tuple(r[c] for c in "abcd")) for r in read_current(spark, lake, "s").collect()])
    assert got == sorted(map(str, [("x", 1.0, None, None), (None, 2.5, True, None), ("5", None, None, "[1]"), (None, None, False, None)]))
    assert all(r["_extra"] is None for r in read_current(spark, lake, "s").collect())


@pytest.mark.parametrize("broadcast", [True, False])
def test_more_files_than_are_named(spark, tmp_path, small_splits, monkeypatch, broadcast):
    for k in range(6):
        write(str(tmp_path / f"j/{k}.json"), "\n".join(json.dumps({"k": k, "i": i}, indent=2) for i in range(9)))
        write(str(tmp_path / f"j/l{k}.json"), "".join(json.dumps({"k": k + 6, "i": i}) + "\n" for i in range(9)))
        write(str(tmp_path / f"c/{k}.csv"), "a,b\n" + "".join(f'{k},"x\n{i}"\n' for i in range(9)))
        write(str(tmp_path / f"c/l{k}.csv"), "a,b\n" + "".join(f"{k + 6},x{i}\n" for i in range(9)))
    monkeypatch.setattr(headers, "NAMED_FILES", 2)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        monkeypatch.setattr(joins, "MAX_BROADCAST_BYTES", 0)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _values(spark, str(tmp_path / "j")) == sorted(json.dumps({"k": k, "i": i}, sort_keys=True) for k in range(12) for i in range(9))
        path = str(tmp_path / "c")
        over = headers.first_records(spark, path, (".csv",)).filter("multi_line").select("uri")
        rest = readers.read_csv(spark, path, ["a", "b"], keep=lambda d: headers.chosen(d, over, keep=False))
        cut = quoted.read_quoted_csv(spark, path, ["a", "b"], ",", "*.csv", lambda d: headers.chosen(d, over))
        assert rest.columns == cut.columns
        assert sorted((int(r["a"]), r["b"]) for r in cut.collect()) == [(k, f"x\n{i}") for k in range(6) for i in range(9)]
        assert sorted((int(r["a"]), r["b"]) for r in rest.collect()) == [(k + 6, f"x{i}") for k in range(6) for i in range(9)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_named_files_are_split_alike(spark, tmp_path):
    """A pretty-printed file is few bytes of the folder, so a scan of it alone has smaller splits."""
    write(str(tmp_path / "a.json"), "\n".join(json.dumps({"k": i}, indent=2) for i in range(400)))
    for f in range(4):
        write(str(tmp_path / f"l{f}.json"), "".join(json.dumps({"f": f, "i": i}) + "\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        assert jsontext.json_documents(spark, str(tmp_path)).filter("v IS NOT NULL").count() == 400 + 4 * 3000
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
