"""Readers, listings and config (F-CONFIG, F-CSV, F-JSON/XML, F-TEXT,
F-IMAGE/F-VIDEO, F-WRITE)."""

import json
import os

import pytest
from pyspark.sql import functions as F

from sluice.operators import quality
from sluice.sinks import tables
from sluice.sources import config, files, readers

from conftest import png_bytes, write

HEADER = "timestamp,acc_x,acc_y,acc_z\n"
ROWS = "t1,1,2,3\nt2,4,5,6\nt3,7,8,9\n"


def test_config_rows_and_defaults(spark, tmp_path):
    cfg = {"sources": [
        {"name": "a", "path": "/d/a", "modality": "structured", "worker": "direct", "options": {"k": "v"}},
        {"name": "b", "path": "/d/b"},
    ]}
    p = write(str(tmp_path / "c.json"), json.dumps(cfg, indent=2))
    rows = {r["name"]: r for r in config.load_sources(spark, p).collect()}
    assert rows["a"]["options"] == {"k": "v"} and rows["a"]["worker"] == "direct"
    assert rows["b"]["options"] == {} and rows["b"]["modality"] is None
    assert rows["b"]["target_table"] == "b"


def test_config_empty_and_missing_name(spark, tmp_path):
    p = write(str(tmp_path / "e.json"), json.dumps({"sources": []}))
    assert config.load_sources(spark, p).count() == 0
    p2 = write(str(tmp_path / "bad.json"), json.dumps({"sources": [{"path": "/x"}]}))
    with pytest.raises(config.ConfigError):
        config.load_sources(spark, p2)


def _csv_dir(tmp_path):
    d = tmp_path / "csv"
    write(str(d / "a.csv"), HEADER + ROWS)
    write(str(d / "sub" / "a.csv"), HEADER + ROWS)
    write(str(d / "narrow.csv"), "timestamp,acc_x,acc_y\n" + "t,1,2\n")
    write(str(d / "wide.csv"), "timestamp,acc_x,acc_y,acc_z,e\n" + "t,1,2,3,4\n")
    write(str(d / "dup.csv"), "a,a,b,c\n" + "1,2,3,4\n")
    write(str(d / "blankline.csv"), "\n" + HEADER + ROWS)
    write(str(d / "ragged.csv"), HEADER + "t1,1,2\n" + "t2,1,2,3,4\n" + "t3,1,2,3\n")
    write(str(d / "quoted.csv"), HEADER + 't1,"1,5",2,3\n' + 't2,"say ""hi""",2,3\n' + 't3,"line\nbreak",2,3\n')
    write(str(d / "empty.csv"), "")
    return str(d)


def test_header_checks(spark, tmp_path):
    d = _csv_dir(tmp_path)
    manifest = files.file_manifest(spark, d, "s")
    checks = {os.path.basename(r["file_path"]) + ("/sub" if "/sub/" in r["file_path"] else ""): r["reason"]
              for r in quality.header_checks(spark, d, manifest, 4).collect()}
    assert checks["a.csv"] is None and checks["a.csv/sub"] is None    # E22: same stem, no collision
    assert checks["narrow.csv"] == "header_width"
    assert checks["wide.csv"] == "header_width"
    assert checks["dup.csv"] == "duplicate_header"                    # E9
    assert checks["blankline.csv"] is None                            # first non-blank line
    assert checks["ragged.csv"] is None                               # rows are D7's job
    assert checks["quoted.csv"] is None
    assert checks["empty.csv"] == "empty_file"                        # E10, whatever the listing order
    write(d + "/reorder.csv", "acc_x,timestamp,acc_y,acc_z\n1,t,2,3\n")
    m2 = files.file_manifest(spark, d, "s")
    plain = {os.path.basename(r["file_path"]): r["reason"] for r in quality.header_checks(spark, d, m2, 4).collect()}
    strict = {os.path.basename(r["file_path"]): r["reason"]
              for r in quality.header_checks(spark, d, m2, 4, ["timestamp", "acc_x", "acc_y", "acc_z"]).collect()}
    assert plain["reorder.csv"] is None                                # valid by width (E7)
    assert strict["reorder.csv"] == "header_order" and strict["dup.csv"] == "duplicate_header"


def test_row_width_and_quoted_rows(spark, tmp_path):
    d = _csv_dir(tmp_path)
    cols = ["timestamp", "acc_x", "acc_y", "acc_z"]
    df = readers.read_csv(spark, d + "/ragged.csv", cols)
    tagged = quality.apply_rules(df, [quality.row_width()])
    rows = tagged.collect()               # a plan reading only _corrupt is refused by Spark
    bad = [r for r in rows if r[quality.REASONS]]
    assert (len(rows), len(bad)) == (3, 2)                            # short and long rows
    q = readers.read_csv(spark, d + "/quoted.csv", cols, multi_line=True)
    vals = sorted(r["acc_x"] for r in q.collect())
    assert vals == ["1,5", "line\nbreak", 'say "hi"']


def test_headerless_read_counts_header(spark, tmp_path):
    d = _csv_dir(tmp_path)
    df = readers.read_headerless_csv(spark, d + "/a.csv")
    assert df.count() == 4 and df.columns[:4] == ["_c0", "_c1", "_c2", "_c3"]    # E21


def test_tsv_and_manifest_with_empty_file(spark, tmp_path):
    d = _csv_dir(tmp_path)
    write(str(tmp_path / "csv" / "b.tsv"), HEADER.replace(",", "\t") + ROWS.replace(",", "\t"))
    t = readers.read_csv(spark, d, ["timestamp", "acc_x", "acc_y", "acc_z"], sep="\t", path_glob="*.tsv")
    rows = t.collect()
    assert len(rows) == 3 and all(r["_corrupt"] is None for r in rows)
    m = files.file_manifest(spark, d, "s")
    names = {r["file_name"]: r["size_bytes"] for r in m.collect()}
    assert names["empty.csv"] == 0 and "b.tsv" in names              # zero-byte file listed


def test_json_shapes(spark, tmp_path):
    d = tmp_path / "json"
    write(str(d / "lines.json"), '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n')
    write(str(d / "arr.json"), '[{"a": 3, "b": "z"}, {"a": 4}]\n')
    df = readers.read_json(spark, str(d), schema="a bigint, b string")
    assert sorted(r["a"] for r in df.collect()) == [1, 2, 3, 4]
    write(str(tmp_path / "pretty" / "p.json"), json.dumps({"a": 5, "b": "w"}, indent=2))
    p = readers.read_json(spark, str(tmp_path / "pretty"), schema="a bigint, b string", multi_line=True)
    assert p.first()["a"] == 5


def test_json_field_types_python_names(spark):
    from sluice.operators import schema
    doc = json.dumps({"s": "x", "i": 1, "f": 1.5, "b": True, "l": [1], "d": {"k": 1}, "n": None})
    df = spark.createDataFrame([(doc,), (json.dumps([{"i": 2}]),)], "j string")
    got = {(r["key"], r["type_name"]): r["n"] for r in schema.json_field_types(df, "j").collect()}
    assert got == {("s", "str"): 1, ("i", "int"): 2, ("f", "float"): 1, ("b", "bool"): 1,
                   ("l", "list"): 1, ("d", "dict"): 1, ("n", "NoneType"): 1}


def test_xml_rows(spark, tmp_path):
    p = write(str(tmp_path / "x" / "r.xml"), "<r><row><a>1</a><b>x</b></row><row><a>2</a></row></r>")
    df = readers.read_xml(spark, os.path.dirname(p), "row")
    assert dict(df.dtypes)["a"] == "bigint" and df.count() == 2


def test_text_and_yaml_documents(spark, tmp_path):
    d = tmp_path / "t"
    write(str(d / "a.txt"), "hello world\nline two\n")
    write(str(d / "b.md"), "# title\n")
    write(str(d / "bad.log"), b"ok \xff\xfe bytes\n")
    write(str(d / "c.yaml"), "k: v\nl: [1, 2]\n")
    docs = files.read_text_documents(spark, str(d))
    by = {os.path.basename(r["path"]): r["text"] for r in docs.collect()}
    assert by["a.txt"] == "hello world\nline two\n" and "bytes" in by["bad.log"]   # E12: readable
    y = readers.read_yaml_documents(spark, str(d)).collect()
    assert len(y) == 1 and y[0]["document"].startswith("k: v")


def test_images_and_binary(spark, tmp_path):
    d = tmp_path / "img"
    write(str(d / "a.png"), png_bytes(4, 3))
    write(str(d / "sub" / "B.PNG"), png_bytes(2, 2))
    write(str(d / "bad.png"), b"not an image")
    write(str(d / "attr.csv"), "id,x\n1,2\n")
    write(str(d / "x.txt"), "t")
    imgs = {os.path.basename(r["path"]): (r["width"], r["height"]) for r in files.read_images(spark, str(d)).collect()}
    assert imgs == {"a.png": (4, 3), "B.PNG": (2, 2), "bad.png": (-1, -1)}
    m = files.file_manifest(spark, str(d), "img")
    inv = {r["file_name"] for r in m.filter(quality.image_file_invalid(F.col("extension"))).collect()}
    assert inv == {"x.txt"}                                       # csv side file allowed (E13)
    vd = tmp_path / "vid"
    for n in ["a.mp4", "b.AVI", "c.mov", "d.mkv", "e.webm", "f.txt"]:
        write(str(vd / n), os.urandom(64))
    b = files.read_binary(spark, str(vd), with_content=True)
    assert b.count() == 5 and {r["length"] for r in b.collect()} == {64}
    vm = files.file_manifest(spark, str(vd), "v")
    assert vm.filter(quality.video_file_invalid(F.col("extension"))).count() == 1


def test_create_only_write_refuses_existing(spark, tmp_path):
    target = str(tmp_path / "w")
    df = spark.range(3)
    tables.write_create_only(df, target)
    with pytest.raises(Exception):
        tables.write_create_only(spark.range(5), target)
    assert spark.read.parquet(target).count() == 3


def test_bounded_take_is_ordered(spark):
    df = spark.range(0, 1000, 1, 8).withColumn("k", (F.col("id") * 7919) % 1000)
    got = [r["k"] for r in files.bounded_take(df, 5, "k").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_unreadable_text_files(spark, tmp_path):
    import gzip
    d = tmp_path / "txt"
    write(str(d / "ok.txt"), "fine\n")
    write(str(d / "empty.log"), "")
    write(str(d / "good.txt.gz"), gzip.compress(b"zipped text\n"))
    write(str(d / "broken.txt.gz"), b"\x1f\x8b\x08\x00garbage-not-gzip")
    m = files.file_manifest(spark, str(d), "t")
    bad = {os.path.basename(r["path"]): r["reason"] for r in files.unreadable_files(spark, m, str(d)).collect()}
    assert bad == {"broken.txt.gz": "unreadable"}                 # zero-byte files are readable (D2)


def test_json_values_and_fields(spark, tmp_path):
    from sluice.plans.ingest import discover_fields

    def fields(name, text):
        d = str(tmp_path / name)
        write(f"{d}/x.json", text)
        return discover_fields(spark, d, files.file_manifest(spark, d, "s"), "semi_structured")
    obj = {"s": "x", "i": 1, "f": 1.5, "b": False, "l": [], "d": {}, "n": None}
    want = [("s", "str"), ("i", "int"), ("f", "float"), ("b", "bool"), ("l", "list"), ("d", "dict"), ("n", "NoneType")]
    assert fields("obj", json.dumps(obj)) == want and fields("pretty", json.dumps(obj, indent=2)) == want
    assert fields("arr", json.dumps([{"k": 1}, {"z": 2}])) == [("k", "int")]
    assert fields("lines", '{"a": 1}\n{"a": 2}\n') == [("a", "int")]
    assert fields("long", '{"a": "' + "x" * 200000 + '"}\n' * 3) == [("a", "str")]       # no size changes the answer
    for name, text in (("bad", "{not json"), ("empty", "[]"), ("number", "5")):
        assert fields(name, text) == [("unknown", "string")]


def test_header_cells_of_a_line(spark):
    from sluice.sources import headers
    rows = [("a,b", ["a", "b"]), (",a,,", ["", "a", "", ""]), ('"x,y",z', ["x,y", "z"]), ('"say ""hi""",b', ['say "hi"', "b"]),
            ("", [""]), ('"",q', ["", "q"]), ('"open,b', ['"open', "b"]), ("é ö, ü", ["é ö", " ü"])]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {r["i"]: r["c"] for r in df.select("i", headers.split_record("t", ",").alias("c")).collect()}
    assert got == {i: c for i, (_, c) in enumerate(rows)}
    tab = spark.createDataFrame([("a\t\tb",)], "t string").select(headers.split_record("t", "\t")).first()[0]
    assert tab == ["a", "", "b"]


def test_binary_content_bound(spark, tmp_path):
    d = tmp_path / "bin"
    write(str(d / "small.mp4"), os.urandom(10))
    write(str(d / "large.mp4"), os.urandom(100))
    rows = {os.path.basename(r["path"]): r for r in files.read_binary(spark, str(d), with_content=True,
                                                                      max_content_bytes=50).collect()}
    assert len(rows["small.mp4"]["content"]) == 10 and rows["small.mp4"]["issue"] is None
    assert rows["large.mp4"]["content"] is None and rows["large.mp4"]["issue"] == files.TOO_LARGE
    assert rows["large.mp4"]["length"] == 100


ODD = ["a b.csv", "per%20cent.csv", "per%cent.csv", "ha#sh.csv", "pl+us.csv", "süß.csv", "q?m.csv"]


def test_one_path_form_for_odd_names(spark, tmp_path):
    """Listings, scans and reasons spell a file alike, whatever its name holds."""
    from pyspark.sql import functions as F

    from sluice.functions.paths import source_file
    d = str(tmp_path / "o dd")
    for n in ODD:
        write(f"{d}/{n}", HEADER + ROWS)
    write(f"{d}/no row.csv", "")
    write(f"{d}/b ad.csv", "x,y\n1,2\n")
    m = files.file_manifest(spark, d, "s")
    names = sorted(r["file_name"] for r in m.collect())
    assert names == sorted([*ODD, "no row.csv", "b ad.csv"])                       # no phantom rows
    paths = {r["path"] for r in m.collect()}
    scan = spark.read.option("recursiveFileLookup", True).text(d).select(source_file().alias("p")).distinct()
    assert {r["p"] for r in scan.collect()} == {p for p in paths if not p.endswith("no row.csv")}
    reasons = {os.path.basename(r["file_path"]): r["reason"] for r in quality.header_checks(spark, d, m, 4).collect()}
    assert reasons == {**dict.fromkeys(ODD), "no row.csv": "empty_file", "b ad.csv": "header_width"}
    assert files.unreadable_files(spark, m.filter(F.col("size_bytes") > 0), d).count() == 0


def test_listing_failures_are_not_absence(spark, tmp_path):
    assert not files.path_exists(spark, str(tmp_path / "nothing"))
    with pytest.raises(Exception):
        files.path_exists(spark, "nosuchscheme://bucket/a")


def test_config_options_of_any_json_type(spark, tmp_path):
    cfg = {"sources": [{"name": "a", "path": "/x",
                        "options": {"kwargs": {"p": 1}, "maxFilesPerTrigger": 2, "multiLine": True}}]}
    p = write(str(tmp_path / "c.json"), json.dumps(cfg))
    opts = config.load_sources(spark, p).first()["options"]
    assert opts["maxFilesPerTrigger"] == "2" and opts["multiLine"] == "true"
    assert json.loads(opts["kwargs"]) == {"p": 1}                  # nested values stay as JSON text


def test_yaml_extensions_any_case(spark, tmp_path):
    d = tmp_path / "y"
    write(str(d / "a.yaml"), "a: 1\n")
    write(str(d / "b.Yml"), "b: 2\n")
    write(str(d / "c.YAML"), "c: 3\n")
    write(str(d / "d.txt"), "not yaml\n")
    assert readers.read_yaml_documents(spark, str(d)).count() == 3
