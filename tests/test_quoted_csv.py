"""Delimited files with values over several lines, read in splits."""
import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from conftest import write
from sluice.sources import quoted, readers

NAMES = ["a", "b", "c"]


def _random_file(rng, rows, sep, ending):
    """Cells with quotes, separators, line ends, stray quotes inside unquoted cells; short and long rows."""
    out = [sep.join(NAMES)]
    for _ in range(rows):
        cells = []
        for _ in range(rng.choice([3, 3, 3, 3, 2, 4])):
            kind = rng.random()
            if kind < 0.4:
                cells.append("".join(rng.choices("xyz 1é", k=rng.randint(0, 6))))
            elif kind < 0.5:
                cells.append("5" + '"' + " disk")
            else:
                body = "".join(rng.choices(["x", "y", '""', sep, "\n", "\r\n", " ", "é", '""'], k=rng.randint(0, 12)))
                cells.append(f'"{body}"')
        out.append(sep.join(cells))
        if rng.random() < 0.05:
            out.append("")
    return ending.join(out) + (ending if rng.random() < 0.5 else "")


def _rows(df):
    return sorted(map(str, ((r["a"], r["b"], r["c"], r["_corrupt"] is not None, r["_source_file"].rsplit("/", 1)[-1]) for r in df.collect())))


@pytest.mark.parametrize("sep, split", [(",", 40), (",", 400), ("\t", 97), (",", 1 << 20)])
def test_equals_the_whole_record_read(spark, tmp_path, sep, split):
    rng = random.Random(split)
    for k in range(6):
        write(str(tmp_path / "in" / f"f {k}.csv"), _random_file(rng, rng.randint(0, 60), sep, "\n" if k % 2 else "\r\n"))
    write(str(tmp_path / "in" / "g.csv"), sep.join(NAMES) + "\n" + f'1{sep}"' + "long\n" * 400 + f'"{sep}3\n4{sep}5{sep}6')
    path = str(tmp_path / "in")
    want = readers.read_csv(spark, path, NAMES, sep=sep, multi_line=True)
    want = _rows(want)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        got = _rows(quoted.read_quoted_csv(spark, path, NAMES, sep, "*.csv", lambda d: d))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want and len(got) > 50


def test_one_file_in_many_tasks(spark, tmp_path):
    path = str(tmp_path / "in")
    body = io.StringIO()
    w = csv.writer(body)
    w.writerow(NAMES)
    for i in range(4000):
        w.writerow([i, f"line one {i}\nline, two", 'say "hi"'])
    write(f"{path}/a.csv", body.getvalue())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        df = quoted.read_quoted_csv(spark, path, NAMES, ",", "*.csv", lambda d: d)
        tasks = df.select(F.spark_partition_id().alias("p"), "a", "b", "c").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len({r["p"] for r in tasks}) >= 8
    assert sorted(int(r["a"]) for r in tasks) == list(range(4000))
    assert all(r["b"] == f"line one {r['a']}\nline, two" and r["c"] == 'say "hi"' for r in tasks)


def test_long_lines_and_wide_rows(spark):
    lines = [("x," * 50000 + '"open',), ('"' + 'a""' * 50000,), ('a""' * 50000 + '","next',), ("y" * 300000,), ('5" disk,3" disk',), ('"a"b,"c',)]
    df = spark.createDataFrame(lines, "value string")
    out0, out1 = quoted.after_line(F.col("value"), ",")
    got = [(r[0], r[1]) for r in df.select(out0, out1).collect()]
    assert got == [(True, False), (True, False), (True, True), (False, True), (False, False), (True, True)]
