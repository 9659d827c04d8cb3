"""Records of delimited files whose quoted values run over line ends (A5), read
in splits.

A split does not know whether it begins inside a quoted value. Each line is therefore described by what it
does to that state: the state after it if it began outside quotes, and if it began inside. One narrow pass
composes the lines of every split into one such pair, a window over the splits of a file (a row each) gives the state each
split begins in, and a second narrow pass cuts the lines into records. A record that crosses
a split's end is put together from at most two pieces a split. So one file of any size runs in many tasks; the rows are those of Spark's
whole-record reader.

A quote opens a value only at the beginning of a cell, as in that reader: a stray one inside a
cell changes nothing. A file whose first line ends with ``\\r\\n`` has such line ends, and its values get
``\\n``; in the others ``\\r`` is a character like any other."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import decoded_path
from ..operators.joins import join_small_in_order

#: What is left of a quoted value: no quotes but doubled ones. (Possessive, without alternatives: any length, no recursion.)
_INSIDE = '[^"]*+(?:""[^"]*+)*+'


def _patterns(sep: str) -> tuple[str, str, str]:
    """(opens from outside, stays inside, closes and opens again) as patterns of a whole line."""
    s = "\\t" if sep == "\t" else f"\\{sep}"
    # a cell that ends on this line: a quoted part or none, then anything up to the separator
    cell = f'(?:"{_INSIDE}")?+(?!")[^{s}]*+{s}'
    opens = f'(?:{cell})*+"{_INSIDE}'
    return rf"\A{opens}\z", rf"\A{_INSIDE}\z", rf'\A{_INSIDE}"(?!")[^{s}]*+{s}{opens}\z'


def after_line(line: Column, sep: str) -> tuple[Column, Column]:
    """Whether a quoted value is open after ``line`` if none was before, and if one was."""
    opens, stays, again = _patterns(sep)
    return line.rlike(opens), line.rlike(stays) | line.rlike(again)


def _lines(spark: SparkSession, path: str, glob: str, keep) -> DataFrame:
    """Lines in file order inside each split, with the split they lie in."""
    text = (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("lineSep", "\n").text(path))
    return keep(text).select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"), "value")


def split_states(lines: DataFrame, sep: str) -> DataFrame:
    """``uri, block, open, crlf``: whether each split begins inside a quoted value, and whether its file has ``\\r\\n`` line ends."""
    out0, out1 = after_line(F.col("value"), sep)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, crlf = None, (False, True), False

        def row():
            return pa.RecordBatch.from_pydict({"uri": [at[0]], "block": [at[1]], "o0": [state[0]], "o1": [state[1]], "crlf": [crlf]})
        for batch in batches:
            for uri, block, o0, o1, cr in zip(*[c.to_pylist() for c in batch.columns]):
                if (uri, block) != at:
                    if at is not None:
                        yield row()
                    at, state, crlf = (uri, block), (False, True), cr
                after = (o0, o1)
                state = (after[state[0]], after[state[1]])
        if at is not None:
            yield row()

    told = lines.select("uri", "block", out0.alias("o0"), out1.alias("o1"), F.col("value").endswith("\r").alias("crlf"))
    splits = told.mapInArrow(compose, "uri string, block bigint, o0 boolean, o1 boolean, crlf boolean")
    w = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a split either settles the state, whatever it was, or keeps or flips it
    settles, flips = F.col("o0") == F.col("o1"), (F.col("o0") & ~F.col("o1")).cast("int")
    first = F.first("crlf").over(w.rowsBetween(Window.unboundedPreceding, 0))  # of the file's first line
    marked = splits.select("uri", "block", F.when(settles, F.col("o0")).alias("settled"), flips.alias("flip"), first.alias("crlf"))
    marked = marked.withColumn("flips", F.coalesce(F.sum("flip").over(w), F.lit(0)))
    last = F.last(F.when(F.col("settled").isNotNull(), F.struct(F.col("settled").cast("int").alias("to"), "flips")), ignorenulls=True).over(w)
    begun = F.coalesce(F.col("last.to") + F.col("flips") - F.col("last.flips"), F.col("flips"))
    return marked.withColumn("last", last).select("uri", "block", (F.pmod(begun, F.lit(2)) == 1).alias("open"), "crlf")


def records(spark: SparkSession, path: str, glob: str, sep: str, keep) -> DataFrame:
    """``uri, record``: every record of the chosen files but the first of each
    (the header). ``keep`` narrows a scan to the files."""
    lines = _lines(spark, path, glob, keep)
    states = split_states(lines, sep)
    out0, out1 = after_line(F.col("value"), sep)
    told = join_small_in_order(lines.select("*", out0.alias("o0"), out1.alias("o1")), states, ["uri", "block"], "left") \
        .select("uri", "block", "value", "o0", "o1", "open", "crlf")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, inside, head, first = None, [], False, False, False
        out: list = []

        def finish(kind):
            nonlocal held, head, first
            text = "\n".join(held)
            if kind == "whole" and not head:
                if text:
                    out.append((*at, "whole", first, text))
                    first = False
            elif held:
                out.append((*at, ("through" if kind == "tail" else "head") if head else kind, first and not head, text))
                first = first and head
            held, head = [], False

        for batch in batches:
            for uri, block, value, o0, o1, opened, crlf in zip(*[c.to_pylist() for c in batch.columns]):
                if (uri, block) != at:
                    if held:
                        finish("tail")
                    if opened is None:
                        raise RuntimeError(f"{uri}: the file's splits changed while it was read")
                    at, inside, head, first = (uri, block), opened, opened, block == 0
                held.append(value[:-1] if crlf and value.endswith("\r") else value)
                inside = o1 if inside else o0
                if not inside:
                    finish("whole")
            if len(out) >= 1:
                yield rows(out)
                out.clear()
        if held:
            finish("tail")
        if out:
            yield rows(out)

    def rows(found):
        cols = list(zip(*found))
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()),
                                           pa.array(cols[3], pa.bool_()), pa.array(cols[4], pa.string())],
                                          names=["uri", "block", "kind", "first", "record"])

    pieces = told.mapInArrow(cut, "uri string, block bigint, kind string, first boolean, record string")
    whole = pieces.filter("kind = 'whole' AND NOT first").select("uri", "record")
    # pieces of records that cross splits: at most two a split
    parts = pieces.filter("kind <> 'whole'")
    place = F.struct("block", (F.col("kind") == "tail").alias("last"))
    order = Window.partitionBy("uri").orderBy("block", (F.col("kind") == "tail"))
    parts = parts.withColumn("n", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    joined = parts.groupBy("uri", "n").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct(place.alias("at"), "record"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["record"]), "\n")
    crossing = joined.filter(~F.col("first")).select("uri", text.alias("record"))
    return whole.unionByName(crossing)


def read_quoted_csv(spark: SparkSession, path: str, columns, sep: str, glob: str, keep, corrupt: str = "_corrupt") -> DataFrame:
    """The chosen files as :func:`sluice.sources.readers.read_csv` gives them
    with ``multi_line``, but in splits."""
    found = records(spark, path, glob, sep, keep)
    options = {"sep": sep, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "columnNameOfCorruptRecord": corrupt}
    parsed = F.from_csv("record", _ddl([*columns, corrupt]), options)
    return found.select(parsed.alias("_r"), decoded_path("uri").alias("_source_file")).select("_r.*", "_source_file")


def _ddl(columns) -> str:
    return ", ".join(f"`{c.replace('`', '``')}` string" for c in columns)
