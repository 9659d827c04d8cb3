"""JSON values of files (A6), read in splits.

A raw line end cannot stand inside a JSON string, so every line can be looked at alone: how many brackets it
opens more than it closes, strings left out. Files whose lines are all balanced hold a value on each
line. In the others the depth at a split's begin is the sum of what lies before it (a row a split), and a narrow pass
cuts the lines where the depth is 0 - and, if the file begins with ``[``, where it is 1, so that the
elements of one large array are dealt to many tasks. A value that crosses a split's end is put
together from at most two pieces a split. Files whose brackets do not balance are read line by line."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import decoded_path
from ..operators.joins import join_small_in_order, persist_fresh
from .headers import GLOBS, chosen

#: A JSON string, whatever its length (possessive, without alternatives: no recursion).
_STRING = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
_BLANK = " \t\r\n"
#: A value that no text holds: it ends the list that a text is parsed in.
_END = uuid.uuid4().hex


def parse_whole(text) -> Column:
    """Variant of a text that is one JSON value from end to end, else NULL. The
    built-in parse takes the first value and ignores what follows; in a list that ends with a
    random word, the text must be the one element before it."""
    text = F.col(text) if isinstance(text, str) else text
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_END}"]')))
    # the list is bound to a name: a condition and its branch would parse it twice
    return F.get(F.transform(F.array(listed), lambda x: F.when(F.try_variant_get(x, "$[1]", "string") == _END,
                                                               F.try_variant_get(x, "$[0]", "variant"))), F.lit(0))


def fields_of(value) -> Column:
    """Fields of a variant that is an object, as a map; NULL for any other value."""
    return F.try_variant_get(value, "$", "map<string,variant>")


def opened(line: Column) -> Column:
    """Brackets that a line opens less those it closes, outside strings."""
    bare = F.regexp_replace(line, _STRING, "")
    return (F.length(F.regexp_replace(bare, r"[^\[{]+", "")) - F.length(F.regexp_replace(bare, r"[^\]}]+", ""))).cast("bigint")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return (spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", GLOBS[".json"]).text(path)
            .filter(F.btrim("value", F.lit(_BLANK)) != ""))


def _splits(lines: DataFrame) -> DataFrame:
    """``uri, block, depth, listed``: a row a split of ``lines``: the depth that it begins in, and whether its
    file is an array. A scan of other files may be split in other places, so this is asked of the scan that is cut."""
    told = lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
                        opened(F.col("value")).alias("more"), F.substr(F.ltrim(F.col("value")), F.lit(1), F.lit(1)).alias("char"),
                        F.monotonically_increasing_id().alias("id"))
    # what a split opens, and its first character
    splits = told.groupBy("uri", "block").agg(F.sum("more").alias("more"), F.min_by("char", "id").alias("char"))
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return splits.select("uri", "block", F.coalesce(F.sum("more").over(before), F.lit(0)).alias("depth"),
                         (F.first("char").over(every) == "[").alias("listed"))


def _segments(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """``uri, b, i, text``: texts to parse of the files of ``splits(uri, block,
    depth, listed)``: whole values, or elements of the file's array as a list."""
    told = join_small_in_order(lines.select(F.col("_metadata.file_path").alias("uri"), F.col("_metadata.file_block_start").alias("block"),
                                   "value", opened(F.col("value")).alias("more")), splits, ["uri", "block"], "left") \
        .select("uri", "block", "value", "more", "depth", "listed")
    names = ["uri", "block", "seq", "kind", "begins", "ends", "listed", "text"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            out = []
            for uri, block, value, more, start, listed in zip(*[c.to_pylist() for c in batch.columns]):
                if (uri, block) != at:
                    if start is None:
                        raise RuntimeError(f"{uri}: the file's splits changed while it was read")
                    if at is not None and held:
                        out.append((*at, seq, "through" if head else "tail", begins, False, last_listed, "\n".join(held)))
                    at, depth, seq, held, last_listed = (uri, block), start, 0, [], listed
                    rest = (0, 1) if listed else (0,)  # depths between values
                    head, begins = depth not in rest, depth == 0
                held.append(value)
                depth += more
                if depth in rest:
                    out.append((*at, seq, "head" if head else "whole", begins, depth == 0, listed, "\n".join(held)))
                    held, head, begins, seq = [], False, depth == 0, seq + 1
            if out:
                yield rows(out)
        if at is not None and held:
            yield rows([(*at, seq, "through" if head else "tail", begins, False, last_listed, "\n".join(held))])

    def rows(found):
        types = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)

    pieces = told.mapInArrow(cut, "uri string, block bigint, seq bigint, kind string, begins boolean, ends boolean, listed boolean, text string")
    whole = pieces.filter("kind = 'whole'").select("uri", F.col("block").alias("b"), F.col("seq").alias("i"), "begins", "ends", "listed", "text")
    parts = pieces.filter("kind <> 'whole'")
    order = Window.partitionBy("uri").orderBy("block", "seq")
    parts = parts.withColumn("n", F.sum((F.col("kind") == "tail").cast("int")).over(order))
    p = F.array_sort(F.collect_list(F.struct("block", "seq", "begins", "ends", "text")))
    joined = parts.groupBy("uri", "n").agg(p.alias("p"), F.first("listed").alias("listed")).select(
        "uri", F.col("p")[0]["block"].alias("b"), F.col("p")[0]["seq"].alias("i"), F.col("p")[0]["begins"].alias("begins"),
        F.element_at("p", -1)["ends"].alias("ends"), "listed", F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"))
    found = whole.unionByName(joined).withColumn("raw", F.btrim("text", F.lit(_BLANK)))
    # a part of the file's array: without the array's own brackets, and the comma behind the part
    body = F.when(F.col("begins"), F.regexp_replace("raw", r"\A\[", "")).otherwise(F.col("raw"))
    body = F.when(F.col("ends"), F.regexp_replace(body, r"\]\z", "")).otherwise(F.regexp_replace(body, r",\z", ""))
    inner = F.col("listed") & ~(F.col("begins") & F.col("ends"))
    found = found.withColumn("body", F.when(inner, F.btrim(body, F.lit(_BLANK))).otherwise(F.col("raw"))).filter("body <> ''")
    return found.select("uri", "b", "i", "raw", F.when(inner, F.concat(F.lit("["), "body", F.lit("]"))).otherwise(F.col("body")).alias("text"))


def json_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every JSON value of the ``.json`` files under ``path`` as ``_source_file,
    _at`` (order in the file), ``v`` (variant, NULL if the text is no JSON), ``_raw``
    (that text) and ``_text`` (the text that holds the value).

    Values are lines where every line is balanced, else whatever stands between depths
    of 0; the elements of a top-level array are values of their own. Each text is parsed once."""
    lines = _lines(spark, path)
    # one row a file: the files with an unbalanced line whose brackets balance in all
    files = lines.select(F.col("_metadata.file_path").alias("uri"), opened(F.col("value")).alias("more")) \
        .groupBy("uri").agg(F.sum("more").alias("total"), F.bool_or(F.col("more") != 0).alias("uneven"))
    many = persist_fresh(files.filter("uneven AND total = 0").select("uri"))
    at = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))

    def single(kept):
        return kept.select(F.col("_metadata.file_path").alias("uri"), at.alias("_at"), F.col("value").alias("text")).withColumn("v", parse_whole("text"))
    if many.isEmpty():
        return _elements(single(lines))
    cut = chosen(lines, many)
    cut = _segments(cut, _splits(cut)).select("uri", F.struct("b", "i").alias("_at"), "raw", "text").withColumn("v", parse_whole("text"))
    # lines of a text between brackets that is no JSON are looked at one by one: a damaged value does not take others with it
    broken = F.col("v").isNull() & F.col("raw").contains("\n")
    texts = F.when(broken, F.filter(F.split("raw", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")).otherwise(F.array("raw"))
    cut = cut.select("uri", "_at", F.explode(texts).alias("text"), F.when(~broken, F.col("v")).alias("v"), broken.alias("broken"))
    cut = cut.select("uri", "_at", "text", F.when(F.col("broken"), parse_whole("text")).otherwise(F.col("v")).alias("v"))
    return _elements(single(chosen(lines, many, keep=False)).unionByName(cut))


def _elements(values: DataFrame) -> DataFrame:
    """Values as rows, the elements of lists each on its own."""
    each = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return values.select("uri", "_at", "text", F.posexplode(each).alias("pos", "v")).select(
        decoded_path("uri").alias("_source_file"), F.struct(F.col("_at.b").alias("b"), F.col("_at.i").alias("i"), "pos").alias("_at"),
        "v", F.when(F.col("v").isNull(), F.col("text")).alias("_raw"), F.col("text").alias("_text"))
