"""Files of any size as rows of bounded size.

A value of a Spark row holds two gigabytes at most, so a larger file is stored as chunks: ``(path, chunk, offset, content)``.
Spark reads byte ranges of a file in tasks only as lines; here a line ends with ``\\n`` alone, and the bytes between line ends are taken
as they are, whatever they mean. One aggregate gives the bytes of every split, a window over splits (a row each) the offset at which each
begins, and a narrow pass cuts the splits at the chunk boundaries. Only the pieces at a split's two ends are shuffled, to
meet the other half of their chunk; all others are whole where they were read. The price is three reads of the large files.

Chunks do not depend on how the file was split: byte chunks begin at multiples of ``chunk_bytes``; with ``by_line`` a line
belongs to the chunk in whose range it begins, so no character is cut and a chunk exceeds ``chunk_bytes`` by one line at most.

What the lines hold is checked against the file's size, in total and at every split. A file that fails it, one with a compressed
file's extension (Spark's reader would unpack it), and one with two gigabytes between two line ends, is a row
with the issue ``too_large_for_row`` and no content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import sha256
from ..functions.paths import decoded_path, extension, file_name, plain_path
from ..operators.joins import join_small_in_order, persist_fresh
from .files import TOO_LARGE, read_binary

CHUNK_BYTES = 8 << 20
#: A larger file's SHA-256 is taken split by split, not from one value of a row.
DIGEST_BYTES = 256 << 20
DIGESTS = "path string, size_bytes bigint, digest string"
#: Extensions that Spark's line reader unpacks (fixed values of the Hadoop codecs).
PACKED = (".bz2", ".deflate", ".gz", ".lz4", ".snappy", ".zst")
BYTE_ORDER_MARK = b"\xef\xbb\xbf"
SCHEMA = "uri string, size_bytes bigint, chunk bigint, offset bigint, edge boolean, content binary"


def _splits(lines: DataFrame) -> DataFrame:
    """``uri, block, n, begin, mark, whole``: the bytes of every split and where they begin in the file; whether the file begins
    with a byte order mark, which the line reader leaves out; whether the lines account for the whole file."""
    counted = lines.groupBy("uri", "size_bytes", "block", "length").agg(F.sum(F.octet_length("value") + F.lit(1).cast("bigint")).alias("n"))
    of_file, before = Window.partitionBy("uri"), Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # a last line without a line end counts one byte too many, a mark three too few
    over = F.sum("n").over(of_file) - F.col("size_bytes")
    marked = counted.withColumn("mark", over.isin(-3, -2)) \
        .withColumn("n", F.col("n") + F.when(F.col("mark") & (F.col("block") == 0), F.lit(3)).otherwise(F.lit(0)))
    placed = marked.withColumn("begin", F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint"))) \
        .withColumn("over", F.sum("n").over(of_file) - F.col("size_bytes"))
    # the first line of a split begins in the split, behind its first byte (but for the file's first)
    fits = ((F.col("block") == 0) & (F.col("begin") == 0)) | \
        ((F.col("block") > 0) & (F.col("begin") > F.col("block")) & (F.col("begin") <= F.col("block") + F.col("length")))
    whole = F.min(fits.cast("int")).over(of_file) == 1
    return placed.select("uri", "block", "n", "begin", "mark", (whole & F.col("over").between(0, 1)).alias("whole"))


def _cutter(chunk_bytes: int, by_line: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list = []
        at = None            # the split: uri, block, size of the file, bytes of the split, where it begins
        held, pos, first = bytearray(), 0, True

        def put(n, last):
            """The first ``n`` bytes held are a piece. Its chunk may go on in another split at the split's ends."""
            nonlocal pos, first
            uri, block, size = at[:3]
            content = bytes(held[:min(n, size - pos)])
            if content:
                edge = (first and block > 0) or (last and pos + len(content) < size)
                out.append((uri, size, pos // chunk_bytes, pos, edge, content))
                first = False
            del held[:n]
            pos += n

        def end():
            if at is not None:
                if pos + len(held) - at[4] != at[3]:
                    raise RuntimeError(f"{at[0]}: the file was not read as before")
                put(len(held), True)

        for batch in batches:
            for uri, size, block, n, begin, mark, value in zip(*[c.to_pylist() for c in batch.columns]):
                if at is None or (uri, block) != at[:2]:
                    end()
                    at, pos, first = (uri, block, size, n, begin), begin, True
                    if mark and block == 0:
                        held += BYTE_ORDER_MARK
                if by_line and held and (pos + len(held)) // chunk_bytes > pos // chunk_bytes:
                    put(len(held), False)
                held += value
                held += b"\n"
                while not by_line and (room := chunk_bytes - pos % chunk_bytes) <= len(held):
                    put(room, False)
                if len(out) >= 256 or (out and len(out) * chunk_bytes >= CHUNK_BYTES):
                    yield rows(out)
                    out.clear()
        end()
        if out:
            yield rows(out)

    def rows(found):
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        names = ["uri", "size_bytes", "chunk", "offset", "edge", "content"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), types)], names=names)
    return cut


def _pieces(spark: SparkSession, path: str, above: int, chunk_bytes: int, by_line: bool = False, extensions=None,
            glob: str | None = None, longest: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(the pieces of the files that can be cut, each where it was read and in a split's order; ``path, size_bytes`` of the others).
    A task reads a line to its end up to ``longest`` bytes; a file with a longer one is among the others."""
    if chunk_bytes < 1:
        raise ValueError("chunk_bytes must be positive")

    def chosen(df, name: Column, size: str):
        df = df.filter(F.col(size) > above)
        return df.filter(extension(file_name(name)).isin(*extensions)) if extensions else df

    def reader(r):
        r = r.option("recursiveFileLookup", True)
        return r.option("pathGlobFilter", glob) if glob else r
    lines_of = reader(spark.read).option("lineSep", "\n").option("ignoreCorruptFiles", True)
    if longest:
        lines_of = lines_of.option("mapreduce.input.linerecordreader.line.maxlength", longest)
    text = lines_of.text(path)
    uri = decoded_path("_metadata.file_path")
    lines = chosen(text, uri, "_metadata.file_size").filter(~extension(file_name(uri)).isin(*PACKED)).select(
        uri.alias("uri"), F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_block_length").alias("length"), F.col("value").cast("binary").alias("value"))
    splits = persist_fresh(_splits(lines))
    told = join_small_in_order(lines, splits.filter("whole"), ["uri", "block"], "inner")
    pieces = told.select("uri", "size_bytes", "block", "n", "begin", "mark", "value").mapInArrow(_cutter(chunk_bytes, by_line), SCHEMA)
    listing = reader(spark.read.format("binaryFile")).load(path).select(plain_path("path").alias("path"), F.col("length").alias("size_bytes"))
    done = splits.filter("whole").select(F.col("uri").alias("path")).distinct()
    return pieces, chosen(listing, F.col("path"), "size_bytes").join(done, "path", "left_anti")


def file_chunks(spark: SparkSession, path: str, above: int = 0, chunk_bytes: int = CHUNK_BYTES, by_line: bool = False,
                extensions=None, glob: str | None = None) -> DataFrame:
    """``path, size_bytes, chunk, offset, content, issue``: the chunks of every file under ``path`` with more than
    ``above`` bytes (and one of ``extensions``, if given). The contents of a file's rows in the order of ``offset`` are the file."""
    pieces, others = _pieces(spark, path, above, chunk_bytes, by_line, extensions, glob)
    columns = ["uri", "size_bytes", "chunk", "offset", "content"]
    part = F.array_sort(F.collect_list(F.struct("offset", "content")))
    joined = pieces.filter("edge").groupBy("uri", "size_bytes", "chunk").agg(part.alias("p")) \
        .select("uri", "size_bytes", "chunk", F.col("p")[0]["offset"].alias("offset"),
                F.aggregate("p", F.lit(bytearray(b"")), lambda a, x: F.concat(a, x["content"])).alias("content"))
    chunks = pieces.filter("NOT edge").select(*columns).unionByName(joined).withColumnRenamed("uri", "path") \
        .withColumn("issue", F.lit(None).cast("string"))
    left = others.select(
        "path", "size_bytes", F.lit(None).cast("bigint").alias("chunk"), F.lit(None).cast("bigint").alias("offset"),
        F.lit(None).cast("binary").alias("content"), F.lit(TOO_LARGE).alias("issue"))
    return chunks.unionByName(left)


def _runs(rows) -> Iterator[tuple[str, int, int, Iterator[bytes]]]:
    """``file, its size, offset, contents``: the pieces of a task that follow on each other in a file, read one by one."""
    rows = iter(rows)
    ahead = next(rows, None)
    while ahead is not None:
        uri, size, begin = ahead[:3]

        def contents():
            nonlocal ahead
            end = begin
            while ahead is not None and (ahead[0], ahead[2]) == (uri, end):
                content = bytes(ahead[3])
                end += len(content)
                ahead = next(rows, None)
                yield content
        of_run = contents()
        yield uri, size, begin, of_run
        for _ in of_run:
            pass


def _told(index, rows):
    """Where the runs of a task lie, and whether it can go on with another's digest."""
    for uri, size, begin, contents in _runs(rows):
        yield index, uri, size, begin, begin + sum(map(len, contents)), sha256.available()


def _link(states: dict):
    """The task that goes on with the digests of ``(file, offset)``."""
    def link(rows):
        for uri, _, begin, contents in _runs(rows):
            if (uri, begin) in states:
                digest, end = sha256.Sha256(states[uri, begin]), begin
                for content in contents:
                    digest.update(content)
                    end += len(content)
                yield uri, begin, end, digest.state()
    return link


def file_digests(spark: SparkSession, path: str, above: int, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``path, size_bytes, digest``: the SHA-256 of every file under ``path`` with more than ``above`` bytes, none of which a task
    reads whole. The digest is one chain over a file: a task goes on with the state that the task of the split before ended with, so a
    job takes one split of every file, and there are as many jobs as the largest file has splits. The driver holds a state a file
    and a place a split. A file that cannot be cut (see above; here also one with ``above`` bytes between two line ends) is read by one task
    if it fits a row; if not, its digest is null."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    if listing.filter(F.col("length") > above).select("path").isEmpty():
        return spark.createDataFrame([], DIGESTS)
    pieces, others = _pieces(spark, path, above, chunk_bytes, longest=above)
    rdd = pieces.select("uri", "size_bytes", "offset", "content").rdd
    runs = rdd.mapPartitionsWithIndex(_told).collect()
    of_file: dict = {}
    if all(r[5] for r in runs):
        for index, uri, size, begin, end, _ in sorted(runs, key=lambda r: r[3]):
            of_file.setdefault((uri, size), []).append((begin, end, index))
    jobs = max(map(len, of_file.values()), default=0)
    states = {uri: (0, None) for uri, _ in of_file}
    for job in range(jobs):
        # files end together: the short splits at their ends, which share tasks, are read once
        now = {uri: r[job - jobs] for (uri, _), r in of_file.items() if job >= jobs - len(r)}
        told = {(uri, begin): states[uri][1] for uri, (begin, _, _) in now.items()}
        for uri, begin, end, state in spark.sparkContext.runJob(rdd, _link(told), sorted({index for _, _, index in now.values()})):
            if (begin, end) != now[uri][:2] or begin != states[uri][0]:
                raise RuntimeError(f"{uri}: the file was not read as before")
            states[uri] = (end, state)
    if any(states[uri][0] != size for uri, size in of_file):
        raise RuntimeError("a file was not read as before")
    found = spark.createDataFrame([(uri, size, sha256.Sha256(states[uri][1]).hexdigest()) for uri, size in of_file], DIGESTS)
    names = [r["path"] for r in (others if of_file else listing.filter(F.col("length") > above).select(plain_path("path").alias("path"))).collect()]
    if not names:
        return found
    rest = read_binary(spark, [re.sub(r"([\\{}\[\]*?])", r"\\\1", n) for n in names], with_content=True, extensions=None)
    return found.unionByName(rest.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("digest")))


def chunk_digests(chunks: DataFrame) -> DataFrame:
    """``path, size_bytes, n_chunks, digest``: a file's digest is the SHA-256 of its chunks' SHA-256 (hex) in order, so contents are
    hashed where they lie and a file hands on 64 characters a chunk. ``complete`` says whether the chunks hold all its bytes."""
    told = chunks.select("path", "size_bytes", F.struct("offset", F.sha2("content", 256).alias("h")).alias("c"),
                         F.octet_length("content").cast("bigint").alias("n"))
    found = told.groupBy("path", "size_bytes").agg(F.array_sort(F.collect_list(F.when(F.col("n").isNotNull(), F.col("c")))).alias("c"),
                                                   F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return found.select("path", "size_bytes", F.size("c").cast("bigint").alias("n_chunks"),
                        F.sha2(F.array_join(F.transform("c", lambda x: x["h"]), ""), 256).alias("digest"),
                        (F.col("n") == F.col("size_bytes")).alias("complete"))
