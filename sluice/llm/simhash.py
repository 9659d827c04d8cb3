r"""SimHash near-duplicates over a Gray-order hierarchical index.

Fingerprints (64 bits, one vote per shingle hash) are sorted by Gray rank, so
neighbours share long runs of bits. Equal slices of that order are the leaves'
blocks; a block's node holds the bits all its members share (mask) and their
values, and the nodes above factor out what their children share. A query
walks down and adds, level by level, the differences to the newly fixed bits:
beyond the allowed distance the whole group is pruned.

The same walk runs twice. First over the blocks' nodes (at most ``MAX_BLOCKS``
of them, whatever the input) to decide which blocks a fingerprint must visit;
then, inside each block, over the members' own tree. Blocks are slices of one
global order and therefore of equal size: no bucket can become hot. Copies
with one fingerprint are collapsed before, and a block returns star edges of
what it links, never all pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import checkpointed, components, fresh, partitions_of, with_global_index

#: Shingle length (words) and largest number of differing bits of the operator.
SHINGLE_WORDS, MAX_BITS = 3, 2
HASH_SEED = 42
#: Fewest members of a block, and most blocks (the nodes that are broadcast: three longs each).
BLOCK_ROWS, MAX_BLOCKS = 65536, 16384
#: Children of an index node.
FANOUT = 16
#: Shingles hashed, and fingerprints walked down the tree, at a time.
CHUNK, WALK = 16384, 1024


# --- fingerprints ---------------------------------------------------------------

def fingerprint(text: str | None, n: int = SHINGLE_WORDS) -> int:
    """SimHash of one text as a signed 64-bit integer; 0 for a text without a word."""
    from xxhash import xxh64_intdigest
    words = text.encode("utf-8").lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    width = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
    starts = np.concatenate(([0], np.cumsum(width)))
    k = min(n, len(words))
    total = len(words) - k + 1
    votes = np.zeros(64, dtype=np.int64)
    for a in range(0, total, CHUNK):
        b = min(total, a + CHUNK)
        h = np.fromiter([xxh64_intdigest(joined[i:j], HASH_SEED) for i, j in
                         zip(starts[a:b].tolist(), (starts[a + k:b + k] - 1).tolist())], dtype="<u8", count=b - a)
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > total, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_column(text: Column, n: int = SHINGLE_WORDS) -> Column:
    """Fingerprint (bigint) of a text column: words by ASCII white space, A-Z
    lower-cased, shingles with repeats; fewer than ``n`` words form one
    shingle, none give fingerprint zero (null text too)."""
    @F.pandas_udf(T.LongType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([fingerprint(t, n) for t in s], dtype="int64")
    return run.asNondeterministic()(text)


def gray_rank(fp: Column) -> Column:
    """Position of a fingerprint in the binary-reflected Gray sequence, as a
    bigint that sorts like the unsigned rank."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


# --- the index ------------------------------------------------------------------

class GrayTree:
    """Hierarchy over groups given in Gray order by the bits they share.

    ``levels[0]`` are the given groups, each level above joins ``FANOUT``
    children. A node keeps the shared bits its parent does not fix already
    (residual mask), so differences accumulate on the way down."""

    def __init__(self, ones: np.ndarray, anys: np.ndarray, fanout: int = FANOUT):
        self.fanout = fanout
        levels = [(ones, anys)]
        while len(levels[-1][0]) > fanout:
            a, o = levels[-1]
            at = np.arange(0, len(a), fanout)
            levels.append((np.bitwise_and.reduceat(a, at), np.bitwise_or.reduceat(o, at)))
        self.masks, self.values = [], []
        for depth, (a, o) in enumerate(levels):
            mask = ~(a ^ o)
            if depth + 1 < len(levels):
                pa_, po = levels[depth + 1]
                mask = mask & np.repeat(pa_ ^ po, fanout)[:len(a)]  # bits the parent leaves open
            self.masks.append(mask)
            self.values.append(a)

    def visit(self, queries: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """(query position, group position) of every group no part of which is
        pruned at ``bits`` accumulated differences."""
        top = len(self.masks) - 1
        n = len(self.masks[top])
        q = np.repeat(np.arange(len(queries)), n)
        g = np.tile(np.arange(n), len(queries))
        far = np.zeros(len(q), dtype=np.uint8)
        for depth in range(top, -1, -1):
            far = far + np.bitwise_count((queries[q] ^ self.values[depth][g]) & self.masks[depth][g])
            near = far <= bits
            q, g, far = q[near], g[near], far[near]
            if depth:
                below = len(self.masks[depth - 1])
                q, far = np.repeat(q, self.fanout), np.repeat(far, self.fanout)
                g = (g[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                inside = g < below
                q, g, far = q[inside], g[inside], far[inside]
        return q, g


def _roots(up: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        y = up[x]
        if np.array_equal(x, y):
            return x
        x = y


def _member_roots(members: np.ndarray, tree: GrayTree, bits: int) -> np.ndarray:
    """Position of the local root (the first member of its class) of each of a block's members."""
    up = np.arange(len(members))
    for a in range(0, len(members), WALK):
        q, g = tree.visit(members[a:a + WALK], bits)
        q = q + a
        keep = q < g
        q, g = q[keep], g[keep]
        while len(q):
            x, y = _roots(up, q), _roots(up, g)
            apart = x != y
            if not apart.any():
                break
            q, g = q[apart], g[apart]
            np.minimum.at(up, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
    return _roots(up, np.arange(len(members)))


def _link_blocks(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Rows ``block, visitor, fp`` sorted by block, members before visitors in
    Gray order -> star edges (u, v) of signed fingerprints. A block's members
    are held (``BLOCK_ROWS`` or 1/``MAX_BLOCKS`` of all), visitors stream."""
    block, parts, tree, members, roots = None, [], None, None, None

    def close():  # the members are complete: build the tree, link them
        nonlocal tree, members, roots
        members = np.concatenate(parts)
        tree = GrayTree(members, members)
        roots = _member_roots(members, tree, bits)
        linked = roots != np.arange(len(members))
        return members[linked], members[roots[linked]]

    def out(u, v):
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    for batch in batches:
        blocks, visitor, fps = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        fps = np.ascontiguousarray(fps).view(np.uint64)
        cuts = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(visitor.astype(np.int8)) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)]):
            if a == b:
                continue
            if block != blocks[a]:
                if block is not None and tree is None:
                    yield out(*close())
                block, parts, tree = blocks[a], [], None
            if not visitor[a]:
                parts.append(fps[a:b])
                continue
            if tree is None:
                yield out(*close())
            for c in range(a, b, WALK):
                mine = fps[c:min(b, c + WALK)]
                q, g = tree.visit(mine, bits)
                if len(q):  # one edge for each local component a visitor touches
                    pairs = np.unique(np.stack([q, roots[g]]), axis=1)
                    yield out(mine[pairs[0]], members[pairs[1]])
    if block is not None and tree is None:
        yield out(*close())


def links(fingerprints: DataFrame, bits: int = MAX_BITS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Edges ``u, v`` over distinct non-null bigint column ``fp`` that connect
    exactly what pairs at ``bits`` or fewer differing bits connect."""
    spark = fingerprints.sparkSession
    ranked = with_global_index(fingerprints.select("fp"), [gray_rank(F.col("fp"))], "at")
    n = ranked.count()
    size = max(block_rows, -(-n // MAX_BLOCKS))
    blocked = ranked.select((F.floor(F.col("at") / size)).cast("int").alias("block"), "fp")
    nodes = blocked.groupBy("block").agg(F.bit_and("fp").alias("ones"), F.bit_or("fp").alias("anys")) \
        .orderBy("block").collect()  # at most MAX_BLOCKS rows
    ones = np.array([r["ones"] for r in nodes], dtype=np.int64).view(np.uint64)
    anys = np.array([r["anys"] for r in nodes], dtype=np.int64).view(np.uint64)
    upper = spark.sparkContext.broadcast((ones, anys))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = GrayTree(*upper.value)
        for batch in batches:
            own_all = batch.column(0).to_numpy()
            fps_all = np.ascontiguousarray(batch.column(1).to_numpy()).view(np.uint64)
            for a in range(0, len(fps_all), WALK):
                own, fps = own_all[a:a + WALK], fps_all[a:a + WALK]
                q, g = tree.visit(fps, bits)
                home = own[q]
                # either of two blocks may hold the other's visitor: odd and even distances take turns
                keep = (g != home) & (((g > home) & ((g + home) % 2 == 0)) | ((g < home) & ((g + home) % 2 == 1)))
                blocks = np.concatenate([own, g[keep].astype(np.int32)])
                yield pa.RecordBatch.from_arrays([
                    pa.array(blocks, type=pa.int32()), pa.array(np.arange(len(blocks)) >= len(own)),
                    pa.array(np.concatenate([fps, fps[q[keep]]]).view(np.int64))], names=["block", "visitor", "fp"])

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _link_blocks(batches, bits)

    routed = blocked.mapInArrow(route, "block int, visitor boolean, fp bigint")
    return routed.repartition(partitions_of(spark), "block") \
        .sortWithinPartitions("block", "visitor", gray_rank(F.col("fp"))) \
        .mapInArrow(link, "u bigint, v bigint")


def _classes(signed: DataFrame, bits: int) -> DataFrame:
    """``fp, component_id`` of the distinct fingerprints of ``signed(id, fp)``."""
    reps = checkpointed(signed.groupBy("fp").agg(F.min("id").alias("rep")))
    comp = components(links(reps, bits))
    rooted = checkpointed(reps.join(comp.withColumnRenamed("node", "fp"), "fp", "left")
                          .select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    # materialized apart, so that the join below can split a large class
    smallest = checkpointed(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    n: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, fp`` (bigint), ``component_id``
    (smallest id reachable over links, its own included).

    Null and empty texts and texts of white space have fingerprint zero and
    link like any other. Repeated ids and rows stay, each with its class; a
    null id never is a class id unless the whole class has none. An empty
    table gives an empty result."""
    signed = checkpointed(docs.select(F.col(id_col).alias("id"), fingerprint_column(F.col(text_col), n).alias("fp")))
    return signed.join(_classes(signed, bits), "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                n: int = SHINGLE_WORDS, bits: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, all its columns:
    the one with the smallest id (rows of equal id: the smallest text hash, and
    one of rows equal in both). Classes of null ids only keep one row too.

    Decisions are made on (id, text hash, fingerprint); the documents
    themselves move once, to meet them."""
    key, order = fresh(docs, "_key"), fresh(docs, "_order")
    keyed = docs.withColumn(key, F.struct(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th")))
    signed = checkpointed(keyed.select(F.col(f"{key}.id").alias("id"), F.col(f"{key}.th").alias("th"),
                                       fingerprint_column(F.col(text_col), n).alias("fp")))
    # per class the smallest (has no id, id, hash); partial aggregation carries hot classes
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("w")
    winners = signed.groupBy("fp").agg(first).join(_classes(signed, bits), "fp") \
        .groupBy("component_id", F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")) \
        .agg(F.min("w").alias("w")).select(F.struct("w.id", "w.th").alias(key))
    one = Window.partitionBy(key).orderBy(F.lit(0))
    return keyed.join(winners, key, "left_semi") \
        .withColumn(order, F.row_number().over(one)).where(F.col(order) == 1).drop(order, key)
