"""Sharding by minimax contiguous partition.

Documents of equal text are one atomic group. Groups are put in the order of
their text digest, and the line is cut into at most ``SHARDS`` runs so that the
largest run is as small as possible: binary search for the smallest capacity
that a greedy fill can meet, then cut where that fill cuts.

The search runs on running totals, not on groups. The driver holds a coarse
line of at most ``COARSE`` points and searches with bounds (a fill that always
stops short of a point's block, one that may use all of it); the blocks that
the two bounds leave open are fetched at finer steps until both agree. Cuts are
digests, so a document finds its shard by comparing its own digest with at
most ``SHARDS - 1`` constants: no join, and a group of any size moves nothing."""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, fresh, with_global_index

SHARDS = 16
#: Points of the coarse line, and of each open block's finer line.
COARSE, FINE = 16384, 64


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint")


def digest_of(text: Column) -> Column:
    """Digest that names and orders the group of a text; null groups with the empty text."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class _Line:
    """Running totals known so far, as sorted points ``ends`` (0 first). A
    stretch between neighbouring points is closed if it holds one group."""

    def __init__(self, points: list[tuple[int, bool]]):
        self.ends = [0] + [p for p, _ in points]
        self.closed = [True] + [c for _, c in points]  # of the stretch that ends there

    def reach(self, limit: int, hopeful: bool) -> tuple[int, int]:
        """(largest total at or below ``limit``, index of the stretch that an
        open answer lies in, else -1). ``hopeful`` takes what an open stretch
        may allow at best, else what it surely allows."""
        i = bisect_right(self.ends, limit) - 1
        if i + 1 >= len(self.ends) or self.closed[i + 1] or self.ends[i] == limit:
            return self.ends[i], -1
        return (limit if hopeful else self.ends[i]), i + 1

    def fill(self, capacity: int, shards: int, hopeful: bool) -> tuple[list[int], set[int]]:
        """Totals where a greedy fill cuts, and the open stretches it met."""
        cuts, open_, at, last = [], set(), 0, self.ends[-1]
        for _ in range(shards):
            at, met = self.reach(at + capacity, hopeful)
            if met >= 0:
                open_.add(met)
            cuts.append(at)
            if at >= last:
                break
        return cuts, open_

    def smallest(self, lo: int, hi: int, shards: int, hopeful: bool) -> int:
        """Smallest capacity in [lo, hi] whose fill covers the line (hi does)."""
        while lo < hi:
            mid = (lo + hi) // 2
            if self.fill(mid, shards, hopeful)[0][-1] >= self.ends[-1]:
                hi = mid
            else:
                lo = mid + 1
        return lo


def minimax_cuts(groups: DataFrame, shards: int = SHARDS, coarse: int = COARSE, fine: int = FINE) -> list[str]:
    """First digests of shards 1, 2, ... for ``groups(digest, size)`` with
    distinct digests (fewer than ``shards - 1`` if the line is covered sooner)."""
    numbered = with_global_index(groups.select("digest", "size"), [F.col("digest")], "at")
    # running totals: totals of equal slices first, then inside each slice
    n, total, largest = numbered.agg(F.count(F.lit(1)), F.sum("size"), F.max("size")).first()
    if not n:
        return []
    step = -(-n // coarse)
    block = F.floor(F.col("at") / step).cast("bigint")
    numbered = numbered.withColumn("block", block)
    sums = numbered.groupBy("block").agg(F.sum("size").alias("size")).orderBy("block").collect()  # <= coarse rows
    start, points = {}, []
    for r in sums:
        start[r["block"]] = points[-1][0] if points else 0
        points.append((start[r["block"]] + r["size"], step == 1))
    spark = groups.sparkSession
    starts = spark.createDataFrame(list(start.items()), "block bigint, start bigint")  # <= coarse rows
    running = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    line = checkpointed(numbered.join(F.broadcast(starts), "block")
                        .select("digest", "at", "block", "size", (F.col("start") + F.sum("size").over(running)).alias("end")))
    known = _Line(points)
    width = step  # groups in an open stretch, at most
    low = max(largest, -(-total // shards))
    while True:
        lo = known.smallest(low, total, shards, hopeful=True)
        hi = known.smallest(lo, total, shards, hopeful=False)
        # every stretch that a fill with a capacity in [lo, hi] can stop in
        open_ = set()
        first, last = 0, 0
        for _ in range(shards):
            first, last = known.reach(first + lo, False)[0], min(known.ends[-1], last + hi)
            a = bisect_right(known.ends, min(first, known.ends[-1])) - 1
            b = bisect_right(known.ends, last)
            open_.update(i for i in range(max(1, a), min(b + 1, len(known.ends))) if not known.closed[i])
        if not open_:
            break
        width = -(-width // fine)
        spans = _merge([(known.ends[i - 1], known.ends[i]) for i in sorted(open_)])
        inside = F.lit(False)
        for a, b in spans:
            inside = inside | ((F.col("end") > a) & (F.col("end") <= b))
        # every width-th group of a block ends a finer stretch; a block's last group always does
        found = line.where(inside).groupBy("block", F.floor((F.col("at") - F.col("block") * step) / width).alias("k")) \
            .agg(F.max("end").alias("end")).select("end").orderBy("end").collect()
        old = {known.ends[i]: known.closed[i] for i in range(1, len(known.ends)) if i not in open_}
        new = {r["end"]: width == 1 for r in found}
        known = _Line(sorted((new | old).items()))
    cuts = [c for c in known.fill(hi, shards, False)[0] if c < total]
    if not cuts:
        return []
    firsts = line.where((F.col("end") - F.col("size")).isin(cuts)).select("digest").orderBy("digest").collect()
    return [r["digest"] for r in firsts]  # at most shards - 1


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def assign(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """One row per row of ``docs``: ``id_col, size, text_crc32, digest, shard,
    slot``.

    Null texts group with empty ones (size 1, crc32 0). Slots of a shard are
    gapless from 0 in the order (digest, id, position in the input); a hot
    group is spread over tasks by its ids. Shards that the cut line does not
    need stay empty. Copies of one text always share a shard, so a group
    larger than an equal share makes its shard that large."""
    text = F.col(text_col)
    rows = checkpointed(docs.select(
        F.col(id_col).alias("id"), size_of(text).alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        digest_of(text).alias("digest"), F.monotonically_increasing_id().alias("place")))
    cuts = minimax_cuts(rows.groupBy("digest").agg(F.sum("size").alias("size")), shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + (F.col("digest") >= F.lit(c)).cast("int")
    placed = with_global_index(rows.withColumn("shard", shard), [F.col("digest"), F.col("id"), F.col("place")], "at")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("at").alias("first")).collect()}
    start = F.create_map([x for k, v in first.items() for x in (F.lit(k), F.lit(v))]) if first else \
        F.create_map(F.lit(0), F.lit(0))
    return placed.select(F.col("id").alias(id_col), "size", "text_crc32", "digest", "shard",
                         (F.col("at") - start[F.col("shard")]).cast("bigint").alias("slot"))
