"""Helpers the operators of this package share: shared-folder checkpoints, a
distributed 0-based row index, connected components and column naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: White space of the word rule ``[^\x20\x09-\x0D]+`` (ASCII only), for Java and RE2 patterns.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Frames up to this measured size are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Remainder of crc32(doc_id as text) by 3 that marks a held-out document.
HELD_OUT_REMAINDER = 1


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the session's shared checkpoint folder and cut its
    lineage (survives lost executors, unlike a local checkpoint)."""
    spark = df.sparkSession
    folder = ensure_checkpoint_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, base: str) -> str:
    """A column name that does not clash with any column of ``df`` (names
    compare without case, as Spark resolves them)."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column) -> Column:
    """True where crc32 of the id's text leaves remainder 1 by 3; a null id is
    treated as the empty text."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3) == HELD_OUT_REMAINDER


def broadcast_if_small(side: DataFrame, key: str | None = None) -> DataFrame:
    """A broadcast hint for a materialized frame of a few numbers a row whose
    measured size (rows, and the bytes of ``key``) is bounded; as it is beyond."""
    width = F.coalesce(F.sum(F.octet_length(key)), F.lit(0)) if key else F.lit(0)
    n, size = side.agg(F.count(F.lit(1)), width).first()
    return F.broadcast(side) if n * 256 + size <= BROADCAST_BYTES else side


def partitions_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` sorted by ``order`` with a gapless 0-based bigint column ``name``.

    Rows are range partitioned (no single task sorts all), numbered inside
    their partition, and shifted by the count of the partitions before; only
    one count per partition reaches the driver. The order must be total up to
    interchangeable rows. The result is checkpointed, so later stages see one
    fixed numbering."""
    spark = df.sparkSession
    n = partitions_of(spark)
    keys = [F.col(f"_o{i}") for i in range(len(order))]
    keyed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"),
                      *[o.alias(f"_o{i}") for i, o in enumerate(order)])
    ranged = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys) \
        .select("_row", F.monotonically_increasing_id().alias("_mid"))
    pinned = checkpointed(ranged)
    part, pos = F.shiftright("_mid", 33), F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {r[0]: r[1] for r in pinned.groupBy(part.alias("p")).count().collect()}
    total, rows = 0, []
    for p in sorted(counts):
        rows.append((p, total))
        total += counts[p]
    # one row per partition: as small as the partition count, so it may be broadcast
    offsets = spark.createDataFrame(rows, "_part bigint, _off bigint")
    return pinned.withColumn("_part", part).join(F.broadcast(offsets), "_part") \
        .select("_row.*", (F.col("_off") + pos).alias(name))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of the undirected ``edges(u, v)``: one row
    ``(node, root)`` per node that has an edge, ``root`` the smallest node of
    its component.

    Alternates the large-star and small-star steps (Kiveris et al., 2014)
    until the edge set is a star forest. Edge count never grows, every step is
    an aggregation with map-side combine and a join on the node. A hub node's
    edges are one skewed join key: the aggregate is checkpointed before it is
    joined, so the join shuffles both sides and adaptive execution can split
    the hub."""
    edges = checkpointed(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
                         .distinct())
    before = _signature(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpointed(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = checkpointed(large.where("u <> v").distinct())  # u > v: each node points to a smaller one
        least = checkpointed(large.groupBy("u").agg(F.min("v").alias("m")))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")) \
            .select(F.col("e.v").alias("u"), F.col("e.u").alias("v")).where("u <> v").distinct()
        edges = checkpointed(small)
        after = _signature(edges)
        if after == before:
            break
        before = after
    stars = edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root")
    hubs = edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct()
    return stars.unionByName(hubs)


def _signature(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)).alias("n"), F.sum((F.xxhash64("u", "v") % 1_000_003)).alias("s"),
                  F.sum((F.xxhash64("v", "u") % 998_244_353)).alias("t")).first()
    return tuple(r)
