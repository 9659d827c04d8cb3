r"""Mixing sources to target weights by capped water-filling.

A source's size is its number of words. Sources share a budget in proportion
to their weights; whoever would exceed ``MAX_EPOCHS`` times its size is
clamped there, and what it leaves is shared by weight among the rest until no
source is above its cap. A target of ``e`` times the size is met by ``floor(e)``
whole repetitions of the source and one fractional repetition: documents in
the order of a seeded digest of their id, each that still fits (a document larger than
what is left is passed over), and then the one document left whose size is nearest to the rest, if it brings the sum
nearer to the target.

No source is ever gathered. Documents are taken in turns: from the last one passed over on, those that
are not larger than the rest, up to the first that does not fit any more. In a turn, words are summed by (source, digest bucket),
the bucket where the turn ends is found from those sums, and only that bucket's documents are put in order. The rest
shrinks below the size of the document passed over, so turns are few (sources without a fitting
document are out). A document's copies then follow from its own digest and its source's row of the plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_PATTERN, broadcast_if_small, checkpointed, fresh, with_global_index

#: Cycle of weights over the sources in code point order, share of all words to take, most repetitions of a source.
WEIGHTS, BUDGET, MAX_EPOCHS = (3, 1, 2), 1.5, 2
SEED = "mix-1"
#: Hexadecimal digits of the digest that name a bucket: 16 ** DIGITS buckets a source.
DIGITS = 3


def size_of(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def seeded_digest(doc_id: Column) -> Column:
    """Hexadecimal digest that orders documents; a null id counts as the empty text."""
    return F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def water_fill(sources: DataFrame) -> DataFrame:
    """``sources(source, source_size, weight)`` with a double ``target`` each.

    Every round sums, over all sources, the caps of the clamped and the
    weights of the free ones (two numbers reach the driver) and raises the
    level until it stays; a source once clamped stays clamped."""
    size = F.col("source_size")
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = MAX_EPOCHS * size
    level = None
    while True:
        clamped = (F.lit(level) * F.col("weight") >= cap) if level is not None else F.lit(False)
        fixed, free = sources.agg(F.sum(F.when(clamped, cap).otherwise(F.lit(0))),
                                  F.sum(F.when(clamped, F.lit(0)).otherwise(F.col("weight")))).first()
        if not free:  # every source is at its cap (or there is none)
            break
        new = (BUDGET * total - fixed) / free
        if new == level:
            break
        level = new
    if level is None:
        return sources.withColumn("target", F.lit(0.0))
    share = F.lit(level) * F.col("weight")
    return sources.withColumn("target", F.when(share >= cap, cap.cast("double")).otherwise(share.cast("double")))


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row a source (null is a source, ordered last): ``source,
    source_size, weight, target, whole`` repetitions, words of the fractional
    one (``extra``), its ``turns`` (null: nothing is taken; in each, documents after ``after`` and before
    ``stop`` that are not larger than ``rest``) and ``fill`` (the document added at the
    end, null for none)."""
    base = checkpointed(docs.select(F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("n"),
                                    seeded_digest(F.col(id_col)).alias("digest")))
    bucket = F.substring("digest", 1, DIGITS)
    sums = checkpointed(base.groupBy("source", bucket.alias("bucket")).agg(F.sum("n").alias("n")))
    sizes = checkpointed(sums.groupBy("source").agg(F.sum("n").alias("source_size")))
    ranked = with_global_index(sizes, [F.col("source").isNull(), F.col("source")], "at")
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    filled = water_fill(checkpointed(ranked.withColumn("weight", weight.cast("bigint")).drop("at")))
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MAX_EPOCHS))) \
        .otherwise(F.lit(0)).cast("int")
    filled = checkpointed(filled.withColumn("whole", whole).withColumn(
        "extra", F.when(F.col("whole") < MAX_EPOCHS, F.col("target") - F.col("whole") * F.col("source_size")).otherwise(0.0)))

    def with_side(rows: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "s")
        return rows.join(broadcast_if_small(side, "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")

    def turn(rests: DataFrame) -> DataFrame:
        """``source, stop, left``: the first document after ``after`` (null: from the beginning), not
        larger than ``rest``, that does not fit the rest any more (null: all fit), and what is left of the rest there."""
        rows = with_side(base, rests).where((F.col("n") <= F.col("rest")) & F.coalesce(F.struct("digest", "n") > F.col("after"), F.lit(True)))
        sums = checkpointed(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("n").alias("n"), F.first("rest").alias("rest")))
        # at most 16 ** DIGITS rows a source
        earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        steps = sums.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
        ends = checkpointed(steps.where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("n")))
                            .select("source", F.col("bucket").alias("last"), "before"))
        # documents of the last bucket in order; rows of equal digest and size count together
        inside = with_side(rows, ends).where(bucket == F.col("last")).groupBy("source", "digest", "n") \
            .agg(F.sum("n").alias("w"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        order = Window.partitionBy("source").orderBy("digest", "n").rowsBetween(Window.unboundedPreceding, -1)
        ahead = F.col("before") + F.coalesce(F.sum("w").over(order), F.lit(0))
        stops = inside.withColumn("ahead", ahead).where(F.col("ahead") + F.col("w") > F.col("rest")) \
            .groupBy("source").agg(F.min(F.struct("digest", "n", "ahead", "rest")).alias("s")) \
            .select("source", F.struct("s.digest", "s.n").alias("stop"), (F.col("s.rest") - F.col("s.ahead")).alias("left"))
        # a source that has candidates and no stop takes them all
        every = sums.groupBy("source").agg((F.first("rest") - F.sum("n")).alias("all")).withColumnRenamed("source", "t")
        return checkpointed(every.join(stops, F.col("source").eqNullSafe(F.col("t")), "left").select(
            F.col("t").alias("source"), "stop", F.coalesce("left", "all").alias("left")))

    key = "struct<digest:string,n:bigint>"
    turns = checkpointed(filled.where("extra > 0").select(
        "source", F.lit(0).alias("turn"), F.lit(None).cast(key).alias("after"), F.col("extra").alias("rest")))
    taken, k = None, 0
    while not turns.isEmpty():
        ended = turn(turns.drop("turn")).withColumnRenamed("source", "t")
        done = checkpointed(turns.join(ended, F.col("source").eqNullSafe(F.col("t"))).drop("t"))
        taken = done if taken is None else taken.unionByName(done)
        k += 1
        turns = checkpointed(done.where("stop IS NOT NULL AND left > 0").select(
            "source", F.lit(k).alias("turn"), F.col("stop").alias("after"), F.col("left").alias("rest")))
    full = filled
    if taken is not None:
        # a few turns a source; the last one tells what is left
        spans = taken.groupBy("source").agg(F.collect_list(F.struct("after", "stop", "rest")).alias("turns"),
                                            F.max_by("left", "turn").alias("left"))
        spans = checkpointed(spans)
        # the document not taken whose size is nearest to the rest, if it is the only one of its id and size
        off = F.abs(F.col("n") - F.col("left"))
        fills = with_side(base, spans).where((F.col("n") > 0) & (off < F.col("left")) & ~_taken(F.struct("digest", "n"), F.col("n"), F.col("turns"))) \
            .groupBy("source", "digest", "n", "left").agg(F.count(F.lit(1)).alias("times")).where("times = 1") \
            .groupBy("source").agg(F.min(F.struct(off.alias("off"), "digest", "n")).alias("fill")) \
            .select(F.col("source").alias("f"), F.struct("fill.digest", "fill.n").alias("fill"))
        full = full.join(spans.select(F.col("source").alias("s"), "turns"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s") \
            .join(fills, F.col("source").eqNullSafe(F.col("f")), "left").drop("f")
    else:
        full = full.withColumn("turns", F.lit(None).cast(f"array<struct<after:{key},stop:{key},rest:double>>")).withColumn("fill", F.lit(None).cast(key))
    return checkpointed(full)


def _taken(key: Column, size: Column, turns: Column) -> Column:
    """Whether a document of the source's order is taken by one of the turns."""
    return F.exists(turns, lambda t: F.coalesce(key > t["after"], F.lit(True)) & F.coalesce(key < t["stop"], F.lit(True)) & (size <= t["rest"]))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        prefix: str = "_mix_") -> DataFrame:
    """``docs`` with columns ``<prefix>size``, ``<prefix>source_size``,
    ``<prefix>target`` and ``<prefix>copies`` (0 to ``MAX_EPOCHS``).

    Texts without a word weigh nothing and are taken like their neighbours in
    the order (``copies`` may be positive, the words taken are 0). A source
    without words has target 0. Rows of equal id and size are taken alike.
    Reruns agree."""
    sources = plan(docs, id_col, text_col, source_col)
    names = {c: f"{prefix}{c}" for c in ("size", "source_size", "target", "copies")}
    side = broadcast_if_small(sources.select("source", F.struct(*[F.col(c) for c in sources.columns]).alias("_plan")), "source")
    row = fresh(docs, "_row")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(row),
                       F.col(source_col).cast("string").alias("_source"), size_of(F.col(text_col)).alias("_n"),
                       seeded_digest(F.col(id_col)).alias("_digest"))
    rows = rows.join(side, F.col("_source").eqNullSafe(F.col("source")))
    key = F.struct(F.col("_digest").alias("digest"), F.col("_n").alias("n"))
    more = F.coalesce(_taken(key, F.col("_n"), F.col("_plan.turns")), F.lit(False)) | F.coalesce(key == F.col("_plan.fill"), F.lit(False))
    return rows.select(
        f"{row}.*", F.col("_n").alias(names["size"]), F.col("_plan.source_size").alias(names["source_size"]),
        F.col("_plan.target").alias(names["target"]), (F.col("_plan.whole") + more.cast("int")).alias(names["copies"]))


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: every document as often as it is taken, all its columns."""
    prefix = fresh(docs, "_mix_")
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix += "_"
    mixed = mix(docs, id_col, text_col, source_col, prefix)
    copy = f"{prefix}copy"
    return mixed.where(F.col(f"{prefix}copies") > 0) \
        .withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(f"{prefix}copies")))) \
        .select(*[F.col(f"`{c}`") for c in docs.columns])
