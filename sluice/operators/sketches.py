"""Column statistics that merge (P5): sketches stored once a version, so the
statistics of any range of versions come from a few small rows and no data is read again.

Per column: exact counts, least and greatest values and text lengths; a HyperLogLog sketch (distinct values), a KLL sketch
(quantiles of numbers and times) and a frequent-items sketch (heavy hitters). All are aggregates with partial results in the tasks: one
pass, and what is shuffled is a sketch a task and column. Values of other than number types are compared by their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Accuracy: a relative standard error of 1.04 / sqrt(2^LG_DISTINCT) for distinct counts, about 0.6 % of the rows for the rank of a quantile;
#: a value's frequency is overstated by at most 3.5 rows in TRACKED, and exact while a column has fewer than 3/4 TRACKED values.
LG_DISTINCT, QUANTILE_K, TRACKED = 14, 400, 4096

NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
STORED = ("n", "n_non_null", "min_num", "max_num", "min_text", "max_text", "min_len", "max_len", "distinct", "quantile", "frequent")


def _as_text(c: Column, kind: str) -> Column:
    return F.to_json(c) if kind.startswith(("array", "map", "struct", "variant")) else c.cast("string")


def _as_number(c: Column, kind: str) -> Column:
    if kind in NUMBERS or kind.startswith("decimal"):
        return c.cast("double")
    if kind == "timestamp":
        return F.unix_micros(c).cast("double") / 1e6
    if kind == "date":
        return F.unix_date(c).cast("double") * 86400
    return F.lit(None).cast("double")


def column_sketches(df: DataFrame, cols=None, by=()) -> DataFrame:
    """One row a column (and value of ``by``): ``column_name`` and the mergeable state ``STORED``. An empty frame gives counts of 0."""
    kinds = dict(df.dtypes)
    cols = [c for c in (cols or df.columns) if c not in by]
    if not cols:
        raise ValueError("no column to describe")

    def state(name):
        c, kind = F.col(f"`{name}`"), kinds[name]
        text, number = _as_text(c, kind), _as_number(c, kind)
        plain = F.lit(None).cast("string") if kind in NUMBERS or kind.startswith("decimal") else text
        return F.struct(F.lit(name).alias("column_name"), F.count(F.lit(1)).alias("n"), F.count(text).alias("n_non_null"),
                        F.min(number).alias("min_num"), F.max(number).alias("max_num"), F.min(plain).alias("min_text"), F.max(plain).alias("max_text"),
                        F.min(F.length(text)).cast("bigint").alias("min_len"), F.max(F.length(text)).cast("bigint").alias("max_len"),
                        F.hll_sketch_agg(text, F.lit(LG_DISTINCT)).alias("distinct"),
                        F.kll_sketch_agg_double(number, QUANTILE_K).alias("quantile"),
                        F.call_function("approx_top_k_accumulate", text, F.lit(TRACKED)).alias("frequent"))
    wide = df.groupBy(*by).agg(*[state(c).alias(f"_{i}") for i, c in enumerate(cols)])
    return wide.select(*by, F.inline(F.array(*[f"_{i}" for i in range(len(cols))])))


def merge_sketches(sketches: DataFrame, by=()) -> DataFrame:
    """The state of the union of all rows the given states describe, per column (and ``by``)."""
    low, high = [F.min(c).alias(c) for c in ("min_num", "min_text", "min_len")], [F.max(c).alias(c) for c in ("max_num", "max_text", "max_len")]
    return sketches.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.sum("n_non_null").alias("n_non_null"), *low, *high, F.hll_union_agg("distinct").alias("distinct"),
        F.kll_merge_agg_double("quantile").alias("quantile"),
        F.call_function("approx_top_k_combine", F.col("frequent"), F.lit(TRACKED)).alias("frequent")).select(*by, "column_name", *STORED)


def statistics(sketches: DataFrame, ranks=(0.25, 0.5, 0.75), top: int = 5, by=()) -> DataFrame:
    """Readable statistics: counts, bounds, ``n_distinct``, ``quantiles`` (at ``ranks``; NULL without numbers; times in
    seconds since 1970) and ``top`` (item, count), the most frequent values."""
    has_numbers = F.col("min_num").isNotNull()
    frequent = F.call_function("approx_top_k_estimate", F.col("frequent"), F.lit(top))
    return sketches.select(
        *by, "column_name", "n", (F.col("n") - F.col("n_non_null")).alias("n_null"), F.hll_sketch_estimate("distinct").alias("n_distinct"),
        "min_num", "max_num", "min_text", "max_text", "min_len", "max_len",
        F.when(has_numbers, F.kll_sketch_get_quantile_double("quantile", F.array(*[F.lit(float(r)) for r in ranks]))).alias("quantiles"),
        F.filter(frequent, lambda x: x["item"].isNotNull()).alias("top"))
