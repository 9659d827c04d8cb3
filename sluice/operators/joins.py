"""Joins of a big frame with a derived small one, broadcast only behind a
measured size.

The small side (duplicate keys, bad files, per-source summaries) is derived
from the data, so its size is unknown when the plan is built; the static
planner then shuffles the big side. Here the small side is materialized
once (persisted, so the join does not recompute it), its bytes are measured,
and it is broadcast only under ``max_bytes``; beyond that the join is a
regular shuffle join (AQE splits skewed keys).

Spark's cache matches persisted data by plan, so a later call over the same
input path (with changed files) could be served the old result: every
persisted side carries a per-call tag column, which makes its plan unique.
Sides persisted inside a ``with released():`` block are dropped at its end;
blocks of concurrent runs do not touch each other."""

from __future__ import annotations

import contextlib
import contextvars
import uuid

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_BROADCAST_BYTES = 64 << 20
_TAG = "_sluice_call"
_PLACE = "_sluice_place"
_KEPT: contextvars.ContextVar = contextvars.ContextVar("sluice_kept", default=None)


@contextlib.contextmanager
def released():
    """Unpersist, at the end, the small sides that were kept inside."""
    kept: list = []
    token = _KEPT.set(kept)
    try:
        yield
    finally:
        _KEPT.reset(token)
        for f in kept:
            try:
                f.unpersist()
            except Exception:  # pragma: no cover - the session may be gone
                pass


def persist_fresh(df: DataFrame) -> DataFrame:
    """Persist ``df`` under a plan no other call can match. The returned
    frame has an extra ``_sluice_call`` column (drop it after use). Outside a
    ``released()`` block it stays until Spark evicts it."""
    tagged = df.withColumn(_TAG, F.lit(uuid.uuid4().hex)).persist(StorageLevel.MEMORY_AND_DISK)
    kept = _KEPT.get()
    if kept is not None:
        kept.append(tagged)
    return tagged


def measured_bytes(df: DataFrame) -> int:
    """Rows times fixed width plus the bytes of variable-length columns, in one aggregate."""
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "binary")]
    rest = [f.name for f in df.schema.fields if f.dataType.simpleString().startswith(("array", "map", "struct", "variant"))]
    width = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for c in wide:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    for c in rest:
        width = width + F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0))
    return int(df.agg(F.sum(width)).first()[0] or 0)


def join_small(big: DataFrame, small: DataFrame, on, how: str = "left",
               max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    fresh = small if _TAG in small.columns else persist_fresh(small)
    side = F.broadcast(fresh) if measured_bytes(fresh) <= max_bytes else fresh
    return big.join(side, on, how).drop(_TAG)


def join_small_in_order(big: DataFrame, small: DataFrame, on, how: str = "left",
                        max_bytes: int | None = None) -> DataFrame:
    """:func:`join_small` for a pass that reads ``big`` in its order: a
    broadcast leaves the rows where they are; a shuffle join brings the rows of a key together in any order, so
    they are sorted back by their place in ``big``."""
    bound = MAX_BROADCAST_BYTES if max_bytes is None else max_bytes
    fresh = small if _TAG in small.columns else persist_fresh(small)
    if measured_bytes(fresh) <= bound:
        return big.join(F.broadcast(fresh), on, how).drop(_TAG)
    placed, keys = big.withColumn(_PLACE, F.monotonically_increasing_id()), [on] if isinstance(on, str) else on
    return placed.join(fresh, on, how).sortWithinPartitions(*keys, _PLACE).drop(_TAG, _PLACE)
