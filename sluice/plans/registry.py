"""Collects the query keys of every plan module for the driver contract."""

from __future__ import annotations

from . import ingest_queries, queries, source_queries, stream_queries  # noqa: F401 - registration by import


def all_queries() -> dict:
    return dict(queries.QUERIES)


def all_oracles() -> dict:
    return dict(queries.ORACLES)


def flagship(spark, sf_dir: str):
    return ingest_queries.flagship_summary(spark, sf_dir)
