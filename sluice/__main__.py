"""Run every source of a configuration: ``python -m sluice --config sources.json
--lake <shared folder> [--gate source|record] [--summary <path>]``.

Prints the run rows as JSON lines; ``--summary`` also writes them (S9)."""

from __future__ import annotations

import argparse
import json


def main(argv=None) -> int:
    ap = argparse.ArgumentParser(prog="python -m sluice")
    ap.add_argument("--config", required=True, help='JSON file {"sources": [{name, path, ...}]}')
    ap.add_argument("--lake", required=True, help="root folder of staging, lakehouse, quarantine, catalog")
    ap.add_argument("--gate", choices=("source", "record"), default="source")
    ap.add_argument("--format", default="parquet", help="table format (delta when its jar is present)")
    ap.add_argument("--summary", help="also write the run rows as JSON lines here")
    ap.add_argument("--master", help="Spark master for a local run (default: the launcher's)")
    args = ap.parse_args(argv)

    from .plans.ingest import Lake, ingest_sources
    from .session import build_session
    from .sinks.tables import write_run_summary
    from .sources.config import load_sources

    spark = build_session(args.master)
    runs = ingest_sources(spark, load_sources(spark, args.config), Lake(args.lake, args.format), gate=args.gate)
    cols = [c for c in runs.columns if c not in ("fields", "metadata")]
    for r in runs.select(*cols).collect():  # one row per configured source
        print(json.dumps(r.asDict(), default=str))
    if args.summary:
        write_run_summary(runs.select(*cols), args.summary)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
