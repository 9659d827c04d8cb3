"""Hot-group check for the chunked version scan (C7): N attempts, one source
holding a third of them. Prints timings, the largest window group of each
plan and whether the results agree (usage: python tools/skew_check.py [N])."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main():
    n = int(sys.argv[1]) if len(sys.argv) > 1 else 3_000_000
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from sluice.operators import schema
    from sluice.session import build_session
    spark = build_session("local[8]", shuffle_partitions=64, extra={"spark.ui.showConsoleProgress": "false"})
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
         .otherwise(F.concat(F.lit("s"), (F.col("id") % 1000).cast("string"))).alias("source_name"),
        F.col("id").alias("attempt_id"),
        F.when(F.rand(7) < 0.01, F.lit("B")).otherwise(F.lit("A")).alias("sig")).cache()
    df.count()
    t = time.perf_counter()
    chunked = schema.versions_by_change(df, "source_name", "attempt_id", "sig")
    chunked.write.format("noop").mode("overwrite").save()
    t_chunked = time.perf_counter() - t
    w = Window.partitionBy("source_name").orderBy("attempt_id")
    t = time.perf_counter()
    plain = (df.withColumn("_p", F.lag("sig").over(w))
               .withColumn("changed", F.col("_p").isNull() | (F.col("_p") != F.col("sig")))
               .withColumn("version", F.sum(F.col("changed").cast("int")).over(w)))
    plain.write.format("noop").mode("overwrite").save()
    t_plain = time.perf_counter() - t
    cols = ["source_name", "attempt_id", "changed", "version"]
    differing = chunked.select(*cols).exceptAll(plain.select(*cols)).count()
    chunk_max = df.groupBy("source_name", F.floor(F.col("attempt_id") / 65536)).count().agg(F.max("count")).first()[0]
    group_max = df.groupBy("source_name").count().agg(F.max("count")).first()[0]
    print(json.dumps({"rows": n, "chunked_seconds": round(t_chunked, 2), "plain_window_seconds": round(t_plain, 2),
                      "rows_differing": differing, "largest_window_group_chunked": chunk_max,
                      "largest_window_group_plain": group_max}))


if __name__ == "__main__":
    main()
