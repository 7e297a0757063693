"""Skew check: one comment holds a third of the operation log.

Re-keys every third event of the events-bound log to a single comment, then
runs the replay twice: over many chunks of the log, and over a single one (a
plain per-comment window). Prints the largest chunk and the time of each, and
checks both give the same queue / actions / not-found.

Usage: python scripts/skew_check.py [sf_dir] [chunks]
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from vigil.operators import classify as C  # noqa: E402
from vigil.operators import replay as R  # noqa: E402
from vigil.session import local_session  # noqa: E402
from vigil.sources import tables as T  # noqa: E402


def main() -> None:
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    chunks = int(sys.argv[2]) if len(sys.argv) > 2 else 64
    spark = local_session(8, 8, app="vigil-skew")
    docs = T.documents(spark, sf)
    log = T.operation_log(spark, sf).withColumn(
        "comment_id", F.when(F.pmod(F.col("seq"), F.lit(3)) == 0, F.lit("t1_hot")).otherwise(F.col("comment_id"))
    )
    n = log.count()
    hot_n = log.where(F.col("comment_id") == "t1_hot").count()
    out = {}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    for label, k in (("split", chunks), ("plain", 1)):
        t0 = time.perf_counter()
        r = R.replay(log, flags=C.toxic_flags(docs, "doc_id"), partitions=k)
        res = (
            sorted(map(tuple, r.queue_state.collect())),
            sorted(map(tuple, r.actions_keyed.collect())),
            sorted(map(tuple, r.not_found.collect())),
        )
        out[label] = (res, round(time.perf_counter() - t0, 2))
    sizes = R.assign_chunks(log, chunks).groupBy("chunk").count()
    biggest = sizes.agg(F.max("count"), F.count(F.lit(1))).first()
    same = out["split"][0] == out["plain"][0]
    print(f"log rows {n}, hot comment rows {hot_n}; {biggest[1]} chunks, largest {biggest[0]} rows")
    print(f"split {out['split'][1]} s, plain {out['plain'][1]} s, identical results: {same}")
    print("queue / actions / not-found:", [len(x) for x in out["split"][0]])


if __name__ == "__main__":
    main()
