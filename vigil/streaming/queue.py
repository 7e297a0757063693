"""The moderation queue over a stream of operations, as a chain of queue snapshots.

Each micro-batch is one step of :func:`vigil.operators.replay.advance`: the snapshot that the batch before left
meets the batch's ops. So a comment with most rows of a micro-batch is cut over chunks like in the batch replay;
no function ever holds all rows of a comment. Inside a batch the order is ``(ts, seq)``, across batches it is
arrival: a row that comes in a later micro-batch than a newer row of its comment cannot be re-ordered. The batch
replay is the reference for backfills.

What is kept, under ``out_dir``: ``outcomes/batch=<id>`` (a row for each delete and action) and ``queue/<id>`` (the
pending comments after the batch). Both are named by the batch and overwritten if Spark repeats it, so a retry
after a lost driver changes nothing: the step reads the snapshot of an earlier batch only. The last
``KEEP_VERSIONS`` snapshots stay. Null comment ids are one comment; a table of ops without rows is a step that
changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from vigil.operators.replay import QUEUE_COLUMNS, advance
from vigil.session import remove_path, scratch
from vigil.streaming.sources import child_names, start

QUEUE_SCHEMA = "comment_id string, doc_id long, confidence double, queued_ts timestamp_ntz, queued_seq long"
OUTCOME_SCHEMA = "comment_id string, seq long, ts timestamp_ntz, op string, outcome string, doc_id long, confidence double"
KEEP_VERSIONS = 2


def _versions(spark: SparkSession, out_dir: str) -> list[int]:
    return sorted(int(n) for n in child_names(spark, f"{out_dir}/queue") if n.isdigit())


def _snapshot(spark: SparkSession, out_dir: str, before: int | None = None) -> DataFrame:
    known = [v for v in _versions(spark, out_dir) if before is None or v < before]
    if not known:
        return spark.createDataFrame([], QUEUE_SCHEMA)
    return spark.read.schema(QUEUE_SCHEMA).parquet(f"{out_dir}/queue/{known[-1]}")


def queue_step(out_dir: str, flags: DataFrame | None = None, partitions: int | None = None):
    """The function that ``foreachBatch`` calls with a batch of ops ``seq, ts, comment_id, op, doc_id[, toxic, confidence]``."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        with scratch(spark):
            done = advance(_snapshot(spark, out_dir, batch_id), batch, flags=flags, partitions=partitions)
            done.outcomes.write.mode("overwrite").parquet(f"{out_dir}/outcomes/batch={batch_id}")
            done.queue_state.select(*QUEUE_COLUMNS).write.mode("overwrite").parquet(f"{out_dir}/queue/{batch_id}")
        for old in [v for v in _versions(spark, out_dir) if v < batch_id][: -(KEEP_VERSIONS - 1)]:
            remove_path(spark, f"{out_dir}/queue/{old}")

    return step


def stream_queue(
    ops: DataFrame, out_dir: str, checkpoint: str, flags: DataFrame | None = None, partitions: int | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Run the queue over streaming ops; ``flags`` as in :func:`vigil.operators.replay.replay`."""
    out_dir = out_dir.rstrip("/")
    return start(ops.writeStream.foreachBatch(queue_step(out_dir, flags, partitions)), checkpoint, available_now)


def read_outcomes(spark: SparkSession, out_dir: str) -> DataFrame:
    """All outcomes so far, with the ``batch`` of each."""
    schema = f"{OUTCOME_SCHEMA}, batch int"
    if not child_names(spark, f"{out_dir.rstrip('/')}/outcomes"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{out_dir.rstrip('/')}/outcomes")


def current_queue(spark: SparkSession, out_dir: str) -> DataFrame:
    """The pending comments after the last batch: ``comment_id, doc_id, confidence, queued_ts, queued_seq``."""
    return _snapshot(spark, out_dir.rstrip("/"))
