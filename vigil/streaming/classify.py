"""Classify every arriving comment; flagged ones are appended to the queue log.

Stateless: each micro-batch is a narrow projection + filter, written to a
parquet sink whose checkpoint gives exactly-once output across restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from vigil.operators.classify import classify, flagged
from vigil.streaming.sources import run_to_parquet


def flagged_stream(comments: DataFrame) -> DataFrame:
    """``comment_id, text, label, confidence`` for toxic comments of a stream."""
    return flagged(classify(comments))


def stream_classify(comments: DataFrame, data_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    return run_to_parquet(flagged_stream(comments), data_path, checkpoint, available_now)
