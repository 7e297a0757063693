"""Flag dedupe on a stream, and the live training report.

* ``flags_stream``: page elements flagged once per element id within a window of
  time; ids older than that are forgotten. A settings change starts it anew.
* ``stream_report``: each micro-batch of log lines is folded into a one-row
  state (``foreachBatch``), as the dashboard refreshes per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.operators.pages import Settings, scan_pages
from vigil.operators.trainlog import merge_states, parse_train_log, report_of, report_state


def flags_stream(pages: DataFrame, settings: Settings, host_regex: str, keep: str = "1 day", seen_at: str | None = None) -> DataFrame:
    """Scan a page stream; an element id that was emitted is not emitted again for ``keep`` of time.

    ``seen_at``: the page's time column; without one the time of arrival counts, and no row is ever late. With one,
    a row older than the newest time of the batches before by more than ``keep`` is late and dropped (its id may be
    forgotten); a null time never closes a window and counts as the beginning of time, so such rows are late from
    the second batch on. The state holds the ids of the last ``keep`` only. A page seen again after that is
    flagged again, as after a full scan anew.
    """
    carry = (seen_at,) if seen_at else ()
    flags = scan_pages(pages, settings, host_regex, carry=carry)
    time = F.coalesce(F.col(seen_at).cast("timestamp"), F.timestamp_seconds(F.lit(0))) if seen_at else F.current_timestamp()
    once = flags.withColumn("_seen", time).withWatermark("_seen", keep).dropDuplicatesWithinWatermark(["element_id"])
    return once.drop("_seen", *carry)


def stream_report(lines: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keep a report of all log lines seen so far; :func:`read_report` returns it.

    Each micro-batch is folded by itself and put together with the one-row state of the batch
    before; its state goes to a folder of its own, ``out_dir/state/<batch>``, so nothing is re-read
    or overwritten but on a replay of that batch. Lines after the batch with the first ``complete``
    never count.
    """
    spark = lines.sparkSession
    state = f"{out_dir.rstrip('/')}/state"

    def fold(batch: DataFrame, batch_id: int) -> None:
        new = report_state(parse_train_log(batch))
        if batch_id:
            new = spark.read.schema(new.schema).parquet(f"{state}/{batch_id - 1}").withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
            new = merge_states(new)
        new.coalesce(1).write.mode("overwrite").parquet(f"{state}/{batch_id}")  # one row

    w = lines.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="5 seconds")
    return w.start()


def read_report(spark: SparkSession, out_dir: str, query: StreamingQuery) -> DataFrame:
    """The report after the last batch of ``query``."""
    last = query.lastProgress["batchId"]
    return report_of(spark.read.parquet(f"{out_dir.rstrip('/')}/state/{last}"))
