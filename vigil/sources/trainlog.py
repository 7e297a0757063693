"""Training log as text lines (S6): read with exact line numbers, write in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import materialize


def _before(name: str, over) -> F.Column:
    return F.coalesce(F.sum(name).over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def read_train_log(spark: SparkSession, path: str) -> DataFrame:
    """``(file, line_no, log_line_no, line)``: every line of every log file, blank ones too.

    ``line_no`` counts from 0 in each file, ``log_line_no`` over all files in the order of their
    names. A file of any size is read in splits; a line's number is its place in its split plus the
    lines of the splits before, which are summed over one row a split.
    """
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace("value", "\r$", "").alias("line"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
    )
    rows = materialize(rows, "log-lines")
    blocks = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("low"))
    in_file = blocks.withColumn("start", _before("n", Window.partitionBy("file").orderBy("block")))
    files = blocks.groupBy("file").agg(F.sum("n").alias("n"))
    files = files.select("file", _before("n", Window.orderBy("file")).alias("file_start"))  # one row a file
    offsets = in_file.drop("n").join(files, "file")
    numbered = rows.join(materialize(offsets, "log-offsets"), ["file", "block"])
    line_no = (F.col("start") + F.col("place") - F.col("low")).cast("bigint")
    return numbered.select("file", line_no.alias("line_no"), (F.col("file_start") + line_no).cast("bigint").alias("log_line_no"), "line")


def write_train_log(lines: DataFrame, path: str) -> None:
    """Write ``(line_no, line)`` as text files whose names are in line order, one a range of lines."""
    ordered = lines.repartitionByRange("line_no").sortWithinPartitions("line_no").select("line")
    ordered.write.mode("overwrite").option("lineSep", "\n").text(path)
