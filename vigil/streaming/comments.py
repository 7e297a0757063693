"""The comment feed as JSON lines, with a second sink for lines that are not comments.

A comment is a JSON object with ``comment_id`` and ``text``, both strings (other fields are ignored). Every other line
goes to the rejects with a reason: ``not JSON``, ``not an object``, ``<field> missing`` or ``<field> not a string`` (a
null is no string). Lines of white space are not JSON; a line above Spark's limit for a variant value (16 MB) isn't
either. Both sinks are written by micro-batch, under its number: a repeated batch overwrites itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vigil.streaming.sources import child_names, start

REQUIRED = ("comment_id", "text")
ACCEPTED_SCHEMA, REJECTED_SCHEMA = "comment_id string, text string", "line string, reason string"


def read_line_stream(spark: SparkSession, folder: str, max_files: int = 1) -> DataFrame:
    """``line`` of each line of the text files in a folder, as they come."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(folder).withColumnRenamed("value", "line")


def checked(lines: DataFrame) -> DataFrame:
    """``line, comment_id, text, reason`` of each line; the reason is null for a comment. Batch or stream."""
    # One-element generators: a line is parsed once.
    parsed = lines.select("line", F.explode(F.array(F.try_parse_json("line"))).alias("v"))
    fields = [F.try_variant_get("v", f"$.{f}", "variant").alias(f"_{f}") for f in REQUIRED]
    parsed = parsed.select("line", "v", F.inline(F.array(F.struct(F.schema_of_variant("v").alias("kind"), *fields))))
    reason = F.when(F.col("v").isNull(), "not JSON").when(~F.col("kind").startswith("OBJECT"), "not an object")
    for f in REQUIRED:
        reason = reason.when(F.col(f"_{f}").isNull(), f"{f} missing").when(F.schema_of_variant(f"_{f}") != "STRING", f"{f} not a string")
    return parsed.select("line", *[F.try_variant_get(f"_{f}", "$", "string").alias(f) for f in REQUIRED], reason.alias("reason"))


def stream_comments(lines: DataFrame, out_dir: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Write comments to ``out_dir/accepted`` and other lines to ``out_dir/rejected``."""
    out_dir = out_dir.rstrip("/")

    def split(batch: DataFrame, batch_id: int) -> None:
        rows = checked(batch).persist()
        try:
            rows.where("reason IS NULL").select(*REQUIRED).write.mode("overwrite").parquet(f"{out_dir}/accepted/batch={batch_id}")
            rows.where("reason IS NOT NULL").select("line", "reason").write.mode("overwrite").parquet(f"{out_dir}/rejected/batch={batch_id}")
        finally:
            rows.unpersist()

    return start(lines.writeStream.foreachBatch(split), checkpoint, available_now)


def read_sink(spark: SparkSession, out_dir: str, name: str) -> DataFrame:
    """The rows of ``accepted`` or ``rejected`` so far."""
    schema = {"accepted": ACCEPTED_SCHEMA, "rejected": REJECTED_SCHEMA}[name]
    path = f"{out_dir.rstrip('/')}/{name}"
    empty = spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path).select(*empty.columns) if child_names(spark, path) else empty
