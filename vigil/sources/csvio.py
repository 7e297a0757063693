"""Labelled CSV in and out (S2, S3) and the moderator-actions table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABELLED_SCHEMA = T.StructType(
    [T.StructField("clean_text", T.StringType()), T.StructField("Label", T.IntegerType())]
)

ACTIONS_SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("comment_id", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("timestamp", T.TimestampNTZType()),
    ]
)

# --- Fixed values: strings pandas.read_csv turns into missing values ---------
PANDAS_NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# -----------------------------------------------------------------------------


def read_labelled_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header CSV with quoted multi-line fields; pandas' NA tokens become null.

    Columns are taken by name from the header, in any order and among others;
    exactly one column is the label, whatever its case (Q13). A whole number
    may be written as a float (``1.0``, as pandas does once the column had a
    gap); any other ``Label`` becomes null, like a failed parse.
    """
    raw = (
        spark.read.option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .option("mode", "PERMISSIVE")
        .csv(path)
    )
    labels = [c for c in raw.columns if c.strip().lower() == "label"]
    if "clean_text" not in raw.columns or len(labels) != 1:
        raise ValueError(f"need clean_text and one Label column, found {raw.columns}")
    text, label = F.col("clean_text"), F.col(f"`{labels[0]}`")
    number = F.trim(label).try_cast("double")
    return raw.select(
        F.when(text.isin(*PANDAS_NA_TOKENS), F.lit(None)).otherwise(text).alias("clean_text"),
        F.when(~label.isin(*PANDAS_NA_TOKENS) & (number == F.floor(number)), number.cast("int")).alias("Label"),
    )


def write_labelled(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """Write the training set as a directory (never coalesced to one file); texts keep their padding."""
    w = df.select("clean_text", "Label").write.mode(mode)
    if fmt == "csv":
        keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        w.options(header=True, escape='"', quoteAll=False, **keep).csv(path)
    else:
        w.parquet(path)


def action_key(comment_id: str = "comment_id", ts: str = "timestamp", seq: str = "id") -> Column:
    """The surrogate key of an action: a hash of the comment, the time and the place in the log (a null is empty)."""
    time = F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.sha2(F.concat_ws("|", *[F.coalesce(c, F.lit("")) for c in (F.col(comment_id), time, F.col(seq).cast("string"))]), 256)


def read_actions(spark: SparkSession, path: str) -> DataFrame:
    """Scan the moderator-actions table with its declared schema.

    Filters on ``action`` and ``action_date`` are pushed to the scan (and
    prune partitions for the date).
    """
    more = [T.StructField("action_key", T.StringType()), T.StructField("action_date", T.DateType()), T.StructField("batch", T.StringType())]
    return spark.read.schema(T.StructType([*ACTIONS_SCHEMA.fields, *more])).parquet(path)


def append_actions(df: DataFrame, path: str, batch: str) -> None:
    """Append actions by day under the name of their ``batch``; the same batch again leaves the table as it is.

    A batch's rows lie in folders of its own below each day. A retry, after a failure or not, replaces these
    folders and no others; Spark puts them in place when the whole job has succeeded. ``action_key`` is the
    same in every run, unlike a number that is counted up. The table is made if it is missing.

    Rows are dealt by ``(day, id)`` ranges first: a task writes a few neighbouring days, so the
    files are about as many as tasks and days, and a day with most rows is cut over many tasks.
    """
    out = df.select(*[f.name for f in ACTIONS_SCHEMA.fields]).withColumns(
        {"action_key": action_key(), "action_date": F.to_date("timestamp"), "batch": F.lit(batch)}
    )
    writer = out.repartitionByRange("action_date", "id").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("action_date", "batch").parquet(path)
