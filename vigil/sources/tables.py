"""Readers for the driver's parquet tables and their binding to our inputs.

Every reader selects only the columns it needs so the scan's ReadSchema is
pruned; filters written downstream are pushed into the parquet scan by
Catalyst.

Bindings (how the generic test tables stand in for the moderation inputs):

* comments           documents: ``cast(doc_id as string), text``
* user turns         conversations where role = 'user':
                     ``concat(conv_id, '_', turn), text``
* operation log      events: ``comment_id = 't1_' || user_id``, ``seq = event_id``,
                     ``view``/``signup`` -> detect, ``click`` -> delete,
                     ``purchase`` -> approved, ``error`` -> rejected; the detected
                     text is the document ``event_id % count(documents)``
* labelled examples  documents JOIN labels USING (doc_id): ``text, toxic``
* loss steps         events: ``epoch = event_id % 3 + 1``,
                     ``batch = floor(event_id / 24)``, ``loss = value``
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# --- Fixed values: the event-type -> operation binding of the test log -------
EVENT_OPS = {
    "view": "detect",
    "signup": "detect",
    "click": "delete",
    "purchase": "approved",
    "error": "rejected",
}
# -----------------------------------------------------------------------------


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


# Declared schemas of the tables the queries read. A declared schema needs no
# footer read at planning time (Spark otherwise runs a schema job per read) and
# cannot drift with the files.
SCHEMAS = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "pages": "page_id bigint, url string, html string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None = None) -> DataFrame:
    reader = spark.read.schema(SCHEMAS[name]) if name in SCHEMAS else spark.read
    df = reader.parquet(table_path(sf_dir, name))
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents", ["doc_id", "text"])


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(comment_id STRING, text STRING)`` from documents."""
    return documents(spark, sf_dir).select(
        F.col("doc_id").cast("string").alias("comment_id"), "text"
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second comment set: every turn of the conversations."""
    conv = read_table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    return conv.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("comment_id"), "text"
    )


def _op_expr(event_type: Column) -> Column:
    expr = None
    for et, op in EVENT_OPS.items():
        expr = F.when(event_type == et, op) if expr is None else expr.when(event_type == et, op)
    return expr.otherwise(event_type)


def operation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(seq, ts, comment_id, op, doc_id)`` from events.

    ``doc_id`` uses a scalar subquery for ``count(documents)``, so the plan
    stays lazy and the count is answered from parquet footers.
    """
    ev = read_table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"])
    n_docs = documents(spark, sf_dir).select(F.count(F.lit(1))).scalar()
    return ev.select(
        F.col("event_id").alias("seq"),
        F.col("ts"),
        F.concat(F.lit("t1_"), F.col("user_id").cast("string")).alias("comment_id"),
        _op_expr(F.col("event_type")).alias("op"),
        F.pmod(F.col("event_id"), n_docs).alias("doc_id"),
    )


def labelled_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(clean_text, Label, ord)`` with input order ``ord = doc_id``."""
    docs = documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return docs.join(labels, "doc_id").select(
        F.col("text").alias("clean_text"),
        F.col("toxic").cast("int").alias("Label"),
        F.col("doc_id").alias("ord"),
    )


def scored_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(comment_id, doc_id, text, truth)``: labelled documents with their ground truth."""
    docs = documents(spark, sf_dir)
    labels = read_table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").cast("string").alias("comment_id"),
        "doc_id",
        "text",
        F.col("toxic").cast("int").alias("truth"),
    )


def loss_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(epoch INT, batch BIGINT, loss DOUBLE)`` per training sample from events."""
    ev = read_table(spark, sf_dir, "events", ["event_id", "value"])
    return ev.select(
        (F.pmod(F.col("event_id"), F.lit(3)) + 1).cast("int").alias("epoch"),
        F.floor(F.col("event_id") / 24).cast("bigint").alias("batch"),
        F.col("value").alias("loss"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages", ["page_id", "url", "html"])
