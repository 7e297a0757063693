"""Unique-key load (R7): insert a row only if its key is new; the first wins.

The reference inserts one user at a time and maps the unique-constraint
error to "already registered". In bulk: every incoming row is classified as
``inserted`` (key absent from the table and first incoming row with that
key), ``exists`` (key already stored) or ``duplicate`` (an earlier incoming
row took the key). "First" is the smallest ``order_col``.

Plan: keys are compared by their SHA-256 (so no long text is shuffled or
sorted), a null key by a mark of its own, which makes null keys equal to each
other like the reference's single NULL-equal key. One aggregation over the
keys of both tables (map-side combined) gives, per key, whether it is stored
and its first incoming row. That result is written: both sides of the join
with the incoming rows are then plain tables, and a key that holds very many
rows is split by the skew join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.session import materialize


def load_unique(existing: DataFrame, incoming: DataFrame, key: str, order_col: str) -> DataFrame:
    """``(order_col, status)`` for every incoming row; null keys are equal to each other."""
    def hashed(df: DataFrame, name: str) -> Column:
        return F.coalesce(F.sha2(df[key].cast("string"), 256), F.lit("null")).alias(name)

    ord_type = incoming.schema[order_col].dataType
    keys = incoming.select(hashed(incoming, "_k"), F.lit(0).alias("_stored"), F.col(order_col).alias("_ord")).unionByName(
        existing.select(hashed(existing, "_k"), F.lit(1).alias("_stored"), F.lit(None).cast(ord_type).alias("_ord"))
    )
    per_key = keys.groupBy("_k").agg(F.max("_stored").alias("_exists"), F.min("_ord").alias("_first"))
    per_key = materialize(per_key, "unique-keys")
    tagged = incoming.select(order_col, hashed(incoming, "_k")).join(per_key, "_k")
    status = (
        F.when(F.col("_exists") == 1, F.lit("exists"))
        .when(F.col(order_col) == F.col("_first"), F.lit("inserted"))
        .otherwise(F.lit("duplicate"))
    )
    return tagged.select(order_col, status.alias("status"))
