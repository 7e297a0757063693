"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Two texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. Each level is a count over narrow rows (never text), combined on the map
side, and only rows whose key another row shares go on to the next level:

1. rows that share the normalised length in bytes,
2. of these, rows that share the hash of the first ``PREFIX_CHARS`` normalised characters,
3. of these, rows that share the SHA-256 of the whole normalised text.

A row that leaves at level 1 or 2 is a group of its own. Of a group, the row with the most code
points in the original text stays, then the one with the smallest ``doc_id``.

Defined results: a null text counts as empty, and all texts without other characters are one group.
A null ``doc_id`` ranks after every other id; its group is found like any other. Rows that repeat
as a whole are members of one group each, so ``group_size`` counts them, and every row with the
group's ``keep_id`` says ``kept`` in :func:`exact_groups`; :func:`drop_copies` leaves one row of
them. An empty table gives an empty result. Columns beside ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import drop_rows, materialize, same, whole_text

#: Fixed value: the characters that do not count.
SPACE = r"[\x20\x09-\x0D]"
#: Characters of the normalised text that level 2 hashes.
PREFIX_CHARS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, SPACE, "")


def _narrow(docs: DataFrame, *more: Column) -> DataFrame:
    """One pass over the texts, ``t``; what is shuffled later is about 60 bytes a row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("t"))
    # One-element generator: the normalised text is computed once a row, not once a use.
    base = base.select("doc_id", F.char_length("t").alias("n_cp"), *more, F.explode(F.array(normalised(F.col("t")))).alias("norm"))
    return base.select(
        *base.drop("norm").columns,
        F.octet_length("norm").alias("n_bytes"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash"),
        F.sha2("norm", 256).alias("text_sha256"),
    )


def _levels(docs: DataFrame, *more: Column) -> tuple[DataFrame, DataFrame]:
    """All narrow rows, and those that share length and prefix hash with another."""
    rows = materialize(_narrow(docs, *more), "exact-rows")
    # Key sets are written first: both sides of each join are plain tables, so the rows of a hot
    # length or prefix are split by the skew join.
    by_length = materialize(rows.groupBy("n_bytes").count().where("count > 1").select("n_bytes"), "exact-lengths")
    level1 = rows.join(by_length, "n_bytes", "left_semi")
    by_prefix = level1.groupBy("n_bytes", "prefix_hash").count().where("count > 1").select("n_bytes", "prefix_hash")
    by_prefix = materialize(by_prefix, "exact-prefixes")
    return rows, rows.join(by_prefix, ["n_bytes", "prefix_hash"], "left_semi")


def exact_groups(docs: DataFrame) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row for each row of ``docs``."""
    rows, level2 = _levels(docs)
    # Per text: fixed-width aggregates, combined before the shuffle, so a text with a third of
    # all rows is a few rows by then. First by code points, then the longest form's smallest id.
    forms = level2.groupBy("text_sha256", "n_cp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n"))
    best = F.max(F.struct("n_cp", "low")).alias("best")
    groups = forms.groupBy("text_sha256").agg(best, F.sum("n").alias("size")).where("size > 1")
    groups = materialize(
        groups.select("text_sha256", F.col("best.low").alias("g_keep"), F.col("best.n_cp").alias("g_cp"), "size"),
        "exact-groups",
    )
    out = rows.join(groups, "text_sha256", "left")
    alone = F.col("size").isNull()
    return out.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("g_keep")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (same(F.col("doc_id"), F.col("g_keep")) & (F.col("n_cp") == F.col("g_cp")))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group, all columns as they came.

    Texts are normalised and hashed once. A row that goes is named by its id, its code points and a 64-bit hash
    of its text as it stands; of rows with the same name one stays.
    """
    rows, level2 = _levels(docs, F.xxhash64("t").alias("text_hash"))
    name = ["doc_id", "n_cp", "text_hash"]
    forms = level2.groupBy("text_sha256", *name).agg(F.count("*").alias("n"))
    order = F.struct((-F.col("n_cp")).alias("short"), F.col("doc_id").isNull().alias("none"), *name, "n")
    best = forms.groupBy("text_sha256").agg(F.min(order).alias("best"), F.sum("n").alias("size")).where("size > 1")
    best = materialize(best.select("text_sha256", "best"), "exact-groups")
    is_best = [same(F.col(c), F.col(f"best.{c}")) for c in name]
    gone = rows.join(best, "text_sha256").where(~(is_best[0] & is_best[1] & is_best[2])).select(*name).distinct()
    again = best.where("best.n > 1").select("best.*").select(*name)
    key = {"doc_id": F.col("doc_id").cast("long"), "n_cp": F.char_length(whole_text()), "text_hash": F.xxhash64(whole_text())}
    return drop_rows(docs, key, materialize(gone, "exact-gone"), materialize(again, "exact-again"))
