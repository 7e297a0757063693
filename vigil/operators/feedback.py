"""Moderator feedback -> training set.

The reference runs one SQL ``DISTINCT ON`` in Postgres and then pandas in
one process. Here every step is an aggregation with map-side combine, so a
comment or a text that holds a third of the rows still spreads over all
tasks before the final merge:

* latest feedback per comment   ``max(struct(null-first ts, ts, id, ...))``
* distinct examples             by ``(sha2(clean_text), Label)``, keeping the
                                first comment id as input order
* keep-first merge on the text  ``min(struct(src, ord, Label, ...))`` per
  ``sha2(clean_text)`` (original rows before feedback, then input order) --
  not ``dropDuplicates``, which keeps an arbitrary row.

A maximum over a struct is a sort aggregate in Spark; what it sorts are the
comment ids or 64-character hashes, never the texts, which only ride along.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.operators.replay import attach_text
from vigil.session import materialize
from vigil.sources.csvio import write_labelled

# --- Fixed values: action -> training label ----------------------------------
LABEL_OF_ACTION = {"approved": 1, "rejected": 0}
# -----------------------------------------------------------------------------
FEEDBACK_ACTIONS = tuple(LABEL_OF_ACTION)
SHUFFLE_SEED = 42
_ORD_WIDTH = 20


def _label(action: Column) -> Column:
    mapped = F.create_map(*[F.lit(x) for pair in LABEL_OF_ACTION.items() for x in pair])
    return mapped[action].cast("int")


def _text_key(c: Column) -> Column:
    """The text's hash; null texts are equal to each other."""
    return F.coalesce(F.sha2(c, 256), F.lit("null"))


def valid_feedback(actions: DataFrame) -> DataFrame:
    """Only approve/reject decisions train; other action strings are kept but ignored."""
    return actions.where(F.col("action").isin(*FEEDBACK_ACTIONS))


def latest_feedback(actions: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """``DISTINCT ON (comment_id) ... ORDER BY comment_id, timestamp DESC``.

    Filter first; a null timestamp sorts first under ``DESC`` in Postgres and
    therefore wins; ties on the timestamp go to the larger ``id``.
    Output ``comment_id, text, action``.

    With ``texts`` (``doc_id, text``) the actions carry ``doc_id`` instead of
    text: no text is shuffled, and it is attached to the winners only.
    """
    fb = valid_feedback(actions)
    code = _label(F.col("action"))
    if texts is not None:
        key = F.struct(
            F.col("timestamp").isNull().alias("n"), F.col("timestamp").alias("ts"), F.col("id").alias("id"),
            F.col("doc_id").alias("doc_id"), code.alias("a"),
        )
        best = fb.groupBy("comment_id").agg(F.max(key).alias("b")).select(
            "comment_id", F.col("b.doc_id").alias("doc_id"),
            F.when(F.col("b.a") == 1, F.lit("approved")).otherwise(F.lit("rejected")).alias("action"),
        )
        return attach_text(best, texts).select("comment_id", "text", "action")
    key = F.struct(
        F.col("timestamp").isNull().alias("n"),
        F.col("timestamp").alias("ts"),
        F.col("id").alias("id"),
        F.col("text").alias("text"),
        F.col("action").alias("action"),
    )
    best = fb.groupBy("comment_id").agg(F.max(key).alias("b"))
    return best.select("comment_id", F.col("b.text").alias("text"), F.col("b.action").alias("action"))


def to_examples(latest: DataFrame) -> DataFrame:
    """Map action -> Label, rename text -> clean_text, drop nulls, distinct.

    Keeps ``ord`` = the first comment id of each distinct example (the input
    order pandas would see), for the keep-first merge.
    """
    ex = latest.select(F.col("text").alias("clean_text"), _label(F.col("action")).alias("Label"), "comment_id")
    ex = ex.na.drop("any", subset=["clean_text", "Label"])
    first = F.min(F.struct(F.col("comment_id").alias("ord"), F.col("clean_text").alias("clean_text"))).alias("f")
    per = ex.groupBy(_text_key(F.col("clean_text")).alias("_k"), "Label").agg(first)
    return per.select("f.clean_text", "Label", "f.ord")


def concat_examples(original: DataFrame, feedback: DataFrame) -> DataFrame:
    """Original rows (``src`` 0, ``ord`` zero-padded) then feedback (``src`` 1), by name."""
    o = original.select(
        "clean_text", F.col("Label").cast("int").alias("Label"),
        F.lit(0).alias("src"), F.lpad(F.col("ord").cast("string"), _ORD_WIDTH, "0").alias("ord"),
    )
    f = feedback.select(
        "clean_text", F.col("Label").cast("int").alias("Label"),
        F.lit(1).alias("src"), F.col("ord").cast("string").alias("ord"),
    )
    return o.unionByName(f, allowMissingColumns=True)


def _first_of_text(both: DataFrame) -> DataFrame:
    """``clean_text, Label, n_original``: the first row per text, and how many original rows have it."""
    first = F.min(F.struct("src", "ord", "Label", "clean_text")).alias("f")
    per = both.groupBy(_text_key(F.col("clean_text")).alias("_k")).agg(first, F.count_if(F.col("src") == 0).alias("n_original"))
    return per.select("f.clean_text", "f.Label", "n_original")


def merge_dedupe(original: DataFrame, feedback: DataFrame) -> DataFrame:
    """Keep the first row per ``clean_text`` (original wins, then input order; nulls equal)."""
    return _first_of_text(concat_examples(original, feedback)).drop("n_original")


def seeded_shuffle(df: DataFrame, seed: int = SHUFFLE_SEED) -> DataFrame:
    """Repeatable shuffle: a distributed range sort by ``shuffle_key``, a seeded hash of the text.

    Only the key is sampled and compared, never a text; rows of one text are told apart by ``Label``.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("clean_text"), F.lit(""))))
    return df.withColumn("shuffle_key", key).orderBy("shuffle_key", "Label")


STAGES = ("feedback", "examples", "original", "merged")


def write_training_set(latest: DataFrame, original: DataFrame, path: str, fmt: str = "csv") -> dict[str, int]:
    """Merge latest feedback with the original set and write it; returns the rows of each stage.

    Each stage is computed once and written; feedback, examples and the merged set are then counted from the
    files' footers, and the merge itself notes how many original rows met in each text. (``Observation`` would
    count in passing too, but its manager makes the session's ML models unserialisable in this Spark.) Without any
    feedback it warns and writes nothing, as the reference does.
    """
    latest = materialize(latest, "latest-feedback")
    examples = materialize(to_examples(latest), "training-examples")
    merged = materialize(_first_of_text(concat_examples(original, examples)), "merged-set")
    met = merged.agg(F.coalesce(F.sum("n_original"), F.lit(0)).alias("o"), F.count(F.lit(1)).alias("m")).first()
    counts = dict(zip(STAGES, (latest.count(), examples.count(), met.o, met.m), strict=True))
    if counts["feedback"]:
        write_labelled(merged, path, fmt)
    else:
        warnings.warn("no moderator feedback: the training set is not written", stacklevel=2)
    return counts


def merge_stats(latest: DataFrame, original: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """:func:`write_training_set`, its counts as ``(stage, n)``; ``feedback`` 0 means nothing is written."""
    counts = write_training_set(latest, original, path, fmt)
    return latest.sparkSession.createDataFrame([(s, counts[s]) for s in STAGES], "stage string, n long")


def flag_precision(actions: DataFrame) -> DataFrame:
    """Per day: approved / (approved + rejected) -- how often a flag was right."""
    fb = valid_feedback(actions).where(F.col("timestamp").isNotNull())
    per_day = fb.groupBy(F.date_format("timestamp", "yyyy-MM-dd").alias("day")).agg(
        F.count_if(F.col("action") == "approved").cast("bigint").alias("approved"),
        F.count_if(F.col("action") == "rejected").cast("bigint").alias("rejected"),
    )
    return per_day.withColumn(
        "precision", F.col("approved").cast("double") / (F.col("approved") + F.col("rejected")).cast("double")
    )


def feedback_conflicts(original: DataFrame, examples: DataFrame) -> DataFrame:
    """Feedback examples the merge drops because the original holds the text with another label."""
    o = original.select(_text_key(F.col("clean_text")).alias("_k"), F.col("Label").cast("int").alias("orig_label")).distinct()
    # Feedback is small next to the labelled set: written once, its size is known when the join
    # is planned (a broadcast when under the threshold). The labelled side is hashes, not texts.
    f = examples.where("clean_text IS NOT NULL").select(
        "clean_text", F.col("Label").cast("int").alias("feedback_label"), _text_key(F.col("clean_text")).alias("_k")
    )
    f = materialize(f, "feedback-examples")
    hit = f.join(o, "_k").where(F.col("orig_label") != F.col("feedback_label"))
    return hit.dropDuplicates(["_k", "feedback_label", "orig_label"]).select("clean_text", "feedback_label", "orig_label")
