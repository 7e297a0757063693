"""Lexicon classification (P1), flag filter (P2), queue projection.

``classify`` is a narrow projection: no shuffle, one pass, inside codegen.
It is one :data:`Scorer`; ``graded`` and a fitted Spark ML model
(``operators.train.model_scorer``) are others. The gate, the page scan
(``pages.scan_pages``) and the queue (``scored_flags`` into ``replay.replay``
or ``replay.advance``) take any of them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import (
    CONFIDENCE_CLEAN,
    CONFIDENCE_TOXIC,
    DEFAULT_LEXICON,
    LABEL_CLEAN,
    LABEL_TOXIC,
    lexicon_hit,
)

#: ``df`` with a ``text`` -> the same rows and columns, with ``label`` and ``confidence`` (0 to 1).
Scorer = Callable[[DataFrame], DataFrame]
GRADED_BASE, GRADED_STEP = 75, 5


def classify(df: DataFrame, lexicon: Sequence[str] = DEFAULT_LEXICON, text_col: str = "text") -> DataFrame:
    """Echo every input column and add ``label`` and ``confidence``.

    The lexicon hit is computed once per row and ``label``/``confidence``
    come out of a one-element ``inline``. As plain projections they would be
    substituted into any filter on them (``flagged``, ``gate``, search), and
    Catalyst would push that filter, with the whole lexicon, below an earlier
    repartition into the scan task and evaluate the lexicon again for the
    output. A filter on generator output stays above the generator.
    """
    hit = lexicon_hit(text_col, lexicon)
    toxic = F.struct(F.lit(LABEL_TOXIC).alias("label"), F.lit(CONFIDENCE_TOXIC).cast("double").alias("confidence"))
    clean = F.struct(F.lit(LABEL_CLEAN).alias("label"), F.lit(CONFIDENCE_CLEAN).cast("double").alias("confidence"))
    return df.select(*[F.col(c) for c in df.columns], F.inline(F.array(F.when(hit, toxic).otherwise(clean))))


def graded(df: DataFrame, lexicon: Sequence[str] = DEFAULT_LEXICON, text_col: str = "text") -> DataFrame:
    """A scorer whose confidence grows with the number of different words met: 0.75, and 0.05 for each, at most 1.

    The label is that of :func:`classify`; a clean text has 0.75. A null text is clean.
    """
    low = F.lower(F.col(text_col))
    met = sum((F.when(low.contains(w), 1).otherwise(0) for w in lexicon), F.lit(0))
    rows = df.select(*[F.col(c) for c in df.columns], F.inline(F.array(F.struct(met.alias("_met")))))
    confidence = F.least(F.lit(GRADED_BASE) + F.lit(GRADED_STEP) * F.col("_met"), F.lit(100)).cast("double") / F.lit(100.0)
    label = F.when(F.col("_met") > 0, F.lit(LABEL_TOXIC)).otherwise(F.lit(LABEL_CLEAN))
    return rows.select(*[F.col(c) for c in df.columns], label.alias("label"), confidence.alias("confidence"))


def toxic_flags(df: DataFrame, key: str, lexicon: Sequence[str] = DEFAULT_LEXICON, text_col: str = "text") -> DataFrame:
    """``(key, toxic BOOLEAN)``: classify once per text, carry only the key.

    Used by the replay so the wide ``text`` column never enters a shuffle.
    """
    return df.select(key, lexicon_hit(text_col, lexicon).alias("toxic"))


def scored_flags(df: DataFrame, scorer: Scorer, key: str, threshold: float = 0.0) -> DataFrame:
    """``(key, toxic, confidence)`` by any scorer: ``df (key, text)`` -> the same rows with ``label, confidence``.

    Toxic is what the scorer calls so with ``threshold`` or more; the confidence goes into the queue.
    """
    scored = scorer(df.select(key, "text"))
    toxic = (F.col("label") == LABEL_TOXIC) & (F.col("confidence") >= F.lit(threshold))
    return scored.select(key, F.coalesce(toxic, F.lit(False)).alias("toxic"), F.col("confidence").cast("double").alias("confidence"))


def flagged(df: DataFrame) -> DataFrame:
    """Only rows the classifier calls toxic go to the queue."""
    return df.where(F.col("label") == LABEL_TOXIC)


def queue_view(df: DataFrame) -> DataFrame:
    """``comment_id, text, label, confidence`` with the constant queue label."""
    return df.select("comment_id", "text", F.lit(LABEL_TOXIC).alias("label"), F.col("confidence").cast("double"))
