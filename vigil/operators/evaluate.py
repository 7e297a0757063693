"""Evaluation: pairing (J4), confusion matrix (A4), P/R/F1 (A5), threshold
sweep (R4) and per-word lexicon hits (R5).

Every metric is one aggregation pass with map-side combine; the per-threshold
sweep aggregates once by score value and derives all 101 thresholds from
suffix sums over a 101-row grid, never rescanning the data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import DEFAULT_LEXICON, LABEL_TOXIC, lexicon_word_count


def pair(pred: DataFrame, truth: DataFrame, key: str = "comment_id", check_unique: bool = True) -> DataFrame:
    """Inner equi-join of predictions and truth on ``key``.

    The reference pairs by position, one to one; here by key, so a key that
    repeats on either side is an error. With ``check_unique`` (the default) it
    is raised by the plan itself: the pairs of a key are counted in an
    aggregation by that key, whose partitioning the join has made already.
    """
    met = pred.join(truth, key)
    if not check_unique:
        return met
    others = [c for c in met.columns if c != key]
    one = met.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in others])
    message = F.concat(F.lit(f"duplicate {key}: "), F.col(key).cast("string"))
    checked = F.when(F.col("_n") > 1, F.raise_error(message)).otherwise(F.col(key)).cast(met.schema[key].dataType)
    return one.select(checked.alias(key), *others)


def _binary(c: Column) -> Column:
    return F.coalesce(c.cast("int"), F.lit(0))


def confusion(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Always 2x2: ``(truth, pred, n)`` for the four cells, zeros included."""
    t, p = _binary(F.col(truth)), _binary(F.col(pred))
    cells = pairs.agg(
        F.count_if((t == 0) & (p == 0)).alias("c00"),
        F.count_if((t == 0) & (p == 1)).alias("c01"),
        F.count_if((t == 1) & (p == 0)).alias("c10"),
        F.count_if((t == 1) & (p == 1)).alias("c11"),
    )
    return cells.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(a).cast("bigint").alias("truth"), F.lit(b).cast("bigint").alias("pred"),
                             F.col(f"c{a}{b}").cast("bigint").alias("n"))
                    for a in (0, 1) for b in (0, 1)
                ]
            )
        )
    )


def _ratio(num: Column, den: Column) -> Column:
    """``num / den`` as double, 0 when the denominator is 0 (zero_division=0)."""
    return F.when(den == 0, F.lit(0.0)).otherwise(num.cast("double") / den.cast("double"))


def prf_columns(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    return {
        "precision": _ratio(tp, tp + fp),
        "recall": _ratio(tp, tp + fn),
        "f1": _ratio(2 * tp, 2 * tp + fp + fn),
    }


def prf1(pairs: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Binary precision / recall / F1 for class 1, zero division -> 0, one row."""
    t, p = _binary(F.col(truth)), _binary(F.col(pred))
    counts = pairs.agg(
        F.count_if((t == 1) & (p == 1)).cast("bigint").alias("tp"),
        F.count_if((t == 0) & (p == 1)).cast("bigint").alias("fp"),
        F.count_if((t == 1) & (p == 0)).cast("bigint").alias("fn"),
        F.count_if((t == 0) & (p == 0)).cast("bigint").alias("tn"),
    )
    return counts.withColumns(prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def lexicon_pred(df: DataFrame) -> DataFrame:
    """0/1 prediction from a classified frame (``label``)."""
    return df.withColumn("pred", (F.col("label") == LABEL_TOXIC).cast("int"))


def graded_score(text: str = "text", lexicon: Sequence[str] = DEFAULT_LEXICON) -> Column:
    """Distinct lexicon words present / 10, as a percent in integer tenths (0, 10, ..., 100)."""
    return lexicon_word_count(text, lexicon) * F.lit(10)


def threshold_sweep(scored: DataFrame, score_pct: str = "score_pct", truth: str = "truth") -> DataFrame:
    """P/R/F1 for every threshold 0..100 (predict 1 iff ``score_pct >= threshold``).

    ``score_pct`` is an integer percent (clipped to 0..100). One aggregation
    by score value over the data, then suffix sums over the 101 percent
    values: threshold ``t`` predicts 1 for every score ``>= t``.
    """
    spark = scored.sparkSession
    t = _binary(F.col(truth))
    s = F.least(F.greatest(F.col(score_pct).cast("bigint"), F.lit(0)), F.lit(100))
    by_score = scored.groupBy(s.alias("s")).agg(
        F.count_if(t == 1).cast("bigint").alias("pos"),
        F.count_if(t == 0).cast("bigint").alias("neg"),
    )
    grid = spark.range(0, 101).select(F.col("id").alias("s"))
    filled = grid.join(by_score, "s", "left").na.fill(0, ["pos", "neg"])
    # 101 rows: a window without partition is bounded by construction.
    suffix = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sweep = filled.select(
        F.col("s").alias("threshold"),
        F.sum("pos").over(suffix).cast("bigint").alias("tp"),
        F.sum("neg").over(suffix).cast("bigint").alias("fp"),
        (F.sum("pos").over(everything) - F.sum("pos").over(suffix)).cast("bigint").alias("fn"),
    )
    return sweep.withColumns(prf_columns(F.col("tp"), F.col("fp"), F.col("fn")))


def lexicon_hits(docs: DataFrame, lexicon: Sequence[str] = DEFAULT_LEXICON, text: str = "text") -> DataFrame:
    """Documents per lexicon word: as a substring (what fires) and as a whole word.

    One pass over the documents with one ``count_if`` pair per word, then
    the single result row is turned into one row per word.
    """
    low = F.col("_low")
    aggs = []
    for i, w in enumerate(lexicon):
        whole = "(?<![A-Za-z0-9_])" + _re_escape(w.lower()) + "(?![A-Za-z0-9_])"
        sub = low.contains(w.lower())
        aggs.append(F.count_if(sub).cast("bigint").alias(f"s{i}"))
        # The regex runs only on texts that hold the word at all.
        aggs.append(F.count_if(sub & low.rlike(whole)).cast("bigint").alias(f"w{i}"))
    row = docs.select(F.lower(F.col(text)).alias("_low")).agg(*aggs)
    return row.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(w).alias("word"), F.col(f"s{i}").alias("substring_docs"),
                             F.col(f"w{i}").alias("word_docs"))
                    for i, w in enumerate(lexicon)
                ]
            )
        )
    )


def _re_escape(w: str) -> str:
    return "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in w)
