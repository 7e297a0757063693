"""Training progress and report (A6, A7, A9, W3-W5, S6 parsing).

The reference prints one JSON object per line while it trains (summary,
training_started, progress, confusion_matrix, epoch_end, model_saved,
complete) and the dashboard folds that stream into a report. Here:

* the per-step numbers are aggregations over a loss-step table
  ``(epoch, batch, loss)``: batch means, then the mean of batch means per
  epoch (a short last batch weighs as much as a full one);
* progress ticks ``int(step / total * 100)`` are emitted only when they grow;
  the value never decreases with the step, so the ticks are the first step
  of each distinct value -- a ``min`` per value, no global window;
* "model saved" is a strict best-so-far over (a handful of) epoch rows;
* log lines are stripped and parsed with ``from_json`` into one wide nullable
  struct; anything that is not a JSON object, a blank line too, is a ``raw`` line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.text import js_trim

# --- Fixed values: hyper-parameters reported by the reference's trainer ------
EPOCHS = 3
BATCH_SIZE = 8
# -----------------------------------------------------------------------------

LOG_SCHEMA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("epochs", T.LongType()),
        T.StructField("batch_size", T.LongType()),
        T.StructField("total_steps", T.LongType()),
        T.StructField("device", T.StringType()),
        T.StructField("epoch", T.LongType()),
        T.StructField("step", T.LongType()),
        T.StructField("progress", T.LongType()),
        T.StructField("avg_loss", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("best_f1", T.DoubleType()),
        T.StructField("matrix", T.ArrayType(T.ArrayType(T.LongType()))),
        T.StructField("line", T.StringType()),
    ]
)


def avg_loss(steps: DataFrame) -> DataFrame:
    """``epoch, avg_loss, n_batches``: mean of batch means, rounded to 4 places."""
    per_batch = steps.groupBy("epoch", "batch").agg(F.avg("loss").alias("m"))
    return per_batch.groupBy("epoch").agg(
        F.round(F.avg("m"), 4).alias("avg_loss"), F.count(F.lit(1)).cast("bigint").alias("n_batches")
    )


def total_steps(n_rows: Column, epochs: int = EPOCHS, batch_size: int = BATCH_SIZE) -> Column:
    """``epochs * ceil(n / batch_size)``; zero rows is an error in the reference (Q19)."""
    return (F.lit(epochs) * F.ceil(n_rows / F.lit(batch_size))).cast("bigint")


def step_budget(train: DataFrame, epochs: int = EPOCHS, batch_size: int = BATCH_SIZE) -> DataFrame:
    """One row ``n_train, epochs, batch_size, steps_per_epoch, total_steps`` for a training set."""
    n = train.agg(F.count(F.lit(1)).cast("bigint").alias("n_train"))
    return n.select(
        "n_train",
        F.lit(epochs).cast("bigint").alias("epochs"),
        F.lit(batch_size).cast("bigint").alias("batch_size"),
        F.ceil(F.col("n_train") / F.lit(batch_size)).cast("bigint").alias("steps_per_epoch"),
        total_steps(F.col("n_train"), epochs, batch_size).alias("total_steps"),
    )


def global_steps(steps: DataFrame) -> DataFrame:
    """Distinct ``(epoch, batch)`` with ``step = (epoch - 1) * n_batches + batch + 1`` and ``total``.

    ``n_batches`` and the epoch count are scalar subqueries (one-row
    aggregates), so every row is numbered without a global window.
    """
    n_batches = steps.select((F.max("batch") + 1).cast("bigint")).scalar()
    n_epochs = steps.select(F.max("epoch").cast("bigint")).scalar()
    batches = steps.select("epoch", "batch").distinct()
    return batches.select(
        F.col("epoch").cast("bigint").alias("epoch"),
        "batch",
        ((F.col("epoch") - 1) * n_batches + F.col("batch") + 1).cast("bigint").alias("step"),
        (n_epochs * n_batches).cast("bigint").alias("total"),
    )


def progress_value(step: Column, total: Column) -> Column:
    """Python ``int(step / total * 100)`` in double arithmetic (29/100 -> 28)."""
    return F.floor((step.cast("double") / total.cast("double")) * F.lit(100.0)).cast("bigint")


def progress_ticks(steps: DataFrame) -> DataFrame:
    """``epoch, step, progress``: the steps at which the integer percent grows."""
    g = global_steps(steps).withColumn("progress", progress_value(F.col("step"), F.col("total")))
    first = g.groupBy("progress").agg(F.min(F.struct("step", "epoch")).alias("f"))
    return first.select(F.col("f.epoch").alias("epoch"), F.col("f.step").alias("step"), "progress")


def model_saved(epochs: DataFrame) -> DataFrame:
    """``epoch, f1, saved``: saved iff f1 beats every earlier epoch and 0.0, strictly.

    ``epochs`` has one row per epoch (a handful), so the running max over
    the whole frame is bounded by the epoch count.
    """
    before = Window.orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)
    best = F.coalesce(F.max("f1").over(before), F.lit(0.0))
    return epochs.select("epoch", "f1", (F.col("f1") > F.greatest(best, F.lit(0.0))).alias("saved"))


# --- log lines ------------------------------------------------------------------


def _obj(*pairs: tuple[str, Column]) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in pairs]))


def epoch_lines(epochs: DataFrame, first: Column) -> DataFrame:
    """``(line_no, line)`` of a finished training run, a few for each epoch.

    ``epochs``: ``epoch, avg_loss, f1, saved, tn, fp, fn, tp``, a row for each epoch of a fit;
    ``first`` is the number of the first line.
    """
    kind = lambda name: ("type", F.lit(name))
    matrix = F.array(F.array("tn", "fp"), F.array("fn", "tp"))
    rounded = F.round("f1", 4)
    own = F.array(
        F.when(F.col("epoch") == 1, _obj(kind("training_started"))),
        _obj(kind("confusion_matrix"), ("matrix", matrix)),
        _obj(kind("epoch_end"), ("epoch", F.col("epoch")), ("avg_loss", F.round("avg_loss", 4)), ("f1", rounded)),
        F.when(F.col("saved"), _obj(kind("model_saved"), ("f1", rounded))),
    )
    best = epochs.select(F.coalesce(F.max(F.when(F.col("saved"), F.col("f1"))), F.lit(0.0))).scalar()
    last = epochs.select(F.max("epoch")).scalar()
    end = F.when(F.col("epoch") == last, F.array(_obj(kind("complete"), ("best_f1", F.round(best, 4))))).otherwise(F.array().cast("array<string>"))
    lines = epochs.select("epoch", F.posexplode(F.concat(own, end)).alias("k", "line")).where("line IS NOT NULL")
    return lines.select((first + F.col("epoch") * 5 + F.col("k")).cast("bigint").alias("line_no"), "line")


def parse_train_log(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """Typed events: JSON objects by their fields, anything else ``type = 'raw'``.

    ``json_object_keys`` is null for text that is not a JSON object (garbage,
    numbers, arrays), which is exactly when the reference falls back to raw.
    """
    # One-element generators: the line is trimmed, tested and parsed once, not once a field.
    one = lines.select("line_no", F.explode(F.array(js_trim(F.col(line_col)))).alias("raw"))
    parsed = F.when(F.json_object_keys("raw").isNotNull(), F.from_json("raw", LOG_SCHEMA))
    ev = one.select("line_no", "raw", F.explode(F.array(parsed)).alias("ev"))
    is_obj, m = F.col("ev").isNotNull(), F.col("ev.matrix")
    return ev.select(
        "line_no",
        F.when(is_obj, F.col("ev.type")).otherwise(F.lit("raw")).alias("type"),
        *[F.col(f"ev.{c}").alias(c) for c in
          ("epochs", "batch_size", "total_steps", "device", "epoch", "step", "progress", "avg_loss", "f1", "best_f1")],
        m[0][0].alias("cm_tn"),
        m[0][1].alias("cm_fp"),
        m[1][0].alias("cm_fn"),
        m[1][1].alias("cm_tp"),
        F.when(~is_obj, F.col("raw")).alias("raw_line"),
    )


def _upto_complete(events: DataFrame) -> DataFrame:
    """The dashboard closes the stream at the first ``complete``: later lines never count."""
    stop = events.where(F.col("type") == "complete").select(F.min("line_no")).scalar()
    return events.where(stop.isNull() | (F.col("line_no") <= stop))


def report_state(events: DataFrame) -> DataFrame:
    """The fold of some events as one row, with the line numbers that a later merge needs."""
    ev = _upto_complete(events)
    at = lambda kind: F.when(F.col("type") == kind, F.col("line_no"))
    return ev.agg(
        F.coalesce(F.max(F.col("type") == "training_started"), F.lit(False)).alias("started"),
        F.coalesce(F.max(F.col("type") == "complete"), F.lit(False)).alias("complete"),
        F.max_by(F.col("progress"), at("progress")).alias("last_progress"),
        F.max_by(F.col("f1"), at("model_saved")).alias("best_f1"),
        F.count_if(F.col("type") == "epoch_end").cast("bigint").alias("epochs_reported"),
    )


def merge_states(states: DataFrame) -> DataFrame:
    """Two states ``(..., turn)``, turn 1 after turn 0, as one; nothing counts after a ``complete``."""
    old = states.where("turn = 0").select(F.col("complete")).scalar()
    counts = states.where((F.col("turn") == 0) | ~old)
    turn = lambda c: F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("turn")))
    return counts.agg(
        F.max("started").alias("started"), F.max("complete").alias("complete"), turn("last_progress").alias("last_progress"),
        turn("best_f1").alias("best_f1"), F.sum("epochs_reported").cast("bigint").alias("epochs_reported"),
    )


def report_of(state: DataFrame) -> DataFrame:
    """``started, progress, best_f1, epochs_reported, complete`` (the dashboard state) of a one-row state."""
    hundred = F.lit(100).cast("bigint")
    progress = F.when(F.col("complete"), hundred).otherwise(F.coalesce("last_progress", F.lit(0).cast("bigint")))
    return state.select("started", progress.alias("progress"), "best_f1", "epochs_reported", "complete")


def train_report(events: DataFrame) -> DataFrame:
    """One row: ``started, progress, best_f1, epochs_reported, complete`` (the dashboard state)."""
    return report_of(report_state(events))


def train_epochs(events: DataFrame) -> DataFrame:
    """The report table: one row per ``epoch_end`` line, in line order."""
    ev = _upto_complete(events).where(F.col("type") == "epoch_end")
    return ev.select("line_no", "epoch", "avg_loss", "f1").orderBy("line_no")
