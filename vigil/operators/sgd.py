"""M3: epochs that go on from each other: mini-batch gradient steps over hashed words.

Texts become sets of word hashes (``FEATURES`` places); rows are dealt into mini-batches by a hash of the text and
written by batch, so a step reads its own batch only. A step is one Spark job: each task sums the gradient of its
rows, ``groupBy`` adds the tasks' sums, and the driver, which holds one weight a place, moves the weights (steps
scaled by the gradients so far). Weights go on from step to step and from epoch to epoch, so every epoch costs the
same. An epoch's loss is the mean of its batch means (A6); its model is judged by the validation F1 and kept if
that beats all before (W3).

Memory: the driver and each task hold ``FEATURES`` numbers, whatever the vocabulary; a step brings that many sums
to the driver at most. Rows without a text or a label don't train; an empty set is an error (Q19).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import LABEL_CLEAN, LABEL_TOXIC
from vigil.operators.classify import Scorer
from vigil.operators.evaluate import prf1
from vigil.operators.trainlog import EPOCHS, model_saved
from vigil.session import materialize, ship_package

FEATURES = 1 << 16
BATCHES = 10
RATE = 0.05
L2 = 1e-5
_BIAS, _LOSS, _WEIGHT = -1, -2, -3


def places(text: Column, features: int = FEATURES) -> Column:
    """The distinct places of a text's words (letters only, lower case)."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(features)).cast("int")))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(x / 2))  # no overflow at either end


def _margins(idx: list[np.ndarray], weights: np.ndarray, bias: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    row = np.repeat(np.arange(len(idx)), [len(i) for i in idx])
    flat = np.concatenate([*idx, np.zeros(0, np.int64)]).astype(np.int64)
    return bias + np.bincount(row, weights[flat], len(idx)), row, flat


def sums(idx: list[np.ndarray], y: np.ndarray, w: np.ndarray, weights: np.ndarray, bias: float) -> tuple[np.ndarray, float, float]:
    """Of some rows: the summed weighted gradient by place, by bias, and the summed weighted cross-entropy."""
    margin, row, flat = _margins(idx, weights, bias)
    error = w * (_sigmoid(margin) - y)
    loss = w * (np.logaddexp(0, margin) - y * margin)
    return np.bincount(flat, error[row], len(weights)), float(error.sum()), float(loss.sum())


def batch_sums(rows: DataFrame, weights: np.ndarray, bias: float) -> dict[int, float]:
    """:func:`sums` over ``rows (y, w, idx)``: place to sum, and the bias, the loss and the weight under negative keys."""
    shared = rows.sparkSession.sparkContext.broadcast((weights, bias))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, own_bias = shared.value
        total, extra = np.zeros(len(own)), np.zeros(3)
        for b in batches:
            y, w = b["y"].to_numpy(float), b["w"].to_numpy(float)
            g, g_bias, loss = sums(list(b["idx"]), y, w, own, own_bias)
            total += g
            extra += (g_bias, loss, w.sum())
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"place": [*hit, _BIAS, _LOSS, _WEIGHT], "s": [*total[hit], *extra]})

    got = rows.select("y", "w", "idx").mapInPandas(partial, "place long, s double").groupBy("place").agg(F.sum("s").alias("s"))
    return {r.place: r.s for r in got.collect()}  # a row a place at most


@dataclass
class HashedModel:
    weights: np.ndarray
    bias: float

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        """``df`` with ``label, confidence, pred``; a tie goes to class 0, a null text is scored like an empty one."""
        ship_package(df.sparkSession)
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.bias))

        @F.pandas_udf("double")
        def probability(idx: pd.Series) -> pd.Series:
            return pd.Series(_sigmoid(_margins(list(idx), *shared.value)[0]))

        p = probability(places(F.coalesce(F.col(text_col), F.lit("")), len(self.weights)))
        out = df.select(*[F.col(c) for c in df.columns], F.inline(F.array(F.struct(p.alias("_p")))))
        toxic = F.col("_p") > 0.5
        return out.select(
            *[F.col(c) for c in df.columns], F.when(toxic, F.lit(LABEL_TOXIC)).otherwise(F.lit(LABEL_CLEAN)).alias("label"),
            F.greatest(F.col("_p"), 1 - F.col("_p")).alias("confidence"), toxic.cast("int").alias("pred"),
        )

    def scorer(self) -> Scorer:
        return lambda df: self.score(df).drop("pred")


@dataclass
class EpochRun:
    epochs: DataFrame  # epoch, avg_loss, f1, saved, tn, fp, fn, tp
    best: HashedModel | None
    best_f1: float
    models: list[HashedModel]


def fit_epochs(train: DataFrame, val: DataFrame, epochs: int = EPOCHS, batches: int = BATCHES, features: int = FEATURES, rate: float = RATE) -> EpochRun:
    """Train on ``clean_text, Label`` for some epochs; the model with the highest F1 on ``val`` is ``best``."""
    spark = train.sparkSession
    ship_package(spark)
    rows = train.where("clean_text IS NOT NULL AND Label IS NOT NULL")
    counts = rows.agg(F.count_if(F.col("Label") == 1).alias("pos"), F.count("*").alias("n")).first()
    if not counts.n:
        raise ValueError("empty training set")
    heavy = (counts.n - counts.pos) / max(counts.pos, 1) or 1.0  # few positives weigh as much as all others
    y = F.col("Label").cast("double")
    rows = rows.select(
        y.alias("y"), F.when(y == 1, F.lit(float(heavy))).otherwise(F.lit(1.0)).alias("w"), places(F.col("clean_text"), features).alias("idx"),
        F.pmod(F.xxhash64("clean_text"), F.lit(batches)).cast("int").alias("batch"),
    )
    rows = materialize(rows, "sgd-batches", by="batch")
    held_out = materialize(val.where("clean_text IS NOT NULL AND Label IS NOT NULL").select(F.col("clean_text").alias("text"), F.col("Label").cast("int").alias("truth")), "sgd-val")
    weights, bias, seen, seen_bias = np.zeros(features), 0.0, np.zeros(features), 0.0
    done, models = [], []
    for epoch in range(1, epochs + 1):
        means = []
        for b in range(batches):
            got = batch_sums(rows.where(F.col("batch") == b), weights, bias)
            total = got.get(_WEIGHT, 0.0)
            if not total:
                continue  # no text fell into this batch
            g = np.zeros(features)
            at = [p for p in got if p >= 0]
            g[at] = [got[p] / total for p in at]
            g += L2 * weights
            seen += g * g
            weights = weights - rate * g / np.sqrt(seen + 1e-12)
            seen_bias += (got[_BIAS] / total) ** 2
            bias -= rate * got[_BIAS] / total / (seen_bias + 1e-12) ** 0.5
            means.append(got[_LOSS] / total)
        models.append(HashedModel(weights.copy(), bias))
        m = prf1(models[-1].score(held_out), truth="truth", pred="pred").first()
        done.append((epoch, float(np.mean(means)), float(m["f1"]), int(m["tn"]), int(m["fp"]), int(m["fn"]), int(m["tp"])))
    ep = spark.createDataFrame(done, "epoch long, avg_loss double, f1 double, tn long, fp long, fn long, tp long")
    saved = model_saved(ep.select("epoch", "f1"))
    last = max((r.epoch for r in saved.collect() if r.saved), default=None)  # a row an epoch; the last save is the best
    out = ep.join(saved.select("epoch", "saved"), "epoch")
    return EpochRun(out, models[last - 1] if last else None, done[last - 1][2] if last else 0.0, models)
