"""Epochs that continue (M3): gradients against numpy, equal work, the best model."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.operators import sgd


def table(spark, n=120):
    rows = [(f"a good day number{k % 7} friend{k}", 0) for k in range(n)] + [(f"you idiot number{k % 7} fool{k}", 1) for k in range(n // 10)]
    return spark.createDataFrame([*rows, (None, 1), ("", 0), ("no label", None)], "clean_text string, Label int").repartition(5)


def test_gradient_equals_numpy(spark):
    rng = np.random.default_rng(4)
    features = 32
    rows = [(float(rng.integers(2)), float(rng.random() * 3), rng.choice(features, rng.integers(0, 9), replace=False).tolist()) for _ in range(90)]
    weights, bias = rng.normal(size=features), 0.3
    got = sgd.batch_sums(spark.createDataFrame(rows, "y double, w double, idx array<int>").repartition(6), weights, bias)
    x = np.zeros((90, features))
    for i, r in enumerate(rows):
        x[i, r[2]] = 1
    y, w = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    p = 1 / (1 + np.exp(-(x @ weights + bias)))
    assert np.allclose([got.get(k, 0) for k in range(features)], x.T @ (w * (p - y)))
    assert np.allclose([got[-1], got[-2], got[-3]], [(w * (p - y)).sum(), -(w * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum(), w.sum()])
    # The gradient is that of the loss.
    moved = weights.copy()
    moved[3] += 1e-6
    more = sgd.sums([r[2] for r in rows], y, w, moved, bias)[2] - sgd.sums([r[2] for r in rows], y, w, weights, bias)[2]
    assert abs(more / 1e-6 - got.get(3, 0)) < 1e-3


def test_large_margins_do_not_overflow():
    with np.errstate(over="raise", invalid="raise"):
        g, b, loss = sgd.sums([np.array([0]), np.array([0])], np.array([1.0, 0.0]), np.ones(2), np.array([800.0]), 0.0)
    assert loss == 800.0 and b == 1.0


def test_epochs_go_on(spark):
    run = sgd.fit_epochs(table(spark), table(spark), epochs=4, batches=3, features=1 << 10)
    rows = run.epochs.orderBy("epoch").collect()
    assert [r.epoch for r in rows] == [1, 2, 3, 4]
    assert rows[-1].avg_loss < rows[0].avg_loss  # the second epoch starts from the first one's weights
    assert rows[-1].f1 > 0.9 and run.best_f1 == max(r.f1 for r in rows)
    assert [r.saved for r in rows] == [r.f1 > max([0.0, *[q.f1 for q in rows[:i]]]) for i, r in enumerate(rows)]
    longer = sgd.fit_epochs(table(spark), table(spark), epochs=2, batches=3, features=1 << 10)
    assert np.allclose(longer.models[1].weights, run.models[1].weights)  # an epoch doesn't depend on how many follow


def test_scorer_keeps_columns_and_rows(spark):
    model = sgd.fit_epochs(table(spark), table(spark), epochs=1, batches=2, features=1 << 8).models[0]
    df = spark.createDataFrame([("1", "you idiot"), ("2", None), ("3", ""), ("3", "")], "comment_id string, text string")
    out = model.scorer()(df)
    assert out.columns == ["comment_id", "text", "label", "confidence"] and out.count() == 4
    assert out.where("confidence < 0.5 OR confidence > 1 OR confidence IS NULL").count() == 0
    assert out.where("comment_id <> '1'").select(F.round("confidence", 9)).distinct().count() == 1  # null scored as empty


def test_empty_set_is_an_error(spark):
    with pytest.raises(ValueError):
        sgd.fit_epochs(table(spark).where("clean_text IS NULL"), table(spark))
