"""The queue as a stored snapshot: steps of a log equal its replay; batches of clicks and deletes."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F
from test_replay import LOG_SCHEMA, T0, random_log, simulate

from vigil.operators import replay as R
from vigil.session import materialize


def in_order(log):
    return sorted(log, key=lambda r: (r[1] is not None, r[1] or T0, r[0]))


def by_steps(spark, log, cuts, partitions=None):
    queue = spark.createDataFrame([], "comment_id string, doc_id long, confidence double, queued_ts timestamp_ntz, queued_seq long")
    acts, missed, gone = [], [], []
    order = in_order(log)
    for a, b in zip([0, *cuts], [*cuts, len(order)], strict=True):
        r = R.advance(queue, spark.createDataFrame(order[a:b], LOG_SCHEMA), partitions=partitions)
        acts += [(x.id, x.comment_id, x.action, x.doc_id) for x in r.actions_keyed.collect()]
        missed += [x.seq for x in r.not_found.collect()]
        gone += [x.seq for x in r.deleted.collect()]
        queue = materialize(r.queue_state, "test-queue")
    q = [(x.comment_id, x.doc_id, x.confidence) for x in queue.orderBy("queued_ts", "queued_seq").collect()]
    return q, sorted(acts), sorted(missed), sorted(gone)


@pytest.mark.parametrize("seed,partitions", [(1, None), (2, 1), (3, 40)])
def test_steps_equal_replay(spark, seed, partitions):
    rng = random.Random(seed)
    log = random_log(rng, 500, 15, ts_span=300)
    cuts = sorted(rng.sample(range(500), 3)) + [500]  # the last step is empty
    assert by_steps(spark, log, cuts, partitions) == simulate(log)


def test_hot_comment_goes_on_from_the_snapshot(spark):
    """Pending before the batch; its ops of the batch lie in several chunks, the first of which meets the snapshot row."""
    first = [(0, T0, "hot", "detect", 7, True, 0.9), (1, T0, "other", "detect", 8, True, 0.9)]
    more = [(10 + i, T0 + timedelta(seconds=1 + i // 50), "hot", ["approved", "detect", "delete"][i % 3], i, True, 0.925) for i in range(400)]
    queue = materialize(R.replay(spark.createDataFrame(first, LOG_SCHEMA)).queue_state, "hot-queue")
    r = R.advance(queue, spark.createDataFrame(more, LOG_SCHEMA), partitions=16)
    model = simulate(first + more)
    assert sorted((x.id, x.comment_id, x.action, x.doc_id) for x in r.actions_keyed.collect()) == model[1]
    assert (10, "hot", "approved", 7) in model[1]
    assert sorted(x.seq for x in r.not_found.collect()) == model[2] and sorted(x.seq for x in r.deleted.collect()) == model[3]
    assert [(x.comment_id, x.doc_id, x.confidence) for x in r.queue_state.orderBy("queued_ts", "queued_seq").collect()] == model[0]
    chunks = R.assign_chunks(R._kept(spark.createDataFrame(more, LOG_SCHEMA), None), 16)
    assert chunks.groupBy("chunk").count().agg(F.max("count")).first()[0] < 100


def test_re_detect_keeps_its_place_across_steps(spark):
    a = [(0, T0, "x", "detect", 1, True, 0.9), (1, T0 + timedelta(seconds=1), "y", "detect", 2, True, 0.9)]
    b = [(2, T0 + timedelta(seconds=2), "x", "detect", 3, True, 0.8), (3, T0 + timedelta(seconds=3), "y", "detect", 4, False, 0.99)]
    assert by_steps(spark, a + b, [2])[0] == [("x", 3, 0.8), ("y", 2, 0.9)]


QUEUE = [("a", 1, 0.9, T0, 0), ("b", 2, 0.9, T0, 1), ("c", 3, 0.9, None, 2), (None, 4, 0.9, T0, 3)]
QUEUE_SCHEMA = "comment_id string, doc_id long, confidence double, queued_ts timestamp_ntz, queued_seq long"
OPS = "seq long, ts timestamp_ntz, comment_id string, op string"


def test_resolve_and_delete(spark):
    queue = spark.createDataFrame(QUEUE, QUEUE_SCHEMA)
    late = T0 + timedelta(hours=1)
    ops = [(10, late, "a", "rejected"), (11, T0, "a", "approved"), (12, None, "b", "escalated"), (13, T0, "zz", "approved"), (14, T0, None, "approved"), (15, T0, None, "approved")]
    texts = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    acts, missed, left = R.resolve(queue, spark.createDataFrame(ops, OPS), texts)
    assert sorted((r.id, r.comment_id, r.text, r.action, r.doc_id) for r in acts.collect()) == [
        (11, "a", "one", "approved", 1), (12, "b", "two", "escalated", 2), (14, None, None, "approved", 4)]
    assert sorted(r.seq for r in missed.collect()) == [10, 13, 15]
    assert [r.comment_id for r in left.collect()] == ["c"]
    left, missed = R.delete(queue, spark.createDataFrame([(1, T0, "c", "x"), (2, T0, "c", "x"), (3, T0, "q", "x")], OPS).drop("op"))
    assert sorted(str(r.comment_id) for r in left.collect()) == ["None", "a", "b"]
    assert sorted((r.seq, r.op) for r in missed.collect()) == [(2, "delete"), (3, "delete")]


def test_empty_batches(spark):
    queue, none = spark.createDataFrame(QUEUE, QUEUE_SCHEMA), spark.createDataFrame([], OPS)
    acts, missed, left = R.resolve(queue, none)
    assert acts.count() == missed.count() == 0 and left.count() == 4
    left, missed = R.delete(spark.createDataFrame([], QUEUE_SCHEMA), none)
    assert left.count() == missed.count() == 0
