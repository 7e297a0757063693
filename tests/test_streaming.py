"""Structured Streaming: keyed-state queue equals the batch replay; classify and flags streams."""

import os
import random
import tempfile

from vigil.operators import replay as R
from vigil.streaming import queue as Sq
from vigil.streaming import sources as Ss
from vigil.streaming.classify import stream_classify

from test_replay import LOG_SCHEMA, random_log, simulate


def _write_batches(spark, log, n_files):
    """Time-ordered micro-batches: the log sorted by (ts, seq), cut into files."""
    d = tempfile.mkdtemp(prefix="vigil-ops-")
    order = sorted(log, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    step = max(1, len(order) // n_files)
    for i in range(0, len(order), step):
        spark.createDataFrame(order[i:i + step], LOG_SCHEMA).coalesce(1).write.parquet(os.path.join(d, f"b{i:06d}"))
    # one flat folder of files, named in time order
    flat = tempfile.mkdtemp(prefix="vigil-ops-flat-")
    k = 0
    for sub in sorted(os.listdir(d)):
        for f in sorted(os.listdir(os.path.join(d, sub))):
            if f.endswith(".parquet"):
                os.link(os.path.join(d, sub, f), os.path.join(flat, f"{k:06d}.parquet"))
                k += 1
    return flat


def test_stream_queue_equals_batch_replay(spark):
    rng = random.Random(5)
    # ts without nulls: arrival order across batches is time order.
    log = random_log(rng, 600, 25, ts_span=600)
    folder = _write_batches(spark, log, 6)
    ops = spark.readStream.schema(LOG_SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    out_dir, ckpt = Ss.new_sink(spark, "test-queue")
    Sq.stream_queue(ops, out_dir, ckpt, partitions=7).awaitTermination()
    out = Sq.read_outcomes(spark, out_dir)
    assert out.select("batch").distinct().count() > 1  # the queue went on over several micro-batches
    q_model, acts_model, nf_model, del_model = simulate(log)
    acts = sorted((r.seq, r.comment_id, r.op, r.doc_id) for r in out.where("outcome = 'recorded'").collect())
    nf = sorted(r.seq for r in out.where("outcome = 'not_found'").collect())
    de = sorted(r.seq for r in out.where("outcome = 'deleted'").collect())
    assert (acts, nf, de) == (acts_model, nf_model, del_model)
    queue = Sq.current_queue(spark, out_dir).orderBy("queued_ts", "queued_seq").collect()
    assert [(r.comment_id, r.doc_id, r.confidence) for r in queue] == q_model
    batch = R.replay(spark.createDataFrame(log, LOG_SCHEMA))
    assert sorted(r.comment_id for r in batch.queue_state.collect()) == sorted(r.comment_id for r in queue)
    assert len(Ss.child_names(spark, f"{out_dir}/queue")) == Sq.KEEP_VERSIONS


def test_repeated_batch_changes_nothing(spark):
    """Spark may run a batch again after a failure: same files, same rows."""
    rng = random.Random(8)
    log = random_log(rng, 200, 9, ts_span=200)
    log.sort(key=lambda r: (r[1], r[0]))
    out_dir, _ = Ss.new_sink(spark, "test-repeat")
    step = Sq.queue_step(out_dir, partitions=3)
    parts = [spark.createDataFrame(log[i:i + 100], LOG_SCHEMA) for i in (0, 100)]
    step(parts[0], 0), step(parts[1], 1)
    before = sorted(map(str, Sq.read_outcomes(spark, out_dir).collect())), sorted(map(str, Sq.current_queue(spark, out_dir).collect()))
    step(parts[1], 1)
    assert before == (sorted(map(str, Sq.read_outcomes(spark, out_dir).collect())), sorted(map(str, Sq.current_queue(spark, out_dir).collect())))


def test_stream_classify(spark):
    d = tempfile.mkdtemp(prefix="vigil-comments-")
    for i, rows in enumerate([[("a", "you idiot"), ("b", "hello")], [("c", "garbage take")]]):
        spark.createDataFrame(rows, "comment_id string, text string").coalesce(1).write.parquet(os.path.join(d, str(i)))
    flat = tempfile.mkdtemp(prefix="vigil-comments-flat-")
    for i in range(2):
        for f in os.listdir(os.path.join(d, str(i))):
            if f.endswith(".parquet"):
                os.link(os.path.join(d, str(i), f), os.path.join(flat, f"{i}.parquet"))
    data, ckpt = Ss.new_sink(spark, "test-classify")
    stream_classify(Ss.read_comment_stream(spark, flat), data, ckpt).awaitTermination()
    assert sorted(r.comment_id for r in spark.read.parquet(data).collect()) == ["a", "c"]
