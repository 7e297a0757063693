"""Training progress, log parsing and report."""

import json

from pyspark.sql import functions as F

from vigil.operators import trainlog as Tl


def lines(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "line_no long, line string")


def test_parse_raw_fallback_q10(spark):
    df = Tl.parse_train_log(lines(spark, ["garbage", "3", "{}", "[1]", '{"type":"progress","progress":5}']))
    got = [(r.type, r.raw_line, r.progress) for r in df.orderBy("line_no").collect()]
    assert got == [("raw", "garbage", None), ("raw", "3", None), (None, None, None), ("raw", "[1]", None),
                   ("progress", None, 5)]


def test_report_stops_at_first_complete_q15(spark):
    log = [
        json.dumps({"type": "summary", "epochs": 3, "batch_size": 8, "total_steps": 9, "device": "cpu"}),
        json.dumps({"type": "training_started"}),
        json.dumps({"type": "progress", "epoch": 1, "step": 1, "progress": 11}),
        json.dumps({"type": "epoch_end", "epoch": 1, "avg_loss": 0.5, "f1": 0.4}),
        json.dumps({"type": "model_saved", "f1": 0.4}),
        json.dumps({"type": "epoch_end", "epoch": 2, "avg_loss": 0.4, "f1": 0.6}),
        json.dumps({"type": "model_saved", "f1": 0.6}),
        json.dumps({"type": "complete", "best_f1": 0.6}),
        json.dumps({"type": "complete"}),
        json.dumps({"type": "epoch_end", "epoch": 9, "avg_loss": 0.1, "f1": 0.9}),
    ]
    ev = Tl.parse_train_log(lines(spark, log))
    r = Tl.train_report(ev).first()
    assert (r.started, r.progress, r.best_f1, r.epochs_reported, r.complete) == (True, 100, 0.6, 2, True)
    assert [x.epoch for x in Tl.train_epochs(ev).collect()] == [1, 2]
    partial = Tl.train_report(Tl.parse_train_log(lines(spark, log[:3]))).first()
    assert (partial.progress, partial.best_f1, partial.complete) == (11, None, False)


def test_progress_ticks_q14(spark):
    # 1 epoch of 100 batches: step 29 -> int(29/100*100) == 28 in floating point.
    steps = spark.createDataFrame([(1, b, 1.0) for b in range(100)], "epoch int, batch long, loss double")
    ticks = {r.step: r.progress for r in Tl.progress_ticks(steps).collect()}
    expect, last = {}, -1
    for s in range(1, 101):
        p = int(s / 100 * 100)
        if p > last:
            expect[s], last = p, p
    assert ticks == expect and 29 not in ticks


def test_avg_loss_mean_of_batch_means(spark):
    steps = spark.createDataFrame([(1, 0, 1.0), (1, 0, 3.0), (1, 1, 10.0)], "epoch int, batch long, loss double")
    r = Tl.avg_loss(steps).first()
    assert r.avg_loss == 6.0 and r.n_batches == 2  # (2 + 10) / 2, not 14 / 3


def test_model_saved_strict_q17(spark):
    ep = spark.createDataFrame([(1, 0.0), (2, 0.5), (3, 0.5), (4, 0.7)], "epoch long, f1 double")
    assert [r.saved for r in Tl.model_saved(ep).orderBy("epoch").collect()] == [False, True, False, True]


def test_step_budget(spark):
    df = spark.range(17)
    r = Tl.step_budget(df).first()
    assert (r.steps_per_epoch, r.total_steps) == (3, 9)


def test_epoch_lines_parse_back(spark):
    epochs = spark.createDataFrame(
        [(1, 0.7, 0.5, True, 1, 2, 3, 4), (2, 0.6, 0.4, False, 1, 2, 3, 4)],
        "epoch long, avg_loss double, f1 double, saved boolean, tn long, fp long, fn long, tp long",
    )
    ev = Tl.parse_train_log(Tl.epoch_lines(epochs, F.lit(100)))
    got = [(r.type, r.epoch, r.f1) for r in ev.orderBy("line_no").collect()]
    assert got == [("training_started", None, None), ("confusion_matrix", None, None), ("epoch_end", 1, 0.5), ("model_saved", None, 0.5),
                   ("confusion_matrix", None, None), ("epoch_end", 2, 0.4), ("complete", None, None)]
    assert ev.agg(F.min("line_no")).first()[0] > 100
    r = Tl.train_report(ev).first()
    assert (r.started, r.progress, r.best_f1, r.epochs_reported, r.complete) == (True, 100, 0.5, 2, True)


def test_blank_and_padded_lines_are_raw(spark):
    ev = Tl.parse_train_log(lines(spark, ["", "  padded \t", ' {"type":"progress","progress":7} ']))
    assert [(r.type, r.raw_line, r.progress) for r in ev.orderBy("line_no").collect()] == [("raw", "", None), ("raw", "padded", None), ("progress", None, 7)]


def test_read_log_file_with_raw_lines(spark, tmp_path):
    from vigil.sources.trainlog import read_train_log

    p = tmp_path / "log"
    p.mkdir()
    (p / "run.jsonl").write_text('{"type":"training_started"}\ngarbage\n\n3\r\n{}\n{"type":"complete","best_f1":0.5}\n')
    ev = Tl.parse_train_log(read_train_log(spark, str(p)).select("line_no", "line"))
    got = [(r.line_no, r.type, r.raw_line) for r in ev.orderBy("line_no").collect()]
    assert got == [(0, "training_started", None), (1, "raw", "garbage"), (2, "raw", ""), (3, "raw", "3"), (4, None, None), (5, "complete", None)]
    r = Tl.train_report(ev).first()
    assert (r.started, r.progress, r.complete) == (True, 100, True)


def test_lines_of_a_split_file_are_numbered(spark, tmp_path):
    """Files read in many splits: every line has its own place."""
    from vigil.sources.trainlog import read_train_log, write_train_log

    (tmp_path / "in").mkdir()
    texts = [[f"{f} line {k} " + "x" * (k % 50) if k % 7 else "" for k in range(500)] for f in range(3)]
    for f, t in enumerate(texts):
        (tmp_path / "in" / f"part-{f}.txt").write_text("\n".join(t) + "\n")
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "700b")
    try:
        got = read_train_log(spark, str(tmp_path / "in"))
        assert [r.line for r in got.orderBy("log_line_no").collect()] == [x for t in texts for x in t]
        assert sorted(r.line_no for r in got.collect()) == sorted(list(range(500)) * 3)
        write_train_log(got.select(F.col("log_line_no").alias("line_no"), "line"), str(tmp_path / "out"))
        back = read_train_log(spark, str(tmp_path / "out"))
        assert [r.line for r in back.orderBy("log_line_no").collect()] == [x for t in texts for x in t]
    finally:
        spark.conf.set(key, before)


def test_stream_report_equals_the_batch_report(spark, tmp_path):
    from vigil.streaming import report as Sr

    texts = ["noise", '{"type":"training_started"}', '{"type":"progress","progress":30}', '{"type":"model_saved","f1":0.3}', '{"type":"epoch_end","epoch":1}',
             '{"type":"progress","progress":60}', '{"type":"epoch_end","epoch":2}', '{"type":"complete"}', '{"type":"epoch_end","epoch":9}', '{"type":"model_saved","f1":0.9}']
    for n in (5, len(texts)):
        folder = tmp_path / f"lines-{n}"
        for k in range(0, n, 2):
            part = spark.createDataFrame(list(enumerate(texts))[k : min(n, k + 2)], "line_no long, line string")
            part.coalesce(1).write.parquet(str(folder / f"f{k}"))
        stream = spark.readStream.schema("line_no long, line string").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        query = Sr.stream_report(stream, str(tmp_path / f"out-{n}"), str(tmp_path / f"ckpt-{n}"))
        query.awaitTermination()
        got = Sr.read_report(spark, str(tmp_path / f"out-{n}"), query).collect()
        assert got == Tl.train_report(Tl.parse_train_log(lines(spark, texts[:n]))).collect()


def test_progress_ticks_strictly_increase(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    @settings(max_examples=5, deadline=None)
    @given(st.integers(1, 4), st.integers(1, 300))
    def check(epochs, batches):
        steps = spark.createDataFrame([(e, b, 0.0) for e in range(1, epochs + 1) for b in range(batches)],
                                      "epoch int, batch long, loss double")
        t = [(r.step, r.progress) for r in Tl.progress_ticks(steps).orderBy("step").collect()]
        assert all(a[1] < b[1] for a, b in zip(t, t[1:]))
        assert t[0] == (1, int(1 / (epochs * batches) * 100)) and t[-1][1] == 100

    check()
