"""Named tests for the quirk decisions of SURVEY §2.12 not covered elsewhere.

Elsewhere: Q1, Q4-Q6 (test_classify_filters), Q2, Q3 (test_replay / test_feedback), Q9, Q12
(test_feedback), Q10, Q14, Q15, Q17 (test_trainlog), Q11 (test_evaluate_pages).
"""

from datetime import datetime, timedelta

import pytest

from vigil.operators import pages as Pg
from vigil.operators import replay as R
from vigil.operators import train as Tr

T0 = datetime(2024, 1, 1)


def test_q7_blocklisted_text_is_queued_only_if_classifier_agrees(spark):
    pages = spark.createDataFrame([(1, "https://x.reddit.com/", "<p>la plage</p><p>la idiot</p>")],
                                  "page_id long, url string, html string")
    s = Pg.Settings.from_text("la", auto_scan=False)
    got = {r.txt: (r.reason, r.queued) for r in Pg.scan_pages(pages, s, r"\.reddit\.com$").collect()}
    assert got == {"la plage": ("blocklist", False), "la idiot": ("blocklist", True)}


def test_q8_element_ids_are_deterministic_and_flagged_once(spark):
    pages = spark.createDataFrame([(1, "https://x.reddit.com/", "<p>you idiot</p>")], "page_id long, url string, html string")
    s = Pg.Settings.from_text("", auto_scan=True)
    a = Pg.scan_pages(pages, s, r"\.reddit\.com$").collect()
    b = Pg.scan_pages(pages.repartition(3), s, r"\.reddit\.com$").collect()
    assert [r.element_id for r in a] == [r.element_id for r in b] and len(a) == 1
    assert Pg.dedupe_flags(spark.createDataFrame(a + b)).count() == 1


def test_q13_label_is_case_insensitive_in_spark(spark):
    df = spark.createDataFrame([("x", 1)], "clean_text string, Label int")
    # Spark resolves `label` to `Label`: a scorer adding `label` would replace the training label.
    assert df.select("label").first()[0] == 1
    prepared = Tr._prepare(df)
    assert "Label" not in prepared.columns and {"y", "truth"} <= set(prepared.columns)


def test_q16_queue_and_actions_come_from_one_log(spark):
    log = spark.createDataFrame(
        [(1, T0, "a", "detect", 1, True, 0.925), (2, T0 + timedelta(seconds=1), "a", "approved", None, None, None)],
        "seq long, ts timestamp_ntz, comment_id string, op string, doc_id long, toxic boolean, confidence double",
    )
    r = R.replay(log)
    # The action is recorded and the comment left the queue: both read the same replay.
    assert r.actions_keyed.count() == 1 and r.queue_state.count() == 0


def test_q18_any_action_string_clears_and_is_stored(spark):
    log = spark.createDataFrame(
        [(1, T0, "a", "detect", 1, True, 0.925), (2, T0 + timedelta(seconds=1), "a", "Escalate!", None, None, None)],
        "seq long, ts timestamp_ntz, comment_id string, op string, doc_id long, toxic boolean, confidence double",
    )
    r = R.replay(log)
    assert [x.action for x in r.actions_keyed.collect()] == ["Escalate!"] and r.queue_state.count() == 0


def test_q19_empty_training_set_raises(spark):
    empty = spark.createDataFrame([], "clean_text string, Label int")
    with pytest.raises(ValueError):
        Tr.train(empty)


def test_q19_empty_feedback_writes_nothing(spark):
    from vigil.operators import feedback as Fb

    empty = spark.createDataFrame([], "id long, comment_id string, action string, timestamp timestamp_ntz, doc_id long")
    latest = Fb.latest_feedback(empty, texts=spark.createDataFrame([], "doc_id long, text string"))
    assert latest.count() == 0 and latest.columns == ["comment_id", "text", "action"]
