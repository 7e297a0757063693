"""Moderation replay against a plain-Python model of the reference's queue rules."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from vigil.operators import replay as R

LOG_SCHEMA = "seq bigint, ts timestamp_ntz, comment_id string, op string, doc_id bigint, toxic boolean, confidence double"
T0 = datetime(2024, 1, 1)


def simulate(log):
    """The reference: an ordered dict filled by /detect, emptied by DELETE and /action."""
    queue = OrderedDict()
    actions, not_found, deleted = [], [], []
    order = sorted(log, key=lambda r: (r[1] is not None, r[1] or T0, r[0]))
    for seq, ts, cid, op, doc, toxic, conf in order:
        if op == "detect":
            if toxic:
                queue[cid] = (doc, conf)  # re-detect keeps the position, overwrites the value
        elif op == "delete":
            if cid in queue:
                del queue[cid]
                deleted.append(seq)
            else:
                not_found.append(seq)
        else:
            if cid in queue:
                doc_, _ = queue.pop(cid)
                actions.append((seq, cid, op, doc_))
            else:
                not_found.append(seq)
    return [(cid, d, c) for cid, (d, c) in queue.items()], sorted(actions), sorted(not_found), sorted(deleted)


def run(spark, log, **kw):
    df = spark.createDataFrame(log, LOG_SCHEMA)
    r = R.replay(df, **kw)
    q = [(x.comment_id, x.doc_id, x.confidence) for x in r.queue_state.orderBy("queued_ts", "queued_seq").collect()]
    acts = sorted((x.id, x.comment_id, x.action, x.doc_id) for x in r.actions.collect())
    nf = sorted(x.seq for x in r.not_found.collect())
    de = sorted(x.seq for x in r.deleted.collect())
    return q, acts, nf, de


def random_log(rng, n_ops, n_comments, ts_span=40, null_ts=0.0):
    ops = ["detect", "detect", "detect", "delete", "approved", "rejected", "escalated"]
    out = []
    for seq in range(n_ops):
        ts = None if rng.random() < null_ts else T0 + timedelta(seconds=rng.randrange(ts_span))
        op = rng.choice(ops)
        toxic = rng.random() < 0.7 if op == "detect" else None
        conf = rng.choice([0.925, 0.985, 0.5]) if op == "detect" else None
        out.append((seq, ts, f"c{rng.randrange(n_comments)}", op, rng.randrange(50), toxic, conf))
    return out


def test_seed_queue_fixture(spark):
    """The three seeded rows, in order, with their own confidences."""
    log = [
        (0, T0, "t1_cb101", "detect", 101, True, 0.985),
        (1, T0, "t1_cb102", "detect", 102, True, 0.942),
        (2, T0, "t1_cb103", "detect", 103, True, 0.897),
    ]
    q, acts, nf, de = run(spark, log)
    assert q == [("t1_cb101", 101, 0.985), ("t1_cb102", 102, 0.942), ("t1_cb103", 103, 0.897)]
    assert acts == [] and nf == [] and de == []


def test_quirks(spark):
    """Q2 clean re-detect, delete then act, unknown action string, tied timestamps."""
    t = T0
    log = [
        (1, t, "a", "detect", 1, True, 0.925),
        (2, t + timedelta(seconds=1), "a", "detect", 2, False, 0.991),  # clean: leaves a pending
        (3, t + timedelta(seconds=2), "a", "approved", None, None, None),  # records doc 1
        (4, t, "b", "detect", 3, True, 0.925),
        (5, t + timedelta(seconds=1), "b", "delete", None, None, None),
        (6, t + timedelta(seconds=2), "b", "approved", None, None, None),  # not found after delete
        (7, t, "c", "detect", 4, True, 0.925),
        (8, t + timedelta(seconds=1), "c", "escalated", None, None, None),  # any string is stored
        (10, t + timedelta(seconds=5), "d", "rejected", None, None, None),  # tie on ts: seq decides
        (9, t + timedelta(seconds=5), "d", "detect", 5, True, 0.925),
    ]
    q, acts, nf, de = run(spark, log)
    assert acts == [(3, "a", "approved", 1), (8, "c", "escalated", 4), (10, "d", "rejected", 5)]
    assert nf == [6] and de == [5] and q == []
    assert (q, acts, nf, de) == simulate(log)


def test_null_timestamps_sort_first(spark):
    log = [
        (1, T0, "a", "approved", None, None, None),
        (2, None, "a", "detect", 1, True, 0.925),
    ]
    assert run(spark, log) == simulate(log)


@pytest.mark.parametrize("partitions", [None, 1, 300])
def test_random_logs_match_model(spark, partitions):
    rng = random.Random(7)
    log = random_log(rng, 3000, 60, null_ts=0.02)
    assert run(spark, log, partitions=partitions) == simulate(log)


def test_hot_comment_is_split(spark):
    """One comment holds a third of the log; the chunked plan gives the model's answer."""
    rng = random.Random(11)
    log = random_log(rng, 1500, 30, ts_span=10_000)
    log += [(10_000 + i, T0 + timedelta(seconds=rng.randrange(10_000)), "hot", rng.choice(["detect", "approved", "delete"]),
             i % 50, True, 0.925) for i in range(800)]
    assert run(spark, log, partitions=40) == simulate(log)


def test_bursty_hot_comment_matches_model(spark):
    """Most of the hot comment's ops share a few seconds (some share one timestamp): refined chunks, same answer."""
    rng = random.Random(13)
    log = random_log(rng, 1000, 20, ts_span=10_000)
    log += [(20_000 + i, T0 + timedelta(seconds=rng.choice([5000, 5000, 5001, rng.randrange(10_000)])), "hot",
             rng.choice(["detect", "detect", "approved", "delete"]), i % 50, rng.random() < 0.8, 0.925) for i in range(900)]
    assert run(spark, log, partitions=50) == simulate(log)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(min_value=0, max_value=10_000), st.integers(min_value=1, max_value=40))
def test_property_random_small_logs(spark, seed, n):
    log = random_log(random.Random(seed), n, 3, ts_span=5, null_ts=0.1)
    assert run(spark, log, partitions=6) == simulate(log)


def test_history_newest_first_nulls_last(spark):
    df = spark.createDataFrame(
        [("a", "x", "approved", None), ("b", "y", "rejected", T0), ("c", "z", "approved", T0 + timedelta(1))],
        "comment_id string, text string, action string, timestamp timestamp_ntz",
    )
    assert [r.comment_id for r in R.history(df).collect()] == ["c", "b", "a"]


def test_events_binding_counts(spark):
    """FIXTURES.md: sf0.01 queue 19, actions 537, not-found 5,170."""
    from vigil.plans.catalog import moderation

    r = moderation(spark, "/root/testdata/sf0.01")
    assert r.queue.count() == 19
    assert r.actions.count() == 537
    assert r.not_found.count() == 5170


def test_events_binding_matches_model_sf0001(spark):
    """The whole sf0.001 events log through the Python model, with the Python lexicon."""
    import pyarrow.parquet as pq

    from vigil.functions.text import DEFAULT_LEXICON
    from vigil.plans.catalog import moderation

    sf = "/root/testdata/sf0.001"
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    texts = {d["doc_id"]: d["text"] for d in docs}
    ops = {"view": "detect", "signup": "detect", "click": "delete", "purchase": "approved", "error": "rejected"}
    log = []
    for e in pq.read_table(f"{sf}/events.parquet", columns=["event_id", "ts", "user_id", "event_type"]).to_pylist():
        doc = e["event_id"] % len(docs)
        toxic = any(w in texts[doc].lower() for w in DEFAULT_LEXICON)
        log.append((e["event_id"], e["ts"], f"t1_{e['user_id']}", ops.get(e["event_type"], e["event_type"]), doc, toxic, 0.925))
    q_model, acts_model, nf_model, _ = simulate(log)
    r = moderation(spark, sf)
    q = [(x.comment_id, x.doc_id, x.confidence) for x in r.queue_state.orderBy("queued_ts", "queued_seq").collect()]
    acts = sorted((x.id, x.comment_id, x.action, x.doc_id) for x in r.actions_keyed.collect())
    assert q == q_model and acts == acts_model
    assert sorted(x.seq for x in r.not_found.collect()) == nf_model
    assert (len(q), len(acts), len(nf_model)) == (1, 40, 550)  # FIXTURES.md


@pytest.mark.parametrize("partitions", [1, 20])
def test_comment_status_matches_model(spark, partitions):
    """Pending if queued at the end, else the latest recorded approve/reject; others absent."""
    rng = random.Random(7)
    log = random_log(rng, 400, 12, null_ts=0.05)
    queue, actions, _, _ = simulate(log)
    recorded = {a[0] for a in actions}
    latest = {}
    for seq, ts, cid, op, *_ in sorted(log, key=lambda r: (r[1] is not None, r[1] or T0, r[0])):
        if seq in recorded:
            latest[cid] = op
    pending = {cid for cid, _, _ in queue}
    want = {cid: "pending" for cid in pending}
    want.update({cid: op for cid, op in latest.items() if cid not in pending and op in ("approved", "rejected")})
    r = R.replay(spark.createDataFrame(log, LOG_SCHEMA), partitions=partitions)
    got = {x.comment_id: x.status for x in R.comment_status(r).collect()}
    assert got == want
