"""Feedback -> training set against a pandas model."""

import hashlib
import os
import tempfile
from datetime import datetime

import pandas as pd
import pytest
from pyspark.sql import functions as F

from vigil.operators import feedback as Fb
from vigil.sources import csvio

from conftest import rows

ACT = "id long, comment_id string, text string, action string, timestamp timestamp_ntz"
T = datetime(2024, 1, 1)


def test_latest_feedback_null_first_q3(spark):
    acts = spark.createDataFrame(
        [
            (1, "a", "old", "approved", datetime(2024, 1, 1)),
            (2, "a", "nul", "rejected", None),  # Postgres DESC: null first -> wins
            (3, "b", "x", "approved", datetime(2024, 1, 1)),
            (4, "b", "y", "escalated", datetime(2024, 1, 5)),  # filtered before DISTINCT ON
            (5, "c", "t1", "approved", datetime(2024, 1, 3)),
            (6, "c", "t2", "rejected", datetime(2024, 1, 3)),  # tie -> larger id
        ],
        ACT,
    )
    got = rows(Fb.latest_feedback(acts))
    assert got == [("a", "nul", "rejected"), ("b", "x", "approved"), ("c", "t2", "rejected")]


def _pandas_merge(orig: pd.DataFrame, fb: pd.DataFrame) -> pd.DataFrame:
    fbx = fb.sort_values("comment_id")
    fbx = fbx.assign(Label=fbx["action"].map({"approved": 1, "rejected": 0})).rename(columns={"text": "clean_text"})
    fbx = fbx[["clean_text", "Label"]].dropna().drop_duplicates()
    both = pd.concat([orig, fbx], ignore_index=True)
    return both.drop_duplicates(subset="clean_text")


def test_merge_matches_pandas_q9(spark):
    orig = pd.DataFrame({"clean_text": ["x", "y", "x", None, None], "Label": [1, 0, 0, 1, 0]})
    fb = pd.DataFrame(
        {"comment_id": ["c2", "c1", "c3", "c4", "c5"], "text": ["y", "z", "z", "w", None],
         "action": ["approved", "rejected", "approved", "weird", "approved"]}
    )
    key = lambda t: (t[0] is None, t[0] or "", t[1])
    expect = sorted(
        ((None if pd.isna(t) else t, int(lab)) for t, lab in _pandas_merge(orig, fb).itertuples(index=False)), key=key
    )
    o = spark.createDataFrame(
        [(t, int(lab), i) for i, (t, lab) in enumerate(orig.itertuples(index=False))], "clean_text string, Label int, ord long"
    )
    latest = spark.createDataFrame(fb, "comment_id string, text string, action string")
    ex = Fb.to_examples(latest)
    got = sorted((tuple(r) for r in Fb.merge_dedupe(o, ex).collect()), key=key)
    # z: feedback only, two labels; the lowest comment id (c1 -> 0) wins. y: original wins.
    assert got == expect


def test_stage_counts_of_the_writing_pass(spark):
    """The counts come from the pass that writes, with repeated texts, nulls and the original's own copies."""
    o = spark.createDataFrame([("x", 1, 0), ("x", 0, 1), (None, 1, 2)], "clean_text string, Label int, ord long").repartition(3)
    rows = [("c1", "x", "approved"), ("c2", "y", "rejected"), ("c3", "y", "rejected"), ("c4", None, "approved")]
    latest = spark.createDataFrame(rows, "comment_id string, text string, action string").repartition(4)
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-stats-"), "out")
    stats = {r.stage: r.n for r in Fb.merge_stats(latest, o, out).collect()}
    assert stats == {"feedback": 4, "examples": 2, "original": 3, "merged": 3}
    assert spark.read.parquet(out).count() == 3


def test_seeded_shuffle_is_repeatable(spark):
    df = spark.createDataFrame([(str(i), i % 2) for i in range(200)], "clean_text string, Label int")
    a = [r.clean_text for r in Fb.seeded_shuffle(df).collect()]
    b = [r.clean_text for r in Fb.seeded_shuffle(df.repartition(7)).collect()]
    assert a == b and sorted(a) == sorted(r.clean_text for r in df.collect()) and a != sorted(a)


def test_csv_round_trip_and_na_tokens_q12(spark):
    d = tempfile.mkdtemp(prefix="vigil-csv-")
    src = os.path.join(d, "in.csv")
    with open(src, "w", encoding="utf-8") as f:
        f.write('clean_text,Label\n"he said ""hi""\nthen left",1\nNA,0\nnull,1\n"",0\nplain,NA\n')
    df = csvio.read_labelled_csv(spark, src)
    got = [tuple(r) for r in df.collect()]
    assert got == [('he said "hi"\nthen left', 1), (None, 0), (None, 1), (None, 0), ("plain", None)]
    out = os.path.join(d, "out")
    csvio.write_labelled(df, out, fmt="csv")
    back = csvio.read_labelled_csv(spark, out)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))


def _csv(text):
    d = tempfile.mkdtemp(prefix="vigil-csv-")
    with open(os.path.join(d, "in.csv"), "w", encoding="utf-8") as f:
        f.write(text)
    return os.path.join(d, "in.csv")


def test_csv_columns_by_name_and_float_labels(spark):
    df = csvio.read_labelled_csv(spark, _csv("id,Label,clean_text\n7,1,a\n8,1.0,b\n9,0.5,c\n10,,d\n11,x,e\n"))
    assert [tuple(r) for r in df.collect()] == [("a", 1), ("b", 1), ("c", None), ("d", None), ("e", None)]
    for bad in ("clean_text,y\na,1\n", "clean_text,Label,label\na,1,1\n"):
        with pytest.raises(ValueError):
            csvio.read_labelled_csv(spark, _csv(bad))


def test_csv_keeps_padding(spark):
    rows_ = [("  padded \t", 1), ("\n lines \n", 0), ('quo"te, comma', 1)]
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-csv-"), "out")
    csvio.write_labelled(spark.createDataFrame(rows_, "clean_text string, Label int"), out, fmt="csv")
    assert sorted(tuple(r) for r in csvio.read_labelled_csv(spark, out).collect()) == sorted(rows_)


def test_empty_feedback_writes_nothing(spark):
    empty = spark.createDataFrame([], "comment_id string, text string, action string")
    original = spark.createDataFrame([("x", 1, 0)], "clean_text string, Label int, ord long")
    out = os.path.join(tempfile.mkdtemp(prefix="vigil-csv-"), "out")
    with pytest.warns(UserWarning):
        assert Fb.write_training_set(empty, original, out) == {"feedback": 0, "examples": 0, "original": 1, "merged": 1}
    assert not os.path.exists(out)
    assert Fb.write_training_set(spark.createDataFrame([("c", "t", "approved")], empty.schema), original, out)["merged"] == 2
    assert os.path.exists(out)


def test_actions_table_append_and_scan(spark):
    d = tempfile.mkdtemp(prefix="vigil-actions-")
    acts = spark.createDataFrame([(1, "a", "t", "approved", T), (2, "b", "u", "rejected", datetime(2024, 1, 2))], ACT)
    third = acts.limit(1).selectExpr("3 as id", "comment_id", "text", "action", "timestamp")
    csvio.append_actions(acts, d, "one")
    csvio.append_actions(third, d, "two")
    scan = csvio.read_actions(spark, d)
    assert scan.count() == 3
    assert scan.where("action = 'approved'").count() == 2
    before = sorted(map(str, scan.collect()))
    csvio.append_actions(acts, d, "one")  # a retry
    csvio.append_actions(third, d, "two")
    assert sorted(map(str, csvio.read_actions(spark, d).collect())) == before


def test_action_keys(spark):
    """A function of comment, time and place alone; a hot comment, one time or missing values keep rows apart."""
    rows = [(1, "a", "t", "approved", T), (2, "a", "t", "approved", T), (3, "a", "t", "approved", None), (4, None, "t", "approved", None)]
    keys = [r[0] for r in spark.createDataFrame(rows, ACT).select(csvio.action_key()).collect()]
    assert len(set(keys)) == 4
    want = hashlib.sha256(f"a|{T.isoformat(timespec='microseconds')}|1".encode()).hexdigest()
    assert keys[0] == want


def test_flag_precision_and_conflicts(spark):
    acts = spark.createDataFrame(
        [(1, "a", "t", "approved", T), (2, "b", "u", "rejected", T), (3, "c", "v", "approved", datetime(2024, 1, 2))], ACT
    )
    got = {r.day: (r.approved, r.rejected, r.precision) for r in Fb.flag_precision(acts).collect()}
    assert got == {"2024-01-01": (1, 1, 0.5), "2024-01-02": (1, 0, 1.0)}
    o = spark.createDataFrame([("x", 0, 1), ("y", 1, 2)], "clean_text string, Label int, ord long")
    ex = spark.createDataFrame([("x", 1, "c1"), ("y", 1, "c2")], "clean_text string, Label int, ord string")
    assert rows(Fb.feedback_conflicts(o, ex)) == [("x", 1, 0)]


def test_merge_idempotent_and_original_wins(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    texts = st.sampled_from(["a", "b", "c", "d", None])

    @settings(max_examples=6, deadline=None)
    @given(st.lists(st.tuples(texts, st.integers(0, 1)), max_size=8),
           st.lists(st.tuples(texts, st.integers(0, 1)), max_size=8))
    def check(orig, fb):
        o = spark.createDataFrame([(t, lab, i) for i, (t, lab) in enumerate(orig)], "clean_text string, Label int, ord long")
        f = spark.createDataFrame([(t, lab, f"c{i:03d}") for i, (t, lab) in enumerate(fb)],
                                  "clean_text string, Label int, ord string")
        merged = Fb.merge_dedupe(o, f)
        once = sorted(map(tuple, merged.collect()), key=str)
        again = Fb.merge_dedupe(merged.withColumn("ord", F.lit(0).cast("long")), f.limit(0))
        assert sorted(map(tuple, again.collect()), key=str) == once
        first_orig = {}
        for t, lab in orig:
            first_orig.setdefault(t, lab)
        got = dict(once)
        for t, lab in first_orig.items():
            assert got[t] == lab  # the original's first row always wins

    check()


def test_load_unique_first_wins_nulls_equal(spark):
    from vigil.operators.load import load_unique

    existing = spark.createDataFrame([(1, "a"), (2, None)], "id long, k string")
    incoming = spark.createDataFrame(
        [(10, "a"), (11, "b"), (12, "b"), (13, None), (14, "c"), (9, "c"), (15, "")], "id long, k string"
    )
    got = sorted(tuple(r) for r in load_unique(existing, incoming, "k", "id").collect())
    assert got == [(9, "inserted"), (10, "exists"), (11, "inserted"), (12, "duplicate"), (13, "exists"),
                   (14, "duplicate"), (15, "inserted")]


def test_load_unique_shuffles_the_key_twice(spark):
    from vigil.operators.load import load_unique

    existing = spark.range(0, 1000).selectExpr("id", "cast(id % 700 as string) as k")
    incoming = spark.range(500, 2000).selectExpr("id", "cast(id % 900 as string) as k")
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        df = load_unique(existing, incoming, "k", "id")
        df.write.format("noop").mode("overwrite").save()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert plan.count("Exchange hashpartitioning") == 2
