"""Plan shape: the scale properties the design relies on."""

import contextlib
import random
import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigil.operators import classify as C
from vigil.operators import feedback as Fb
from vigil.operators import replay as R
from vigil.operators.load import load_unique
from vigil.plans.catalog import REGISTRY, moderation
from vigil.sources import tables as T

SF = "/root/testdata/sf0.01"


def executed(df) -> str:
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


def final(df) -> str:
    """The plan as it ran, after the adaptive changes."""
    df._jdf.queryExecution().toRdd().count()
    return df._jdf.queryExecution().executedPlan().toString()


SKEW = {
    "spark.sql.shuffle.partitions": "32",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "16k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
}


@contextlib.contextmanager
def conf(spark, values):
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_text_join_splits_a_hot_document(spark):
    """A third of the rows ask for one document; broadcasts off, as for tables of any size."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    rows = spark.range(90_000, numPartitions=16).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 3000).alias("doc_id"))
    with conf(spark, SKEW):
        out = R.attach_text(rows, docs)
        assert "skew=true" in final(out)
        assert out.where("text = 'text 7'").count() == rows.where("doc_id = 7").count()


def test_unique_load_splits_a_hot_key(spark):
    old = spark.range(100).select(F.concat(F.lit("k"), "id").alias("key"), "id")
    rows = spark.range(90_000, numPartitions=16).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), "id")).alias("key"), "id")
    with conf(spark, SKEW):
        out = load_unique(old, rows, "key", "id")
        assert "skew=true" in final(out)
        assert dict(map(tuple, out.groupBy("status").count().collect())) == {"inserted": 60_001 - 66, "duplicate": 29_999, "exists": 66}


def test_latest_feedback_is_an_aggregate_not_a_window(spark):
    acts = spark.createDataFrame([], "id long, comment_id string, text string, action string, timestamp timestamp_ntz")
    plan = Fb.latest_feedback(acts.repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "partial_max" in plan


def test_training_set_keys_are_hashes_not_texts(spark):
    """No exchange or sort by a text in the distinct, the merge and the shuffle of the training set."""
    ex = spark.createDataFrame([("c", "t", "approved")], "comment_id string, text string, action string").repartition(2)
    orig = spark.createDataFrame([("t", 1, 1)], "clean_text string, Label int, ord long").repartition(2)
    examples = Fb.to_examples(ex)
    merged = Fb.merge_dedupe(orig, examples)
    plan = final(Fb.seeded_shuffle(merged))
    assert "rangepartitioning(shuffle_key" in plan
    for line in plan.splitlines():
        if "Exchange" in line or "Sort [" in line:
            assert not re.search(r"(hashpartitioning|rangepartitioning|Sort )[\[(](clean_text|text)#", line), line


LOG = "seq long, ts timestamp_ntz, comment_id string, op string, doc_id long, toxic boolean, confidence double"


def _largest_chunk(spark, rows, partitions):
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small data would be put together again
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        sizes = [r["count"] for r in R.assign_chunks(spark.createDataFrame(rows, LOG), partitions).groupBy("chunk").count().collect()]
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == len(rows)
    return max(sizes)


def test_any_hot_comment_is_cut(spark):
    """Bursts, one shared timestamp, missing times, several hot comments: no chunk much above the mean."""
    rng, t0, n = random.Random(1), datetime(2024, 1, 1), 6000
    spread_out = [(i, t0 + timedelta(seconds=rng.randrange(100_000)), f"c{i % 50}", "delete", None, None, None) for i in range(n)]
    hot = lambda k, ts: [(n * (k + 1) + i, ts(i), f"hot{k}", "detect", i, True, 0.925) for i in range(n // 2)]
    cases = [
        hot(0, lambda i: t0),
        hot(0, lambda i: None),
        hot(0, lambda i: t0 + timedelta(seconds=rng.randrange(9) if i % 10 else rng.randrange(31_536_000))),
        [r for k in range(5) for r in hot(k, lambda i: t0 + timedelta(seconds=i))],
    ]
    for rows in cases:
        rows = rows + spread_out
        assert _largest_chunk(spark, rows, 40) <= 2 * len(rows) / 40


def test_replay_is_one_plan_for_every_size(spark):
    docs = T.documents(spark, SF)
    for log in (T.operation_log(spark, SF), T.operation_log(spark, SF).limit(3)):
        r = R.replay(log, flags=C.toxic_flags(docs, "doc_id"))
        plan = r.steps._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Window [lag(kind") == 1 and "chunk" in plan


def test_no_python_in_scan_and_filters(spark):
    for name in ("classify", "blocklist", "search", "lexicon_hits"):
        plan = executed(REGISTRY[name](spark, SF))
        assert "Python" not in plan and "ArrowEval" not in plan, name


def test_scans_are_pruned_and_filters_pushed(spark):
    plan = executed(T.operation_log(spark, SF))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string>" in plan
    assert "props" not in plan and "value:double" not in plan
    plan = executed(REGISTRY["actions_table"](spark, SF))
    assert "PushedFilters: [In(action, [approved,rejected])" in plan


def test_history_sort_splits_a_hot_timestamp(spark):
    """A third of the actions share one timestamp: the unique tie-break lets the range sort split them."""
    t0 = datetime(2024, 1, 1)
    rows = [(i, f"c{i}", "x", "approved", t0 if i % 3 == 0 else t0 + timedelta(seconds=i)) for i in range(3000)]
    acts = spark.createDataFrame(rows, "id long, comment_id string, text string, action string, timestamp timestamp_ntz")
    ordered = R.history(acts.repartition(8))
    assert "rangepartitioning(timestamp#" in executed(ordered) and " id#" in executed(ordered).split("rangepartitioning")[1]
    # Small data: AQE would coalesce the sorted ranges into one; look at the ranges themselves.
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        sizes = ordered.rdd.glom().map(len).collect()
    finally:
        spark.conf.set(key, before)
    assert sum(sizes) == 3000 and max(sizes) < 1000
    got = [(r["timestamp"], r["comment_id"]) for r in ordered.collect()]
    assert got == sorted(got, key=lambda t: (t[0], int(t[1][1:])), reverse=True)


def test_narrow_queries_have_no_exchange(spark):
    for name in ("classify", "flagged", "blocklist", "search", "page_elements", "scan_pages"):
        assert "Exchange" not in executed(REGISTRY[name](spark, SF)), name


def test_filters_on_labels_evaluate_the_lexicon_once(spark):
    for name in ("flagged", "gate", "search"):
        plan = REGISTRY[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        # One pass of the lexicon ("stupid" is a lexicon word and not the search term).
        assert plan.count(", stupid)") == 1, name
