"""The comment feed with rejects (S5) and the flags stream with a bounded state."""

import os
import tempfile
from datetime import datetime, timedelta

from vigil.operators.pages import Settings
from vigil.streaming import comments as Cm
from vigil.streaming import report as Sr
from vigil.streaming import sources as Ss

LINES = {
    '{"comment_id": "a", "text": "x", "more": [1]}': None, '{"text": "", "comment_id": ""}': None, "": "not JSON", "  ": "not JSON",
    "plain words": "not JSON", '{"comment_id": "a"': "not JSON", "3": "not an object", "[1]": "not an object", "null": "not an object", '"s"': "not an object",
    "{}": "comment_id missing", '{"comment_id": "a"}': "text missing", '{"comment_id": 5, "text": "x"}': "comment_id not a string",
    '{"comment_id": "a", "text": null}': "text not a string", '{"comment_id": "a", "text": ["x"]}': "text not a string", '{"comment_id": true, "text": 1}': "comment_id not a string",
}


def test_reasons(spark):
    got = {r.line: r.reason for r in Cm.checked(spark.createDataFrame([(x,) for x in LINES], "line string")).collect()}
    assert got == LINES
    assert Cm.checked(spark.createDataFrame([(None,)], "line string")).first().reason == "not JSON"


def test_both_sinks(spark):
    d = tempfile.mkdtemp(prefix="vigil-feed-")
    for i, part in enumerate([list(LINES)[:6], list(LINES)[6:]]):
        with open(os.path.join(d, f"{i}.json"), "w") as f:
            f.write("\n".join(part) + "\n")
    out, ckpt = Ss.new_sink(spark, "test-feed")
    assert Cm.read_sink(spark, out, "accepted").count() == 0
    for _ in range(2):  # the second run finds nothing new
        Cm.stream_comments(Cm.read_line_stream(spark, d), out, ckpt).awaitTermination()
    assert sorted(tuple(r) for r in Cm.read_sink(spark, out, "accepted").collect()) == [("", ""), ("a", "x")]
    assert sorted(tuple(r) for r in Cm.read_sink(spark, out, "rejected").collect()) == sorted((k, v) for k, v in LINES.items() if v)


PAGES = "page_id long, url string, html string, seen timestamp"
T0 = datetime(2024, 1, 1)


def _flag_batches(spark, batches, **kw):
    """Run micro-batches of ``(page_id, hours)`` one after the other; rows of each, state rows after each."""
    d = tempfile.mkdtemp(prefix="vigil-pages-")
    data, ckpt = Ss.new_sink(spark, "test-flags")
    state, rows, before = [], [], 0
    for i, batch in enumerate(batches):
        made = [(p, "https://a.example.com/", f"<p>an idiot {p}</p>", None if h is None else T0 + timedelta(hours=h)) for p, h in batch]
        spark.createDataFrame(made, PAGES).coalesce(1).write.mode("append").parquet(d)
        pages = spark.readStream.schema(PAGES).parquet(d)
        flags = Sr.flags_stream(pages, Settings(auto_scan=True), "example", **kw)
        q = Ss.run_to_parquet(flags, data, ckpt)
        q.awaitTermination()
        state.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
        got = spark.read.schema(flags.schema).parquet(data).select("page_id").collect()
        rows.append(len(got) - before)
        before = len(got)
    return rows, state


def test_flags_state_is_bounded_and_late_rows_are_dropped(spark):
    batches = [[(1, 0), (1, 0), (2, 0)], [(1, 1), (3, 1)], [(9, 50)], [(1, 50), (4, 2), (5, None)], [(9, 51)]]
    rows, state = _flag_batches(spark, batches, keep="10 hours", seen_at="seen")
    # Again within the window: not flagged. After it: flagged anew. More than the window behind the newest: dropped.
    assert rows == [2, 1, 1, 1, 0]
    assert state[-1] <= 2 < state[1] + 1  # the first three ids are forgotten


def test_flags_by_arrival_lose_nothing(spark):
    rows, _ = _flag_batches(spark, [[(1, 0), (2, 90)], [(1, 5), (3, 1), (4, None)]])
    assert rows == [2, 2]
