"""Other scorers than the word list: the gate, the page scan and the queue ask them once a row."""

from datetime import datetime

from pyspark.sql import functions as F

from vigil.operators import classify as C
from vigil.operators import filters as Fl
from vigil.operators import pages as Pg
from vigil.operators import replay as R
from vigil.operators import train as Tr
from vigil.operators import trainlog as Tl
from vigil.plans.catalog import HOST_REGEX, SCAN_SETTINGS
from vigil.sources import tables as T

SF = "/root/testdata/sf0.001"


def test_graded(spark):
    df = spark.createDataFrame([(1, "fine"), (2, "IDIOT"), (3, "idiot trash idiot"), (4, None), (5, "stupid idiot hate dumb jerk kill garbage")], "id int, text string")
    got = {r.id: (r.label, r.confidence) for r in C.graded(df).collect()}
    assert got == {1: ("non-cyberbully", 0.75), 2: ("cyberbully", 0.8), 3: ("cyberbully", 0.85), 4: ("non-cyberbully", 0.75), 5: ("cyberbully", 1.0)}
    assert sorted(r.id for r in Fl.gate(C.graded(df), 85).collect()) == [3, 5]


def test_word_list_as_scorer_gives_the_same_scan(spark):
    pages = T.pages(spark, SF)
    one = Pg.scan_pages(pages, SCAN_SETTINGS, HOST_REGEX)
    two = Pg.scan_pages(pages, SCAN_SETTINGS, HOST_REGEX, scorer=C.classify)
    assert one.count() > 0 and one.columns == two.columns
    assert one.exceptAll(two).count() == two.exceptAll(one).count() == 0


def test_threshold_decides(spark):
    html = "<p>an idiot</p><p>idiot and trash</p><p>la</p>"
    pages = spark.createDataFrame([(1, "https://a.example.com/x", html)], "page_id long, url string, html string")
    def hits(pct, auto=True):
        s = Pg.Settings.from_text("la", threshold_percent=pct, auto_scan=auto)
        return sorted((r.txt, r.reason, r.queued) for r in Pg.scan_pages(pages, s, HOST_REGEX, scorer=C.graded).collect())
    assert hits(80) == [("an idiot", "classifier", True), ("idiot and trash", "classifier", True), ("la", "blocklist", False)]
    assert hits(85) == [("idiot and trash", "classifier", True), ("la", "blocklist", False)]
    assert hits(0, auto=False) == [("la", "blocklist", False)]


def test_model_in_gate_scan_and_queue(spark):
    rows = [(f"good day number{k % 3}", 0) for k in range(30)] + [(f"you rotten number{k % 3}", 1) for k in range(30)]
    scorer = Tr.model_scorer(Tr.train(spark.createDataFrame(rows, "clean_text string, Label int"), max_iter=10))
    docs = spark.createDataFrame([(0, "you rotten day"), (1, "good day"), (2, None)], "doc_id long, text string")
    out = scorer(docs)
    assert out.columns == ["doc_id", "text", "label", "confidence"] and out.count() == 3
    t = datetime(2024, 1, 1)
    log = spark.createDataFrame([(i, t, f"c{i}", "detect", i) for i in range(3)], "seq long, ts timestamp_ntz, comment_id string, op string, doc_id long")
    conf = {r.doc_id: r.confidence for r in out.collect()}
    def queue(at):
        return [(r.comment_id, r.confidence) for r in R.replay(log, flags=C.scored_flags(docs, scorer, "doc_id", at)).queue_state.collect()]
    assert queue(0.5) == [("c0", conf[0])] and queue(min(1.0, conf[0] + 1e-6)) == []
    pages = spark.createDataFrame([(1, "https://a.example.com/x", "<p>you rotten day</p><p>good day</p>")], "page_id long, url string, html string")
    found = Pg.scan_pages(pages, Pg.Settings(threshold_percent=50, auto_scan=True), HOST_REGEX, scorer=scorer)
    assert [(r.txt, r.reason) for r in found.collect()] == [("you rotten day", "classifier")]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_page_elements_are_made_once(spark):
    """One Python node; no filter holds the text clean-up (only the test for plain pages)."""
    for df in (Pg.page_elements(T.pages(spark, SF)), Pg.scan_pages(T.pages(spark, SF), SCAN_SETTINGS, HOST_REGEX)):
        plan = _plan(df)
        assert plan.count("ArrowEvalPython") == 1
        filters = [x for x in plan.splitlines() if "Filter " in x]
        assert not any("transform(" in x or "regexp_replace" in x for x in filters), filters


def test_log_lines_are_parsed_once(spark):
    lines = spark.createDataFrame([(1, '{"type": "progress", "step": 3}'), (2, " x "), (3, None)], "line_no long, line string")
    ev = Tl.parse_train_log(lines.repartition(2))
    plan = _plan(ev.where(F.col("type").isNotNull()))
    assert plan.count("from_json") <= 1 and plan.count("json_object_keys") <= 1
    got = {r.line_no: (r.type, r.step, r.raw_line) for r in ev.collect()}
    assert got == {1: ("progress", 3, None), 2: ("raw", None, "x"), 3: ("raw", None, None)}
