"""Lexicon classify and the dashboard / extension filters."""

from datetime import datetime

from pyspark.sql import functions as F

from vigil.functions.text import blocklist_regex, js_trim, parse_float_js
from vigil.operators import classify as C
from vigil.operators import filters as Fl

from conftest import rows


def comments(spark, data):
    return spark.createDataFrame(data, "comment_id string, text string")


def test_lexicon_is_substring_q1(spark):
    df = C.classify(comments(spark, [("1", "Whatever you say"), ("2", "SHUT UP now"), ("3", "lovely day"), ("4", None)]))
    got = {r.comment_id: (r.label, r.confidence) for r in df.collect()}
    assert got["1"] == ("cyberbully", 0.925)  # "hate" inside "whatever"
    assert got["2"] == ("cyberbully", 0.925)
    assert got["3"] == ("non-cyberbully", 0.991)
    assert got["4"] == ("non-cyberbully", 0.991)


def test_no_python_in_narrow_plans(spark):
    df = Fl.blocklist(C.classify(comments(spark, [("1", "x")])), ["la", "on"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan


def test_search_q6(spark):
    df = comments(spark, [("AbC", "hello"), ("abc", "other"), ("x", "Hello there")])
    assert rows(Fl.search(df, "  ABC "), "comment_id") == [("abc",)]  # id not lower-cased
    assert rows(Fl.search(df, " HELLO "), "comment_id") == [("AbC",), ("x",)]
    assert Fl.search(df, "   ").count() == 3


def test_min_confidence_p5(spark):
    df = spark.createDataFrame([("a", 0.925), ("b", 0.991), ("c", 0.5)], "comment_id string, confidence double")
    assert Fl.min_confidence(df, "").count() == 3
    assert Fl.min_confidence(df, "abc").count() == 0  # NaN -> nothing
    assert rows(Fl.min_confidence(df, " 92.5xyz"), "comment_id") == [("a",), ("b",)]
    assert parse_float_js("1e") == 1.0 and parse_float_js("-.5") == -0.5


def test_gate_inclusive_p6(spark):
    df = spark.createDataFrame(
        [("a", "cyberbully", 0.8), ("b", "cyberbully", 0.79), ("c", "non-cyberbully", 0.99)],
        "comment_id string, label string, confidence double",
    )
    assert rows(Fl.gate(df, 80), "comment_id") == [("a",)]


def test_blocklist_ascii_boundaries_q4(spark):
    df = comments(spark, [("1", "voilà la maison"), ("2", "là-bas"), ("3", "Ballade"), ("4", "IDIOT!"),
                          ("5", "labels"), ("6", "été")])
    got = rows(Fl.blocklist(df, [" la ", "idiot", "t"]), "comment_id")
    # "là" is not "la" ('à' is not 'a'); "Ballade"/"labels" have word letters around "la".
    # "été": the 't' sits between non-ASCII letters, which JS's ASCII \\b treats as non-word.
    assert got == [("1",), ("4",), ("6",)]
    assert blocklist_regex([]) is None


def test_blocklist_entries_are_regex(spark):
    df = comments(spark, [("1", "cat"), ("2", "cot"), ("3", "dog")])
    assert rows(Fl.blocklist(df, ["c.t"]), "comment_id") == [("1",), ("2",)]


def test_js_trim_q5_and_parse_list(spark):
    df = spark.createDataFrame([("  a,\tb ,, ,c\n",)], "s string")
    out = Fl.parse_blocklist(df, "s").select(js_trim(F.lit(" \t x \u3000")).alias("t"), "entries")
    r = out.first()
    assert r.t == "x" and r.entries == ["a", "b", "c"]


def test_host_filter_p9(spark):
    df = spark.createDataFrame(
        [(1, "https://www.reddit.com/r/x"), (2, "https://reddit.com/r/x"), (3, "http://old.Reddit.com:8080/"),
         (4, "not a url"), (5, "https://reddit.com.evil.net/")],
        "page_id long, url string",
    )
    assert rows(Fl.host_filter(df, r"\.reddit\.com$"), "page_id") == [(1,), (3,)]


def test_displays_p15_p16(spark):
    h = spark.createDataFrame(
        [("a", "", "approved", datetime(2024, 1, 2, 3, 4, 5)), ("b", None, "rejected", datetime(2024, 1, 2, 3, 4, 5, 120))],
        "comment_id string, text string, action string, timestamp timestamp_ntz",
    )
    got = {r.comment_id: (r.text, r.action, r.timestamp) for r in Fl.history_display(h).collect()}
    assert got["a"] == ("-", "Approved", "2024-01-02T03:04:05")
    assert got["b"] == ("-", "Rejected", "2024-01-02T03:04:05.000120")
    d = spark.createDataFrame([("a", "cyberbully", 0.925), ("b", "non-cyberbully", 0.991)],
                              "comment_id string, label string, confidence double")
    got = {r.comment_id: (r.title, r.message) for r in Fl.detection_display(d).collect()}
    assert got == {"a": ("CYBERBULLY", "Confidence: 92.5%"), "b": ("NON-CYBERBULLY", "Confidence: 99.1%")}
