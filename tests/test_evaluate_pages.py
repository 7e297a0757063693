"""Evaluation (J4, A4, A5, R4, R5) and page scan."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.functions.html import element_texts
from vigil.operators import evaluate as Ev
from vigil.operators import pages as Pg

from conftest import rows


def test_confusion_always_2x2_q11(spark):
    one_class = spark.createDataFrame([(1, 1), (1, 0)], "truth int, pred int")
    got = rows(Ev.confusion(one_class))
    assert got == [(0, 0, 0), (0, 1, 0), (1, 0, 1), (1, 1, 1)]


def test_prf1_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "truth int, pred int")
    r = Ev.prf1(df).first()
    assert (r.precision, r.recall, r.f1) == (0.0, 0.0, 0.0)


def test_pair_rejects_duplicates(spark):
    p = spark.createDataFrame([("a", 1), ("a", 0)], "comment_id string, pred int")
    t = spark.createDataFrame([("a", 1)], "comment_id string, truth int")
    with pytest.raises(Exception, match="duplicate comment_id: a"):
        Ev.pair(p, t).collect()
    with pytest.raises(Exception, match="duplicate comment_id: a"):
        Ev.pair(t, p).collect()
    assert Ev.pair(p, t, check_unique=False).count() == 2


def test_threshold_sweep_matches_brute_force(spark):
    rng = random.Random(3)
    data = [(rng.choice(range(0, 101, 10)), rng.randrange(2)) for _ in range(300)]
    df = spark.createDataFrame(data, "score_pct int, truth int")
    got = {r.threshold: (r.tp, r.fp, r.fn) for r in Ev.threshold_sweep(df).collect()}
    for t in range(101):
        tp = sum(1 for s, y in data if s >= t and y == 1)
        fp = sum(1 for s, y in data if s >= t and y == 0)
        fn = sum(1 for s, y in data if s < t and y == 1)
        assert got[t] == (tp, fp, fn)


def test_lexicon_hits_substring_vs_word(spark):
    df = spark.createDataFrame([("whatever",), ("I hate it",), ("shut up!",)], "text string")
    got = {r.word: (r.substring_docs, r.word_docs) for r in Ev.lexicon_hits(df).collect()}
    assert got["hate"] == (2, 1) and got["shut up"] == (1, 1) and got["kill"] == (0, 0)


HTML = (
    '<html><head><script>var t="</p>";</script><style>p{}</style></head><body>'
    '<div class="comment">Top <b>level</b><div data-test-id="comment">inner idiot</div></div>'
    "<p>First &amp; <i>only</i></p><p class='x'>Second<br>line<p>Third unclosed"
    "<article>after</article><p>   </p><!-- <p>hidden</p> --></body></html>"
)


def test_paragraph_path(spark):
    pages = spark.createDataFrame([(1, "https://a.example.com/", HTML)], "page_id long, url string, html string")
    got = [(r.pos, r.txt) for r in Pg.page_elements(pages).orderBy("pos").collect()]
    # The page has comment elements: all of the selector list comes out.
    assert got == [(0, "Top levelinner idiot"), (1, "inner idiot"), (2, "First & only"), (3, "Second\nline"), (4, "Third unclosed")]


PLAIN = [
    "<p>one<blockquote>two</blockquote>three", "<p>a<p>b</p>c<p class=x>d  \n e</p>", "<ul><li><p>in li</li>out</ul><p>x</p>",
    "<div><p>a <b>b</b>c<br> d<br/>e</div>f", "<td><p>cell</td>gap<p>&lt;t&gt; &amp;amp; &nbsp;x&copy;</p>", "<P>UP<PRE>no</PRE><p>\u3000trim\u3000</p>",
    "<p>it<!-- <p>no</p> -->s<script>var a='<p>';</script> ok<hr>no", "<pre>x</pre><p></p><p> </p><p>last", "no paragraph", "", None,
]
OTHER = ["<p>it&#8217;s &hellip; x&eacute;</p>", '<div class="comment">you idiot</div><div data-test-id="comment">la plage</div>',
         '<p class="Comment x">both once</p>', "<section class='a comment'>out <p>in</p> end</section>"]


def test_both_paths_agree(spark):
    made = [(k, "https://a.example.com/", h) for k, h in enumerate(PLAIN + OTHER)]
    pages = spark.createDataFrame(made, "page_id long, url string, html string")
    from vigil.functions import html as H

    plain = {r.page_id for r in pages.where(H.is_plain(F.col("html"))).collect()}
    assert plain == {k for k, h in enumerate(PLAIN) if h is not None and "comment" not in h}
    assert rows(Pg.page_elements(pages)) == rows(Pg.page_elements_dom(pages))
    got = {(r.page_id - len(PLAIN), r.txt) for r in Pg.page_elements(pages).where(f"page_id >= {len(PLAIN)}").collect()}
    assert got == {(0, "it\u2019s \u2026 x\u00e9"), (1, "you idiot"), (1, "la plage"), (2, "both once"), (3, "out in end"), (3, "in")}
    s = Pg.Settings.from_text("la", auto_scan=True)
    flagged = Pg.scan_pages(pages, s, r"\.example\.com$").where(f"page_id = {len(PLAIN) + 1}")
    assert sorted((r.txt, r.reason) for r in flagged.collect()) == [("la plage", "blocklist"), ("you idiot", "classifier")]


def test_dom_path_classes_and_nesting():
    got = element_texts(HTML)
    assert got[0] == "Top levelinner idiot"  # .comment holds its nested comment
    assert got[1] == "inner idiot"  # [data-test-id="comment"]
    assert got[2:5] == ["First & only", "Second\nline", "Third unclosed"]
    assert element_texts(None) == []


def test_scan_reasons_and_settings_rescan_t5(spark):
    pages = spark.createDataFrame(
        [(1, "https://www.reddit.com/r/a", "<p>you idiot</p><p>la plage</p><p>so dumb</p><p>fine</p>"),
         (2, "https://example.org/", "<p>you idiot</p>")],
        "page_id long, url string, html string",
    )
    s = Pg.Settings.from_text("la, ,idiot", auto_scan=True, privacy_mode=True)
    got = {r.txt: (r.reason, r.blur, r.queued) for r in Pg.scan_pages(pages, s, r"\.reddit\.com$").collect()}
    assert got == {"you idiot": ("blocklist", True, True), "la plage": ("blocklist", True, False),
                   "so dumb": ("classifier", True, True)}
    strict = Pg.Settings.from_text("", auto_scan=True, threshold_percent=95)
    assert Pg.scan_pages(pages, strict, r"\.reddit\.com$").count() == 0
    off = Pg.Settings.from_text("idiot", auto_scan=False)
    assert [r.txt for r in Pg.scan_pages(pages, off, r"\.reddit\.com$").collect()] == ["you idiot"]
    both = Pg.scan_pages(pages, s, r"\.reddit\.com$")
    assert Pg.dedupe_flags(both.unionByName(both)).count() == 3


def test_scan_elements_equals_scan_pages(spark):
    pages = spark.createDataFrame([(1, "https://www.reddit.com/", "<p>you idiot</p><p>la plage</p><p>so dumb</p>")],
                                  "page_id long, url string, html string")
    s = Pg.Settings.from_text("la", auto_scan=True)
    a = rows(Pg.scan_pages(pages, s, r"\.reddit\.com$"))
    b = rows(Pg.scan_elements(Pg.page_elements(pages).select("page_id", "pos", "txt"), s))
    assert a == b and len(a) == 3
