"""Reversed ranked search against brute force."""

import math
import re

import numpy as np
import pytest
from llm_cases import empty, frame, rows

from vigil.llm import ranked

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, doc_id long, score long"


def split(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(items, docs, k=20):
    made = [(i, split(t)) for i, t in docs]
    made = [(i, t) for i, t in made if t]
    total, length = len(made), sum(len(t) for _, t in made)
    out = []
    for item, text in items:
        use = split(text)
        weight = {t: math.floor(1000 * math.log((2 * total + 2) / (2 * sum(t in x for _, x in made) + 1))) for t in set(use)}
        found = []
        for doc, t in made:
            m = 100 - 25 + (25 * len(t) * total) // length
            score = sum(weight[x] * ((10**9 * t.count(x)) // (1000 * t.count(x) + 12 * m)) for x in use if x in t)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def items():
    some = [(i, t) for i, t, *_ in rows() if i is not None and i % 4 == 0]
    return [*some, (500, None), (501, ""), (502, "cat cat CAT dog"), (502, "the the town"), (None, "où les"), (503, "nowhere"), (504, "?! ."), (505, "É é ÉÉ 𝒳 中文字")]


def table(spark, made):
    return spark.createDataFrame([(i, t, 1, 2) for i, t in made], ITEMS)


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


@pytest.mark.parametrize("index_bytes,cells", [(4 << 20, 1 << 22), (300, 40)])
def test_equals_brute_force(spark, monkeypatch, index_bytes, cells):
    monkeypatch.setattr(ranked, "MERGE", 2)
    docs = [(i, t) for i, t, *_ in rows()]
    found = ranked.search(table(spark, items()), frame(spark), index_bytes=index_bytes, cells=cells)
    assert dict(found.dtypes)["rank"] == "int"
    assert got(found) == brute(items(), docs)


def test_large_ties_go_to_smaller_ids(spark):
    docs = [(i, "same words here", "en", "a", 1) for i in range(300)] + [(-5, "other words", "en", "a", 1)]
    frame_ = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(7)
    found = got(ranked.search(table(spark, [(1, "same here")]), frame_, k=7))
    assert [r[2] for r in sorted(found, key=lambda r: r[1])] == list(range(7))


def test_empty_tables(spark):
    assert got(ranked.search(table(spark, []), frame(spark))) == []
    assert got(ranked.search(table(spark, items()), empty(spark))) == []
    assert got(ranked.search(table(spark, [(1, None)]), frame(spark))) == []


def test_sums_are_exact_beyond_doubles():
    value = np.array([(1 << 61) + 12345, 7, (1 << 60) + 1], np.int64)
    assert ranked._sums(np.array([1, 1, 0]), value, 3, False).tolist() == [(1 << 60) + 1, (1 << 61) + 12352, 0]
