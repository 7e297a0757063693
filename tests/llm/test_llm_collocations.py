"""Phrase mining against brute force; tile counts against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import empty, frame, rows

from vigil.llm import collocations as C


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall("[^\x20\x09]+", p) for p in re.split("[.,;:!?\x0a-\x0d]", low)]


def brute(docs, least=10, top=2000):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            n[lang] += len(ws)
            for size in (1, 2, 3):
                f.update((lang, *ws[i : i + size]) for i in range(len(ws) - size + 1))
    cands = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in cands.items():
        lang, *ws = p
        if any(len(q) > len(p) and q[0] == lang and 100 * b >= 50 * a and any(list(q[1 + i : 1 + i + len(ws)]) == ws for i in range(len(q) - len(p) + 1)) for q, b in cands.items()):
            continue
        cuts = [(10**6 * a * a // (f[(lang, *ws[:k])] * f[(lang, *ws[k:])]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[(lang, *ws[:k])], f[(lang, *ws[k:])]))
    return sorted((lang, r + 1, x[2].decode(), -x[1], x[3], x[4], n[lang], -x[0]) for lang, xs in out.items() for r, x in enumerate(sorted(xs)[:top]))


COLS = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def table(spark, docs, parts=5):
    return spark.createDataFrame([(t, lang, "x", 1, 2) for lang, t in docs], "text string, lang string, word string, n long, rank int").repartition(parts)


def corpus(seed):
    rnd = random.Random(seed)
    words = ["a", "b", "C", "d\x00", "é", "É", "new", "york", "city", "\x1c", "中", "x" * 70, *[f"w{i}" for i in range(40)]]
    out = []
    for _ in range(120):
        toks = []
        while len(toks) < rnd.randint(0, 60):
            toks += rnd.choice([["new", "york", "city"], ["New", "York"], ["x" * 70, "is", "long"], [rnd.choice(words)], [rnd.choice(words), rnd.choice(",.!\n\r;")]])
        out.append((rnd.choice(["en", "fr", None, "und"]), rnd.choice([" ", "  ", "\t"]).join(toks)))
    return [*out, ("de", None), ("it", ""), ("it", " \t.,\n"), ("es", "one two " * 400), ("es", "a b c " * 9)]


@pytest.mark.parametrize("sizes", [C.Sizes(), C.Sizes(4, 8, 50, 2, 0.3, 1 << 15, 1 << 12, 30, 40), C.Sizes(1, 64, 300, 3, 1e-9, 1 << 6, 1 << 3, 5, 7)])
def test_equals_brute_force(spark, sizes):
    docs = corpus(sizes.head_bits)
    got = sorted(tuple(r) for r in C.mine(table(spark, docs), sizes=sizes).select(*COLS).collect())
    want = brute(docs)
    assert len(want) > 20 and any(len(r[2].split(" ")) == 3 for r in want)
    assert got == want


def test_top_and_least(spark):
    docs = corpus(9)
    got = sorted(tuple(r) for r in C.mine(table(spark, docs, 3), least=4, top=6).select(*COLS).collect())
    assert got == brute(docs, 4, 6)


def test_awkward_rows(spark):
    got = sorted(tuple(r) for r in C.mine(frame(spark)).select(*COLS).collect())
    assert got == brute([(r[2], r[1]) for r in rows()]) and got


def test_empty_table(spark):
    assert C.mine(empty(spark)).select(*COLS).collect() == []


@pytest.mark.parametrize("dense", [1 / 16, 1e-9, 9])
def test_tile_counts(dense):
    rng = np.random.default_rng(1)
    a, b = rng.geometric(0.05, 3000) - 1, rng.geometric(0.02, 3000) + (rng.random(3000) < 0.01) * (1 << 30)
    x, y, n = C.tile_counts(a, b, 4, dense)
    assert Counter(dict(zip(zip(x.tolist(), y.tolist(), strict=True), n.tolist(), strict=True))) == Counter(zip(a.tolist(), b.tolist(), strict=True))
    assert all(len(v) == 0 for v in C.tile_counts(a[:0], b[:0], 4, dense))


def test_scores_are_exact_beyond_64_bits(spark):
    a, l, r = 3_000_000_007, 3_500_000_011, 9_000_000_000_001
    got = spark.range(1).selectExpr(f"{a}L AS a", f"{l}L AS l", f"{r}L AS r").select(C._exact("a", "l", "r")).first()[0]
    assert got == 10**6 * a * a // (l * r)
