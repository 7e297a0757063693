import math
import re
from collections import Counter, defaultdict

import pytest
from llm_cases import empty, frame, rows

from vigil.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


@pytest.fixture(scope="module")
def totals(spark):
    return spark.createDataFrame([("a", 8000, 10), ("b", 1000, 10), ("c", 500, 10), ("d", 0, 1)], "source string, tokens long, rows long")


def test_exponent_meets_the_repetition_limit(totals):
    x = mixing.exponent(totals, repetition=3.0)
    assert math.isclose(16 ** (1 - x), 3.0, rel_tol=1e-6)
    assert mixing.exponent(totals, repetition=16.5) == 0.0
    assert mixing.exponent(totals, repetition=1.0) == 1.0


def test_exponent_meets_the_entropy(totals):
    x = mixing.exponent(totals, entropy=0.8)
    lift = [(n / 9500) ** x for n in (8000, 1000, 500)]
    w = [v / sum(lift) for v in lift]
    assert math.isclose(-sum(v * math.log(v) for v in w), 0.8, abs_tol=1e-6)


def test_exponent_under_a_budget(totals):
    x = mixing.exponent(totals, repetition=4.0, budget=9500)
    lift = {s: (n / 9500) ** x for s, n in (("a", 8000), ("b", 1000), ("c", 500))}
    assert math.isclose(lift["c"] / sum(lift.values()) * 9500 / 500, 4.0, rel_tol=1e-5)


def test_passes_fill_the_budgets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    made = rows()
    uses = mixing.permutations(frame(spark)).collect()
    plan = {r["source"]: r for r in mixing.mixture(frame(spark).select("source", mixing.F.regexp_count("text", mixing.F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens")).na.fill(0, ["tokens"])).collect()}
    tokens, count = Counter(), Counter()
    for _, t, _, s, *_ in made:
        tokens[s] += words(t)
        count[s] += 1
    assert {s: r["tokens"] for s, r in plan.items()} == dict(tokens)
    by_pass = defaultdict(list)
    for u in uses:
        by_pass[u["source"], u["pass"]].append(u)
    for s, r in plan.items():
        assert abs(r["budget"] - r["weight"] * max(t / plan[x]["weight"] for x, t in tokens.items() if t)) <= 0.5 + 1e-6 or not tokens[s]
        assert r["passes"] >= 1  # every row is used
        for p in range(r["passes"]):
            assert len(by_pass[s, p]) == count[s]
        part = by_pass.get((s, r["passes"]), [])
        assert sum(u["tokens"] for u in part) <= r["rest"]
        for p in range(r["passes"] + 1):
            # The starts are those of one order of the pass's rows, without a gap, block by block.
            order = sorted(by_pass.get((s, p), []), key=lambda u: (u["token_start"], u["tokens"]))
            at, blocks = 0, []
            for u in order:
                assert u["token_start"] == at
                at += u["tokens"]
                if u["tokens"] and (not blocks or blocks[-1] != u["block"]):
                    blocks.append(u["block"])
            assert len(blocks) == len(set(blocks))


def test_repetition_stays_within_the_limit(spark):
    made = [(k, "w " * 10, "en", "big" if k < 64 else f"s{k % 4}", 1, "x", 7, 0.5, 3, 9, "c", "b", "p", "no", 11) for k in range(80)]
    docs = frame(spark, made)
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    assert all(n[k] == 1 for k in range(64)) and all(n[k] == 2 for k in range(64, 80))


def test_mix_keeps_each_row_with_its_columns(spark):
    n = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix(frame(spark)).collect())
    want = Counter((i, t, s) for i, t, _, s, *_ in rows())
    assert n.keys() == want.keys() and all(n[k] >= want[k] for k in want)


def test_empty_table_and_no_tokens(spark):
    assert mixing.permutations(empty(spark)).count() == 0 and mixing.mix(empty(spark)).count() == 0
    bare = [r for r in rows() if not words(r[1])]
    assert mixing.mix(frame(spark, bare)).count() == len(bare)


def test_no_source_loses_rows_to_rounding(spark):
    """Token counts of 10^12 to 10^15: the budget is never below the source's own tokens."""
    big = [(f"s{k}", 10**12 * 3**k + 7919 * k + 1) for k in range(7)]
    for target in ({}, {"repetition": 1.0}, {"repetition": 5.0}, {"repetition": None, "entropy": 1.2}):
        plan = mixing.mixture(spark.createDataFrame(big, "source string, tokens long"), **target).collect()
        assert len(plan) == 7 and all(r["passes"] >= 1 and r["budget"] >= r["tokens"] for r in plan)
        assert min(r["budget"] - r["tokens"] for r in plan) == 0  # and as small as that allows


def test_null_ids_are_dealt_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    made = [(None, f"text {k} " + "w " * (k % 5), "en", "big", 1, "x", 7, 0.5, 3, 9, "c", "b", "p", "no", 11) for k in range(80)]
    uses = Counter(r["block"] for r in mixing.permutations(frame(spark, made)).collect())
    assert sum(uses.values()) == 80 and len(uses) > 12 and max(uses.values()) < 16


@pytest.mark.parametrize("target", [{}, {"repetition": 5.0}, {"repetition": None, "entropy": 1.2}, {"budget": 900}, {"budget": 40000, "repetition": None, "entropy": 1.0}])
def test_mix_uses_rows_as_often_as_the_permutations(spark, monkeypatch, target):
    """Whole blocks, the block that the budget ends in, and rows that repeat in it."""
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 4)
    made = [(i, t, lang, s, n, *x) for k, (i, t, lang, s, n, *x) in enumerate(rows()) if i is not None]
    made += [(900 + k % 3, f"again and again {k % 3}", "en", f"s{k % 2}", 1, "x", k, 0.5, 3, 9, "c", "b", "p", "no", 11) for k in range(24)]
    docs = frame(spark, made)
    want = Counter((u["doc_id"], u["source"], u["tokens"]) for u in mixing.permutations(docs, **target).collect())
    got = Counter((r["doc_id"], r["source"], words(r["text"])) for r in mixing.mix(docs, **target).collect())
    assert got == want and sum(want.values())
