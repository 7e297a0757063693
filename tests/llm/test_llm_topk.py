import math
import random

import numpy as np
import pandas as pd
import pytest

from vigil.llm import topk

SCHEMA = "vec_id long, embedding array<double>, label int, seg int, v string, query_id long"


def made(n=260, dim=8, seed=3):
    rnd = random.Random(seed)
    out = [(k, [rnd.uniform(-1, 1) for _ in range(dim)]) for k in range(n)]
    out += [(k, out[7][1]) for k in range(n, n + 90)]  # a hot vector
    out += [(1000, None), (1050, [None] + [0.1] * (dim - 1)), (1100, [math.nan] * dim), (1150, [math.inf] + [0.0] * (dim - 1)), (1200, [0.5] * (dim + 1)), (1250, [])]
    out += [(1300, [0.25] * dim), (1300, [0.25] * dim), (None, [0.3] * dim), (-50, [-0.001] * dim)]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "v", 3) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, by=50, k=5):
    used = []
    dim = max((len(v) for _, v in rows if v), key=[len(v) for _, v in rows if v].count)
    for i, v in rows:
        if i is None or v is None or len(v) != dim or any(x is None or not math.isfinite(x) for x in v):
            continue
        used.append((i, [min(max(math.floor(256 * x), -(2**63)), 2**63 - 1) for x in v]))
    out = []
    for q in sorted({i for i, _ in used if i % by == 0}):
        own = [v for i, v in used if i == q]
        score = lambda a, b: min(max(sum(x * y for x, y in zip(a, b, strict=True)), 1 - 2**63), 2**63 - 1)
        scores = sorted((-score(a, v), i) for a in own for i, v in used if i != q)[:k]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores, 1)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # many segments and chunks
        for name, n in (("SEGMENT", 30), ("CHUNK", 3), ("PIVOTS", 5)):
            monkeypatch.setattr(topk, name, n)
    rows = made()
    df = topk.top_k(frame(spark, rows))
    assert df.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, df.collect())) == brute(rows)


def test_fewer_candidates_and_empty_table(spark):
    rows = [(0, [0.5, 0.25]), (1, [0.5, 0.25]), (50, [-0.5, 0.0])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == brute(rows)
    assert topk.top_k(frame(spark, [])).count() == 0


def test_large_components_are_exact():
    a = np.array([[2**31 + 1, 3], [-(2**30), 5]], np.int64)
    assert topk.product(a, a).tolist() == [[int(x) for x in r] for r in (a.astype(object) @ a.astype(object).T)]


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v, q, p = (rng.integers(-200, 200, (n, 6)) for n in (400, 40, 5))
    norm = lambda x: (x.astype(float) ** 2).sum(axis=1)
    at = ((v[:, None] - p) ** 2).sum(axis=2).argmin(axis=1)
    r = np.sqrt(norm(v - p[at]))
    for k in range(len(p)):
        own = np.flatnonzero(at == k)
        own = own[np.argsort(r[own])]
        for part in np.array_split(own, 4):
            if len(part):
                most = topk.bound(norm(q), np.sqrt(norm(q - p[k])), norm(p[k : k + 1])[0], r[part].min(), r[part].max(), norm(v[part]).max())
                assert ((q @ v[part].T).max(axis=1) <= most).all()


def test_a_chunk_of_queries_meets_blocks_in_any_order():
    rng = np.random.default_rng(2)
    v, p = rng.integers(-99, 99, (64, 4)), np.zeros((1, 4), np.int64)
    r = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    order = np.argsort(r)
    blocks = pd.DataFrame([{"pivot": 0, "r0": r[x].min(), "r1": r[x].max(), "norm": (r[x] ** 2).max(), "rows": b"", "ids": x.astype(np.int64).tobytes(), "vectors": v[x].tobytes()} for x in np.array_split(order, 8)])
    queries = pd.DataFrame({"query": np.arange(64) + 5, "query_id": np.arange(64), "v": [x.tobytes() for x in v], "floor": -np.inf})
    got = topk._met(3, 4, p)(queries, blocks)
    for k in range(64):
        want = sorted((-int(v[k] @ v[j]), j) for j in range(64) if j != k)[:3]
        mine = got[got.query_id == k]
        assert sorted(zip(-mine.score, mine.vec_id, strict=True)) == want


def test_equal_vectors_over_several_segments(spark, monkeypatch):
    for name, n in (("SEGMENT", 30), ("CHUNK", 500), ("PIVOTS", 3)):
        monkeypatch.setattr(topk, name, n)
    got = sorted(map(tuple, topk.top_k(frame(spark, [(k, [0.5, 0.25, -0.125]) for k in range(150)]), by=2).collect()))
    assert len(got) == 75 * topk.TOP == len({(q, v) for q, _, v, _ in got})
    assert got == brute([(k, [0.5, 0.25, -0.125]) for k in range(150)], by=2)


def test_every_row_is_a_candidate(spark):
    rows = [(7, [0.7] * 4), (7, [3.0] * 4), (50, [1.0] * 4), (8, [0.9] * 4), (8, [0.9] * 4), (100, [0.1] * 4), (100, [-1.0] * 4), (100, [0.1] * 4)]
    got = sorted(map(tuple, topk.top_k(frame(spark, rows)).collect()))
    assert got == brute(rows)
    assert [x[2:] for x in got if x[0] == 50][:3] == [(7, 786432), (8, 235520), (8, 235520)]


@pytest.mark.parametrize("small", [False, True])
def test_scores_beyond_64_bits(spark, monkeypatch, small):
    if small:
        for name, n in (("SEGMENT", 4), ("CHUNK", 2), ("PIVOTS", 3), ("BLOCK", 2)):
            monkeypatch.setattr(topk, name, n)
    rows = [(k, [k * 0.01, 1.0, -2.0, 0.5]) for k in range(20)] + [(50, [1e20] * 4), (51, [-1e20] * 4), (52, [1e300] * 4), (53, [1e9, -1e9, 1e5, 3.0]), (100, [1e7, 2e7, -1e8, 0.25])]
    assert sorted(map(tuple, topk.top_k(frame(spark, rows)).collect())) == brute(rows)


def test_a_hot_row_fills_several_segments(spark, monkeypatch):
    for name, n in (("SEGMENT", 30), ("CHUNK", 7), ("PIVOTS", 3)):
        monkeypatch.setattr(topk, name, n)
    rows = made(60) + [(9, [0.4] * 8)] * 120
    df = frame(spark, rows)
    index = topk.build(df)[0].groupBy("seg").agg(topk.F.sum(topk.F.length("ids") / 8).alias("n")).collect()
    assert len(index) > 5 and max(r["n"] for r in index) < 100
    assert sorted(map(tuple, topk.top_k(df).collect())) == brute(rows)
