import random
import re

import numpy as np
import pandas as pd
import xxhash
from llm_cases import empty, frame, keyed, rows

from vigil.llm import simhash
from vigil.llm.components import components


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(prints, radius=2):
    parent = {x: x for x in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    some = sorted(parent)
    for k, a in enumerate(some):
        for b in some[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(b)] = find(a)
    return {x: find(x) for x in some}


def near(made):
    prints = [plain_fingerprint(t) for _, t, *_ in made]
    root = roots(prints)
    low = {}
    for (i, *_), p in zip(made, prints, strict=True):
        if i is not None:
            low[root[p]] = min(i, low.get(root[p], i))
    return sorted([(i, f"{p:016x}", low.get(root[p])) for (i, *_), p in zip(made, prints, strict=True)], key=repr)


def test_fingerprint_equals_plain_python():
    for _, t, *_ in rows():
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_bit_planes_equal_brute_force():
    rnd = random.Random(1)
    prints = np.array([rnd.getrandbits(64) for _ in range(40)] + [0, 1, 3, 7, 2**63, 2**64 - 1], np.uint64)
    prints = np.unique(np.r_[prints, prints[:20] ^ np.uint64(5), prints[:20] ^ np.uint64(1 << 40)])
    for radius in (1, 2, 3):
        rows_near, bits = simhash.near_bits(prints, np.zeros(len(prints), np.int64), np.arange(len(prints)), 2, radius)
        got = {int(r): int.from_bytes(b.astype("<u8").tobytes(), "little") for r, b in zip(rows_near, bits, strict=True)}
        for k, x in enumerate(prints.tolist()):
            want = sum(1 << j for j, y in enumerate(prints.tolist()) if j != k and (x ^ y).bit_count() <= radius)
            assert got.get(k, 0) == want


def test_links_connect_hot_buckets_after_refinement(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", 60)
    rnd = random.Random(2)
    prints = {rnd.getrandbits(64) for _ in range(60)}
    prints |= {x ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for x in list(prints)[:30]}
    hot = rnd.getrandbits(64)
    prints |= {hot ^ (rnd.getrandbits(9) << 20) for _ in range(150)}
    df = spark.createDataFrame(pd.DataFrame({"fp": np.array(sorted(prints), np.uint64).view(np.int64)}))
    got = {}
    for r in components(simhash.links(df)).collect():
        got.setdefault(r["root"], set()).add(r["node"] % (1 << 64))
    want = {}
    for x, r in roots(prints).items():
        want.setdefault(r, set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_groups_equal_brute_force(spark):
    df = simhash.near_groups(frame(spark))
    assert df.columns == ["doc_id", "fingerprint", "component_id"]
    assert keyed(df, *df.columns) == near(rows())


def test_one_row_of_each_component_stays(spark):
    docs = frame(spark)
    out = simhash.drop_near(docs)
    assert out.columns == docs.columns
    made = near(rows())
    got = sorted((r["doc_id"] for r in out.collect()), key=repr)
    components_ = {c for _, _, c in made if c is not None}
    alone = {f for _, f, c in made if c is None}
    assert got == sorted([*components_, *[None] * len({r for f, r in roots(int(f, 16) for f in alone).items()})], key=repr)


def test_empty_table(spark):
    assert simhash.near_groups(empty(spark)).count() == 0
    assert simhash.drop_near(empty(spark)).count() == 0
