import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from llm_cases import EXTRA, empty, frame, keyed, prose, rows

from vigil.llm import suffix

N = suffix.LENGTH


def brute(made, length=N):
    raw = [(i, (t or "").encode()) for i, t, *_ in made]
    seen = {}
    for _, r in raw:
        for k in range(len(r) - length + 1):
            s = r[k : k + length]
            seen[s] = seen.get(s, 0) + 1
    out = []
    for i, r in raw:
        gone = bytearray(len(r))
        for k in range(len(r) - length + 1):
            if seen[r[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(c for c, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def crafted():
    passage, rnd = prose("passage", 90, "fr"), random.Random(4)
    short = passage.encode()[: N - 1].decode("utf-8", "ignore")
    texts = [passage, "x" + passage, passage + "y", f"{prose(1, 50)} {passage} {prose(2, 50)}", f"{passage} {prose(3, 10)} {passage}"]
    texts += [short + str(k) * 30 for k in range(20)]  # share a core, no string
    texts += [prose(9, 200)[k : k + 700] for k in (0, 10, 333, 400)]
    texts += ["ab" * 450, "ba" * 300, "ab" * 199 + "a", "é" * 230, "é" * 199, "é" * 200 + "e"]
    texts += ["".join(rnd.choice("ab") for _ in range(900)), None, "", "z" * N, "z" * (N - 1)]
    return [(200 + k, t, "en", "s", 1, *EXTRA) for k, t in enumerate(texts)]


@pytest.mark.parametrize("group", [256, 3])
def test_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix, "GROUP", group)  # 3: groups are refined to the last step
    made = crafted() + (rows() if group > 3 else [])
    df = suffix.report(frame(spark, made))
    assert df.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert keyed(df, *df.columns) == brute(made)


def test_empty_table_and_no_repeats(spark):
    assert suffix.report(empty(spark)).count() == 0
    made = [(k, prose(k, 100), "en", "s", 1, *EXTRA) for k in range(3)]
    assert {r["n_removed"] for r in suffix.report(frame(spark, made)).collect()} == {0}


def test_blind_trie_sorts_and_joins_equal_suffixes():
    rnd = random.Random(6)
    for _ in range(60):
        pool = ["".join(rnd.choice("ab") for _ in range(12)) for _ in range(4)]
        raw = "".join(rnd.choice(pool) for _ in range(30)).encode()
        at = rnd.sample(range(len(raw) - 12), 40)
        leaves = suffix.blind_trie(raw, at, [1] * len(at), 12)
        strings = [raw[at[leaf[0]] :][:12] for leaf, _ in leaves]
        assert strings == sorted(set(raw[a : a + 12] for a in at))
        for (leaf, w), s in zip(leaves, strings, strict=True):
            assert w == len(leaf) and sorted(leaf) == [k for k, a in enumerate(at) if raw[a : a + 12] == s]


def test_runs_cover_every_start_once_also_over_pieces(monkeypatch):
    text = prose("runs", 500) + "a" * 900 + prose("more", 300)
    pdf = pd.DataFrame({"doc_id": [1, 2], "text_hash": [5, 6], "text": [text, "k" + text]})
    whole = pd.concat(suffix._runs(iter([pdf])))
    monkeypatch.setattr(suffix, "PIECE", 700)
    cut = pd.concat(suffix._runs(iter([pdf])))
    for made in (whole, cut):
        for doc, size in ((1, len(text)), (2, len(text) + 1)):
            own = made[made.doc_id == doc]
            at = np.concatenate([np.arange(a, a + s) for a, s in zip(own["at"], own["starts"], strict=True)])
            assert sorted(at) == list(range(size - N + 1))
    # A string's core is the same wherever it starts.
    core = {(d, a + k): c for c, d, a, s in zip(whole.core, whole.doc_id, whole["at"], whole.starts, strict=True) for k in range(s)}
    assert all(core[1, k] == core[2, k + 1] for k in range(len(text) - N + 1))
