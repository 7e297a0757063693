import math
import random

import numpy as np
from llm_cases import empty, frame, prose, rows

from vigil.llm import langid
from vigil.llm.queries import op8_language_id


def labelled(n=60):
    return [(1000 + k, prose(k, 40, lang), lang, "s", 1, "x", 7, 0.5, 3, 9, "c", "b", "p", "no", 11) for k in range(n) for lang in [["en", "fr", "de"][k % 3]]]


def test_held_out_accuracy_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op8_language_id(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").toPandas()
    assert len(got) > 150
    assert (got["lang"] == got["lang_pred"]).mean() > 0.98


def test_edge_rows(spark):
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(frame(spark, rows() + labelled())).collect()}
    by_id = {i: p for i, p in got}
    assert [by_id[i] for i in (0, 1, 2, 3)] == ["und"] * 4
    assert (by_id[4], by_id[7], by_id[14]) == ("en", "fr", "de")
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert got[(0, "und")]["score"] == 0


def test_labels_of_held_out_rows_are_never_read(spark):
    import zlib

    made = labelled()
    swapped = [(i, t, "de" if zlib.crc32(str(i).encode()) % 5 == 0 else lang, "other", *r) for i, t, lang, _, *r in made]
    a, b = (sorted(langid.identify(frame(spark, m)).collect()) for m in (made, swapped))
    assert a == b


def test_mixture_proportions_and_sets():
    langs, table = ["en", "fr"], np.full((langid.BUCKETS, 2), -12.0)
    for j, lang in enumerate(langs):
        b = langid.words_of([prose(1, 3000, lang)])[0]
        table[:, j] = np.log((np.bincount(b, minlength=langid.BUCKETS) + 0.5) / (len(b) + 0.5 * langid.BUCKETS))
    half = prose(2, 150, "en") + " " + prose(3, 50, "fr")
    lang, score, sets, shares = zip(*langid.predict([half, prose(4, 100, "fr"), ""], langs, table), strict=True)
    assert lang == ("en", "fr", "und")
    assert 0.6 < score[0] < 0.85 and score[1] > 0.99 and score[2] == 0
    assert sets == (["en", "fr"], ["fr"], []) and abs(sum(shares[0]) - 1) < 1e-9 and shares[2] == []


def plain_fit(words, allowed):
    """Expectation-maximisation by loops: shares and log likelihood."""
    share = {j: 1 / len(allowed) for j in allowed}
    value = -math.inf
    while True:
        total = [sum(share[j] * w[j] for j in allowed) for w in words]
        now = sum(math.log(t) for t in total)
        if now - value < langid.GAIN or len(allowed) == 1:
            return share, now
        value = now
        share = {j: sum(share[j] * w[j] / t for w, t in zip(words, total, strict=True)) / len(words) for j in allowed}


def plain_mixture(words, n_langs):
    """Every prefix of the ranking, without an early end."""
    full = plain_fit(words, list(range(n_langs)))[0]
    rank = sorted(full, key=lambda j: (-full[j], j))
    best = (-math.inf, None)
    for k in range(1, n_langs + 1):
        share, value = plain_fit(words, rank[:k])
        value -= langid.PENALTY * (k - 1) * math.log(len(words) + 1)
        if value > best[0]:
            best = (value, share)
    return best[1]


def test_mixtures_equal_a_plain_loop():
    rnd, n_langs = random.Random(5), 8
    texts = []
    for k in range(40):
        spoken = rnd.sample(range(n_langs), 1 + k % n_langs)
        texts.append([[rnd.uniform(0.5, 1) if j == mine else rnd.uniform(0, 0.4) ** (1 + k % 3) for j in range(n_langs)] for mine in rnd.choices(spoken, k=rnd.choice([1, 3, 40, 400]))])
    likely = np.maximum(np.array([w for t in texts for w in t]), langid.FLOOR)
    start = np.cumsum([0] + [len(t) for t in texts])[:-1]
    got = langid.mixtures(likely, start)
    sizes = set()
    for k, t in enumerate(texts):
        want = plain_mixture([[max(x, langid.FLOOR) for x in w] for w in t], n_langs)
        sizes.add(len(want))
        assert set(np.flatnonzero(got[k])) == set(want)
        assert all(abs(got[k, j] - want[j]) < 1e-6 for j in want)
    assert {1, 2, 6, 8} <= sizes  # sets of any size are found


def test_rows_equal_a_plain_loop(spark):
    """The registered query's columns against the loop, with the table that Spark learned."""
    docs = frame(spark, rows() + labelled() + [(5000, " ".join(prose(k, 70, lang) for k, lang in enumerate(("en", "fr", "de"))), None, *rows()[0][3:])])
    langs, table = langid.learn(docs)
    got = {(r["doc_id"], r["lang_pred"]): r for r in langid.identify(docs).collect()}
    (all_three,) = [r for (i, _), r in got.items() if i == 5000]
    assert set(all_three["langs"]) == {"en", "fr", "de"}
    for i, t, *_ in [r for r in docs.select("doc_id", "text").collect() if r["doc_id"] in (4, 7, 12, 14, 100, 5000, 1001)]:
        bucket, word, _, _ = langid.words_of([t])
        logs = [[0.0] * len(langs) for _ in range(int(word[-1]) + 1)]
        for b, w in zip(bucket.tolist(), word.tolist(), strict=True):
            for j in range(len(langs)):
                logs[w][j] += float(table[np.array([b]), j][0])
        want = plain_mixture([[max(math.exp(x - max(w)), langid.FLOOR) for x in w] for w in logs], len(langs))
        rank = sorted(want, key=lambda j: (-want[j], j))
        row = got[i, langs[rank[0]]]
        assert row["langs"] == [langs[j] for j in rank]
        assert np.allclose(row["shares"], [want[j] for j in rank], atol=1e-6) and abs(row["score"] - min(1.0, want[rank[0]])) < 1e-6


def test_nothing_to_learn_and_empty_table(spark):
    got = langid.identify(frame(spark, [(i, t, None, s, *r) for i, t, _, s, *r in rows()]))
    assert {(r["lang_pred"], r["score"]) for r in got.collect()} == {("und", 0.0)}
    assert langid.identify(empty(spark)).count() == 0


def test_stage_keeps_clean_rows(spark):
    docs = frame(spark, rows() + labelled())
    out = langid.keep_identified(docs)
    assert out.columns == docs.columns
    ids = [r["doc_id"] for r in out.collect()]
    assert not {0, 1, 2, 3} & set(ids)
    assert {4, 5, 7, 9, 14, *range(1000, 1060)} <= set(ids) and ids.count(16) == 2


def test_every_label_is_learned(spark):
    # 80 languages, each with letters of its own; the last by name are as frequent as the others or rarer.
    def text(j, k):
        return " ".join("".join(chr(0x4E00 + 40 * j + (7 * k + 3 * w + c) % 40) for c in range(4)) for w in range(12))

    made = [(1000 * j + k, text(j, k), f"l{j:02}", "s", 1, "x", 7, 0.5, 3, 9, "c", "b", "p", "no", 11) for j in range(80) for k in range(14 if j < 64 else 10)]
    got = langid.identify(frame(spark, made)).where("held_out").collect()
    assert len({r["doc_id"] // 1000 for r in got}) > 70
    right = sum(r["lang_pred"] == f"l{r['doc_id'] // 1000:02}" for r in got)
    print("right", right, "of", len(got))
    assert right == len(got)
