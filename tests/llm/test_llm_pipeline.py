import hashlib
import re
from collections import Counter, defaultdict

import corpus_pipeline
from llm_cases import prose, rows
from test_llm_exactdup import brute as exact_brute
from test_llm_simhash import plain_fingerprint, roots

from vigil.llm import common
from vigil.llm.pieces import default_model


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "exact dedup", "simhash near-dedup", "source mixing", "sentencepiece"]
    assert corpus_pipeline.ORACLE_SQL is None


def documents():
    made = [(i, t, lang, s, n) for i, t, lang, s, n, *_ in rows()]
    return made + [(2000 + k, prose(k, 60, lang), lang, "big", 1) for k in range(45) for lang in [["en", "fr", "de"][k % 3]]]


def test_run_equals_brute_force(spark, tmp_path):
    import sentencepiece

    made = documents()
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)

    with_letter = [r for r in made if any(c.isalpha() for c in r[1] or "")]
    left = exact_brute(with_letter)[1].values()  # one (doc_id, text) of each group
    root = roots(plain_fingerprint(t) for _, t in left)
    kept = {}
    for i, t in left:
        r = root[plain_fingerprint(t)]
        kept[r] = min((i is None, i or 0, i, t), kept.get(r, (i is None, i or 0, i, t)))
    sp = sentencepiece.SentencePieceProcessor(model_file=default_model())
    want = set()
    for _, _, i, t in kept.values():
        ids = sp.encode(t)
        want.add((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert set(got) == want
    # Mixing: every source's budget by a plain bisection; each row as often as its source has passes, or once more.
    source_of = {(i, t): s for i, t, _, s, _ in made}
    per, size = Counter(), defaultdict(list)
    for _, _, i, t in kept.values():
        size[source_of[i, t]].append(len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    low, high, total = 0.0, 1.0, sum(map(sum, size.values()))
    for _ in range(60):
        x = (low + high) / 2
        lift = {s: (sum(n) / total) ** x for s, n in size.items()}
        most = max(sum(n) / lift[s] for s, n in size.items())
        low, high = (low, x) if all(lift[s] * most <= 2 * sum(n) for s, n in size.items()) else (x, high)
    for i, *_ in got:
        per[i] += 1
    for s, n in size.items():
        budget, ids = round(lift[s] * most), [i for _, _, i, t in kept.values() if source_of[i, t] == s]
        passes = max(1, budget // sum(n))
        assert all(passes <= per[i] <= passes + 1 for i in ids), s
        used = sum(per[i] * len(re.findall(r"[^\x20\x09-\x0D]+", t)) for _, _, i, t in kept.values() if i in ids)
        assert max(budget, sum(n)) + 1 >= used > max(budget, sum(n)) - max(n) - 1, s


def test_an_empty_table_passes_every_stage(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_return_columns_of_any_name(spark):
    """Names with a dot or a quote, and names that operators use for columns of their own."""
    names = ["a.b", "row", "made", "use", "uses", "c_n", "k_id", "c_id", "__n", "__c_n", "__c_uses", "__made", "x`y"]
    made = [(*r, *range(len(names))) for r in documents()]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names)
    docs = spark.createDataFrame(made, schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        plain = stage(spark, docs.select("doc_id", "text", "lang", "source", "n_chars"), "")
        out = stage(spark, docs, "")
        assert out.columns == docs.columns, name
        assert out.count() == plain.count() > 0
        assert [tuple(r) for r in out.select("`a.b`", "`x``y`").distinct().collect()] == [(0, len(names) - 1)]


def test_what_stays_is_not_shuffled_at_any_size(spark):
    """With no table under the broadcast threshold the texts that stay still lie where they are."""
    keys = "id long, n int"
    made = [(k if k % 9 else None, k % 5, f"text {k}") for k in range(4000)] + [(7, 2, "text 7")] * 3
    docs = spark.createDataFrame(made, "id long, n int, text string")
    gone = [(k if k % 9 else None, k % 5) for k in range(0, 4000, 10)]
    gone = sorted(set(gone), key=repr)
    key = {"id": docs["id"], "n": docs["n"]}
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        dropped, repeated = spark.createDataFrame(gone, keys), spark.createDataFrame([(7, 2)], keys)
        rows = common.packed(docs, k_id=docs["id"], k_n=docs["n"])
        clear, met = common.sieved(rows, dropped, ["id", "n"])
        plan = clear._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan and "BroadcastExchange" in plan
        out = sorted((tuple(r) for r in common.drop_rows(docs, key, dropped, repeated).collect()), key=repr)
        hit = sum((i, n) in set(gone) for i, n, _ in made)
        assert hit <= met.count() <= hit + 5 and clear.count() + met.count() == len(made)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    left = [r for r in made if r[:2] not in gone]
    assert out == sorted([r for r in left if r[:2] != (7, 2)] + [(7, 2, "text 7")], key=repr)


def test_a_sieve_of_no_key_clears_every_row(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "id long, text string")
    none = docs.select("id").where("false")
    assert common.drop_rows(docs, {"id": docs["id"]}, none, none).count() == 3
