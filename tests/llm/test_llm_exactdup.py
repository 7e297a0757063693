import hashlib
import re
from collections import Counter, defaultdict

from llm_cases import empty, frame, keyed, rows

from vigil.llm import exactdup


def brute(made):
    groups = defaultdict(list)
    for i, t, *_ in made:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]", "", t or "").encode()).hexdigest()].append((i, t or ""))
    out, left = [], {}
    for sha, g in groups.items():
        best = min(g, key=lambda x: (-len(x[1]), x[0] is None, x[0] or 0))
        left[sha] = best
        out += [(i, best[0], len(g), i == best[0] and len(t) == len(best[1]), sha) for i, t in g]
    return sorted(out, key=repr), left


def test_groups_equal_brute_force(spark):
    df = exactdup.exact_groups(frame(spark))
    assert df.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert keyed(df, *df.columns) == brute(rows())[0]


def test_one_row_of_each_group_stays_with_all_columns(spark):
    docs = frame(spark)
    out = exactdup.drop_copies(docs)
    assert out.columns == docs.columns
    assert Counter((r["doc_id"], r["text"] or "") for r in out.collect()) == Counter(brute(rows())[1].values())


def test_empty_table(spark):
    assert exactdup.exact_groups(empty(spark)).count() == 0
    assert exactdup.drop_copies(empty(spark)).count() == 0


def test_white_space_variants_of_one_id(spark):
    base = [(None, "a b"), (None, "ab"), (13, "c d"), (13, "cd"), (14, "e f"), (14, "e\tf")]
    docs = frame(spark, [(i, t, "en", "a", 3, *rows()[0][5:]) for i, t in base])
    got = Counter((r["doc_id"], r["text"].replace("\t", " ")) for r in exactdup.drop_copies(docs).collect())
    assert got == {(None, "a b"): 1, (13, "c d"): 1, (14, "e f"): 1}
