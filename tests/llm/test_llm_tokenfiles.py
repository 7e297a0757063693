"""Token-ID files: the wavelet matrix against plain arrays, ids against the library, files against brute force."""

import random
import zlib

import numpy as np
import pytest
from llm_cases import empty, frame, rows

from vigil.llm import tokenfiles, wavelet
from vigil.session import checkpoint_subdir


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenfiles.default_tokenizer())


@pytest.mark.parametrize("n,top", [(0, 2), (1, 1), (7, 3), (5000, 50257), (5000, 2), (3001, 70000)])
def test_wavelet_equals_plain_array(monkeypatch, n, top):
    monkeypatch.setattr(wavelet, "BLOCK", 512)
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.01, n) - 1, top - 1).astype(np.uint32)
    w = wavelet.Wavelet(wavelet.build(ids, max(1, (top - 1).bit_length()), b"more", own=3) + b"\n")
    assert w.head["own"] == 3 and w.extra == b"more"
    assert (w.decode() == ids).all()
    pos = rng.integers(0, n, 50) if n else np.zeros(0, int)
    assert (w.access(pos) == ids[pos]).all()
    for token in [0, 1, 5, top - 1, top + 5, 1 << 20]:
        lo, hi = sorted(rng.integers(0, n + 1, 2).tolist())
        want = np.flatnonzero(ids == token)
        assert w.rank(token, [0, lo, n]).tolist() == [int((ids[:p] == token).sum()) for p in (0, lo, n)]
        assert w.count(token) == len(want) and (w.locate(token) == want).all()
        assert w.count(token, lo, hi) == int((ids[lo:hi] == token).sum())
        assert (w.locate(token, lo, hi) == want[(want >= lo) & (want < hi)]).all()


def test_damaged_files_are_refused():
    blob = wavelet.build(np.arange(100), 7)
    for bad in (b"nope" + blob, blob[:-1]):
        with pytest.raises(ValueError):
            wavelet.Wavelet(bad)


def texts():
    rnd = random.Random(3)
    parts = ["a", "the", ".", ",", "...", "?!", "²", "½", "ʀ", "ɏ", "-", "_", "\x1f", "　", "<|", "|>", "\x0b", "'ll", "'T", "The", " ", "  ", "\n", "\n\n", "\t", "é", "ción", "中文", "𝒳", "'s", "'", "12", ".", "<|endoftext|>", "\xa0", " ", "\x1c", "\x85", "\r\n", "!", "don't", "​", "́"]
    hard = ["", " ", "\n", " a", "\na", "a ", "a\n", "a \n b", "<|endoftext|>", " <|endoftext|> x", "=" * 500, " " * 90 + "x", "a" * 3000]
    return hard + ["".join(rnd.choice(parts) for _ in range(rnd.randint(1, 20))) for _ in range(8000)]


def test_ids_equal_the_library(library, monkeypatch):
    some = texts()
    want = [e.ids for e in library.encode_batch(some, add_special_tokens=False)]
    for forms, chars, long in ((1 << 20, 1 << 20, 64), (50, 100, 3)):
        for name, v in (("MAX_FORMS", forms), ("GROUP_CHARS", chars), ("MAX_FORM_CHARS", long)):
            monkeypatch.setattr(tokenfiles, name, v)
        got = tokenfiles.Encoder(tokenfiles.default_tokenizer()).encode(some)
        for t, ids, w in zip(some, got, want, strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == w, repr(t)


def brute(library, made):
    out, at = [], 0
    for doc, text in made:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


@pytest.mark.parametrize("shard", [1 << 22, 200])
def test_report_equals_brute_force(spark, library, shard):
    made = [r for r in rows() if r[0] not in (16,)]  # one row an id, but for whole copies
    made = [r for k, r in enumerate(made) if r[0] is not None]
    folder = checkpoint_subdir(spark, f"tokens-{shard}-{random.random()}")
    tokenfiles.write(frame(spark, made), folder, shard_tokens=shard)
    got = sorted(tuple(r) for r in tokenfiles.report(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    want = brute(library, sorted(((r[0], r[1]) for r in made), key=lambda x: x[0]))
    assert got == sorted(want)


def test_awkward_rows(spark, library):
    folder = checkpoint_subdir(spark, f"tokens-{random.random()}")
    tokenfiles.write(frame(spark), folder)
    got = [tuple(r) for r in tokenfiles.report(spark, folder).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert [r[0] for r in got] == sorted((r[0] for r in rows()), key=lambda x: (x is None, x or 0))  # nulls last
    assert [r[1] for r in got] == np.concatenate([[0], np.cumsum([r[2] for r in got])[:-1]]).tolist()
    want = brute(library, [(r[0], r[1]) for r in rows()])
    assert sorted((r[0], *r[2:]) for r in got if r[0] is not None) == sorted((r[0], *r[2:]) for r in want if r[0] is not None)
    # Lookups from the same files, against the plain ids.
    token = library.encode(" the").ids[0]
    hits = [(r[0], k) for r in rows() for k, i in enumerate([*library.encode(r[1] or "", add_special_tokens=False).ids, 0]) if i == token]
    assert len(hits) > 20
    assert sorted(map(tuple, tokenfiles.locate_token(spark, folder, token).collect()), key=str) == sorted(hits, key=str)
    counts = {}
    for doc, _ in hits:
        counts[doc] = counts.get(doc, 0) + 1
    found = {}
    for doc, n in tokenfiles.count_token(spark, folder, token).collect():
        found[doc] = found.get(doc, 0) + n
    assert found == counts


def test_empty_table(spark):
    folder = checkpoint_subdir(spark, f"tokens-{random.random()}")
    tokenfiles.write(empty(spark), folder)
    assert tokenfiles.report(spark, folder).count() == 0


def test_query(spark, library):
    import pyarrow.parquet as pq

    from vigil.llm.queries import op13_token_files

    sf = "/root/testdata/sf0.001"
    got = [tuple(r) for r in op13_token_files(spark, sf).orderBy("start").select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    docs = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert got == brute(library, sorted((d["doc_id"], d["text"]) for d in docs))


def test_words_go_to_the_model_once_and_spaces_cut_right(library, monkeypatch):

    coder = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    asked = []

    class Asked:
        def encode_batch_fast(self, forms, **more):
            asked.extend(forms)
            return library.encode_batch_fast(forms, **more)

    coder.library = Asked()
    assert coder.encode(["One word, one Élan. One", ""])[0] == np.asarray(library.encode("One word, one Élan. One", add_special_tokens=False).ids, "<u4").tobytes()
    assert sorted(asked) == [",", "."]  # words are one piece of the split: the model takes them as they stand
    coder.encode(["Élan one word, word. One word"])
    assert set(asked) == {",", "."}
    some = [" ", " ", "  ", "\n", "\t", " \n", "\x85", "　", "​", "\x1c", "ab", "Été", "'s", "12", "x9", ".", ",", "ɏ", "×", "漢", "<|endoftext|>"]
    pick = random.Random(3)
    odd = ["".join(pick.choices(some, k=pick.randint(0, 9))) for _ in range(4000)]
    assert coder.encode(odd) == [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(odd, add_special_tokens=False)]


def test_words_go_to_the_model_by_lines_not_one_by_one(library):
    coder = tokenfiles.Encoder(tokenfiles.default_tokenizer())
    model, calls = coder.model, []

    class Counted:
        def encode_batch_fast(self, lines, **more):
            calls.append(len(lines))
            return model.encode_batch_fast(lines, **more)

    coder.model = Counted()
    words = [f"{a}{b}{c}" for a in "abcdefghij" for b in ("ra", "é", "ß", "Ti") for c in "klmnopqrst"]
    some = [" ".join(words), "\n".join(words), "x" + ", ".join(reversed(words)) + "."]
    assert coder.encode(some) == [np.asarray(e.ids, "<u4").tobytes() for e in library.encode_batch_fast(some, add_special_tokens=False)]
    assert 1 <= sum(calls) <= 4
    # Known words are not asked again, whatever stands beside them.
    coder.encode([" ".join(sorted(words)) + "!"])
    assert sum(calls) <= 5


def test_forms_start_only_where_the_split_cuts():
    text = "a café au lait.\nDu thé: 3.5\n\nx\u3000 y\xa0 z × à\u2003 ÷. don't"
    raw = np.frombuffer(text.encode(), np.uint8)
    at = [*tokenfiles._starts(raw, np.array([0])).tolist(), len(raw)]
    cut = [raw[a:b].tobytes().decode() for a, b in zip(at, at[1:], strict=False)]
    assert cut == ["a", " café", " au", " lait", ".", "\n", "Du", " thé", ":", " 3", ".5", "\n\nx\u3000 y\xa0 z", " ×", " à\u2003 ÷.", " don't"]


@pytest.mark.parametrize("chars", [1, 300, 1 << 24])
def test_groups_of_texts_meet_their_rows(spark, library, chars):
    made = [(k if k % 7 else -k, "" if k % 5 == 0 else None if k % 11 == 0 else f"text {k}, " * (k % 13)) for k in range(1, 120)]
    folder = checkpoint_subdir(spark, f"tokens-{random.random()}")
    docs = spark.createDataFrame(made, "doc_id long, text string").coalesce(1)
    tokenfiles.write(docs, folder, shard_tokens=150, group_chars=chars)
    got = sorted(tuple(r) for r in tokenfiles.report(spark, folder).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(brute(library, sorted(made)))
