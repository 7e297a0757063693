"""SentencePiece encoding and decoding, and token counts, against the library."""

import hashlib
import random

import numpy as np
import pytest
from llm_cases import empty, frame, keyed, rows

from vigil.llm import fst, spm
from vigil.llm.pieces import default_model

MODEL = default_model()
ALPHABET = ["a", "b", "e", "t", "h", "the", " ", "  ", "\n", "\t", "é", "中", "𝒳", "=", "-", "1", "▁", "́", "ing", "\x00", "ß", "'", " " * 17, "<s>", "<0x41>", "tion", "s", "o", "n"]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def texts():
    rnd = random.Random(5)
    hard = ["", " ", "\n", "\n ", " \n", "a\n", "\na b", " " * 100, "a" * 700, "=" * 500, " " * 47 + "the" + " " * 32 + "the", "aaaaabaaaab " * 40, "0" * 900]
    hard += ["thinghandingnation" * 90, "".join(rnd.choice("abcdefghijklmnop") for _ in range(3000)), "中文" * 400]
    return hard + ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randint(0, 50))) for _ in range(3000)]


def test_encoding_and_decoding_equal_the_library(library):
    codec, some = spm.codec(MODEL), texts()
    for t, ids in zip(some, codec.encode(some), strict=True):
        want = library.encode(t)
        assert ids.tolist() == want, repr(t)
        assert codec.decode(want) == library.decode(want), repr(t)
        if "▁" not in t:
            assert codec.decode(want) == t  # an exact round trip


def test_forms_are_forgotten_without_a_trace(monkeypatch):
    monkeypatch.setattr(spm, "MAX_FORMS", 10)
    codec, some = spm.Codec(MODEL), texts()[:300]
    assert [x.tolist() for k in range(0, 300, 50) for x in codec.encode(some[k : k + 50])] == [x.tolist() for x in spm.codec(MODEL).encode(some)]


def test_counts_equal_the_library(library):
    some = texts()
    assert fst.counter(MODEL)(some) == [len(library.encode(t)) for t in some]


def test_counts_over_many_small_chunks(library, monkeypatch):
    """Chunks cut in words: entries are guessed, composed, and run again where the guess was wrong."""
    monkeypatch.setattr(fst, "CHUNK", 5)
    monkeypatch.setattr(fst, "LOOK_BACK", 1)
    monkeypatch.setattr(fst, "RUN_CHARS", 500)
    some = texts()[:400]
    assert fst.counter(MODEL)(some) == [len(library.encode(t)) for t in some]


def test_a_worker_starts_over_without_a_trace(library, monkeypatch):
    monkeypatch.setattr(fst, "MAX_TRANSITIONS", 100)
    monkeypatch.setattr(fst, "RUN_CHARS", 2000)
    some = texts()[:300]
    assert fst.counter(MODEL)(some) == [len(library.encode(t)) for t in some]


def test_composition_finds_every_exit():
    free = np.array([True, False, False, True, False, False, False])
    entry, leave = np.array([0, 4, 9, 0, 7, 8, 2]), np.array([4, 5, 6, 7, 8, 1, 3])
    whole, before = fst.compose(free, entry, leave)
    assert whole.tolist() == [True, True, False, True, True, True, False]
    assert before[2] == 5 and before[6] == 1


def test_spark_digests_and_counts(spark, library):
    def sha(s):
        return hashlib.sha256(s.encode()).hexdigest()

    want_ids, want_n = [], []
    for i, t, *_ in rows():
        ids = library.encode(t or "")
        want_ids.append((i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
        want_n.append((i, len((t or "").encode()), len(ids), len(ids) > 4096))
    got = spm.digests(frame(spark), MODEL)
    assert keyed(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want_ids, key=repr)
    counts = fst.token_counts(frame(spark), MODEL)
    assert keyed(counts, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want_n, key=repr)
    assert spm.digests(empty(spark), MODEL).count() == 0 and fst.token_counts(empty(spark), MODEL).count() == 0


def test_spark_round_trip(spark):
    made = spm.decode(spm.encode(frame(spark), MODEL), MODEL)
    for r in made.select("text", "ids", "decoded").collect():
        if "▁" not in (r["text"] or ""):
            assert r["decoded"] == (r["text"] or "")
