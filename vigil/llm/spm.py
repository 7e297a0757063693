"""SentencePiece encoding and decoding by vectorised merge rounds.

A batch of texts becomes one flat numpy array of symbols, cut into words that merges never join
(a word starts at a space mark). Each word form is encoded once a batch. A round finds the smallest
pair rank of every word by a segmented minimum, merges that pair at all its leftmost,
non-overlapping places in all words at once, and compacts the arrays; words without a pair left
leave. Rounds end when no word is left.

One round merges a pair in several places of one word only if the order of single merges gives the
same: when a merge makes a new pair that would come before the next place, that word merges its
first place alone in this round. So ids equal those of the library.

Spark deals out the texts; a task holds one Arrow batch and a bounded table of word forms. No
shuffle. Defined results: a null or empty text has no ids and decodes to the empty text; rows may
repeat; texts are never cut; columns beside the named one are not touched.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.pieces import Pieces, load

#: Word forms kept between batches of a Python worker.
MAX_FORMS = 300_000
#: Texts whose ids are held at once where only their digests go on.
SLICE = 1000
_NONE = np.int32(2**31 - 1)


class Merges:
    """Pair to (merged id, rank) as an open-addressing table; lookups are whole-array probes."""

    BITS = 20

    def __init__(self, p: Pieces):
        pairs = {}
        for piece, i in p.ident.items():
            for k in range(1, len(piece)):
                a, b = p.ident.get(piece[:k]), p.ident.get(piece[k:])
                if a is not None and b is not None:
                    pairs[(a << 32) | b] = i
        self.rank_of = np.full(p.size + 1, _NONE, np.int32)
        for i, r in p.rank.items():
            self.rank_of[i] = r
        size = 1 << self.BITS
        if len(pairs) * 2 > size:
            raise ValueError("too many merges for the pair table")
        self.keys = np.full(size, -1, np.int64)
        self.made = np.full(size, p.size, np.int32)
        for key, i in pairs.items():
            at = int(self._slot(np.array([key], np.int64))[0])
            while self.keys[at] >= 0:
                at = (at + 1) & (size - 1)
            self.keys[at], self.made[at] = key, i

    def _slot(self, key: np.ndarray) -> np.ndarray:
        mixed = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The id that each pair merges to; the vocabulary's size where it doesn't."""
        key = (a.astype(np.int64) << 32) | b
        at = self._slot(key)
        out = self.made[at].copy()
        held = self.keys[at]
        out[held != key] = self.made.dtype.type(len(self.rank_of) - 1)
        todo = np.flatnonzero((held != key) & (held >= 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
            held = self.keys[at[todo]]
            hit = held == key[todo]
            out[todo[hit]] = self.made[at[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
        return out


def merge_words(words: list[str], p: Pieces, merges: Merges, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Flat ids of all words, and how many each has. ``table``: code point to id, -1 for none."""
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    # A character without a piece never merges; it stands as minus its code point until the end.
    sym = table[codes]
    sym = np.where(sym >= 0, sym, -codes.astype(np.int64) - 1)
    none = np.int32(p.size)

    word = np.repeat(np.arange(len(words)), sizes)
    out_sym, out_word = [], []

    def rate(s: np.ndarray, w: np.ndarray) -> np.ndarray:
        """What each place and its right neighbour merge to."""
        made = np.full(len(s), none, np.int32)
        ok = np.flatnonzero((w[:-1] == w[1:]) & (s[:-1] >= 0) & (s[1:] >= 0))
        made[ok] = merges(s[ok], s[ok + 1])
        return made

    made = rate(sym, word) if len(sym) else np.empty(0, np.int32)
    while len(sym):
        rank = merges.rank_of[made]
        start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, start)
        span = np.diff(np.r_[start, len(word)])
        best = np.repeat(least, span)
        live = best != _NONE
        if not live.all():
            out_sym.append(sym[~live])
            out_word.append(word[~live])
            sym, word, made, rank, best = sym[live], word[live], made[live], rank[live], best[live]
            if not len(sym):
                break
        hit = rank == best
        # Of places that overlap, every second one from the left.
        at = np.flatnonzero(hit)
        run = np.r_[True, at[1:] != at[:-1] + 1]
        first = at[run]
        at = at[((at - np.repeat(first, np.diff(np.r_[np.flatnonzero(run), len(at)]))) & 1) == 0]
        place = word[at]
        several = np.r_[False, place[1:] == place[:-1]]
        if several.any():
            several |= np.r_[several[1:], False]
            i = at[several]
            new = made[i].astype(np.int64)
            # The symbol left of a merge as it is by then, the one right of it as it is now.
            prev = np.r_[-1, new[:-1]]
            near = np.r_[False, (i[1:] == i[:-1] + 2)]
            left = np.where(near, prev, np.where(i > 0, sym[i - 1], -1))
            left_ok = (i > 0) & (word[i - 1] == word[i]) & (left >= 0)
            right = np.where(i + 2 < len(sym), sym[np.minimum(i + 2, len(sym) - 1)], -1)
            right_ok = (right >= 0) & (word[np.minimum(i + 2, len(sym) - 1)] == word[i]) & (i + 2 < len(sym))
            bad = np.zeros(len(i), bool)
            for ok, a, b in ((left_ok, left, new), (right_ok, new, right)):
                k = np.flatnonzero(ok)
                bad[k] |= merges.rank_of[merges(a[k], b[k])] <= best[i[k]]
            if bad.any():
                worse = np.zeros(len(words), bool)
                worse[word[i[bad]]] = True
                worse = worse[place]
                at = at[~worse | np.r_[True, place[1:] != place[:-1]]]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        moved = at - np.arange(len(at))
        sym, word, made = sym[keep], word[keep], made[keep]
        mark = np.zeros(len(sym) + 1, bool)
        mark[moved] = True
        mark[moved - 1] = True
        mark[-1] = False
        redo = np.flatnonzero(mark)
        made[redo] = none
        redo = redo[redo + 1 < len(sym)]
        redo = redo[(word[redo] == word[redo + 1]) & (sym[redo] >= 0) & (sym[redo + 1] >= 0)]
        made[redo] = merges(sym[redo], sym[redo + 1])
    sym, word = (np.concatenate(out_sym), np.concatenate(out_word)) if out_sym else (sym, word)
    order = np.argsort(word, kind="stable")
    sym, word = sym[order], word[order]
    lone = np.flatnonzero(sym < 0)
    if len(lone):
        spelled = [[p.byte[b] for b in chr(-int(s) - 1).encode("utf-8", "surrogatepass")] for s in sym[lone]]
        times = np.ones(len(sym), np.int64)
        times[lone] = [len(x) for x in spelled]
        sym, word = np.repeat(sym, times), np.repeat(word, times)
        sym[sym < 0] = np.concatenate([np.array(x) for x in spelled])
    return sym.astype(np.int32), np.bincount(word, minlength=len(words)).astype(np.int64)


class Forms(dict):
    """Word form to number; a form that is new gets the next number and is noted."""

    def __missing__(self, form: str) -> int:
        self.new.append(form)
        self[form] = n = len(self)
        return n

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, path: str):
        self.p = load(path)
        self.merges = Merges(self.p)
        self.table = np.full(0x110000, -1, np.int32)
        for c, i in self.p.ident.items():
            if len(c) == 1:
                self.table[ord(c)] = i
        self.decimal = [str(i) for i in range(self.p.size)]
        self.forget()

    def forget(self) -> None:
        self.form = Forms()
        self.ids, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64)

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        if len(self.form) > MAX_FORMS:
            self.forget()
        number = self.form.__getitem__
        codes = [list(map(number, self.p.words(t or ""))) for t in texts]
        if self.form.new:
            ids, sizes = merge_words(list(map(self.p.marked, self.form.new)), self.p, self.merges, self.table)
            self.form.new = []
            self.ids, self.sizes = np.concatenate([self.ids, ids]), np.concatenate([self.sizes, sizes])
        begin = np.cumsum(self.sizes) - self.sizes
        out = []
        for code in map(np.array, codes):
            code = code.astype(np.int64)
            size = self.sizes[code]
            shift = np.repeat(begin[code] - (np.cumsum(size) - size), size)
            out.append(self.ids[shift + np.arange(len(shift))])
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Bytes of the pieces, without the dummy prefix; bytes that aren't UTF-8 become U+FFFD."""
        raw = b"".join(map(self.p.bytes.__getitem__, ids))
        return raw.removeprefix(b" ").decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode_column(text: Column, path: str) -> Column:
    """``array<int>``: the ids of each whole text."""

    @F.pandas_udf("array<int>")
    def encode(s: pd.Series) -> pd.Series:
        return pd.Series(codec(path).encode(s), index=s.index, dtype=object)

    return encode(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of each array of ids; null reads as no ids."""

    @F.pandas_udf("string")
    def decode(s: pd.Series) -> pd.Series:
        c = codec(path)
        return pd.Series([c.decode([] if x is None else list(x)) for x in s], index=s.index, dtype=object)

    return decode(ids)


def digest_column(text: Column, path: str) -> Column:
    """``n_tokens``, and the SHA-256 of the ids in decimal and of the text that they decode to."""

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digest(s: pd.Series) -> pd.DataFrame:
        from hashlib import sha256

        c, rows = codec(path), []
        for k in range(0, len(s), SLICE):
            for x in c.encode(s.iloc[k : k + SLICE]):
                x = x.tolist()
                text = ",".join(map(c.decimal.__getitem__, x))
                rows.append((len(x), sha256(text.encode()).hexdigest(), sha256(c.decode(x).encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"], index=s.index)

    return digest(text)


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of its texts in column ``ids``."""
    return docs.withColumn(ids, encode_column(F.col(text), path))


def decode(rows: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of its ids in column ``text``."""
    return rows.withColumn(text, decode_column(F.col(ids), path))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` for each row, ids made and read in one Python pass."""
    made = digest_column(F.col("text"), path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), made.alias("made"))
    return rows.select("doc_id", "made.n_tokens", "made.ids_sha256", "made.decoded_sha256")
