"""Token counts by a finite-state compilation of the tokenizer.

*Transducer.* Let t(i) be the last token of the encoding of a word's first i characters. The encoding
of a prefix is a prefix's encoding plus t(i), and t(i) is the only piece s that ends there, encodes to
itself, and stays apart from the token before it (the encoding of both strings together is the two).
So all that later characters can depend on is, for each start j from which a piece may still run on,
its place in the piece trie, t(j), and how many tokens lie between. That tuple is a state of a
deterministic transducer; a transition carries the change of the token count (a token that a longer
one replaces is taken back). Tokens that let the same pieces follow at a start count as one there, and
starts from which no piece can follow are left out, so the states are few. Two neighbours that no piece holds side by side are a hard boundary,
after which every state is the start state. States and transitions are compiled when a text first
needs them, into arrays.

*Chunks.* A batch is one flat array of character classes, cut into chunks at hard boundaries about
every ``CHUNK`` characters; where a word has none, in the word. All chunks run at once, one
whole-array step a character, each from its entry state, which gives a point of its state map (entry
to exit). A chunk cut in a word enters with the state that the characters before it lead to from the
start state. The maps compose by a parallel prefix scan; a chunk whose entry was not the exit of the
composed maps before it runs again from there, until all maps compose.

No shuffle: Spark deals out the texts, and a long text is many chunks. Defined results: a null or
empty text has no tokens; rows may repeat; texts are never cut; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections import Counter as Counted
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.pieces import MARK, Pieces, load

CHUNK = 256
#: Characters before a cut that give a chunk's first guess of its entry state.
LOOK_BACK = 48
#: Compiled transitions at which a worker starts over, between batches.
MAX_TRANSITIONS = 1_000_000
#: Characters that run together; bounds a worker's memory, not the texts.
RUN_CHARS = 1_000_000
START = 0


class Transducer:
    """A state is a tuple of numbers, each for one start: trie node, token before it, tokens since."""

    def __init__(self, p: Pieces):
        self.p = p
        # Classes: 0 ends a text, 1 to 4 are characters without a piece by their UTF-8 length.
        number = {c: k for k, c in enumerate((c for c in p.ident if len(c) == 1), 5)}
        self.classes = len(number) + 5
        chars = {k: c for c, k in number.items()}
        self.class_number = number
        self.class_of = np.full(0x110000, 4, np.int16)
        for top, n in ((0x10000, 3), (0x800, 2), (0x80, 1)):
            self.class_of[:top] = n
        for c, k in number.items():
            self.class_of[ord(c)] = k
        self.joined = np.zeros((self.classes, self.classes), bool)
        #: (node, class) to node; node to the piece that ends there, 0 for none; nodes that go on.
        self.trie: dict[int, int] = {}
        self.piece_at, self.goes_on = [0], [True]
        for piece, i in p.ident.items():
            cls = [number.get(c, -1) for c in piece]
            if min(cls) < 0:
                continue  # holds a character without a piece, which no merge starts from
            for x, y in zip(cls, cls[1:], strict=False):
                self.joined[x, y] = True
            node = 0
            for k in cls:
                self.goes_on[node] = True
                if (key := node * self.classes + k) not in self.trie:
                    self.trie[key] = len(self.piece_at)
                    self.piece_at.append(0)
                    self.goes_on.append(False)
                node = self.trie[key]
            self.piece_at[node] = i
        #: What each node spells, and the pieces that run on below it.
        self.spells, self.below = [""] * len(self.piece_at), [[] for _ in self.piece_at]
        for key, child in self.trie.items():  # parents come before their children
            node, k = divmod(key, self.classes)
            self.spells[child] = self.spells[node] + chars[k]
        for piece, i in p.ident.items():
            node = 0
            for c in piece if all(c in number for c in piece) else "":
                node = self.trie[node * self.classes + number[c]]
                if self.spells[node] != piece:
                    self.below[node].append(i)
        if len(self.piece_at) >= 1 << 24 or p.size >= 1 << 24:
            raise ValueError("the vocabulary is too large for the packed states")
        self.tied = {r for r, n in Counted(p.rank.values()).items() if n > 1}
        self.whole: dict[int, bool] = {}
        self.spine: dict[tuple[int, bool], list[tuple[str, int]]] = {}
        self.forget()

    def forget(self) -> None:
        self.apart: dict[int, bool] = {}
        self.crossing: dict[tuple[int, str], list[tuple[str, int]]] = {}
        self.alike: dict[int, int] = {}
        self.first_alike: dict[tuple, int] = {}
        self.states: list[tuple] = [(0,)]
        self.number: dict[tuple, int] = {self.states[0]: START}
        self.used = 0
        self._grow(1 << 16)

    # --- the vocabulary's side: merges of short strings ---------------------------------------

    def _encode(self, text: str, history: dict | None = None) -> list[str]:
        """One by one merges; ``history`` takes each merged string's two halves."""
        rank, ident = self.p.rank, self.p.ident
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ident.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or rank[i] < best):
                    best, at = rank[i], k
            if best is None:
                return parts
            if history is not None:
                history[(sum(map(len, parts[:at])), len(parts[at]) + len(parts[at + 1]))] = len(parts[at])
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _own(self, i: int) -> bool:
        if i not in self.whole:
            self.whole[i] = len(self._encode(self.p.text[i])) == 1
        return self.whole[i]

    def _side(self, i: int, right: bool) -> list[tuple[str, int]]:
        """The strings that stand at one end of a piece while it is merged, each with the rank that ends it."""
        if (i, right) not in self.spine:
            text, cuts, out = self.p.text[i], {}, []
            self._encode(text, cuts)
            at, size, ends = 0, len(text), 1 << 60
            while True:
                part = text[at : at + size]
                out.append((part, ends))
                if size == 1:
                    break
                cut, ends = cuts[(at, size)], self.p.rank[self.p.ident[part]]
                at, size = (at + cut, size - cut) if right else (at, cut)
            self.spine[(i, right)] = out
        return self.spine[(i, right)]

    def _stays(self, before: int, piece: int) -> bool:
        """Is ``piece`` a token of its own right after the token ``before`` (0: at the start)?"""
        key = before << 24 | piece
        found = self.apart.get(key)
        if found is None:
            found = self.apart[key] = self._own(piece) and (not before or self._meet(before, piece))
        return found

    def _meet(self, before: int, piece: int) -> bool:
        ident, rank = self.p.ident, self.p.rank
        if rank[before] in self.tied and rank[piece] in self.tied:
            want = [self.p.text[before], self.p.text[piece]]
            return self._encode("".join(want)) == want
        # Two strings on either side of the border stand there together until the first of the
        # ranks that end them; a merge of both that comes before it crosses the border.
        left, right = self._side(before, True), self._side(piece, False)
        a, b = len(left) - 1, len(right) - 1
        while True:
            (x, x_ends), (y, y_ends) = left[a], right[b]
            i = ident.get(x + y)
            if i is not None and rank[i] < x_ends and rank[i] <= y_ends:  # of equal ranks the left one is first
                return False
            if a == 0 and b == 0:
                return True
            if x_ends < y_ends or x_ends == y_ends and a:
                a -= 1
            else:
                b -= 1

    def _crosses(self, before: int, c: str) -> list[tuple[str, int]]:
        """Strings that start with ``c`` and that some string at the right end of ``before`` merges
        with while it stands there, each with the smallest rank of such a merge."""
        if (before, c) not in self.crossing:
            found: dict[str, int] = {}
            for x, ends in self._side(before, True):
                top = 0
                for k in (self.class_number.get(y) for y in x + c):
                    top = self.trie.get(top * self.classes + k) if top is not None and k else None
                for i in [] if top is None else [*self.below[top], *([self.piece_at[top]] if self.piece_at[top] else [])]:
                    y = self.p.text[i][len(x) :]
                    if self.p.rank[i] < ends and y in self.p.ident:
                        found[y] = min(self.p.rank[i], found.get(y, 1 << 60))
            self.crossing[(before, c)] = sorted(found.items())
        return self.crossing[(before, c)]

    def _class(self, node: int, before: int) -> int:
        """The first token seen that lets the same pieces below ``node`` stand after it as ``before``; -1: none."""
        key = node << 24 | before
        if (found := self.alike.get(key)) is None:
            at = self.spells[node]
            # First by what merges across the border, which is quick and puts most tokens together.
            crosses = self._crosses(before, at[0]) if before and self.p.rank[before] not in self.tied else ()
            sign = (node, before if before and self.p.rank[before] in self.tied else tuple(x for x in crosses if x[0].startswith(at) or at.startswith(x[0])))
            first = self.first_alike.setdefault(sign, before)
            if (found := self.alike.get(node << 24 | first)) is None:
                # Then by the pieces themselves, once for each such class.
                allowed = bytes([self._own(i) and (not first or self._meet(first, i)) for i in self.below[node]])
                found = self.first_alike.setdefault((node, allowed), first) if any(allowed) else -1
                self.alike[node << 24 | first] = found
            self.alike[key] = found
        return found

    # --- the transducer's side ----------------------------------------------------------------

    def _compile(self, state: int, cls: int) -> tuple[int, int]:
        """Next state and change of the token count."""
        if cls < 5:
            return START, cls
        trie, classes, found, change, chain = self.trie, self.classes, 0, 0, []
        for e in self.states[state]:
            child = trie.get((e >> 40) * classes + cls)
            if child is None:
                continue
            if not found and (piece := self.piece_at[child]) and self._stays(e >> 16 & 0xFFFFFF, piece):
                found, change = piece, 1 - ((e & 0xFFFF or 256) - 256)
            if self.goes_on[child] and (alike := self._class(child, e >> 16 & 0xFFFFFF)) >= 0:
                chain.append((child, alike << 16 | e & 0xFFFF))
        # Tokens since a start are kept as 256 more, so that a packed number has no sign.
        key = (*[child << 40 | (e & 0xFFFFFF0000) | ((e & 0xFFFF or 256) + change) for child, e in chain], found << 16 | 256)
        n = self.number.get(key)
        if n is None:
            n = self.number[key] = len(self.states)
            self.states.append(key)
        return n, change

    def _grow(self, size: int) -> None:
        old = (self.keys, self.to, self.change) if self.used else None
        self.shift = np.uint64(64 - (size.bit_length() - 1))
        self.keys, self.to, self.change = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)
        if old:
            held = np.flatnonzero(old[0] >= 0)
            self._put(*(x[held] for x in old))

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _put(self, keys: np.ndarray, to: np.ndarray, change: np.ndarray) -> None:
        at = self._slot(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]
            mine = self.keys[at] == keys
            self.to[at[mine]], self.change[at[mine]] = to[mine], change[mine]
            keys, to, change, at = keys[~mine], to[~mine], change[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    def _find(self, key: np.ndarray) -> np.ndarray:
        """Slots of the keys; -1 for a transition that isn't compiled yet."""
        at = self._slot(key)
        held = self.keys[at]
        todo = np.flatnonzero(held != key)
        while len(todo):
            held = self.keys[at[todo]]
            empty = held < 0
            at[todo[empty]] = -1
            todo = todo[~empty & (held != key[todo])]
            at[todo] = (at[todo] + 1) & (len(self.keys) - 1)
        return at

    def step(self, state: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = state.astype(np.int64) * self.classes + cls
        at = self._find(key)
        if (lack := np.flatnonzero(at < 0)).size:
            new = np.unique(key[lack])
            made = np.array([self._compile(*divmod(k, self.classes)) for k in new.tolist()], np.int64)
            self.used += len(new)
            while self.used * 2 > len(self.keys):
                self._grow(len(self.keys) * 2)
            self._put(new, made[:, 0].astype(np.int32), made[:, 1].astype(np.int16))
            at = self._find(key)
        return self.to[at], self.change[at]

    def run(self, flat: np.ndarray, begin: np.ndarray, end: np.ndarray, entry: np.ndarray, changes: np.ndarray | None) -> np.ndarray:
        """Exit states of the chunks ``begin..end``, all stepping together; notes the changes."""
        order = np.argsort(begin - end, kind="stable")  # longest first: those that still run are a prefix
        size, state, first = (end - begin)[order], entry[order].copy(), begin[order]
        for k in range(int(size[0]) if len(size) else 0):
            n = int(np.searchsorted(-size, -k, side="left"))
            at = first[:n] + k
            state[:n], change = self.step(state[:n], flat[at])
            if changes is not None:
                changes[at] = change
        out = np.empty_like(state)
        out[order] = state
        return out

    def count(self, flat: np.ndarray) -> np.ndarray:
        """The change of the token count at each place of ``flat``, whose last class is 0."""
        changes = np.zeros(len(flat), np.int16)
        hard = np.r_[True, ~self.joined[flat[:-1], flat[1:]]]
        nominal = np.arange(0, len(flat), CHUNK)
        places = np.flatnonzero(hard)
        after = places[np.minimum(np.searchsorted(places, nominal), len(places) - 1)]
        cut = np.unique(np.where((after >= nominal) & (after < nominal + CHUNK), after, nominal))
        begin, end, free = cut, np.r_[cut[1:], len(flat)], hard[cut]
        entry = np.zeros(len(cut), np.int32)
        if not free.all():
            k = np.flatnonzero(~free)
            entry[k] = self.run(flat, np.maximum(begin[k] - LOOK_BACK, begin[k - 1]), begin[k], np.zeros(len(k), np.int32), None)
        leave = self.run(flat, begin, end, entry, changes)
        while True:
            whole, before = compose(free, entry, leave)
            redo = np.flatnonzero(~whole & (before >= 0))
            if not len(redo):
                return changes
            entry[redo] = before[redo]
            leave[redo] = self.run(flat, begin[redo], end[redo], entry[redo], changes)


def compose(free: np.ndarray, entry: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parallel prefix scan over one-point state maps ``entry -> leave``.

    ``free`` chunks start at a hard boundary, where any map before them composes. Returns for each
    chunk whether the maps from the last free chunk up to it compose, and the exit that the composed
    maps before it reach (-1: not known yet).
    """
    ok = free | np.r_[True, leave[:-1] == entry[1:]]
    closed, reach = free.copy(), 1
    while reach < len(ok) and not closed.all():
        # (a b) composes if both halves do; a map that reaches back to a free chunk is closed.
        left_ok, left_closed = np.r_[np.ones(reach, bool), ok[:-reach]], np.r_[np.ones(reach, bool), closed[:-reach]]
        ok = np.where(closed, ok, ok & left_ok)
        closed |= left_closed
        reach *= 2
    before = np.where(np.r_[True, ok[:-1]], np.r_[START, leave[:-1]], -1)
    return ok, before


class Counter:
    """Token counts of one Python worker."""

    def __init__(self, path: str):
        self.machine = Transducer(load(path))

    def __call__(self, texts: Iterable[str | None]) -> list[int]:
        counts: list[int] = []
        held: list[str] = []
        size = 0
        for t in texts:
            held.append(t or "")
            size += len(held[-1]) + 2
            if size > RUN_CHARS:
                counts += self._run(held)
                held, size = [], 0
        return counts + self._run(held)

    def _run(self, texts: list[str]) -> list[int]:
        if not texts:
            return []
        m = self.machine
        if m.used > MAX_TRANSITIONS:
            m.forget()
        # The dummy prefix and a place for the end; an empty text has the end alone.
        line = "".join([MARK + t + "\n" if t else "\n" for t in texts]).replace(" ", MARK)
        flat = m.class_of[np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32)]
        size = np.array([len(t) + 2 if t else 1 for t in texts])
        flat[np.cumsum(size) - 1] = 0
        changes = m.count(flat)
        return np.add.reduceat(changes.astype(np.int64), np.cumsum(size) - size).tolist()


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_column(text: Column, path: str) -> Column:
    """``long``: the number of tokens of each whole text."""

    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        return pd.Series(counter(path)(s), index=s.index, dtype="int64")

    return count(text)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        count_column(F.col("text"), path).alias("n_tokens"),
    )
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
