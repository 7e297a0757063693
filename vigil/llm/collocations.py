"""Phrase collocation mining: tiles of frequency-ranked word ids, frequent pairs ranked anew for triples.

*Words.* Texts, A-Z in lower case, are split into pieces at ``.,;:!?`` and line ends, and pieces into words at
spaces and tabs. A first pass counts the words of each language. The ``head`` most frequent ``(language, word)``,
of ``head_bytes`` bytes at most, get their frequency rank as id and are broadcast; other words get ids after
these, for as long as a task's buffer of ``buffer`` words lives.

*Pairs.* Of a buffer, neighbouring ids ``(a, b)`` are dealt into square tiles of ids. A tile that holds
enough pairs is counted in a dense array by its own cell numbers (``bincount``); all sparse tiles together are
sorted coordinates with run lengths. What leaves a task is one row a distinct pair: one number if both words
are in the head, else the words themselves. Spark adds them up.

*Triples.* A triple can only reach the count if both its pairs do. The frequent pairs are noted in a sieve, a
bit array of ``sieve_bits`` (bits set by a hash, so a pair is never missed; others may pass, which costs rows
but changes nothing). In a buffer, the pairs that pass are ranked by frequency, and ``(pair's rank, next word)``
goes through the same tiles.

Counts, joins, scores (exact decimals) and ranks are DataFrame operations. Memory is bounded by :class:`Sizes`,
however many words or languages there are; no word, pair or language is left out.

Defined results: a null text counts as empty, a null language as ``und`` (with rows that say so). A language
without a candidate has no rows. Rows that repeat are counted each. An empty table gives an empty result. Counts
must stay below 10**15. Only ``text`` and ``lang`` are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialize

LEAST = 10
TOP = 2000
#: Percent of a phrase's occurrences that a longer candidate must hold to replace it.
COVER = 50


class Sizes(NamedTuple):
    """What bounds memory; results don't depend on it."""

    head_bits: int = 18  # the head's ids have so many bits (20 at most: three make one number)
    head_bytes: int = 64
    buffer: int = 1 << 20
    tile_bits: int = 10
    dense: float = 1 / 16  # a tile with this share of its cells is dense
    sieve_bits: int = 1 << 27
    segment: int = 1 << 15  # bits of the sieve that are packed together
    forms: int = 1 << 20  # distinct words that a task keeps counts of
    part: int = 4 << 20  # bytes of a text that are split at once

    @property
    def head(self) -> int:
        return 1 << self.head_bits


# --- Fixed values: A-Z in lower case, piece ends as line feed, tab as space -----------------------
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
# --------------------------------------------------------------------------------------------------
_BREAK, _NONE = -1, -2
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _tokens(text: bytes, part: int) -> Iterator[list[bytes]]:
    """Words and line feeds (a piece's end), with empty strings between, a part of the text at a time."""
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = text.find(b" ", at + part)
        end = len(text) if end < 0 else end
        yield text[at:end].replace(b"\n", b" \n ").split(b" ")
        at = end


class Words(dict):
    """Word to id for one language: the head's, then the next free number of the buffer."""

    def __init__(self, lang: str, head: dict[bytes, int], first: int, new: list[tuple[str, bytes]]):
        super().__init__(head)
        self.lang, self.first, self.new = lang, first, new
        self[b""], self[b"\n"] = _NONE, _BREAK

    def __missing__(self, word: bytes) -> int:
        self[word] = ident = self.first + len(self.new)
        self.new.append((self.lang, word))
        return ident


def tile_counts(a: np.ndarray, b: np.ndarray, bits: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ``(a, b)`` of two id vectors (ids below 2**31) and how often each occurs.

    Tiles of ``bits`` bits of both ids are dense if they have ``least`` pairs a cell.
    """
    tile = (a >> bits) << 32 | b >> bits
    order = np.argsort(tile, kind="stable")
    a, b, tile = a[order], b[order], tile[order]
    edges = np.concatenate([[0], np.flatnonzero(np.diff(tile)) + 1, [len(tile)]]) if len(tile) else np.zeros(1, np.int64)
    size, low = 1 << bits, (1 << bits) - 1
    dense = np.diff(edges) >= least * size * size
    out, rest = [], np.ones(len(tile), bool)
    for lo, hi in zip(edges[:-1][dense], edges[1:][dense], strict=True):
        cells = np.bincount((a[lo:hi] & low) << bits | (b[lo:hi] & low), minlength=size * size)
        hit = np.flatnonzero(cells)
        out.append(((a[lo] & ~low) + (hit >> bits), (b[lo] & ~low) + (hit & low), cells[hit]))
        rest[lo:hi] = False
    key = np.sort(a[rest] << 32 | b[rest])
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    out.append((key[first] >> 32, key[first] & 0xFFFFFFFF, np.diff(np.append(first, len(key)))))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _hash(lang: str, word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode() + b"\0" + word, digest_size=8).digest(), "little")


def _place(h1: np.ndarray, h2: np.ndarray, bits: int) -> np.ndarray:
    """The sieve's bit for a pair of word hashes."""
    mixed = (h1 * _K1 ^ (h2 << np.uint64(31) | h2 >> np.uint64(33))) * _K2
    return ((mixed ^ mixed >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


class Miner:
    """A task's buffer of ids; ``sieve`` is None for pairs, the bits of frequent pairs for triples."""

    def __init__(self, head: dict[str, dict[bytes, int]], sieve: bytes | None, sizes: Sizes):
        self.sizes, self.head, self.sieve = sizes, head, None if sieve is None else np.frombuffer(sieve, np.uint8)
        self.name = {i: (lang, w) for lang, ws in head.items() for w, i in ws.items()}
        self.hashes = np.zeros(sizes.head if sieve is not None else 0, np.uint64)
        if sieve is not None:
            for i, x in self.name.items():
                self.hashes[i] = _hash(*x)
        self.reset()

    def reset(self) -> None:
        self.new, self.words, self.ids, self.size = [], {}, [], 0

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self.words:
            self.words[lang] = Words(lang, self.head.get(lang, {}), self.sizes.head, self.new)
        get = self.words[lang].__getitem__
        for tokens in _tokens(text, self.sizes.part):
            ids = np.fromiter(map(get, tokens), np.int64, len(tokens))
            self.ids.append(ids[ids != _NONE])
            self.size += len(self.ids[-1])
        self.ids.append(np.array([_BREAK]))

    def flush(self) -> Iterator[pd.DataFrame]:
        x = np.concatenate([*self.ids, np.array([_BREAK, _BREAK])])
        met = np.flatnonzero((x[:-1] >= 0) & (x[1:] >= 0))
        if self.sieve is None:
            a, b, n = tile_counts(x[met], x[met + 1], self.sizes.tile_bits, self.sizes.dense)
            parts = (a, b)
        else:
            pair, which, often = np.unique(x[met] << 32 | x[met + 1], return_inverse=True, return_counts=True)
            hashes = np.concatenate([self.hashes, np.array([_hash(*w) for w in self.new], np.uint64)])
            bit = _place(hashes[pair >> 32], hashes[pair & 0xFFFFFFFF], self.sizes.sieve_bits)
            passed = self.sieve[bit >> 3] >> (bit & 7).astype(np.uint8) & 1 == 1
            # Frequent pairs by falling count: their ranks are the left ids now.
            order = np.argsort(np.where(passed, -often, 1), kind="stable")[: int(passed.sum())]
            rank = np.full(len(pair), -1, np.int64)
            rank[order] = np.arange(len(order))
            at = np.full(len(x), -1, np.int64)
            at[met] = rank[which]
            three = np.flatnonzero((at[:-1] >= 0) & (at[1:] >= 0))
            p, c, n = tile_counts(at[three], x[three + 2], self.sizes.tile_bits, self.sizes.dense)
            parts = (pair[order[p]] >> 32, pair[order[p]] & 0xFFFFFFFF, c)
        yield from self._rows(parts, n)
        self.reset()

    def _rows(self, parts: tuple[np.ndarray, ...], n: np.ndarray) -> Iterator[pd.DataFrame]:
        """``k, lang, phrase, n``: a number for words of the head, else language and phrase."""
        code, bits, head = np.zeros(len(n), np.int64), self.sizes.head_bits, self.sizes.head
        known = np.ones(len(n), bool)
        for p in parts:
            code = code << bits | p & (head - 1)
            known &= p < head
        for lo in range(0, len(n), 1 << 18):
            some = slice(lo, lo + (1 << 18))
            lang, phrase = np.full(len(n[some]), None, object), np.full(len(n[some]), None, object)
            for i in np.flatnonzero(~known[some]):
                words = [self.new[p[lo + i] - head] if p[lo + i] >= head else self.name[int(p[lo + i])] for p in parts]
                lang[i], phrase[i] = words[0][0], b" ".join(w for _, w in words).decode()
            k = pd.arrays.IntegerArray(code[some], ~known[some])
            yield pd.DataFrame({"k": k, "lang": lang, "phrase": phrase, "n": n[some].astype(np.int64)})


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))


def word_counts(docs: DataFrame, sizes: Sizes) -> DataFrame:
    """``lang, word, n``, and for each language a row with the word null: all its words."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[str, Counter] = {}

        def rows() -> Iterator[pd.DataFrame]:
            for lang, words in seen.items():
                words.pop(b"", None), words.pop(b"\n", None)
                if words:
                    names, n = zip(*words.items(), strict=True)
                    yield pd.DataFrame({"lang": lang, "word": [None, *[w.decode() for w in names]], "n": [sum(n), *n]})
            seen.clear()

        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                words = seen.setdefault(lang, Counter())
                for tokens in _tokens(text, sizes.part):
                    words.update(tokens)
            if sum(map(len, seen.values())) > sizes.forms:
                yield from rows()
        yield from rows()

    return _texts(docs).mapInPandas(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def _mined(docs: DataFrame, head, sieve, least: int, sizes: Sizes) -> DataFrame:
    """``lang, w (array), n`` of the pairs, or with a sieve the triples, met ``least`` times or more."""
    width = 2 if sieve is None else 3

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        miner = Miner(head.value, None if sieve is None else sieve.value, sizes)
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                miner.add(lang, text)
                if miner.size >= sizes.buffer:
                    yield from miner.flush()
        if miner.size:
            yield from miner.flush()

    def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = {i: (lang, w.decode()) for lang, ws in head.value.items() for w, i in ws.items()}
        for batch in batches:
            lang, phrase = batch["lang"].to_numpy(object), batch["phrase"].to_numpy(object)
            for i, code in enumerate(batch["code"]):
                if code:
                    words = [names[int(code) >> sizes.head_bits * j & (sizes.head - 1)] for j in reversed(range(width))]
                    lang[i], phrase[i] = words[0][0], " ".join(w for _, w in words)
            yield pd.DataFrame({"lang": lang, "phrase": phrase, "n": batch["n"]})

    rows = _texts(docs).mapInPandas(mine, "k long, lang string, phrase string, n long")
    rows = rows.groupBy("k", "lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    # Numbers as text: with a null they would reach pandas as doubles.
    rows = rows.select(F.coalesce(F.col("k").cast("string"), F.lit("")).alias("code"), "lang", "phrase", "n")
    return rows.mapInPandas(named, "lang string, phrase string, n long").select("lang", F.split("phrase", " ").alias("w"), "n")


def _sieve(pairs: DataFrame, sizes: Sizes) -> bytes:
    """The bits of all ``pairs (lang, w)``; ``sieve_bits`` of them come to the driver, whatever their number."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            h = np.array([[_hash(lang, w.encode()) for w in ws] for lang, ws in zip(batch["lang"], batch["w"], strict=True)], np.uint64).reshape(-1, 2)
            bit = np.unique(_place(h[:, 0], h[:, 1], sizes.sieve_bits))
            yield pd.DataFrame({"segment": bit // sizes.segment, "bit": bit % sizes.segment})

    def packed(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(sizes.segment, np.uint8)
        bits[rows["bit"].to_numpy()] = 1
        return pd.DataFrame({"segment": [key[0]], "bits": [np.packbits(bits, bitorder="little").tobytes()]})

    rows = pairs.select("lang", "w").mapInPandas(places, "segment long, bit long").distinct()
    out = bytearray(sizes.sieve_bits // 8)
    for segment, bits in rows.groupBy("segment").applyInPandas(packed, "segment long, bits binary").toLocalIterator():
        out[segment * sizes.segment // 8 : (segment + 1) * sizes.segment // 8] = bits
    return bytes(out)


def _exact(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), in whole numbers."""
    return F.expr(f"(cast(1000000 as decimal(7,0)) * cast({a} as decimal(15,0)) * cast({a} as decimal(15,0))) div (cast({left} as decimal(19,0)) * cast({right} as decimal(19,0)))")


def mine(docs: DataFrame, least: int = LEAST, top: int = TOP, sizes: Sizes = Sizes()) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of each language's first ``top`` phrases of two or three words."""
    spark = docs.sparkSession
    counted = materialize(word_counts(docs, sizes).where((F.col("n") >= least) | F.col("word").isNull()), "phrase-words")
    words = counted.where("word IS NOT NULL")
    totals = counted.where("word IS NULL").select("lang", F.col("n").alias("total"))
    head: dict[str, dict[bytes, int]] = {}
    best = words.where(F.octet_length("word") <= sizes.head_bytes).orderBy(F.desc("n"), "lang", "word").limit(sizes.head).select("lang", "word").toPandas()
    for i, (lang, word) in enumerate(zip(best["lang"], best["word"], strict=True)):
        head.setdefault(lang, {})[word.encode()] = i
    head = spark.sparkContext.broadcast(head)
    pairs = materialize(_mined(docs, head, None, least, sizes), "phrase-pairs")
    triples = materialize(_mined(docs, head, spark.sparkContext.broadcast(_sieve(pairs, sizes)), least, sizes), "phrase-triples")

    word = lambda n, w: words.select("lang", F.col("word").alias(w), F.col("n").alias(n))
    pair = lambda n, x, y: pairs.select("lang", F.col("w")[0].alias(x), F.col("w")[1].alias(y), F.col("n").alias(n))
    two = pairs.select("lang", F.col("w")[0].alias("x"), F.col("w")[1].alias("y"), F.col("n").alias("a"))
    longer = triples.select("lang", F.explode(F.array(*[F.struct(F.col("w")[i].alias("x"), F.col("w")[i + 1].alias("y")) for i in (0, 1)])).alias("p"), "n")
    longer = longer.groupBy("lang", "p.x", "p.y").agg(F.max("n").alias("held"))
    two = two.join(longer, ["lang", "x", "y"], "left").where(f"held IS NULL OR 100 * held < {COVER} * a")
    two = two.join(word("l", "x"), ["lang", "x"]).join(word("r", "y"), ["lang", "y"])
    two = two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", "l", "r", _exact("a", "l", "r").alias("score"))
    three = triples.select("lang", *[F.col("w")[i].alias(c) for i, c in enumerate("xyz")], F.col("n").alias("a"))
    three = three.join(word("l1", "x"), ["lang", "x"]).join(pair("r1", "y", "z"), ["lang", "y", "z"])
    three = three.join(pair("l2", "x", "y"), ["lang", "x", "y"]).join(word("r2", "z"), ["lang", "z"])
    cut = [F.struct(_exact("a", f"l{k}", f"r{k}").alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = three.select("lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), "a", F.least(*cut).alias("c"))
    three = three.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    # The first of each language: in parts by hash, then of what these leave.
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    all_ = two.unionByName(three).withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
    first = all_.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    first = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return first.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
