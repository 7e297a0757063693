"""Language ID by multilingual mixture inference.

*Model.* For each language, smoothed frequencies of hashed letter trigrams (words in lower case, with
their borders), learned from labelled rows whose ``crc32(doc_id)`` modulo 5 is not 0. Rows are taken
by a hash of the id at a rate that gives about ``TRAIN_ROWS`` rows a language (all, if it has fewer);
counting is a Spark aggregation. Every label is a language. The table that goes to the workers is sparse:
a language's met buckets and one value for all others, so its size follows the sample, and texts are fitted in
smaller runs where there are many languages.

*Inference.* A document is a mixture of languages: each word comes from one of them, with the word's
likelihood from its trigrams. Expectation-maximisation estimates the proportions. A text's rounds end when one adds
less than ``GAIN`` to its log likelihood; the likelihood only rises and is bounded, so they do end. Languages are
ranked by their proportion in the full mixture; for each prefix of that ranking the mixture is fitted again, and
the set with the largest likelihood less ``PENALTY * log(words + 1)`` for each further language is selected. No set is
likelier than the full mixture, so a text's prefixes end, without a limit on their size, where the penalty alone
puts the full mixture's likelihood below the best set so far. The prediction is the language with the largest
proportion in the selected mixture, and that proportion is the score; ``langs`` and ``shares`` are the set and its
proportions, largest first.

Only the text goes into a prediction, and the whole text. Defined results: a null text, or one without
a letter, is ``und`` with score 0 and an empty set, as is every row when nothing could be learned (no labelled rows). A
null ``doc_id`` counts as held out. Equal proportions go to the first language by name. Rows may repeat;
columns beside ``doc_id, text, lang`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import packed

BUCKETS = 1 << 16
TRAIN_ROWS = 4000
PENALTY = 2.0
#: A text's rounds end at a gain in log likelihood below this.
GAIN = 1e-3
#: A word's likelihood under a language is not counted as less than this times the best one's.
FLOOR = 1e-6
#: Characters whose trigrams are looked up at once, and texts fitted at once; they bound memory only.
SLICE, RUN_CHARS = 250_000, 500_000
#: So many languages are counted together, and fitted in runs of ``RUN_CHARS``; more of them in parts, and in smaller runs.
AT_ONCE = 64
NONE = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table[0xD800:0xE000] = False
    return table


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram buckets of all letters, the word of each, the text of each word, each word's size."""
    lower = [t.lower() for t in texts]
    codes = np.frombuffer("".join(t + " " for t in lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    text = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in lower])
    letter = _letters()[codes]
    at = np.flatnonzero(letter)
    if not len(at):
        return at, at, at, at
    c = np.where(letter, codes, 0).astype(np.uint64)
    before = np.where(at > 0, c[at - 1], 0)
    mixed = ((before * np.uint64(0x9E3779B1) + c[at]) * np.uint64(0x85EBCA77) + c[at + 1]) * np.uint64(0x9E3779B97F4A7C15)
    bucket = (mixed >> np.uint64(48)).astype(np.int64) & (BUCKETS - 1)
    first = np.r_[True, at[1:] != at[:-1] + 1]
    word = np.cumsum(first) - 1
    return bucket, word, text[at[first]], np.bincount(word)


def _runs(texts: list[str], languages: int = 1) -> Iterator[slice]:
    start, size, most = 0, 0, RUN_CHARS * AT_ONCE // max(AT_ONCE, languages)
    for k, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield slice(start, k + 1)
            start, size = k + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


class Table:
    """Log probabilities ``(BUCKETS, languages)``: ``lists`` has the met buckets and their values of each
    language, ``rest`` the value of all its other buckets."""

    def __init__(self, lists: list[tuple[np.ndarray, np.ndarray]], rest: np.ndarray):
        self.lists, self.rest = lists, rest

    def __getitem__(self, at: tuple[np.ndarray, int]) -> np.ndarray:
        buckets, j = at
        column = np.full(BUCKETS, self.rest[j], np.float32)
        column[self.lists[j][0]] = self.lists[j][1]
        return column[buckets]


def learn(docs: DataFrame) -> tuple[list[str], Table]:
    """Languages by name, and their table."""
    labelled = docs.select("doc_id", "text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~_held_out(F.col("doc_id")))
    sizes = labelled.groupBy("lang").count().collect()  # a row a label
    langs = sorted(r["lang"] for r in sizes)
    if not langs:
        return [], Table([], np.zeros(0, np.float32))
    rate = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(1.0, TRAIN_ROWS / r["count"]))])
    # The hash of the id decides alone, so the sample is the same on each attempt of a task.
    share = F.pmod(F.xxhash64("doc_id", F.lit("langid")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(share < F.coalesce(rate[F.col("lang")], F.lit(0.0))).select("lang", "text")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}

        def counted() -> Iterator[pd.DataFrame]:
            for lang, n in total.items():
                at = np.flatnonzero(n)
                yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": n[at]})
            total.clear()

        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                texts = part["text"].tolist()
                for run in _runs(texts):
                    found = np.bincount(words_of(texts[run])[0], minlength=BUCKETS)
                    total[lang] = total.get(lang, 0) + found
                if len(total) >= AT_ONCE:
                    yield from counted()
        yield from counted()

    counts = sample.mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    parts = {lang: (part["bucket"].to_numpy(), part["n"].to_numpy()) for lang, part in counts.groupby("lang")}
    none = (np.zeros(0, np.int32), np.zeros(0, np.int64))
    lists, rest = [], []
    for lang in langs:
        at, n = parts.get(lang, none)
        whole = n.sum() + 0.5 * BUCKETS
        lists.append((at.astype(np.int32), np.log((n + 0.5) / whole).astype(np.float32)))
        rest.append(np.log(0.5 / whole))
    return langs, Table(lists, np.array(rest, np.float32))


def fit(likely: np.ndarray, start: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Expectation-maximisation for all texts at once, each until it gains less than ``GAIN``.

    ``likely``: words by languages; ``start``: first word of each text; ``allowed``: texts by
    languages. Returns the proportions and the log likelihood of each text.
    """
    size = np.diff(np.r_[start, len(likely)])
    share = allowed / allowed.sum(axis=1, keepdims=True)
    value = np.full(len(start), -np.inf)
    open_, words, first = np.arange(len(start)), likely, start
    while len(open_):
        part = words * np.repeat(share[open_], size[open_], axis=0)
        total = part.sum(axis=1, keepdims=True)
        now = np.add.reduceat(np.log(total[:, 0]), first)
        more = now - value[open_] >= GAIN
        value[open_] = now
        # Only the texts that go on take another step; those with one language never change.
        more &= (allowed[open_] > 0).sum(axis=1) > 1
        step = np.add.reduceat(part / total, first, axis=0) / size[open_][:, None]
        open_, step = open_[more], step[more]
        share[open_] = step
        if not more.all():
            words, first = _part(words, first, more)
    return share, value


def _part(likely: np.ndarray, start: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of the chosen texts, and their starts."""
    size = np.diff(np.r_[start, len(likely)])
    return likely[np.repeat(chosen, size)], np.r_[0, np.cumsum(size[chosen])[:-1]].astype(np.int64)[: chosen.sum()]


def mixtures(likely: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The proportions of each text in its selected mixture; languages outside the set have 0."""
    n = np.diff(np.r_[start, len(likely)])
    share, full = fit(likely, start, np.ones((len(start), likely.shape[1])))
    order = np.argsort(-share, axis=1, kind="stable")
    best, chosen = np.full(len(start), -np.inf), share.copy()
    open_, words, first = np.arange(len(start)), likely, start
    for k in range(1, likely.shape[1] + 1):
        penalty = PENALTY * (k - 1) * np.log(n + 1)
        on = full[open_] - penalty[open_] > best[open_]
        if not on.all():
            open_, (words, first) = open_[on], _part(words, first, on)
        if not len(open_):
            break
        allowed = np.zeros((len(open_), likely.shape[1]))
        np.put_along_axis(allowed, order[open_, :k], 1.0, axis=1)
        made, value = fit(words, first, allowed)
        value = value - penalty[open_]
        better = value > best[open_]
        best[open_[better]], chosen[open_[better]] = value[better], made[better]
    return chosen


def predict(texts: list[str], langs: list[str], table: Table | np.ndarray) -> list[tuple[str, float, list[str], list[float]]]:
    """Language, score, set and proportions of each text."""
    bucket, word, text, size = words_of(texts)
    out: list[tuple[str, float, list[str], list[float]]] = [(NONE, 0.0, [], []) for _ in texts]
    if not len(bucket) or not langs:
        return out
    likely = np.zeros((len(size), len(langs)))
    for k in range(0, len(bucket), SLICE):
        w = word[k : k + SLICE]
        n = int(w[-1]) - int(w[0]) + 1
        for j in range(len(langs)):
            likely[w[0] : w[0] + n, j] += np.bincount(w - w[0], weights=table[bucket[k : k + SLICE], j], minlength=n)
    likely = np.maximum(np.exp(likely - likely.max(axis=1, keepdims=True)), FLOOR)
    first = np.r_[True, text[1:] != text[:-1]]
    share = mixtures(likely, np.flatnonzero(first))
    order = np.argsort(-share, axis=1, kind="stable")
    many = (share > 0).sum(axis=1)
    for i, t in enumerate(text[first].tolist()):
        top = order[i, : many[i]]
        shares = np.minimum(share[i, top], 1.0).tolist()
        out[t] = (langs[top[0]], shares[0], [langs[j] for j in top], shares)
    return out


def predict_column(text: Column, model: tuple[list[str], Table], spark) -> Column:
    """``struct<lang_pred, score, langs, shares>`` of each whole text."""
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, langs array<string>, shares array<double>")
    def guess(s: pd.Series) -> pd.DataFrame:
        langs, table = sent.value
        texts = [t or "" for t in s]
        made = [row for run in _runs(texts, len(langs)) for row in predict(texts[run], langs, table)]
        return pd.DataFrame(made, columns=["lang_pred", "score", "langs", "shares"], index=s.index)

    return guess(text)


def identify(docs: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, langs, shares`` for each row of ``docs``."""
    model = learn(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _held_out(F.col("doc_id")).alias("held_out"), predict_column(F.col("text"), model, docs.sparkSession).alias("made"))
    return rows.select("doc_id", "held_out", "made.lang_pred", "made.score", "made.langs", "made.shares")


def keep_identified(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """``docs`` without rows of no language (``und``) or in which no language holds ``least`` of the words."""
    made = predict_column(F.col("text"), learn(docs), docs.sparkSession)
    return packed(docs, made=made).where((F.col("made.lang_pred") != NONE) & (F.col("made.score") >= least)).select("row.*")
