"""Token-ID files: one wavelet matrix per shard, written and read by Spark.

*Writing.* Rows are dealt and sorted by ``(doc_id, hash of the text, row)``, so a task holds a run of the
ascending ids; a third of all rows may share an id and a text, the row number still cuts them. A task encodes
its texts, appends the end id to each, and closes a shard at the row that brings it to ``SHARD_TOKENS``; a row is
never cut. Each shard is one file of :mod:`vigil.llm.wavelet`, in which the ids and lengths of its documents
ride along. Spark's text writer commits them (the file, then a line feed that its reader ignores), so a lost
or repeated task leaves no file twice, in any store that Spark writes to.

*Encoding.* Texts are cut into forms on their bytes, by numpy: only where the tokenizer's own split cuts too, whatever
stands around: before white space that follows another character (its matches take white space
at their start only), between a letter or digit and a point or the like (matches with letters end in one), and
after a single line feed before a letter or digit. Added tokens hold neither, which is checked against the
model file. Arrow numbers the distinct forms of a group of texts and finds those already known; the library encodes
each new form once. A form of letters alone is one piece of the tokenizer's split, so many go to the library's
model in one line, cut at line feeds; the token that a word's space begins tells where it begins. Forms are forgotten
after ``MAX_FORMS``; a group holds ``GROUP_CHARS`` of text, but for one longer text.

*Reading.* ``binaryFile`` hands whole files to tasks; :func:`documents_of` decodes them, :func:`count_token` and
:func:`locate_token` ask rank and select of one token and decode nothing.

Defined results: a null text counts as empty and holds the end id alone. Null ids come last; equal ids are in
the order of their texts' hashes; rows that repeat are rows of their own. An empty table gives no files and an
empty result. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.llm.common import materialize
from vigil.llm.wavelet import Wavelet, build

SHARD_TOKENS = 1 << 22
#: Shards of one task; a shard's number is its task's, then its own.
_PER_TASK = 1 << 20
#: Distinct forms a worker remembers, and the longest of them in bytes.
MAX_FORMS = 1 << 20
MAX_FORM_CHARS = 64
#: Bytes of texts that are cut at once, and words that go to the model at once.
GROUP_CHARS = 1 << 24
LINE = 1000
END = 0

# --- Fixed values: Unicode's white space, as the tokenizer's split knows it; plain letters ------------------
_WHITE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
# -----------------------------------------------------------------------------------------------------------
_STOP = ".,;:!?"
_WORD = f" ?[{_LETTERS}]+"


def _bytes_in(values) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(values)] = True
    return table


_IS_WHITE = _bytes_in(b"\t\n\x0b\x0c\r ")
_IS_STOP = _bytes_in(_STOP.encode())
_IS_PLAIN = _bytes_in(c for c in range(128) if chr(c).isalnum())
#: First bytes of two-byte characters from À to ȿ: letters, but for × and ÷.
_LEADS = _bytes_in(range(0xC3, 0xC9))
#: The last byte of white characters beyond ASCII, and the byte before it.
_WHITE_LAST = _bytes_in([*range(0x80, 0x8B), 0x85, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF])
_WHITE_LEADS = _bytes_in([0xC2, 0x80, 0x81, 0x9A])


def _starts(raw: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Where forms start in the bytes of texts that start at ``texts``."""
    before = np.r_[np.uint8(0), raw[:-1]]
    cut = _IS_WHITE[raw]
    at = np.flatnonzero(cut)
    last = before[at]
    odd = _IS_WHITE[last]
    wide = np.flatnonzero(_WHITE_LAST[last])
    odd[wide] = _WHITE_LEADS[before[at[wide] - 1]]
    cut[at[odd]] = False
    cut[texts] = True
    at = np.flatnonzero(cut & (raw == 10))
    after = raw[np.minimum(at + 1, len(raw) - 1)]
    cut[at[(at + 1 < len(raw)) & (_IS_PLAIN | _LEADS)[after]] + 1] = True
    at = np.flatnonzero(_IS_STOP[raw])
    last, lead = before[at], before[at - 1]
    letter = _IS_PLAIN[last] | ((last >= 0x80) & _LEADS[lead] & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7))))
    cut[at[letter]] = True
    return np.flatnonzero(cut)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts as little-endian 32-bit integers, as the library gives them without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallel ones
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split = model["pre_tokenizer"] or {}
        if model["normalizer"] or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex", True):
            raise ValueError("only byte-level models without normaliser and prefix space are supported")
        if any(re.search(f"[{_STOP}{_WHITE}]", t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] for t in model["added_tokens"]):
            raise ValueError("added tokens must neither hold nor take white space, nor hold stops")
        self.library = Tokenizer.from_file(path)
        self.planes = max(1, (max(self.library.get_vocab_size(), 2) - 1).bit_length())
        #: Letters and the space as the model knows them; none where an added token could stand in a word.
        self.letters: dict[int, str] = {}
        if not any(re.fullmatch(_WORD, t["content"]) for t in model["added_tokens"]):
            known = filter(re.compile(f"[ {_LETTERS}]").match, map(chr, range(0x250)))
            self.letters = {ord(c): "".join(x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(c)) for c in known}
        #: The library's model by itself, over words that are cut at line feeds.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = CharDelimiterSplit("\n")
        self.spaced = np.zeros(1 << self.planes, bool)
        if self.letters:
            self.spaced[[k for t, k in self.library.get_vocab().items() if t.startswith(self.letters[32])]] = True
        self._forget()

    def _forget(self) -> None:
        """Known forms, and where the ids of each lie in ``ids``."""
        self.known, self.ids = pa.array([], pa.large_binary()), np.zeros(0, "<u4")
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[bytes]:
        out = []
        for ids, sizes in self.groups([pa.array(texts, pa.large_string())]):
            raw, ends = ids.tobytes(), (4 * np.cumsum(sizes)).tolist()
            out += [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def groups(self, columns: Iterator[pa.Array], end: int | None = None, chars: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and their number by text, for groups of the texts in order; ``end``: an id that each text's ids get."""
        held, size, chars = [], 0, chars or GROUP_CHARS
        for column in columns:
            texts = column.cast(pa.large_string()).cast(pa.large_binary())
            ends, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False)), 0
            while at < len(texts):
                # Up to the text that fills the group.
                done = int(ends[at - 1]) if at else 0
                to = min(len(texts), int(np.searchsorted(ends, done + chars - size)) + 1)
                held.append(texts.slice(at, to - at))
                size += int(ends[to - 1]) - done
                at = to
                if size >= chars:
                    yield self._group(pa.concat_arrays(held), end)
                    held, size = [], 0
        if held:
            yield self._group(pa.concat_arrays(held), end)

    def _group(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        size = int(offsets[-1] - offsets[0])
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if size else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        at = np.r_[_starts(raw, offsets[:-1][offsets[:-1] < offsets[1:]]), size].astype(np.int64) if size else np.zeros(1, np.int64)
        forms = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)])
        forms = forms.dictionary_encode()
        begin, sizes, ids = self._known(forms.dictionary)
        which, edges = forms.indices.to_numpy(), np.searchsorted(at, offsets)
        if end is not None:
            which, edges = np.insert(which, edges[1:], len(begin)), edges + np.arange(len(edges))
            begin, sizes, ids = np.r_[begin, len(ids)], np.r_[sizes, 1], np.r_[ids, np.uint32(end)]
        count = sizes[which]
        ends = np.r_[0, np.cumsum(count)]
        spots = np.repeat(begin[which] - ends[:-1], count)
        spots += np.arange(len(spots))
        return ids[spots].astype("<u4", copy=False), np.diff(ends[edges])

    def _known(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each of distinct forms, where its ids begin and how many they are; and the ids."""
        if len(self.known) >= MAX_FORMS:
            self._forget()
        at = pc.index_in(forms, value_set=self.known)
        found = at.is_valid().to_numpy(zero_copy_only=False)
        short = pc.less_equal(pc.binary_length(forms), MAX_FORM_CHARS).to_numpy(zero_copy_only=False)
        begin, size = np.empty(len(forms), np.int64), np.empty(len(forms), np.int64)
        spot = at.drop_null().to_numpy()
        begin[found], size[found] = self.begin[spot], self.size[spot]
        ids = self.ids
        for keep in (True, False):  # long forms come last and are not remembered
            new = np.flatnonzero(~found & (short == keep))
            fresh = forms.take(pa.array(new))
            b, n, more = self._library(fresh.cast(pa.large_string()))
            begin[new], size[new] = b + len(ids), n
            ids = np.r_[ids, more]
            if keep:
                self.known, self.ids = pa.concat_arrays([self.known, fresh]), ids
                self.begin, self.size = np.r_[self.begin, begin[new]], np.r_[self.size, n]
        return begin, size, ids

    def _library(self, forms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_known``, by the library."""
        alone = pc.match_substring_regex(forms, f"^{_WORD}$") if self.letters else pa.array(np.zeros(len(forms), bool))
        plain = pc.string_is_ascii(forms)
        begin, size, ids, total = np.empty(len(forms), np.int64), np.empty(len(forms), np.int64), [], 0
        for part in (pc.and_(alone, plain), pc.and_not(alone, plain), pc.invert(alone)):
            here = np.flatnonzero(part.to_numpy(zero_copy_only=False))
            for k in range(0, len(here), LINE):
                rows = here[k : k + LINE]
                got = forms.take(pa.array(rows))
                if alone[int(rows[0])].as_py():
                    begin[rows], size[rows], made = self._words(got.to_pylist())
                else:
                    made = [e.ids for e in self.library.encode_batch_fast(got.to_pylist(), add_special_tokens=False)]
                    size[rows] = list(map(len, made))
                    begin[rows] = np.cumsum(size[rows]) - size[rows]
                    made = np.fromiter(chain.from_iterable(made), "<u4")
                begin[rows] += total
                total += len(made)
                ids.append(made)
        return begin, size, np.concatenate(ids) if ids else np.zeros(0, "<u4")

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``_library``, of words with or without a space before them."""
        # A word without a space follows a space that is a word of its own and not counted.
        bare = np.array([w[0] != " " for w in words], np.int64)
        line = "\n".join([w if w[0] == " " else " \n" + w for w in words])
        line = line.replace(" ", self.letters[32]) if line.isascii() else line.translate(self.letters)
        ids = np.array(self.model.encode_batch_fast([line], add_special_tokens=False)[0].ids, "<u4")
        begin = np.flatnonzero(self.spaced[ids])
        if len(begin) != len(words):
            raise ValueError("the model does not begin a token at each space")
        return begin + bare, np.diff(np.r_[begin, len(ids)]) - bare, ids


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str | None = None, end: int = END, shard_tokens: int = SHARD_TOKENS, group_chars: int | None = None) -> None:
    """Files of all ``docs (doc_id, text)`` in ``folder``, which must be new, in ascending ``doc_id`` order."""
    path = tokenizer or default_tokenizer()

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task, k = encoder(path), TaskContext.get().partitionId(), 0
        ids, sizes, docs_, total = [], [], [], 0
        names: list[pa.Array] = []

        def texts() -> Iterator[pa.Array]:
            for batch in batches:
                names.append(batch.column("id"))
                yield batch.column("text")

        def close() -> pa.RecordBatch:
            nonlocal ids, sizes, docs_, total, k
            every, size, doc = np.concatenate(ids), np.concatenate(sizes), pa.concat_arrays(docs_)
            extra = doc.fill_null(0).to_numpy().astype("<i8").tobytes() + size.astype("<i8").tobytes() + np.packbits(doc.is_null().to_numpy(zero_copy_only=False)).tobytes()
            made = build(every, coder.planes, extra, shard=task * _PER_TASK + k, rows=len(size), end=end)
            ids, sizes, docs_, total, k = [], [], [], 0, k + 1
            if k > _PER_TASK:
                raise ValueError("too many shards in one task: use more partitions")
            return pa.RecordBatch.from_pydict({"shard": pa.array([task * _PER_TASK + k - 1], pa.int64()), "value": pa.array([made], pa.binary())})

        for got, size in coder.groups(texts(), end, group_chars):
            # The ids of this group's rows, of batches that are met so far.
            every = pa.concat_arrays(names)
            doc, names[:] = every.slice(0, len(size)), [every.slice(len(size))]
            ends, row, at = np.cumsum(size), 0, 0
            while row < len(size):
                # Up to the row that brings the shard to its size.
                to = min(len(size), int(np.searchsorted(ends, at + shard_tokens - total)) + 1)
                ids.append(got[at : ends[to - 1]])
                sizes.append(size[row:to])
                docs_.append(doc.slice(row, to - row))
                total += int(ends[to - 1]) - at
                row, at = to, int(ends[to - 1])
                if total >= shard_tokens:
                    yield close()
        if sizes:
            yield close()

    doc, text = F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))
    rows = docs.select(doc.alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("row"))
    order = [F.col("id").asc_nulls_last(), "hash", "row"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    made = rows.select("id", "text").mapInArrow(shards, "shard long, value binary")
    made.select("shard", F.col("value").cast("string").alias("value")).write.partitionBy("shard").text(folder)


def _files(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(folder).select("content")


def _rows_of(w: Wavelet) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, lengths and null marks of a shard's documents."""
    n = w.head["rows"]
    names, sizes = np.frombuffer(w.extra, "<i8", n), np.frombuffer(w.extra, "<i8", n, 8 * n)
    return names, sizes, np.unpackbits(np.frombuffer(w.extra, np.uint8, offset=16 * n), count=n).astype(bool)


def documents_of(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, shard, at, n_tokens, ids_crc32`` of every document in the files; ``at``: ids of its shard before it."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                w = Wavelet(bytes(blob))
                names, sizes, missing = _rows_of(w)
                ends = np.cumsum(sizes)
                raw = memoryview(w.decode().astype("<u4").tobytes())
                sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
                doc = pd.arrays.IntegerArray(names.astype(np.int64), missing)
                yield pd.DataFrame({"doc_id": doc, "shard": w.head["shard"], "at": ends - sizes, "n_tokens": sizes.astype(np.int64), "ids_crc32": np.array(sums, np.int64)})

    return _files(spark, folder).mapInPandas(read, "doc_id long, shard long, at long, n_tokens long, ids_crc32 long")


def _ask(spark: SparkSession, folder: str, schema: str, answer) -> DataFrame:
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for blob in batch["content"]:
                yield answer(Wavelet(bytes(blob)))

    return _files(spark, folder).mapInPandas(read, schema)


def count_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``doc_id, n`` of the documents that hold ``token``, by two ranks a document."""

    def answer(w: Wavelet) -> pd.DataFrame:
        names, sizes, missing = _rows_of(w)
        edges = w.rank(token, np.concatenate([[0], np.cumsum(sizes)]))
        n = np.diff(edges)
        doc = pd.arrays.IntegerArray(names.astype(np.int64), missing)
        return pd.DataFrame({"doc_id": doc[n > 0], "n": n[n > 0]})

    return _ask(spark, folder, "doc_id long, n long", answer)


def locate_token(spark: SparkSession, folder: str, token: int) -> DataFrame:
    """``doc_id, at`` of every occurrence of ``token``; ``at`` counts from 0 in the document."""

    def answer(w: Wavelet) -> pd.DataFrame:
        names, sizes, missing = _rows_of(w)
        starts = np.cumsum(sizes) - sizes
        pos = w.locate(token)
        row = np.searchsorted(starts, pos, "right") - 1
        doc = pd.arrays.IntegerArray(names.astype(np.int64), missing)
        return pd.DataFrame({"doc_id": doc[row], "at": pos - starts[row]})

    return _ask(spark, folder, "doc_id long, at long", answer)


def report(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files; ``start``: ids of all before it."""
    rows = materialize(documents_of(spark, folder), "token-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("total")).withColumn("task", F.expr(f"shard div {_PER_TASK}"))
    # Two levels: within a task's shards, then over the tasks, a row for each.
    own = F.sum("total").over(Window.partitionBy("task").orderBy("shard")) - F.col("total")
    totals = totals.withColumn("own", own)
    tasks = totals.groupBy("task").agg(F.sum("total").alias("of_task"))
    tasks = tasks.select("task", (F.sum("of_task").over(Window.orderBy("task")) - F.col("of_task")).alias("base"))
    starts = materialize(totals.join(tasks, "task").select("shard", (F.col("own") + F.col("base")).alias("base")), "token-starts")
    return rows.join(starts, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
