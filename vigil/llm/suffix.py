"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also starts elsewhere go.

*Which suffixes to sort.* A string of ``LENGTH`` bytes has one anchor, decided by its content alone: its
``GRAM``-byte piece of the smallest hash (the leftmost of equals). Starts with the same anchor and
about the same distance to it form a run (distances in steps of ``STEPS[0]``); all their strings share
a core around the anchor. Equal strings, wherever they are, lie in runs with equal cores, so runs whose
core hash is met once are done, and the rest is grouped by it. Equal runs (same bytes) of a group are
one weighted context, combined before the shuffle.

*Deep-shallow sorting.* In a group, the suffixes at all starts of its contexts are sorted by
multikey quicksort, eight bytes a key, to depth ``SHALLOW``; suffixes that are still tied, a long
common prefix, go through a blind trie: it branches on single bytes, a descent looks at the branching
bytes only, and one comparison with the leaf gives the common prefix. Suffixes with ``LENGTH`` common bytes
meet in a leaf; a leaf with a weight of two or more is a repeated string.

*Hot groups.* A group of over ``GROUP`` contexts is not sorted at once: its runs are cut into runs of
fewer distances (the next of ``STEPS``), whose cores are longer, and grouped anew. In the last step a core
is the whole string, and a group is a set of equal strings. So no task holds an unbounded group,
and every suffix is still met.

Hashes (64 bits) only group; which strings are equal is decided by comparing bytes, but for equal runs,
which are taken as equal by two hashes. Defined results: a null text counts as empty; texts shorter than
``LENGTH`` lose nothing; rows that repeat are copies of each other; a null ``doc_id`` is a key like any
other. Texts are whole; long ones are read in pieces that overlap. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import materialize, same, whole_text

LENGTH = 400
GRAM = 32
SPAN = LENGTH - GRAM + 1
#: Distances from the anchor that runs hold, level by level; the last is one.
STEPS = (123, 41, 14, 5, 1)
SHALLOW = 32
GROUP = 256
#: Bytes hashed at once, and contexts sorted at once; they bound a worker's memory only.
PIECE, BATCH = 1 << 19, 2000
_BASE = 0x9E3779B97F4A7C15 | 1
_RUNS = "core long, ctx long, doc_id long, text_hash long, at int, starts int, far int"


class Hashes:
    """Hashes of any substrings of a buffer, by prefix sums modulo 2**64."""

    def __init__(self, size: int):
        self.power = np.cumprod(np.r_[np.uint64(1), np.full(size, _BASE, np.uint64)])
        inverse = pow(_BASE, -1, 1 << 64)
        self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, inverse, np.uint64)])

    def sums(self, raw: np.ndarray) -> np.ndarray:
        return np.r_[np.uint64(0), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.power[: len(raw)])]

    def of(self, sums: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        x = (sums[end] - sums[begin]) * self.inverse[begin]
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    rows = full.reshape(-1, width)
    head = np.minimum.accumulate(rows, axis=1).ravel()
    tail = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(x) - width + 1
    return np.minimum(tail[:n], head[width - 1 : width - 1 + n])


def _core(hashes: Hashes, sums: np.ndarray, anchor: np.ndarray, far: np.ndarray, step: int) -> np.ndarray:
    """Hash of the bytes that all strings share whose distance to the anchor is in ``far``'s step."""
    near = far // step * step
    core = hashes.of(sums, anchor - near, anchor - near - (step - 1) + LENGTH)
    return core ^ (near.astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def runs_of(raw: np.ndarray, valid: np.ndarray, hashes: Hashes) -> pd.DataFrame:
    """Runs of a buffer; ``valid``: starts whose string lies within one text."""
    sums = hashes.sums(raw)
    g = np.arange(len(raw) - GRAM + 1)
    key = (hashes.of(sums, g, g + GRAM) & np.uint64(0xFFFFFFFF00000000)) | g.astype(np.uint64)
    p = np.flatnonzero(valid)
    anchor = (sliding_min(key, SPAN)[p] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    part = (anchor - p) // STEPS[0]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
    starts = np.diff(np.r_[first, len(p)])
    at, anchor = p[first], anchor[first]
    far = anchor - at
    core = _core(hashes, sums, anchor, far, STEPS[0])
    ctx = hashes.of(sums, at, at + starts + LENGTH - 1) ^ (far.astype(np.uint64) << np.uint64(40)) ^ starts.astype(np.uint64)
    return pd.DataFrame({"core": core.view(np.int64), "ctx": ctx.view(np.int64), "at": at, "starts": starts, "far": far})


def _runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    hashes = Hashes(2 * PIECE + 2 * LENGTH)
    for pdf in batches:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for k, text in enumerate(pdf["text"]):
            raw = (text or "").encode("utf-8", "surrogatepass")
            for base in range(0, max(0, len(raw) - LENGTH + 1), PIECE):
                held.append((k, base, raw[base : base + PIECE + LENGTH - 1]))
                size += len(held[-1][2])
                if size >= PIECE:
                    yield _run_pieces(held, pdf, hashes)
                    held, size = [], 0
        if held:
            yield _run_pieces(held, pdf, hashes)


def _run_pieces(held: list[tuple[int, int, bytes]], pdf: pd.DataFrame, hashes: Hashes) -> pd.DataFrame:
    raw = np.frombuffer(b"".join(x[2] for x in held), np.uint8)
    size = np.array([len(x[2]) for x in held])
    begin = np.cumsum(size) - size
    piece = np.repeat(np.arange(len(held)), size)
    valid = np.arange(len(raw)) + LENGTH <= (begin + size)[piece]
    out = runs_of(raw, valid, hashes)
    of = piece[out["at"].to_numpy()]
    row = np.array([x[0] for x in held])[of]
    out["at"] += np.array([x[1] for x in held])[of] - begin[of]
    for name in ("doc_id", "text_hash"):
        out[name] = pdf[name].to_numpy()[row]
    return out[["core", "ctx", "doc_id", "text_hash", "at", "starts", "far"]]


# --- deep-shallow sorting -------------------------------------------------------------------------


class _Node:
    """Of a blind trie: where it branches, and its branches by byte."""

    __slots__ = ("depth", "kids")

    def __init__(self, depth: int, kids: dict):
        self.depth, self.kids = depth, kids


def blind_trie(raw: bytes, at: list[int], weight: list[int], length: int = LENGTH) -> list[tuple[list[int], int]]:
    """Sorted leaves of the suffixes at ``at``, compared to ``length``: (numbers of the suffixes, weight)."""
    root: _Node | list = [0]
    heavy = {0: weight[0]}
    for n in range(1, len(at)):
        s = at[n]
        node, path = root, []
        while isinstance(node, _Node):
            path.append(node)
            # Blind: only branching bytes are looked at; a byte that has no branch takes any.
            node = node.kids.get(raw[s + node.depth]) or next(iter(node.kids.values()))
        other = at[node[0]]
        a, b = raw[s : s + length], raw[other : other + length]
        if a == b:
            node.append(n)
            heavy[node[0]] += weight[n]
            continue
        lcp = length - ((int.from_bytes(a) ^ int.from_bytes(b)).bit_length() + 7) // 8
        heavy[n] = weight[n]
        above, below = None, root
        for x in path:
            if x.depth > lcp:
                below = x
                break
            above = x
            below = x.kids.get(raw[s + x.depth])
        if above is not None and above.depth == lcp:
            above.kids[raw[s + lcp]] = [n]
            continue
        if below is None or below is node:
            below = node
        fork = _Node(lcp, {raw[other + lcp]: below, raw[s + lcp]: [n]})
        if above is None:
            root = fork
        else:
            above.kids[raw[s + above.depth]] = fork
    leaves, todo = [], [root]
    while todo:
        x = todo.pop()
        if isinstance(x, _Node):
            todo += [x.kids[c] for c in sorted(x.kids, reverse=True)]
        else:
            leaves.append((x, heavy[x[0]]))
    return leaves


def repeated(contexts: list[bytes], starts: np.ndarray, group: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For each start of each context, in order: does its string have a weight of two or more in its group?"""
    raw = b"".join(contexts) + b"\0" * 8
    buf = np.frombuffer(raw, np.uint8).astype(np.uint64)
    words = np.zeros(len(buf) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | buf[k : len(buf) - 7 + k]
    size = np.array([len(c) for c in contexts])
    of = np.repeat(np.arange(len(contexts)), starts)
    begin = (np.cumsum(size) - size)[of]
    pos = begin + np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts)
    found = weight[of] >= 2
    # Multikey quicksort, eight bytes a key: ties keep their places and go on to the next key.
    live, tie = np.arange(len(of)), group[of]
    for depth in range(0, SHALLOW, 8):
        key = words[pos[live] + depth]
        order = np.lexsort((key, tie))
        live, tie, key = live[order], tie[order], key[order]
        change = np.r_[True, (tie[1:] != tie[:-1]) | (key[1:] != key[:-1])]
        block = np.cumsum(change) - 1
        more = np.bincount(block)[block] > 1
        live, tie = live[more], block[more]
        if not len(live):
            return found
    cut = np.flatnonzero(np.r_[True, tie[1:] != tie[:-1], True]).tolist()
    where, heavy = pos[live].tolist(), weight[of[live]].tolist()
    for a, b in zip(cut, cut[1:], strict=False):
        for leaf, w in blind_trie(raw, where[a:b], heavy[a:b]):
            if w >= 2:
                found[live[[a + k for k in leaf]]] = True
    return found


def _sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Contexts in order of ``core``; out come the repeated starts ``first..last`` of each."""
    held: list[pd.DataFrame] = []
    rows = 0
    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= BATCH:
            every = pd.concat(held, ignore_index=True)
            core = every["core"].to_numpy()
            stop = int(np.flatnonzero(core != core[-1])[-1]) + 1 if core[0] != core[-1] else 0
            k = 0
            while k < stop:
                end = min(stop, k + BATCH)
                while end < stop and core[end] == core[end - 1]:
                    end += 1
                yield _found(every.iloc[k:end])
                k = end
            held, rows = [every.iloc[stop:]], len(every) - stop
    if rows:
        yield _found(pd.concat(held, ignore_index=True))


def _found(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.drop_duplicates(["core", "own_core", "own_ctx", "shift"])
    starts = rows["starts"].to_numpy().astype(np.int64)
    change = np.r_[True, rows["core"].to_numpy()[1:] != rows["core"].to_numpy()[:-1]]
    hit = repeated(rows["raw"].tolist(), starts, np.cumsum(change), rows["weight"].to_numpy())
    of = np.repeat(np.arange(len(rows)), starts)
    shift = np.arange(len(of)) - np.repeat(np.cumsum(starts) - starts, starts) + rows["shift"].to_numpy()[of]
    at = np.flatnonzero(hit)
    if not len(at):
        return pd.DataFrame({"core": [], "ctx": [], "first": [], "last": []}, dtype=np.int64)
    head = np.r_[True, (at[1:] != at[:-1] + 1) | (of[at[1:]] != of[at[:-1]])]
    tail = np.r_[head[1:], True]
    who = of[at[head]]
    return pd.DataFrame({"core": rows["own_core"].to_numpy()[who], "ctx": rows["own_ctx"].to_numpy()[who], "first": shift[at[head]], "last": shift[at[tail]]})


def _finer(step: int, last: bool):
    """Cuts contexts into runs of at most ``step`` distances."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes(LENGTH + STEPS[0])
        for pdf in batches:
            out = []
            for own_core, own_ctx, shift, starts, far, weight, raw in zip(*(pdf[c] for c in ("own_core", "own_ctx", "shift", "starts", "far", "weight", "raw")), strict=True):
                sums = hashes.sums(np.frombuffer(raw, np.uint8))
                k = 0
                while k < starts:
                    n = min(starts - k, (far - k) % step + 1)
                    core = _core(hashes, sums, np.array([far]), np.array([far - k]), step)
                    out.append((int(core.view(np.int64)[0]), own_core, own_ctx, shift + k, n, far - k, weight, b"" if last else raw[k : k + n + LENGTH - 1]))
                    k += n
            yield pd.DataFrame(out, columns=["core", "own_core", "own_ctx", "shift", "starts", "far", "weight", "raw"])

    return cut


_CONTEXT = "core long, own_core long, own_ctx long, shift int, starts int, far int, weight long, raw binary"


def _repeats(level: DataFrame) -> DataFrame:
    """``(core, ctx, first, last)``: repeated starts of each context of ``level``."""
    found = []
    for k, step in enumerate(STEPS):
        sizes = level.groupBy("core").agg(F.count("*").alias("n"), F.sum("weight").alias("heavy")).where("heavy > 1")
        sizes = materialize(sizes.withColumnRenamed("core", "g_core"), "suffix-groups")
        met = level.join(sizes, F.col("core") == F.col("g_core"))
        if k == len(STEPS) - 1:  # a core is the whole string
            found.append(met.select(F.col("own_core").alias("core"), F.col("own_ctx").alias("ctx"), F.col("shift").cast("long").alias("first"), F.col("shift").cast("long").alias("last")))
            break
        small = met.where(F.col("n") <= GROUP).drop("g_core", "n", "heavy")
        dealt = small.repartition("core").sortWithinPartitions("core")
        found.append(dealt.mapInPandas(_sorted, "core long, ctx long, first long, last long"))
        if not sizes.where(F.col("n") > GROUP).limit(1).count():
            break
        hot = met.where(F.col("n") > GROUP).drop("core", "g_core", "n", "heavy")
        level = materialize(hot.mapInPandas(_finer(STEPS[k + 1], k + 1 == len(STEPS) - 1), _CONTEXT), "suffix-hot")
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def spans(docs: DataFrame) -> DataFrame:
    """``doc_id, text_hash, spans``: maximal removed runs ``array<struct<first, end>>`` of texts that lose bytes."""
    rows = _keyed(docs)
    runs = materialize(rows.mapInPandas(_runs, _RUNS), "suffix-runs")
    cores = runs.groupBy("core").count().where("count > 1").select(F.col("core").alias("g_core"))
    cores = materialize(cores, "suffix-cores")
    met = materialize(runs.join(cores, F.col("core") == F.col("g_core"), "left_semi"), "suffix-met")
    sample = F.struct("doc_id", "text_hash", "at", "starts", "far")
    contexts = met.groupBy("core", "ctx").agg(F.count("*").alias("weight"), F.min(sample).alias("s"))
    wanted = contexts.select(F.col("s.doc_id").alias("w_id"), F.col("s.text_hash").alias("w_hash"), F.struct("core", "ctx", "weight", "s.at", "s.starts", "s.far").alias("c"))
    wanted = materialize(wanted.groupBy("w_id", "w_hash").agg(F.collect_list("c").alias("wanted")), "suffix-wanted")
    text = rows.join(wanted, same(F.col("doc_id"), F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
    text = text.select(F.encode("text", "UTF-8").alias("t"), F.explode("wanted").alias("c"))
    level = text.select(
        F.col("c.core").alias("core"), F.col("c.core").alias("own_core"), F.col("c.ctx").alias("own_ctx"), F.lit(0).alias("shift"),
        "c.starts", "c.far", "c.weight", F.substring(F.col("t"), F.col("c.at") + 1, F.col("c.starts") + LENGTH - 1).alias("raw"),
    ).dropDuplicates(["own_core", "own_ctx"])
    hits = _repeats(materialize(level, "suffix-contexts"))
    hits = materialize(hits.select(F.col("core").alias("h_core"), F.col("ctx").alias("h_ctx"), "first", "last"), "suffix-hits")
    covered = met.join(hits, (F.col("core") == F.col("h_core")) & (F.col("ctx") == F.col("h_ctx")))
    piece = F.struct((F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last") + LENGTH).alias("end"))
    pieces = covered.select("doc_id", "text_hash", piece.alias("p")).groupBy("doc_id", "text_hash").agg(F.collect_set("p").alias("pieces"))
    # Overlapping or touching pieces become one run.
    merged = F.aggregate(
        F.array_sort("pieces"),
        F.array().cast("array<struct<first:bigint,end:bigint>>"),
        lambda out, x: F.when(
            (F.size(out) > 0) & (x["first"] <= F.element_at(out, -1)["end"]),
            F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["first"].alias("first"), F.greatest(F.element_at(out, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(out, F.array(x))),
    )
    return pieces.select("doc_id", "text_hash", merged.alias("spans"))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), whole_text().alias("text"))


def _kept_column(text: Column, cut: Column) -> Column:
    @F.pandas_udf("binary")
    def kept(texts: pd.Series, cuts: pd.Series) -> pd.Series:
        out = []
        for t, spans_ in zip(texts, cuts, strict=True):
            raw, parts, at = t.encode("utf-8", "surrogatepass"), [], 0
            for x in spans_ if spans_ is not None else ():
                parts.append(raw[at : x["first"]])
                at = x["end"]
            out.append(b"".join([*parts, raw[at:]]))
        return pd.Series(out, index=texts.index)

    return kept(text, cut)


def drop_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` (binary: the remaining bytes) for each row of ``docs``."""
    cut = materialize(spans(docs).select(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), "spans"), "suffix-spans")
    rows = _keyed(docs).join(cut, same(F.col("doc_id"), F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left")
    return rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "spans", _kept_column(F.col("text"), F.col("spans")).alias("kept"))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``."""
    rows = drop_repeats(docs)
    none = F.col("spans").isNull()
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["first"])
    return rows.select(
        "doc_id", "n_bytes",
        F.when(none, F.lit(0)).otherwise(removed).cast("long").alias("n_removed"),
        F.when(none, F.lit(0)).otherwise(F.size("spans")).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
