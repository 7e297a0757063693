"""SimHash near-dedup: fingerprints, bit-sliced comparison, components.

*Fingerprint.* A-Z of the whole text become lower case; words are ``[^\\x20\\x09-\\x0D]+``; every
``SHINGLE``-word shingle, repeats included, is hashed by XXH64 (seed 42) over its UTF-8 bytes, and
bit ``i`` is set if it is set in over half of the hashes. Fewer words: one hash of all of them; no
word: zero.

*Candidates.* The 64 bits are cut into ``RADIUS + 3`` bands. Two fingerprints within ``RADIUS``
bits agree on some choice of 3 bands, so each distinct fingerprint goes to one bucket per choice. A
bucket of over ``BUCKET`` fingerprints is not cut off: its free bits are cut into ``RADIUS + 1``
parts, one of which two near fingerprints share, and each fingerprint moves to that many smaller
buckets. Fingerprints are distinct, so a bucket with 8 free bits holds 256 at most, and the
refinement ends after a few rounds at any size, with every pair still met.

*Comparison.* A bucket is stored as bit planes, 64 fingerprints a word. For each fingerprint, the
differing bits of all others are added plane by plane into carry-save counters; a block whose
counters all exceed the radius is abandoned. Only a star for each linked set leaves the bucket.

Defined results: a null or empty text has fingerprint zero and is linked like any other. Equal
fingerprints are one node, so a group of copies costs one row after the map-side combine. A null
``doc_id`` is never a ``component_id`` unless its whole component has none. Rows that repeat give a
row each in :func:`near_groups`; :func:`drop_near` leaves one row of each component. Columns beside
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import drop_rows, materialize, same
from vigil.llm.components import components

SHINGLE = 3
RADIUS = 2
#: Fingerprints that one bucket compares at once; larger ones are refined.
BUCKET = 256
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of one text."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(line, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-shingle] + 1].tolist()
    hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 65536):
        ones += np.unpackbits(hashes[k : k + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    """The fingerprint as a signed long of the same bits."""

    @F.pandas_udf("long")
    def prints(s: pd.Series) -> pd.Series:
        found = np.array([fingerprint(t, shingle) for t in s], np.uint64)
        return pd.Series(found.view(np.int64), index=s.index)

    return prints(text)


def near_bits(prints: np.ndarray, bucket: np.ndarray, place: np.ndarray, words: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Bit-sliced comparison of each fingerprint with its bucket.

    ``bucket`` numbers the buckets, ``place`` the members of each, below ``64 * words``. Returns the
    rows that have a neighbour and, for each, a bit for each member of its bucket within ``radius``.
    """
    n, total = len(prints), int(bucket.max()) + 1
    bits = np.unpackbits(prints.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    flat = np.zeros((total, 65, 64 * words), np.uint8)
    flat[bucket, :64, place] = bits
    flat[bucket, 64, place] = 1
    planes = np.packbits(flat, axis=2, bitorder="little").view(np.uint64).reshape(total, 65, words)
    row = np.arange(n)
    over = ~planes[bucket, 64]
    over[row, place // 64] |= np.uint64(1) << (place % 64).astype(np.uint64)
    ask = (np.uint64(0) - bits.astype(np.uint64))[:, :, None]
    counters = [np.zeros((n, words), np.uint64) for _ in range(radius.bit_length())]
    full = ~np.uint64(0)
    for p in range(64):
        carry = planes[bucket[row], p] ^ ask[row, p]
        for c in counters:
            c ^= carry
            carry &= ~c
        over |= carry  # the counter has wrapped
        if p % 8 == 7:
            more, equal = np.zeros_like(over), np.full_like(over, full)
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    more |= equal & counters[k]
                    equal &= ~counters[k]
            over |= more
            alive = (over != full).any(axis=1)
            row, over, counters = row[alive], over[alive], [c[alive] for c in counters]
            if not len(row):
                break
    return row, ~over


def stars(rows: Iterator[pd.DataFrame], radius: int = RADIUS) -> Iterator[pd.DataFrame]:
    """Buckets in, ``(a, b)`` out: each fingerprint with the smallest one of its linked set."""
    for pdf in rows:
        out_a, out_b = [], []
        members = [np.asarray(x, np.int64) for x in pdf["prints"]]
        sizes = np.array([len(x) for x in members], np.int64)
        for words in np.unique((sizes + 63) // 64).tolist():
            own = [m for m, k in zip(members, sizes, strict=True) if (k + 63) // 64 == words]
            step = max(1, 2048 // words)
            for part in (own[k : k + step] for k in range(0, len(own), step)):
                size = np.array([len(m) for m in part])
                prints, bucket = np.concatenate(part), np.repeat(np.arange(len(part)), size)
                begin = np.cumsum(size) - size
                rows_near, near = near_bits(prints.view(np.uint64), bucket, np.arange(len(prints)) - begin[bucket], words, radius)
                links: dict[int, dict[int, int]] = {}
                for r, x in zip(rows_near.tolist(), near, strict=True):
                    links.setdefault(int(bucket[r]), {})[r - int(begin[bucket[r]])] = int.from_bytes(x.astype("<u8").tobytes(), "little")
                for b, near_of in links.items():
                    while near_of:
                        start = next(iter(near_of))
                        todo = linked = 1 << start
                        while todo:
                            k = (todo & -todo).bit_length() - 1
                            reach = near_of.pop(k) & ~linked
                            linked |= reach
                            todo = (todo & (todo - 1)) | reach
                        group = [int(part[b][k]) for k in range(linked.bit_length()) if linked >> k & 1]
                        low = min(group)
                        out_a += [x for x in group if x != low]
                        out_b += [low] * (len(group) - 1)
        yield pd.DataFrame({"a": np.array(out_a, np.int64), "b": np.array(out_b, np.int64)})


def _parts(free: list[int], count: int) -> list[list[int]]:
    cut = [round(len(free) * k / count) for k in range(count + 1)]
    return [free[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges ``(a, b)`` that connect all distinct fingerprints ``fp`` within ``radius`` bits."""
    bands = _parts(list(range(64)), radius + 3)
    masks = [sum(1 << i for band in some for i in band) for some in combinations(bands, 3)]
    level = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)).cast("long") for m in masks])).alias("mask"))
    edges = None
    while True:
        level = level.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("bucket"), "fp")
        sizes = level.groupBy("mask", "bucket").count().where("count > 1")
        sizes = materialize(sizes, "simhash-buckets")
        met = level.join(sizes, ["mask", "bucket"])
        small = met.where(F.col("count") <= BUCKET).groupBy("mask", "bucket").agg(F.collect_list("fp").alias("prints"))
        found = small.select("prints").mapInPandas(lambda rows: stars(rows, radius), "a long, b long").distinct()
        found = materialize(found, "simhash-links")
        edges = found if edges is None else edges.unionByName(found)
        if not sizes.where(F.col("count") > BUCKET).limit(1).count():
            return edges
        finer = {}
        for m in masks:
            free = [i for i in range(64) if not m >> i & 1]
            finer[m] = [m | sum(1 << i for i in part) for part in _parts(free, radius + 1)]
        table = F.create_map(*[x for m, subs in finer.items() for x in (F.lit(_signed(m)).cast("long"), F.array(*[F.lit(_signed(s)).cast("long") for s in subs]))])
        level = materialize(met.where(F.col("count") > BUCKET).select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct(), "simhash-hot")
        masks = sorted({s for subs in finer.values() for s in subs})


def _grouped(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """Narrow rows ``(doc_id, text_hash, fp)``, and ``(fp, root)`` for each distinct fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), fingerprint_column(F.col("text"), shingle).alias("fp"))
    rows = materialize(rows, "simhash-rows")
    prints = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "simhash-prints")
    roots = components(links(prints.select("fp"), radius)).withColumnRenamed("node", "fp")
    return rows, prints.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "low")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for each row of ``docs``."""
    rows, nodes = _grouped(docs, shingle, radius)
    low = nodes.groupBy("root").agg(F.min("low").alias("component_id"))
    of = materialize(nodes.join(low, "root").select("fp", "component_id"), "simhash-components")
    return rows.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each component: the one with the smallest ``doc_id``, nulls last."""
    rows, nodes = _grouped(docs, shingle, radius)
    name = ["doc_id", "text_hash"]
    per = rows.groupBy("fp", *name).agg(F.count("*").alias("n"))
    # Per fingerprint first: a component of many copies is few rows before its own group is formed.
    order = F.struct(F.col("doc_id").isNull().alias("none"), *name, "n")
    first = per.groupBy("fp").agg(F.min(order).alias("first"), F.sum("n").alias("size"))
    of = materialize(nodes.select("fp", "root").join(first, "fp"), "simhash-nodes")
    firsts = of.groupBy("root").agg(F.min("first").alias("best"), F.sum("size").alias("size")).where("size > 1").select("root", "best")
    crowded = materialize(of.select("fp", "root").join(firsts, "root").drop("root"), "simhash-crowded")
    is_best = [same(F.col(c), F.col(f"best.{c}")) for c in name]
    gone = rows.join(crowded, "fp").where(~(is_best[0] & is_best[1])).select(*name).distinct()
    again = crowded.where("best.n > 1").select("best.*").select(*name).distinct()
    key = {"doc_id": F.col("doc_id").cast("long"), "text_hash": F.xxhash64("text")}
    return drop_rows(docs, key, materialize(gone, "simhash-gone"), materialize(again, "simhash-again"))
