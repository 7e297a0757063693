"""Exact top-k search by inner product over a pivot-distance index.

*Index.* Components become ``floor(256 * x)``, x as double. Each vector is keyed by its nearest pivot
(``PIVOTS`` vectors, those with the smallest hash of id and row number; they only steer the work, results are
exact) and its distance r to it. A range partitioning by (pivot, r, vec_id) cuts the whole table into
segments of about ``SEGMENT`` rows, and sorted blocks of ``BLOCK`` rows in them: pieces of annuli around a
pivot. ``vec_id`` is in the key, so even equal vectors are dealt evenly. The index is written once.

*Bounds.* For a query q at distance d from the pivot, a vector v of an annulus [r0, r1] has
``|q - v| >= d - r`` and ``>= r - d`` (triangle inequality), and ``2 q.v = |q|^2 + |v|^2 - |q - v|^2``; also
``q.v = q.p + q.(v - p) <= q.p + |q| r1``. The smaller of both bounds the score of the whole annulus.

*Search.* Each query first goes to the segment that holds its own row, whose k-th score is its threshold.
Then the bound of each pivot's whole ring (``PIVOTS`` numbers a query) picks the pivots that can still reach the
threshold, and among their segments those whose own bound does; pairs of query and segment that fail are never
written. In a segment, blocks are taken by falling bound, each for those queries only whose k-th score so far it
can reach. A segment that many queries ask for meets them in chunks of about ``CHUNK``, a task each, so neither
side of a task grows with the input.

Defined results: vectors that are null, hold null or non-finite components, or have another length than
most take no part, nor do rows with a null id. Every other row is a candidate, also where rows repeat a ``vec_id`` or
a whole row; no row of the query's own id is. Rows that repeat a query's id share one ranking, which holds a
candidate once for each of them. Ties go to the smaller ``vec_id``; fewer than k candidates give fewer rows.
Components beyond 64 bits become the nearest 64-bit number. Sums beyond 2**53 are made with exact integers, and a
score beyond 64 bits is the nearest 64-bit number (but for -2**63). Only ``vec_id`` and ``embedding`` are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vigil.llm.common import materialize

PIVOTS = 64
SEGMENT = 16384
BLOCK = 512
CHUNK = 2048
TOP = 5
#: The score of no candidate, and the largest number.
NONE, LAST = -(2**63), 2**63 - 1
SCALE = 256.0

#: Largest sum of squares that doubles hold exactly with room for the bound's sums; beyond it no bound is trusted.
EXACT = 2.0**51

_INDEX = "seg int, pivot int, r0 double, r1 double, norm double, rows binary, ids binary, vectors binary"
_FOUND = "query long, query_id long, vec_id long, score long"


def _usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    x = F.col("embedding")
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)).where(fine)
    most = rows.groupBy(F.size(x).alias("n")).count().orderBy(F.desc("count"), "n").first()
    size = most["n"] if most else 0
    # The row number is written with the rows, so later jobs agree on it; it tells equal rows apart.
    scaled = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * SCALE, F.lit(2.0**63)), F.lit(-(2.0**63)))))
    return rows.where(F.size(x) == size).select("vec_id", scaled.alias("v"), F.monotonically_increasing_id().alias("row")), size


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows; those beyond 64 bits become the nearest number above ``NONE``."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * a.shape[1] < 2**53:
        return (x @ y.T).astype(np.int64)
    return np.clip(a.astype(object) @ b.astype(object).T, NONE + 1, LAST).astype(np.int64)


def distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each vector to each pivot."""
    v, p = v.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((v**2).sum(axis=1)[:, None] + (p**2).sum(axis=1) - 2 * (v @ p.T), 0))


def bound(q_norm, q_dist, pivot_norm, r0, r1, norm):
    """Largest inner product of a query with any vector of an annulus; arrays broadcast.

    ``q_norm`` is |q|^2, ``pivot_norm`` |p|^2, ``norm`` the largest |v|^2 of the annulus.
    """
    gap = np.maximum(0.0, np.maximum(q_dist - r1, r0 - q_dist))
    near = (q_norm + norm - gap * gap) / 2
    around = (q_norm + pivot_norm - q_dist * q_dist) / 2 + np.sqrt(q_norm) * r1
    least = np.minimum(near, around)
    least = least + 1e-9 * np.abs(least) + 1.0  # beyond the rounding of the distances
    return np.where(q_norm + pivot_norm + norm < EXACT, least, np.inf)


def _bound_column(ring: Callable[[str], Column], distance: Column) -> Column:
    """:func:`bound` of a query's ``q_norm`` for a ring's ``r0, r1, norm, p_norm``."""
    q, r0, r1, norm, p = F.col("q_norm"), ring("r0"), ring("r1"), ring("norm"), ring("p_norm")
    gap = F.greatest(F.lit(0.0), distance - r1, r0 - distance)
    least = F.least((q + norm - gap * gap) / 2, (q + p - distance * distance) / 2 + F.sqrt(q) * r1)
    return F.when(q + p + norm < EXACT, least + F.abs(least) * 1e-9 + 1.0).otherwise(float("inf"))


def build(vectors: DataFrame) -> tuple[DataFrame, np.ndarray, int]:
    """The index (a row a block), the pivots and the number of vectors."""
    rows, size = _usable(vectors)
    rows = materialize(rows, "topk-vectors")
    total = rows.count()
    some = rows.orderBy(F.xxhash64("vec_id", "row"), "row").limit(PIVOTS).toPandas()["v"]
    pivots = np.unique(np.array(some.tolist(), np.int64).reshape(len(some), size), axis=0)

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            v = np.array(pdf["v"].tolist(), np.int64).reshape(len(pdf), size)
            at = distances(v, pivots).argmin(axis=1)
            r = np.sqrt(((v.astype(np.float64) - pivots[at]) ** 2).sum(axis=1))
            yield pd.DataFrame({"pivot": at.astype(np.int32), "r": r, "vec_id": pdf["vec_id"], "row": pdf["row"], "v": [x.tobytes() for x in v]})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seg = TaskContext.get().partitionId()
        for pdf in batches:  # sorted: a block is a piece of one annulus
            out = []
            for pivot, part in pdf.groupby("pivot", sort=False):
                for k in range(0, len(part), BLOCK):
                    b = part.iloc[k : k + BLOCK]
                    v = np.frombuffer(b"".join(b["v"]), np.int64).reshape(len(b), size)
                    norm = (v.astype(np.float64) ** 2).sum(axis=1).max()
                    out.append((seg, pivot, b["r"].min(), b["r"].max(), norm, b["row"].to_numpy(np.int64).tobytes(), b["vec_id"].to_numpy(np.int64).tobytes(), v.tobytes()))
            yield pd.DataFrame(out, columns=["seg", "pivot", "r0", "r1", "norm", "rows", "ids", "vectors"])

    keyed = rows.mapInPandas(key, "pivot int, r double, vec_id long, row long, v binary")
    order = ["pivot", "r", "vec_id", "row"]
    dealt = keyed.repartitionByRange(max(1, -(-total // SEGMENT)), *order).sortWithinPartitions(*order)
    return materialize(dealt.mapInPandas(cut, _INDEX), "topk-index"), pivots, size


def _met(k: int, size: int, pivots: np.ndarray):
    """Search of a segment's blocks for a chunk of queries with their thresholds."""

    def met(queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(blocks):
            return pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype=np.int64)
        q = np.frombuffer(b"".join(queries["v"]), np.int64).reshape(len(queries), size)
        own, floor = queries["query_id"].to_numpy(np.int64), queries["floor"].to_numpy(np.float64)
        at = pivots[blocks["pivot"].to_numpy()]
        q_norm, p_norm = (q.astype(np.float64) ** 2).sum(axis=1)[:, None], (at.astype(np.float64) ** 2).sum(axis=1)
        most = bound(q_norm, distances(q, at), p_norm, blocks["r0"].to_numpy(), blocks["r1"].to_numpy(), blocks["norm"].to_numpy())
        score, ids = np.full((len(q), k), NONE), np.full((len(q), k), LAST)
        for b in np.argsort(-most.max(axis=0)).tolist():
            # Queries whose k-th score this annulus can still reach; the rest stop here.
            open_ = np.flatnonzero(most[:, b] >= np.maximum(floor, score[:, -1].astype(np.float64)))
            if not len(open_):
                continue
            vec = np.frombuffer(blocks["ids"].iloc[b], np.int64)
            made = product(q[open_], np.frombuffer(blocks["vectors"].iloc[b], np.int64).reshape(len(vec), size))
            made[own[open_][:, None] == vec] = NONE
            both, names = np.concatenate([score[open_], made], axis=1), np.concatenate([ids[open_], np.broadcast_to(vec, made.shape)], axis=1)
            order = np.lexsort((names, np.invert(both)), axis=1)[:, :k]  # invert: falling scores
            score[open_], ids[open_] = np.take_along_axis(both, order, axis=1), np.take_along_axis(names, order, axis=1)
        real = score != NONE
        wide = lambda c: np.broadcast_to(c[:, None], ids.shape)[real]
        return pd.DataFrame({"query": wide(queries["query"].to_numpy(np.int64)), "query_id": wide(own), "vec_id": ids[real], "score": score[real]})

    return met


def search(index: DataFrame, pivots: np.ndarray, size: int, wanted, k: int = TOP) -> DataFrame:
    """``query_id, vec_id, score, rank`` of the k best for each indexed vector whose id ``wanted`` picks.

    ``wanted`` maps an array of ids to a mask.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seg, rows, ids, vectors in zip(pdf["seg"], pdf["rows"], pdf["ids"], pdf["vectors"], strict=True):
                ids, v = np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, size)
                pick = np.flatnonzero(wanted(ids))
                if len(pick):
                    norm = (v[pick].astype(np.float64) ** 2).sum(axis=1)
                    yield pd.DataFrame({
                        "query": np.frombuffer(rows, np.int64)[pick], "query_id": ids[pick], "home": seg, "v": [v[i].tobytes() for i in pick],
                        "q_norm": norm, "dist": list(distances(v[pick], pivots)),
                    })

    made = "query long, query_id long, home int, v binary, q_norm double, dist array<double>"
    queries = materialize(index.select("seg", "rows", "ids", "vectors").mapInPandas(take, made), "topk-queries")
    p_norm = F.array(*[F.lit(float(x)) for x in (pivots.astype(np.float64) ** 2).sum(axis=1)]) if len(pivots) else F.array().cast("array<double>")
    widest = [F.min("r0").alias("r0"), F.max("r1").alias("r1"), F.max("norm").alias("norm")]
    rings = index.groupBy("seg", "pivot").agg(*widest).withColumn("p_norm", F.get(p_norm, F.col("pivot")))
    rings = materialize(rings, "topk-rings")

    def visit(asked: DataFrame) -> DataFrame:
        met_by = asked.select(F.col("seg").alias("b_seg"), F.col("chunk").alias("b_chunk")).distinct()
        blocks = index.drop("rows").join(met_by, F.col("seg") == F.col("b_seg"))
        return asked.groupBy("seg", "chunk").cogroup(blocks.groupBy("b_seg", "b_chunk")).applyInPandas(_met(k, size, pivots), _FOUND)

    # A query's own segment: as many queries as the segment has rows at most, so one chunk.
    home = queries.select("query", "query_id", "v", F.col("home").alias("seg"), F.lit(float("-inf")).alias("floor"), F.lit(0).alias("chunk"))
    found = materialize(visit(home), "topk-first")
    # A query's k-th score so far; that of a query with fewer candidates is no bound.
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    floors = found.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).select("query", F.col("score").cast("double").alias("floor"))
    seeking = queries.select("query", "home", "q_norm", "dist").join(floors, "query", "left").fillna(float("-inf"), ["floor"])
    whole = rings.groupBy("pivot", "p_norm").agg(*widest).collect()  # a row a pivot
    ring = F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in ("pivot", "r0", "r1", "norm", "p_norm")]) for r in whole])
    if whole:
        reach = F.filter(ring, lambda r: _bound_column(lambda c: r[c], F.get("dist", r["pivot"])) >= F.col("floor"))
        pivot = F.explode(F.transform(reach, lambda r: r["pivot"]))
    else:
        pivot = F.lit(0)
    near = seeking.select("query", "home", "q_norm", "floor", "dist", pivot.alias("near")).withColumn("d", F.get("dist", F.col("near"))).drop("dist")
    pairs = near.join(rings, (F.col("near") == F.col("pivot")) & (F.col("seg") != F.col("home")) & (_bound_column(F.col, F.col("d")) >= F.col("floor")))
    pairs = materialize(pairs.select("query", "seg", "floor").distinct(), "topk-pairs")
    parts = pairs.groupBy(F.col("seg").alias("p_seg")).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("parts"))
    rest = pairs.join(parts, F.col("seg") == F.col("p_seg")).withColumn("chunk", F.pmod(F.xxhash64("query"), F.col("parts")).cast("int"))
    rest = rest.select("query", "seg", "floor", "chunk").join(queries.select("query", "query_id", "v"), "query")
    every = found.unionByName(visit(materialize(rest, "topk-asked")))
    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def divisible(by: int):
    return lambda ids: ids % by == 0


def top_k(vectors: DataFrame, by: int = 50, k: int = TOP) -> DataFrame:
    """``query_id, rank, vec_id, score`` for queries whose ``vec_id`` is divisible by ``by``."""
    found = search(*build(vectors), divisible(by), k)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
