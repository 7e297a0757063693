"""Moderation replay (W2) and the operators built on it.

The reference keeps an in-memory ``comment_id -> pending comment`` dict that
``/detect`` fills, ``DELETE /queue/{id}`` and ``/action`` empty, and writes
every successful action to ``moderator_actions``. Here that state is derived
from an ordered operation log ``(seq, ts, comment_id, op, doc_id)``:

* ``detect`` rows the classifier calls clean are dropped first (a clean
  re-detect leaves a pending entry alone);
* a ``delete`` or any other action string *finds* the comment iff the
  previous remaining op of the same comment (by ``(ts, seq)``) is a detect;
  an action that finds it is recorded with the text of that detect;
* a comment is pending at the end iff its last remaining op is a detect; its
  queue position is the first detect of that final run of detects.

Plan shape. The only per-row ordering need is "previous op of the same
comment". A plain window would put every row of a comment into one task, so
a hot comment (one third of the log) would serialise the job. One plan, for
every size of log and of comment, splits it:

1. the kept log (narrow: no text) is range-partitioned by
   ``(comment_id, ts, seq)``, nulls first. ``seq`` is unique, so any comment,
   burst or run of missing times is cut where the partition sizes need it;
   the partition number is the row's *chunk*, written with the row. The
   partitioner reads its input twice (a sample, then all rows): what costs
   there, the documents' flags, is written before;
2. ``lag`` runs inside ``(comment_id, chunk)``, never over more than a chunk;
3. only the first row of a chunk can miss its predecessor: the last row of
   the chunk before it, one row a chunk, is joined onto it when it is of the
   same comment.

:func:`advance` continues from a stored queue instead of replaying the log: a
pending comment is the op before all others of its comment (its *turn* comes
first), so a hot comment is cut over chunks there too. Comments that the batch
does not name pass by, and so cost one anti-join. :func:`resolve` and
:func:`delete` are the one-shot forms for a batch of clicks, without any order
but each comment's first op.

Queue state and every per-comment result are aggregations (``max`` over
structs), which combine partially before the shuffle and so do not skew.
The wide ``text`` never enters the shuffles: rows carry ``doc_id`` and the
text is joined back only for the (small) outputs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import CONFIDENCE_TOXIC, LABEL_TOXIC
from vigil.session import materialize

DETECT = "detect"
DELETE = "delete"
# Op kinds as small integers keep the per-comment structs narrow. Their
# max/min aggregates are sort-based (a struct buffer), but they run on the
# window's output, already partitioned and sorted by comment: no extra
# exchange or sort.
K_DETECT, K_DELETE, K_ACTION = 1, 2, 3


def _kind(op: Column) -> Column:
    return F.when(op == DETECT, F.lit(K_DETECT)).when(op == DELETE, F.lit(K_DELETE)).otherwise(F.lit(K_ACTION))


def attach_text(df: DataFrame, texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """Left-join ``text`` by ``key`` without shuffling the whole text table where that can be avoided.

    ``df`` (narrow) is written once so its size is known when the join is planned; the text
    table is cut to the needed keys by a semi join, a broadcast when the key side is under the
    broadcast threshold. The needed texts are written too: both sides of the last join are then
    plain tables, so a key with very many rows is split by the skew join.
    """
    df = materialize(df, "needs-text")
    keys = df.select(F.col(key).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    needed = materialize(texts.select("doc_id", "text").join(keys, "doc_id", "left_semi"), "needed-text")
    return df.join(needed.withColumnRenamed("doc_id", key), key, "left")


# ``turn`` 0 is a pending comment that an earlier step left, 1 an op of the log.
_ORDER = ["comment_id", "turn", "ts", "seq"]
QUEUE_COLUMNS = ["comment_id", "doc_id", "confidence", "queued_ts", "queued_seq"]


def assign_chunks(kept: DataFrame, partitions: int | None = None) -> DataFrame:
    """``kept`` plus ``chunk``: its number in a range partitioning by comment, time and ``seq``.

    ``partitions`` defaults to the session's shuffle partitions. Chunks are in the order of the
    log inside each comment; the result is written, so a row's chunk never changes.
    """
    order = [F.col(c).asc_nulls_first() for c in _ORDER if c in kept.columns]
    dealt = kept.repartitionByRange(partitions, *order) if partitions else kept.repartitionByRange(*order)
    return materialize(dealt.withColumn("chunk", F.spark_partition_id()), "replay-chunks")


@dataclass
class Replay:
    """The annotated log and the three outputs of a replay."""

    steps: DataFrame  # every kept op + prev_kind / prev_doc / prev_conf, and the queue rows they met (turn 0)
    texts: DataFrame | None
    untouched: DataFrame | None = None  # queue rows that no op named

    @property
    def _ops(self) -> DataFrame:
        return self.steps.where("turn = 1")

    def _with_text(self, df: DataFrame, key: str = "doc_id") -> DataFrame:
        if self.texts is None:
            return df.withColumn("text", F.lit(None).cast("string"))
        return attach_text(df, self.texts, key)

    @property
    def actions_keyed(self) -> DataFrame:
        """Recorded actions without text: ``id, comment_id, action, timestamp, doc_id``."""
        hit = self._ops.where((F.col("kind") == K_ACTION) & (F.col("prev_kind") == K_DETECT))
        return hit.select(
            F.col("seq").alias("id"),
            "comment_id",
            F.col("op").alias("action"),
            F.col("ts").alias("timestamp"),
            F.col("prev_doc").alias("doc_id"),
        )

    @property
    def actions(self) -> DataFrame:
        """Recorded moderator actions: ``id, comment_id, text, action, timestamp`` (+ doc_id)."""
        rows = self.actions_keyed
        return self._with_text(rows).select("id", "comment_id", "text", "action", "timestamp", "doc_id")

    @property
    def deleted(self) -> DataFrame:
        """Successful deletes: ``seq, ts, comment_id`` (nothing is recorded for them)."""
        hit = self._ops.where((F.col("kind") == K_DELETE) & (F.col("prev_kind") == K_DETECT))
        return hit.select("seq", "ts", "comment_id")

    @property
    def not_found(self) -> DataFrame:
        """Deletes and actions that found no pending comment (HTTP 404 in the reference)."""
        miss = self._ops.where(
            (F.col("kind") != K_DETECT) & (F.col("prev_kind").isNull() | (F.col("prev_kind") != K_DETECT))
        )
        return miss.select("seq", "ts", "comment_id", "op")

    @property
    def outcomes(self) -> DataFrame:
        """One row for each delete and action: ``recorded``, ``deleted`` or ``not_found``, with what it found."""
        rows = self._ops.where(F.col("kind") != K_DETECT)
        found = F.coalesce(F.col("prev_kind") == K_DETECT, F.lit(False))
        outcome = F.when(~found, "not_found").when(F.col("kind") == K_DELETE, "deleted").otherwise("recorded")
        return rows.select(
            "comment_id", "seq", "ts", "op", outcome.alias("outcome"),
            F.when(found, F.col("prev_doc")).alias("doc_id"), F.when(found, F.col("prev_conf")).alias("confidence"),
        )

    @property
    def queue_state(self) -> DataFrame:
        """Pending comments at the end: ``comment_id, doc_id, confidence, queued_ts, queued_seq``."""
        s = self.steps
        run_start = (F.col("kind") == K_DETECT) & (F.col("prev_kind").isNull() | (F.col("prev_kind") != K_DETECT))
        agg = s.groupBy("comment_id").agg(
            F.max(F.struct("turn", "ts", "seq", "kind", "doc_id", "conf")).alias("last"),
            F.max(F.when(run_start, F.struct("turn", "ts", "seq"))).alias("start"),
        )
        now = agg.where(F.col("last.kind") == K_DETECT).select(
            "comment_id",
            F.col("last.doc_id").alias("doc_id"),
            F.col("last.conf").alias("confidence"),
            F.col("start.ts").alias("queued_ts"),
            F.col("start.seq").alias("queued_seq"),
        )
        return now if self.untouched is None else now.unionByName(self.untouched.select(*QUEUE_COLUMNS))

    @property
    def queue(self) -> DataFrame:
        """``GET /queue``: ``comment_id, text, label, confidence, queued_ts, queued_seq``.

        Sort by ``(queued_ts, queued_seq)`` for the reference's insertion order.
        """
        q = self._with_text(self.queue_state)
        return q.select(
            "comment_id", "text", F.lit(LABEL_TOXIC).alias("label"), "confidence", "queued_ts", "queued_seq"
        )


def _kept(log: DataFrame, flags: DataFrame | None) -> DataFrame:
    """The log without clean detects, narrow: ``comment_id, turn, ts, seq, op, kind, doc_id, conf``."""
    is_detect = F.col("op") == DETECT
    if "toxic" in log.columns:
        ops = log.where(~is_detect | F.coalesce(F.col("toxic"), F.lit(False)))
    elif flags is None:
        raise ValueError("replay needs a toxic column or a flags table")
    else:
        # Only detects ask for a flag, and only toxic documents answer, with their confidence if they have one.
        carried = [c for c in ("confidence",) if c in flags.columns and c not in log.columns]
        toxic = materialize(flags.where("toxic").select("doc_id", *carried), "toxic-documents")
        detects = log.where(is_detect).join(toxic, "doc_id", "inner" if carried else "left_semi")
        ops = detects.select(*log.columns, *carried).unionByName(log.where(~is_detect), allowMissingColumns=True)
    conf = F.col("confidence").cast("double") if "confidence" in ops.columns else F.lit(CONFIDENCE_TOXIC)
    return ops.select(
        "comment_id", F.lit(1).alias("turn"), "ts", "seq", "op", _kind(F.col("op")).alias("kind"), "doc_id",
        F.when(is_detect, conf).alias("conf"),
    )


def _annotate(kept: DataFrame, partitions: int | None) -> DataFrame:
    """Each row with the kind, document and confidence of the row before it in its comment."""
    chunked = assign_chunks(kept, partitions)
    before = ["kind", "doc_id", "conf"]
    w = Window.partitionBy("comment_id", "chunk").orderBy("turn", "ts", "seq")
    local = chunked.select("*", *[F.lag(c).over(w).alias(f"l_{c}") for c in before])
    # One row a chunk: its last op in order, and the chunk that comes next.
    last = chunked.groupBy("chunk").agg(F.max(F.struct(*_ORDER, *before)).alias("last"))
    carry = last.select(F.lead("chunk").over(Window.orderBy("chunk")).alias("c_chunk"), F.col("last.comment_id").alias("c_comment"),
                        *[F.col(f"last.{c}").alias(f"c_{c}") for c in before]).where("c_chunk IS NOT NULL")
    met = F.col("comment_id").eqNullSafe(F.col("c_comment")) & (F.col("chunk") == F.col("c_chunk"))
    joined = local.join(carry, met, "left")
    first = F.col("l_kind").isNull()
    prev = [F.when(first, F.col(f"c_{c}")).otherwise(F.col(f"l_{c}")).alias(f"prev_{n}")
            for c, n in zip(before, ("kind", "doc", "conf"), strict=True)]
    return joined.select(*_ORDER, "op", *before, *prev)


def replay(
    log: DataFrame, flags: DataFrame | None = None, texts: DataFrame | None = None, partitions: int | None = None
) -> Replay:
    """Replay an operation log.

    ``log``: ``seq, ts, comment_id, op, doc_id`` and optionally ``toxic`` and
    ``confidence`` (per detect). ``flags``: ``doc_id, toxic`` and optionally
    ``confidence`` when the log does not carry ``toxic``; any scorer can make
    them (:func:`vigil.operators.classify.scored_flags`). ``texts``:
    ``doc_id, text`` for the outputs. ``partitions``: chunks of the log (see
    :func:`assign_chunks`).
    """
    return Replay(steps=_annotate(_kept(log, flags), partitions), texts=texts)


def advance(
    queue: DataFrame, log: DataFrame, flags: DataFrame | None = None, texts: DataFrame | None = None,
    partitions: int | None = None,
) -> Replay:
    """The next step of a stored queue: ``queue`` (:attr:`Replay.queue_state`, a written table) and one batch of ops.

    ``log`` and the other arguments are those of :func:`replay`. The result's outputs are those of this
    batch, its ``queue_state`` is the next snapshot. All ops of the batch come after those that made the
    queue, whatever their times; inside the batch the order is ``(ts, seq)``. A re-detect of a pending
    comment keeps its place. A null ``comment_id`` is one comment, as in the log.
    """
    kept = materialize(_kept(log, flags), "batch-ops")
    # Comments of the batch, its clean detects aside: narrow, and combined before it is shuffled.
    named = materialize(kept.select(F.col("comment_id").alias("n_id")).distinct(), "batch-comments")
    same = F.col("comment_id").eqNullSafe(F.col("n_id"))
    met = queue.join(named, same, "left_semi").select(
        "comment_id", F.lit(0).alias("turn"), F.col("queued_ts").alias("ts"), F.col("queued_seq").alias("seq"),
        F.lit(DETECT).alias("op"), F.lit(K_DETECT).alias("kind"), "doc_id", F.col("confidence").alias("conf"),
    )
    steps = _annotate(met.unionByName(kept), partitions)
    return Replay(steps=steps, texts=texts, untouched=queue.join(named, same, "left_anti"))


def _first_ops(queue: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(hits, misses, queue)`` of a batch without detects: only a comment's first op can find it."""
    lead = F.struct("ts", "seq", "op")
    first = ops.groupBy("comment_id").agg(F.min(lead).alias("f")).select(F.col("comment_id").alias("f_id"), "f.*")
    same = F.col("comment_id").eqNullSafe(F.col("f_id"))
    hits = materialize(queue.join(first, same).select("comment_id", "doc_id", "confidence", "ts", "seq", "op"), "queue-hits")
    # ``seq`` is unique: a hot comment's misses are not gathered by its id.
    misses = ops.join(hits.select(F.col("seq").alias("h_seq")), F.col("seq") == F.col("h_seq"), "left_anti")
    left = queue.join(hits.select(F.col("comment_id").alias("h_id")), F.col("comment_id").eqNullSafe(F.col("h_id")), "left_anti")
    return hits, misses.select("seq", "ts", "comment_id", "op"), left


def resolve(queue: DataFrame, actions: DataFrame, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A batch of moderator actions ``seq, ts, comment_id, op`` against a queue -> ``(actions, not_found, queue)``.

    The first action on a pending comment is recorded with the text that was queued; others are not found.
    Any action string counts (Q18). ``actions`` are those of :attr:`Replay.actions`.
    """
    hits, misses, left = _first_ops(queue, actions)
    rows = hits.select(F.col("seq").alias("id"), "comment_id", F.col("op").alias("action"), F.col("ts").alias("timestamp"), "doc_id")
    rows = rows.withColumn("text", F.lit(None).cast("string")) if texts is None else attach_text(rows, texts)
    return rows.select("id", "comment_id", "text", "action", "timestamp", "doc_id"), misses, left


def delete(queue: DataFrame, ops: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes ``seq, ts, comment_id`` against a queue -> ``(queue, not_found)``; nothing is recorded."""
    _, misses, left = _first_ops(queue, ops.withColumn("op", F.lit(DELETE)))
    return left, misses


def history(actions: DataFrame) -> DataFrame:
    """``GET /history``: newest first, nulls last, four columns, no paging.

    Ties on the timestamp (a burst, or rows without one) go to the newer
    ``id`` (by ``comment_id`` when the rows carry no id): with a unique sort
    key the range partitioner can split a hot timestamp over many tasks, and
    the order is repeatable.
    """
    tie = F.col("id").desc() if "id" in actions.columns else F.col("comment_id").asc()
    ordered = actions.orderBy(F.col("timestamp").desc_nulls_last(), tie)
    return ordered.select("comment_id", "text", "action", "timestamp")


def comment_status(r: Replay) -> DataFrame:
    """Per comment: ``pending`` if queued now, else its latest recorded approve/reject.

    One aggregation over the annotated log (map-side combined): the last op
    decides ``pending`` (as in ``queue_state``), and the latest recorded
    action (an action that found its comment) gives the decision. Comments
    with neither are left out.
    """
    recorded = (F.col("kind") == K_ACTION) & (F.col("prev_kind") == K_DETECT)
    agg = r.steps.groupBy("comment_id").agg(
        F.max(F.struct("turn", "ts", "seq", "kind")).alias("last"),
        F.max(F.when(recorded, F.struct("ts", "seq", "op"))).alias("l"),
    )
    status = (
        F.when(F.col("last.kind") == K_DETECT, F.lit("pending"))
        .when(F.col("l.op").isin("approved", "rejected"), F.col("l.op"))
    )
    return agg.select("comment_id", status.alias("status")).where(F.col("status").isNotNull())
