"""Registered queries: ``name -> (spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or data Spark derives from them) in
full, so its work grows with the scale factor. Parameters that the
reference takes from a user (search term, thresholds, block list) are fixed
here to the values listed in FIXTURES.md.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions.text import parse_comma_list_py
from vigil.operators import classify as C
from vigil.operators import evaluate as Ev
from vigil.operators import feedback as Fb
from vigil.operators import filters as Fl
from vigil.operators import load as Ld
from vigil.operators import pages as Pg
from vigil.operators import replay as R
from vigil.operators import sgd as Sgd
from vigil.operators import train as Tr
from vigil.operators import trainlog as Tl
from vigil.session import materialize
from vigil.streaming import classify as Sc
from vigil.streaming import comments as Scm
from vigil.streaming import queue as Sq
from vigil.streaming import report as Sr
from vigil.streaming import sources as Ss
from vigil.sources import csvio
from vigil.sources import tables as T
from vigil.sources import trainlog as Stl

# --- Fixed test parameters (FIXTURES.md) -------------------------------------
SEARCH_TERM = "hate"
MIN_CONFIDENCE = "95"
DASHBOARD_MIN_CONFIDENCE = "80"
BLOCK_LIST = "la, on, idiot"
RESCAN_LIST = "und, trash"
HOST_REGEX = r"\.example\.(com|net)$"
# -----------------------------------------------------------------------------

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def register(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn

    return deco


# --- classify / flag / queue projection (P1-P3) ------------------------------


@register("classify")
def q_classify(spark: SparkSession, sf: str) -> DataFrame:
    return C.classify(T.comments(spark, sf))


@register("flagged")
def q_flagged(spark: SparkSession, sf: str) -> DataFrame:
    return C.flagged(C.classify(T.comments(spark, sf)))


@register("queue_projection")
def q_queue_projection(spark: SparkSession, sf: str) -> DataFrame:
    return C.queue_view(C.flagged(C.classify(T.turns(spark, sf))))


# --- dashboard and extension filters (P4-P9, P16) ----------------------------


@register("search")
def q_search(spark: SparkSession, sf: str) -> DataFrame:
    flagged = C.flagged(C.classify(T.comments(spark, sf)))
    return Fl.min_confidence(Fl.search(flagged, SEARCH_TERM), DASHBOARD_MIN_CONFIDENCE)


@register("min_confidence")
def q_min_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.min_confidence(C.classify(T.comments(spark, sf)), MIN_CONFIDENCE)


@register("gate")
def q_gate(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.gate(C.classify(T.comments(spark, sf)), 80)


@register("blocklist")
def q_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    words = parse_comma_list_py(BLOCK_LIST)
    return Fl.blocklist(T.comments(spark, sf), words)


@register("parse_blocklist")
def q_parse_blocklist(spark: SparkSession, sf: str) -> DataFrame:
    """Every comma-separated entry of every turn, trimmed, blanks dropped."""
    parsed = Fl.parse_blocklist(T.turns(spark, sf), "text")
    return parsed.select(
        "comment_id",
        F.posexplode("entries").alias("pos", "entry"),
    ).select("comment_id", F.col("pos").cast("bigint").alias("pos"), "entry")


@register("host_filter")
def q_host_filter(spark: SparkSession, sf: str) -> DataFrame:
    pages = T.pages(spark, sf).select("page_id", "url")
    return Fl.host_filter(pages, HOST_REGEX).select("page_id", "url", Fl.host_of("url").alias("host"))


@register("detection_display")
def q_detection_display(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.detection_display(C.classify(T.turns(spark, sf)))


# --- moderation replay (W2, J1-J3, O1, O2, P15, R1) --------------------------


def moderation(spark: SparkSession, sf: str) -> R.Replay:
    """Replay the events-bound operation log; classify each document once."""
    docs = T.documents(spark, sf)
    return R.replay(T.operation_log(spark, sf), flags=C.toxic_flags(docs, "doc_id"), texts=docs)


@register("queue_now")
def q_queue_now(spark: SparkSession, sf: str) -> DataFrame:
    return moderation(spark, sf).queue.orderBy("queued_ts", "queued_seq")


@register("actions")
def q_actions(spark: SparkSession, sf: str) -> DataFrame:
    return moderation(spark, sf).actions


@register("not_found")
def q_not_found(spark: SparkSession, sf: str) -> DataFrame:
    return moderation(spark, sf).not_found


@register("delete")
def q_delete(spark: SparkSession, sf: str) -> DataFrame:
    return moderation(spark, sf).deleted


@register("history")
def q_history(spark: SparkSession, sf: str) -> DataFrame:
    return R.history(moderation(spark, sf).actions)


@register("history_display")
def q_history_display(spark: SparkSession, sf: str) -> DataFrame:
    return Fl.history_display(R.history(moderation(spark, sf).actions))


@register("comment_status")
def q_comment_status(spark: SparkSession, sf: str) -> DataFrame:
    return R.comment_status(moderation(spark, sf))


# --- the queue as a stored snapshot (J1, J2) ----------------------------------


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The operation log before and from the day in the middle of its time; ops without a time are early."""
    log = T.operation_log(spark, sf)
    day = F.to_date("ts")
    mid = log.select(F.date_add(F.min(day), F.floor(F.datediff(F.max(day), F.min(day)) / 2).cast("int"))).scalar()
    early = F.coalesce(day < mid, F.lit(True))
    return log.where(early), log.where(~early)


def _snapshot(spark: SparkSession, sf: str) -> tuple[R.Replay, DataFrame, DataFrame, DataFrame]:
    """The replay of the first half, its queue as a written table, the ops of the second half, the flags."""
    early, late = _halves(spark, sf)
    flags = C.toxic_flags(T.documents(spark, sf), "doc_id")
    first = R.replay(early, flags=flags, texts=T.documents(spark, sf))
    return first, materialize(first.queue_state, "queue-snapshot"), late, flags


@register("queue_resumed")
def q_queue_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The queue after the second half of the log, from the snapshot of the first (equals ``queue_now``)."""
    _, queue, late, flags = _snapshot(spark, sf)
    return R.advance(queue, late, flags=flags, texts=T.documents(spark, sf)).queue


@register("actions_resumed")
def q_actions_resumed(spark: SparkSession, sf: str) -> DataFrame:
    """The actions of both steps (equal ``actions``)."""
    first, queue, late, flags = _snapshot(spark, sf)
    return first.actions.unionByName(R.advance(queue, late, flags=flags, texts=first.texts).actions)


@register("resolve")
def q_resolve(spark: SparkSession, sf: str) -> DataFrame:
    """The actions of the second half as one batch of clicks on the snapshot."""
    first, queue, late, _ = _snapshot(spark, sf)
    return R.resolve(queue, late.where(~F.col("op").isin(R.DETECT, R.DELETE)), first.texts)[0]


@register("resolve_not_found")
def q_resolve_not_found(spark: SparkSession, sf: str) -> DataFrame:
    _, queue, late, _ = _snapshot(spark, sf)
    return R.resolve(queue, late.where(~F.col("op").isin(R.DETECT, R.DELETE)))[1]


@register("delete_not_found")
def q_delete_not_found(spark: SparkSession, sf: str) -> DataFrame:
    _, queue, late, _ = _snapshot(spark, sf)
    return R.delete(queue, late.where(F.col("op") == R.DELETE))[1]


@register("delete_batch")
def q_delete_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The snapshot after the deletes of the second half."""
    _, queue, late, _ = _snapshot(spark, sf)
    return R.delete(queue, late.where(F.col("op") == R.DELETE))[0]


# --- feedback -> training set (P12-P14, A1-A3, U1, O3, A8, R2, R3) -----------


def _feedback_parts(spark: SparkSession, sf: str):
    r = moderation(spark, sf)
    # Latest feedback runs on the text-less actions; text joins the winners only.
    latest = Fb.latest_feedback(r.actions_keyed, texts=r.texts)
    examples = Fb.to_examples(latest)
    original = T.labelled_examples(spark, sf)
    return r, latest, examples, original


@register("valid_feedback")
def q_valid_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return Fb.valid_feedback(moderation(spark, sf).actions_keyed).select("id", "comment_id", "action", "timestamp")


@register("latest_feedback")
def q_latest_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback_parts(spark, sf)[1]


@register("feedback_examples")
def q_feedback_examples(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback_parts(spark, sf)[2].select("clean_text", "Label")


@register("merged_training")
def q_merged_training(spark: SparkSession, sf: str) -> DataFrame:
    _, _, examples, original = _feedback_parts(spark, sf)
    return Fb.merge_dedupe(original, examples)


@register("seeded_shuffle")
def q_seeded_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    _, _, examples, original = _feedback_parts(spark, sf)
    return Fb.seeded_shuffle(Fb.merge_dedupe(original, examples))


@register("labelled_csv")
def q_labelled_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The merged training set written as CSV and read back, NA tokens as missing values."""
    _, latest, _, original = _feedback_parts(spark, sf)
    path, _ = Ss.new_sink(spark, "labelled-csv")
    if not Fb.write_training_set(latest, original, path)["feedback"]:
        return spark.createDataFrame([], csvio.LABELLED_SCHEMA)
    return csvio.read_labelled_csv(spark, path)


@register("merge_stats")
def q_merge_stats(spark: SparkSession, sf: str) -> DataFrame:
    _, latest, _, original = _feedback_parts(spark, sf)
    return Fb.merge_stats(latest, original, Ss.new_sink(spark, "training-set")[0])


@register("flag_precision")
def q_flag_precision(spark: SparkSession, sf: str) -> DataFrame:
    return Fb.flag_precision(moderation(spark, sf).actions_keyed)


@register("feedback_conflicts")
def q_feedback_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    _, _, examples, original = _feedback_parts(spark, sf)
    return Fb.feedback_conflicts(original, examples)


# --- evaluation (J4, A4, A5, R4, R5) -------------------------------------------


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    truth = T.scored_truth(spark, sf)
    pred = Ev.lexicon_pred(C.classify(truth.select("comment_id", "text"))).select(
        "comment_id", F.col("pred").cast("bigint").alias("pred")
    )
    return Ev.pair(pred, truth.select("comment_id", F.col("truth").cast("bigint").alias("truth")), check_unique=True)


@register("pair")
def q_pair(spark: SparkSession, sf: str) -> DataFrame:
    return _pairs(spark, sf)


@register("confusion")
def q_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return Ev.confusion(_pairs(spark, sf))


@register("prf1")
def q_prf1(spark: SparkSession, sf: str) -> DataFrame:
    return Ev.prf1(_pairs(spark, sf))


@register("threshold_sweep")
def q_threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    scored = T.scored_truth(spark, sf).select(Ev.graded_score("text").alias("score_pct"), "truth")
    return Ev.threshold_sweep(scored)


@register("lexicon_hits")
def q_lexicon_hits(spark: SparkSession, sf: str) -> DataFrame:
    return Ev.lexicon_hits(T.documents(spark, sf))


# --- page scan (P10, P11, T3) ---------------------------------------------------

SCAN_SETTINGS = Pg.Settings.from_text(BLOCK_LIST, threshold_percent=80, privacy_mode=False, auto_scan=True)


@register("page_elements")
def q_page_elements(spark: SparkSession, sf: str) -> DataFrame:
    return Pg.page_elements(T.pages(spark, sf))


@register("page_elements_dom")
def q_page_elements_dom(spark: SparkSession, sf: str) -> DataFrame:
    return Pg.page_elements_dom(T.pages(spark, sf))


@register("scan_pages")
def q_scan_pages(spark: SparkSession, sf: str) -> DataFrame:
    return Pg.scan_pages(T.pages(spark, sf), SCAN_SETTINGS, HOST_REGEX)


@register("rescan_pages")
def q_rescan_pages(spark: SparkSession, sf: str) -> DataFrame:
    """The scan after a settings change: other words, a higher threshold, blur on."""
    settings = Pg.Settings.from_text(RESCAN_LIST, threshold_percent=95, privacy_mode=True, auto_scan=True)
    return Pg.scan_pages(T.pages(spark, sf), settings, HOST_REGEX)


@register("dedupe_flags")
def q_dedupe_flags(spark: SparkSession, sf: str) -> DataFrame:
    """Two full scans (before and after a settings change) flag each element once."""
    pages = T.pages(spark, sf)
    first = Pg.scan_pages(pages, SCAN_SETTINGS, HOST_REGEX)
    again = Pg.scan_pages(pages, Pg.Settings.from_text(BLOCK_LIST, threshold_percent=95, auto_scan=True), HOST_REGEX)
    return Pg.dedupe_flags(first.unionByName(again)).select("element_id", "page_id", "pos")


# --- other scorers in the gate, the page scan and the queue (survey 2.10) ----------

MODEL_THRESHOLD = 60


@register("gate_graded")
def q_gate_graded(spark: SparkSession, sf: str) -> DataFrame:
    """P6 on a graded score: one word (0.8) stays below 85, two words pass."""
    return Fl.gate(C.graded(T.comments(spark, sf)), 85)


@register("scan_pages_graded")
def q_scan_pages_graded(spark: SparkSession, sf: str) -> DataFrame:
    settings = Pg.Settings.from_text(BLOCK_LIST, threshold_percent=85, auto_scan=True)
    return Pg.scan_pages(T.pages(spark, sf), settings, HOST_REGEX, scorer=C.graded)


@register("queue_graded")
def q_queue_graded(spark: SparkSession, sf: str) -> DataFrame:
    """The queue of comments that the graded score gates at 85, with its confidence."""
    docs = T.documents(spark, sf)
    flags = C.scored_flags(docs, C.graded, "doc_id", 0.85)
    return R.replay(T.operation_log(spark, sf), flags=flags, texts=docs).queue


def _trained(spark: SparkSession, sf: str):
    return Tr.model_scorer(Tr.train(materialize(q_merged_training(spark, sf), "merged-train")))


@register("scan_pages_model")
def q_scan_pages_model(spark: SparkSession, sf: str) -> DataFrame:
    """The page scan on the classifier trained on moderator feedback."""
    settings = Pg.Settings.from_text(BLOCK_LIST, threshold_percent=MODEL_THRESHOLD, auto_scan=True)
    return Pg.scan_pages(T.pages(spark, sf), settings, HOST_REGEX, scorer=_trained(spark, sf))


@register("queue_model")
def q_queue_model(spark: SparkSession, sf: str) -> DataFrame:
    """The queue on the trained classifier, gated."""
    docs = T.documents(spark, sf)
    flags = materialize(C.scored_flags(docs, _trained(spark, sf), "doc_id", MODEL_THRESHOLD / 100), "model-flags")
    return R.replay(T.operation_log(spark, sf), flags=flags, texts=docs).queue


# --- training progress, log and report (A6, A7, A9, W3-W5, S6) ---------------


@register("avg_loss")
def q_avg_loss(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.avg_loss(T.loss_steps(spark, sf))


@register("total_steps")
def q_total_steps(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.step_budget(q_merged_training(spark, sf))


@register("progress_ticks")
def q_progress_ticks(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.progress_ticks(T.loss_steps(spark, sf))


def _epochs(spark: SparkSession, sf: str) -> DataFrame:
    """The epochs of a training run on the merged training set."""
    train, val = Tr.split_train_val(materialize(q_merged_training(spark, sf), "merged-train"))
    return Sgd.fit_epochs(train, val).epochs


@register("model_saved")
def q_model_saved(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.model_saved(_epochs(spark, sf).select("epoch", "f1"))


def log_lines(spark: SparkSession, sf: str) -> DataFrame:
    """``(line_no, line)``: the JSON objects of ``events``, then every document as a line of free text."""
    events = T.read_table(spark, sf, "events", ["event_id", "props"])
    n = events.select(F.coalesce(F.max("event_id") + 1, F.lit(0))).scalar()
    docs = T.documents(spark, sf).select((n + F.col("doc_id")).alias("line_no"), F.col("text").alias("line"))
    return events.select(F.col("event_id").alias("line_no"), F.col("props").alias("line")).unionByName(docs)


def run_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The log of a training run: the JSON objects of ``events`` as other output, then the run's own lines."""
    events = T.read_table(spark, sf, "events", ["event_id", "props"])
    n = events.select(F.coalesce(F.max("event_id") + 1, F.lit(0))).scalar()
    own = Tl.epoch_lines(_epochs(spark, sf), n)
    return events.select(F.col("event_id").alias("line_no"), F.col("props").alias("line")).unionByName(own)


def step_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The log of the loss steps: a start, a line a progress tick, then for each epoch its loss and a save if it is a record."""
    steps = T.loss_steps(spark, sf)
    ticks = Tl.progress_ticks(steps).select(F.col("step").alias("line_no"), F.to_json(F.struct(F.lit("progress").alias("type"), "epoch", "step", "progress")).alias("line"))
    last = steps.select(((F.max("batch") + 1) * F.max("epoch")).cast("long")).scalar()
    ends = Tl.model_saved(Tl.avg_loss(steps).select("epoch", F.col("avg_loss").alias("f1")))
    end = F.to_json(F.struct(F.lit("epoch_end").alias("type"), "epoch", F.col("f1").alias("avg_loss"), "f1"))
    save = F.when(F.col("saved"), F.to_json(F.struct(F.lit("model_saved").alias("type"), "f1")))
    ends = ends.select("epoch", F.posexplode(F.array(end, save)).alias("k", "line")).where("line IS NOT NULL")
    ends = ends.select((last + F.col("epoch") * 2 + F.col("k")).cast("long").alias("line_no"), "line")
    begin = spark.createDataFrame([(0, '{"type":"training_started"}')], "line_no long, line string")
    return begin.unionByName(ticks).unionByName(ends)


@register("step_report")
def q_step_report(spark: SparkSession, sf: str) -> DataFrame:
    """A9 over the log of the loss steps."""
    return Tl.train_report(Tl.parse_train_log(materialize(step_lines(spark, sf), "step-lines")))


@register("precision_records")
def q_precision_records(spark: SparkSession, sf: str) -> DataFrame:
    """W3 over R2: the days on which the flags' precision beat every day before."""
    days = Fb.flag_precision(moderation(spark, sf).actions_keyed)
    return Tl.model_saved(days.select(F.col("day").alias("epoch"), F.col("precision").alias("f1"))).withColumnRenamed("epoch", "day")


@register("train_log")
def q_train_log(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.parse_train_log(log_lines(spark, sf))


@register("train_report")
def q_train_report(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.train_report(Tl.parse_train_log(materialize(run_lines(spark, sf), "run-lines")))


@register("train_epochs")
def q_train_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return Tl.train_epochs(Tl.parse_train_log(materialize(run_lines(spark, sf), "run-lines")))


# --- unique-key load (R7) -----------------------------------------------------------


@register("load_unique")
def q_load_unique(spark: SparkSession, sf: str) -> DataFrame:
    """Existing rows: documents with even ``doc_id``; incoming: odd; key: the text."""
    docs = T.documents(spark, sf)
    even = F.pmod(F.col("doc_id"), F.lit(2)) == 0
    return Ld.load_unique(docs.where(even), docs.where(~even), "text", "doc_id")


# --- Spark ML training and scoring (M1-M3, R6); rows-only checks ---------------------


@register("train_score")
def q_train_score(spark: SparkSession, sf: str) -> DataFrame:
    """Fit on the merged training set minus a held-out fifth; score the held-out rows.

    The training set is written once (as the reference writes its merged CSV),
    so the fitting passes read it instead of re-running the replay.
    """
    train, val = Tr.split_train_val(materialize(q_merged_training(spark, sf), "merged-train"))
    model = Tr.train(train)
    held_out = val.select("clean_text", F.col("Label").cast("int").alias("truth"))
    return Tr.score(model, held_out).select("clean_text", "truth", "pred", "label", "confidence")


@register("fit_epochs")
def q_fit_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return _epochs(spark, sf)


@register("embedding_head")
def q_embedding_head(spark: SparkSession, sf: str) -> DataFrame:
    vecs = T.read_table(spark, sf, "embeddings", ["vec_id", "embedding", "label"])
    return Tr.embedding_head(vecs, F.col("label") < 5)[1]


# --- Structured Streaming (S5, T1-T4); rows-only checks ------------------------------
# Each query replays a driver table as a file stream (one file per trigger),
# runs to the end of the available data, and returns the sink read back.


@register("stream_classify")
def q_stream_classify(spark: SparkSession, sf: str) -> DataFrame:
    docs = Ss.read_table_stream(spark, sf, "documents", "doc_id long, text string")
    comments = docs.select(F.col("doc_id").cast("string").alias("comment_id"), "text")
    data, ckpt = Ss.new_sink(spark, "stream-classify")
    Sc.stream_classify(comments, data, ckpt).awaitTermination()
    return spark.read.schema(Sc.flagged_stream(comments).schema).parquet(data)


def _feed(spark: SparkSession, sf: str) -> str:
    """A comment feed in text files: well-formed documents, some without a string id or a text, and other JSON."""
    n = T.documents(spark, sf).select("doc_id", "text")
    kind, good = F.pmod("doc_id", F.lit(4)), F.to_json(F.struct(F.col("doc_id").cast("string").alias("comment_id"), "text"))
    made = F.when(kind == 1, F.to_json(F.struct(F.col("doc_id").alias("comment_id"), "text")))
    made = made.when(kind == 3, F.to_json(F.struct(F.col("doc_id").cast("string").alias("comment_id")))).otherwise(good)
    lines = n.select(made.alias("line")).unionByName(T.read_table(spark, sf, "events", ["props"]).select(F.coalesce("props", F.lit("")).alias("line")))
    folder, out, ckpt = Ss.new_sink(spark, "comment-feed")[0], *Ss.new_sink(spark, "comment-sinks")
    lines.write.text(folder)
    Scm.stream_comments(Scm.read_line_stream(spark, folder, 4), out, ckpt).awaitTermination()
    return out


@register("comment_feed")
def q_comment_feed(spark: SparkSession, sf: str) -> DataFrame:
    """The comments of the feed, classified."""
    return C.classify(Scm.read_sink(spark, _feed(spark, sf), "accepted"))


@register("comment_feed_rejects")
def q_comment_feed_rejects(spark: SparkSession, sf: str) -> DataFrame:
    return Scm.read_sink(spark, _feed(spark, sf), "rejected").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


@register("stream_queue")
def q_stream_queue(spark: SparkSession, sf: str) -> DataFrame:
    """Recorded actions of the queue over the events stream (equals ``actions``)."""
    n_docs = T.documents(spark, sf).count()
    flags = materialize(C.toxic_flags(T.documents(spark, sf), "doc_id"), "doc-flags")
    ev = Ss.read_table_stream(spark, sf, "events", "event_id long, ts timestamp_ntz, user_id long, event_type string")
    ops = ev.select(
        F.col("event_id").alias("seq"), "ts",
        F.concat(F.lit("t1_"), F.col("user_id").cast("string")).alias("comment_id"),
        T._op_expr(F.col("event_type")).alias("op"),
        F.pmod(F.col("event_id"), F.lit(n_docs)).alias("doc_id"),
    )
    out, ckpt = Ss.new_sink(spark, "stream-queue")
    Sq.stream_queue(ops, out, ckpt, flags=flags).awaitTermination()
    return Sq.read_outcomes(spark, out).where("outcome = 'recorded'").select(
        F.col("seq").alias("id"), "comment_id", F.col("op").alias("action"), F.col("ts").alias("timestamp"), "doc_id"
    )


@register("stream_flags")
def q_stream_flags(spark: SparkSession, sf: str) -> DataFrame:
    pages = Ss.read_table_stream(spark, sf, "pages", "page_id long, url string, html string")
    data, ckpt = Ss.new_sink(spark, "stream-flags")
    flags = Sr.flags_stream(pages, SCAN_SETTINGS, HOST_REGEX)
    Ss.run_to_parquet(flags, data, ckpt).awaitTermination()
    return spark.read.schema(flags.schema).parquet(data)


@register("stream_report")
def q_stream_report(spark: SparkSession, sf: str) -> DataFrame:
    folder, _ = Ss.new_sink(spark, "run-lines")
    run_lines(spark, sf).repartitionByRange(4, "line_no").write.parquet(folder)
    lines = spark.readStream.schema("line_no long, line string").option("maxFilesPerTrigger", 2).parquet(folder)
    out, ckpt = Ss.new_sink(spark, "stream-report")
    query = Sr.stream_report(lines, out, ckpt)
    query.awaitTermination()
    return Sr.read_report(spark, out, query)


# --- sources and sinks: actions table (S1, S4), training-log file (S6) ---------------


@register("actions_table")
def q_actions_table(spark: SparkSession, sf: str) -> DataFrame:
    """Append the recorded actions (partitioned by day), then scan the feedback back.

    The ``action`` filter is pushed into the parquet scan; only the selected
    columns are read.
    """
    path, _ = Ss.new_sink(spark, "moderator-actions")
    csvio.append_actions(moderation(spark, sf).actions, path, "all")
    scan = csvio.read_actions(spark, path)
    return scan.where(F.col("action").isin("approved", "rejected")).select("id", "comment_id", "action", "timestamp")


@register("actions_appended")
def q_actions_appended(spark: SparkSession, sf: str) -> DataFrame:
    """Odd and even ids as two batches, the second of them appended twice: keys and days, each action once."""
    path, _ = Ss.new_sink(spark, "moderator-actions")
    acts = materialize(moderation(spark, sf).actions, "actions")
    for odd in (1, 0, 0):
        csvio.append_actions(acts.where(F.pmod("id", F.lit(2)) == odd), path, f"odd-{odd}")
    return csvio.read_actions(spark, path).select("action_key", "id", "comment_id", "action", F.col("action_date").cast("string").alias("action_date"), "batch")


@register("train_log_file")
def q_train_log_file(spark: SparkSession, sf: str) -> DataFrame:
    """Every line of every document written as log files, and parsed back by line number."""
    path, _ = Ss.new_sink(spark, "train-log-file")
    lines = T.documents(spark, sf).select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("pos", "line"))
    Stl.write_train_log(lines.select(F.struct("doc_id", "pos").alias("line_no"), "line"), path)
    back = Stl.read_train_log(spark, path)
    return Tl.parse_train_log(back.select(F.col("log_line_no").alias("line_no"), "line"))


FLAGSHIP = "queue_now"
