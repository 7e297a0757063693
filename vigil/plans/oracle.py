"""DuckDB oracle SQL, one statement per registered query.

Written by hand from the reference's semantics, independently of the Spark
code. Tables are the driver's pre-registered views. Integer outputs are cast
to BIGINT and decimals to DOUBLE so both engines agree on the schema.
"""

from __future__ import annotations

# Lexicon test as SQL: lower(text) contains any of the fixed words.
_LEX = (
    "(contains(lower({t}), 'stupid') OR contains(lower({t}), 'idiot') OR contains(lower({t}), 'hate')"
    " OR contains(lower({t}), 'dumb') OR contains(lower({t}), 'jerk') OR contains(lower({t}), 'kill')"
    " OR contains(lower({t}), 'garbage') OR contains(lower({t}), 'trash') OR contains(lower({t}), 'ugly')"
    " OR contains(lower({t}), 'shut up'))"
)


def lex(t: str) -> str:
    return "coalesce(" + _LEX.format(t=t) + ", false)"


CLASSIFIED_DOCS = f"""
SELECT CAST(doc_id AS VARCHAR) AS comment_id, text,
       CASE WHEN {lex('text')} THEN 'cyberbully' ELSE 'non-cyberbully' END AS label,
       CASE WHEN {lex('text')} THEN CAST(0.925 AS DOUBLE) ELSE CAST(0.991 AS DOUBLE) END AS confidence
FROM documents
"""

ORACLE: dict[str, str] = {}

ORACLE["classify"] = CLASSIFIED_DOCS

ORACLE["flagged"] = f"SELECT * FROM ({CLASSIFIED_DOCS}) c WHERE label = 'cyberbully'"

ORACLE["queue_projection"] = f"""
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id, text,
       'cyberbully' AS label, CAST(0.925 AS DOUBLE) AS confidence
FROM conversations
WHERE {lex('text')}
"""

# JavaScript trim as an RE2 pattern (same character set as the Spark side).
_WS = r"[\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
JS_TRIM_RE = f"^{_WS}+|{_WS}+$"


def js_trim(x: str) -> str:
    return f"regexp_replace({x}, '{JS_TRIM_RE}', '', 'g')"


CLASSIFIED_TURNS = f"""
SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id, text,
       CASE WHEN {lex('text')} THEN 'cyberbully' ELSE 'non-cyberbully' END AS label,
       CASE WHEN {lex('text')} THEN CAST(0.925 AS DOUBLE) ELSE CAST(0.991 AS DOUBLE) END AS confidence
FROM conversations
"""

ORACLE["search"] = f"""
SELECT * FROM ({CLASSIFIED_DOCS}) c
WHERE label = 'cyberbully'
  AND (contains(lower(text), 'hate') OR contains(comment_id, 'hate'))
  AND confidence * 100.0 >= CAST(80 AS DOUBLE)
"""

ORACLE["min_confidence"] = f"""
SELECT * FROM ({CLASSIFIED_DOCS}) c WHERE confidence * 100.0 >= CAST(95 AS DOUBLE)
"""

ORACLE["gate"] = f"""
SELECT * FROM ({CLASSIFIED_DOCS}) c WHERE label = 'cyberbully' AND confidence >= CAST(0.8 AS DOUBLE)
"""

ORACLE["blocklist"] = r"""
SELECT CAST(doc_id AS VARCHAR) AS comment_id, text FROM documents
WHERE regexp_matches(text, '\b(?:la|on|idiot)\b', 'i')
"""

ORACLE["parse_blocklist"] = f"""
WITH t AS (
  SELECT CAST(conv_id AS VARCHAR) || '_' || CAST(turn AS VARCHAR) AS comment_id,
         list_filter(list_transform(string_split(text, ','), lambda x: {js_trim('x')}), lambda x: x <> '') AS l
  FROM conversations
)
SELECT comment_id, CAST(generate_subscripts(l, 1) - 1 AS BIGINT) AS pos, unnest(l) AS entry FROM t
"""

HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))"

ORACLE["host_filter"] = rf"""
SELECT page_id, url, {HOST} AS host FROM pages
WHERE regexp_matches({HOST}, '\.example\.(com|net)$')
"""

ORACLE["detection_display"] = f"""
SELECT comment_id, upper(label) AS title, printf('Confidence: %.1f%%', confidence * 100.0) AS message
FROM ({CLASSIFIED_TURNS}) c
"""

# --- replay: a plain per-comment window over the whole log --------------------
REPLAY_CTE = f"""
WITH ops AS (
  SELECT event_id AS seq, ts, 't1_' || CAST(user_id AS VARCHAR) AS comment_id,
         CASE event_type WHEN 'view' THEN 'detect' WHEN 'signup' THEN 'detect' WHEN 'click' THEN 'delete'
              WHEN 'purchase' THEN 'approved' WHEN 'error' THEN 'rejected' ELSE event_type END AS op,
         event_id % (SELECT count(*) FROM documents) AS doc_id
  FROM events
),
flags AS (SELECT doc_id, {lex('text')} AS toxic FROM documents),
kept AS (
  SELECT o.* FROM ops o LEFT JOIN flags f ON o.doc_id = f.doc_id
  WHERE o.op <> 'detect' OR coalesce(f.toxic, false)
),
steps AS (
  SELECT *,
    lag(op) OVER (PARTITION BY comment_id ORDER BY ts, seq) AS prev_op,
    lag(doc_id) OVER (PARTITION BY comment_id ORDER BY ts, seq) AS prev_doc,
    row_number() OVER (PARTITION BY comment_id ORDER BY ts DESC, seq DESC) AS rn,
    coalesce(count(CASE WHEN op <> 'detect' THEN 1 END) OVER (PARTITION BY comment_id ORDER BY ts, seq
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS run_id
  FROM kept
),
runs AS (
  SELECT *,
    first_value(ts) OVER (PARTITION BY comment_id, run_id ORDER BY ts, seq) AS queued_ts,
    first_value(seq) OVER (PARTITION BY comment_id, run_id ORDER BY ts, seq) AS queued_seq
  FROM steps
),
acts AS (
  SELECT s.seq AS id, s.comment_id, d.text, s.op AS action, s.ts AS timestamp, s.prev_doc AS doc_id
  FROM steps s LEFT JOIN documents d ON d.doc_id = s.prev_doc
  WHERE s.op NOT IN ('detect', 'delete') AND s.prev_op = 'detect'
),
queue AS (
  SELECT r.comment_id, d.text, 'cyberbully' AS label, CAST(0.925 AS DOUBLE) AS confidence, r.queued_ts, r.queued_seq
  FROM runs r LEFT JOIN documents d ON d.doc_id = r.doc_id
  WHERE r.rn = 1 AND r.op = 'detect'
)
"""

ORACLE["queue_now"] = REPLAY_CTE + "SELECT * FROM queue ORDER BY queued_ts, queued_seq"

ORACLE["actions"] = REPLAY_CTE + "SELECT * FROM acts"

ORACLE["not_found"] = REPLAY_CTE + """
SELECT seq, ts, comment_id, op FROM steps
WHERE op <> 'detect' AND (prev_op IS NULL OR prev_op <> 'detect')
"""

ORACLE["delete"] = REPLAY_CTE + """
SELECT seq, ts, comment_id FROM steps WHERE op = 'delete' AND prev_op = 'detect'
"""

# --- the queue as a stored snapshot: the log cut at a day ------------------------
_EARLY = "coalesce(CAST(ts AS DATE) < (SELECT min(CAST(ts AS DATE)) + CAST((max(CAST(ts AS DATE)) - min(CAST(ts AS DATE))) // 2 AS INTEGER) FROM events), true)"
SNAPSHOT_CTE = REPLAY_CTE.replace("WHERE o.op <> 'detect' OR coalesce(f.toxic, false)", f"WHERE (o.op <> 'detect' OR coalesce(f.toxic, false)) AND {_EARLY}") + f"""
, snap AS (SELECT comment_id, doc_id, CAST(0.925 AS DOUBLE) AS confidence, queued_ts, queued_seq FROM runs WHERE rn = 1 AND op = 'detect'),
late AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ts, seq) AS k FROM ops WHERE NOT {_EARLY} AND op NOT IN ('detect', 'delete'))
"""

ORACLE["queue_resumed"] = ORACLE["queue_now"]

ORACLE["actions_resumed"] = ORACLE["actions"]

ORACLE["resolve"] = SNAPSHOT_CTE + """
SELECT l.seq AS id, l.comment_id, d.text, l.op AS action, l.ts AS timestamp, s.doc_id
FROM late l JOIN snap s ON s.comment_id = l.comment_id LEFT JOIN documents d ON d.doc_id = s.doc_id WHERE l.k = 1
"""

ORACLE["resolve_not_found"] = SNAPSHOT_CTE + """
SELECT seq, ts, comment_id, op FROM late WHERE k > 1 OR comment_id NOT IN (SELECT comment_id FROM snap)
"""

ORACLE["delete_not_found"] = SNAPSHOT_CTE + f"""
, d AS (SELECT *, row_number() OVER (PARTITION BY comment_id ORDER BY ts, seq) AS k FROM ops WHERE op = 'delete' AND NOT {_EARLY})
SELECT seq, ts, comment_id, op FROM d WHERE k > 1 OR comment_id NOT IN (SELECT comment_id FROM snap)
"""

ORACLE["delete_batch"] = SNAPSHOT_CTE + f"""
SELECT * FROM snap WHERE comment_id NOT IN (SELECT comment_id FROM ops WHERE op = 'delete' AND NOT {_EARLY})
"""

ORACLE["history"] = REPLAY_CTE + """
SELECT comment_id, text, action, timestamp FROM acts ORDER BY timestamp DESC NULLS LAST
"""

ORACLE["history_display"] = REPLAY_CTE + """
SELECT comment_id,
       coalesce(nullif(text, ''), '-') AS text,
       upper(substr(action, 1, 1)) || substr(action, 2) AS action,
       CASE WHEN strftime(timestamp, '%f') = '000000' THEN strftime(timestamp, '%Y-%m-%dT%H:%M:%S')
            ELSE strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') END AS timestamp
FROM acts
"""

ORACLE["comment_status"] = REPLAY_CTE + """
, latest AS (
  SELECT comment_id, action FROM (
    SELECT comment_id, action,
           row_number() OVER (PARTITION BY comment_id ORDER BY timestamp DESC NULLS LAST, id DESC) AS k
    FROM acts) t
  WHERE k = 1 AND action IN ('approved', 'rejected')
)
SELECT coalesce(q.comment_id, l.comment_id) AS comment_id,
       CASE WHEN q.comment_id IS NOT NULL THEN 'pending' ELSE l.action END AS status
FROM queue q FULL OUTER JOIN latest l ON q.comment_id = l.comment_id
"""

# --- feedback -> training set -------------------------------------------------
FEEDBACK_CTE = REPLAY_CTE + """
, latest AS (
  SELECT comment_id, text, action FROM (
    SELECT comment_id, text, action,
           row_number() OVER (PARTITION BY comment_id ORDER BY timestamp DESC NULLS FIRST, id DESC) AS k
    FROM acts WHERE action IN ('approved', 'rejected')) t
  WHERE k = 1
),
examples AS (
  SELECT clean_text, Label, min(comment_id) AS ord FROM (
    SELECT text AS clean_text, CASE action WHEN 'approved' THEN 1 WHEN 'rejected' THEN 0 END AS Label, comment_id
    FROM latest) t
  WHERE clean_text IS NOT NULL AND Label IS NOT NULL
  GROUP BY clean_text, Label
),
original AS (
  SELECT d.text AS clean_text, CAST(l.toxic AS INTEGER) AS Label, d.doc_id AS ord
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
both_sets AS (
  SELECT clean_text, Label, 0 AS src, lpad(CAST(ord AS VARCHAR), 20, '0') AS ord FROM original
  UNION ALL
  SELECT clean_text, Label, 1 AS src, ord FROM examples
),
merged AS (
  SELECT clean_text, Label FROM (
    SELECT clean_text, Label, row_number() OVER (PARTITION BY clean_text ORDER BY src, ord) AS k FROM both_sets) t
  WHERE k = 1
)
"""

ORACLE["valid_feedback"] = REPLAY_CTE + """
SELECT id, comment_id, action, timestamp FROM acts WHERE action IN ('approved', 'rejected')
"""

ORACLE["latest_feedback"] = FEEDBACK_CTE + "SELECT * FROM latest"

ORACLE["feedback_examples"] = FEEDBACK_CTE + "SELECT clean_text, Label FROM examples"

ORACLE["merged_training"] = FEEDBACK_CTE + "SELECT * FROM merged"

# The key carries the order, which the compare itself ignores.
ORACLE["seeded_shuffle"] = FEEDBACK_CTE + """
SELECT clean_text, Label, md5('42|' || coalesce(clean_text, '')) AS shuffle_key FROM merged
"""

# pandas' missing-value strings come back as nulls.
ORACLE["labelled_csv"] = FEEDBACK_CTE + """
SELECT CASE WHEN clean_text IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN',
                                '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null') THEN NULL
            ELSE clean_text END AS clean_text, Label
FROM merged
"""

ORACLE["merge_stats"] = FEEDBACK_CTE + """
SELECT 'feedback' AS stage, CAST(count(*) AS BIGINT) AS n FROM latest
UNION ALL SELECT 'examples', CAST(count(*) AS BIGINT) FROM examples
UNION ALL SELECT 'original', CAST(count(*) AS BIGINT) FROM original
UNION ALL SELECT 'merged', CAST(count(*) AS BIGINT) FROM merged
"""

ORACLE["flag_precision"] = REPLAY_CTE + """
SELECT strftime(timestamp, '%Y-%m-%d') AS day,
       CAST(count(*) FILTER (WHERE action = 'approved') AS BIGINT) AS approved,
       CAST(count(*) FILTER (WHERE action = 'rejected') AS BIGINT) AS rejected,
       CAST(count(*) FILTER (WHERE action = 'approved') AS DOUBLE) / CAST(count(*) AS DOUBLE) AS precision
FROM acts WHERE action IN ('approved', 'rejected') AND timestamp IS NOT NULL
GROUP BY 1
"""

ORACLE["feedback_conflicts"] = FEEDBACK_CTE + """
SELECT DISTINCT e.clean_text, e.Label AS feedback_label, o.Label AS orig_label
FROM examples e JOIN original o ON e.clean_text = o.clean_text
WHERE e.Label <> o.Label
"""

# --- evaluation -----------------------------------------------------------------
PAIRS = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS comment_id,
       CAST(CASE WHEN {lex('d.text')} THEN 1 ELSE 0 END AS BIGINT) AS pred,
       CAST(l.toxic AS BIGINT) AS truth
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
"""

ORACLE["pair"] = PAIRS

ORACLE["confusion"] = f"""
WITH p AS ({PAIRS}), cells AS (SELECT t.truth, q.pred FROM (VALUES (0), (1)) t(truth), (VALUES (0), (1)) q(pred))
SELECT CAST(c.truth AS BIGINT) AS truth, CAST(c.pred AS BIGINT) AS pred,
       CAST((SELECT count(*) FROM p WHERE coalesce(p.truth, 0) = c.truth AND coalesce(p.pred, 0) = c.pred) AS BIGINT) AS n
FROM cells c
"""

ORACLE["prf1"] = f"""
WITH p AS ({PAIRS}),
c AS (SELECT CAST(sum(CASE WHEN truth = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN truth = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN truth = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
             CAST(sum(CASE WHEN truth = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM p)
SELECT tp, fp, fn, tn,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
FROM c
"""

_WORDS = ["stupid", "idiot", "hate", "dumb", "jerk", "kill", "garbage", "trash", "ugly", "shut up"]
_SCORE = " + ".join(f"(CASE WHEN contains(lower(d.text), '{w}') THEN 10 ELSE 0 END)" for w in _WORDS)

ORACLE["threshold_sweep"] = f"""
WITH s AS (
  SELECT least(greatest({_SCORE}, 0), 100) AS score, coalesce(CAST(l.toxic AS INTEGER), 0) AS truth
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
),
g AS (SELECT range AS threshold FROM range(0, 101)),
c AS (
  SELECT g.threshold,
    CAST((SELECT count(*) FROM s WHERE s.truth = 1 AND s.score >= g.threshold) AS BIGINT) AS tp,
    CAST((SELECT count(*) FROM s WHERE s.truth <> 1 AND s.score >= g.threshold) AS BIGINT) AS fp,
    CAST((SELECT count(*) FROM s WHERE s.truth = 1 AND s.score < g.threshold) AS BIGINT) AS fn
  FROM g
)
SELECT CAST(threshold AS BIGINT) AS threshold, tp, fp, fn,
       CASE WHEN tp + fp = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fp AS DOUBLE) END AS precision,
       CASE WHEN tp + fn = 0 THEN 0.0 ELSE CAST(tp AS DOUBLE) / CAST(tp + fn AS DOUBLE) END AS recall,
       CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE CAST(2 * tp AS DOUBLE) / CAST(2 * tp + fp + fn AS DOUBLE) END AS f1
FROM c
"""

ORACLE["lexicon_hits"] = " UNION ALL ".join(
    f"""SELECT '{w}' AS word,
       CAST(count(*) FILTER (WHERE contains(lower(text), '{w}')) AS BIGINT) AS substring_docs,
       CAST(count(*) FILTER (WHERE regexp_matches(lower(text), '\\b{w}\\b')) AS BIGINT) AS word_docs
FROM documents"""
    for w in _WORDS
)

# --- page scan --------------------------------------------------------------------
# Written from the HTML rules: a paragraph runs to the next start of an element that closes it, or the
# end of one around it; a line break element ends a line; other tags leave no trace.
_CLOSERS = ("address,article,aside,blockquote,center,dd,details,dialog,dir,div,dl,dt,fieldset,figcaption,figure,footer,form,"
            "h1,h2,h3,h4,h5,h6,header,hgroup,hr,li,listing,main,menu,nav,ol,p,plaintext,pre,search,section,summary,table,ul,xmp")
_AROUND = "body,button,caption,html,object,tbody,td,tfoot,th,thead,tr"


def _clean(x: str) -> str:
    c = f"regexp_replace({x}, '[ \\t\\n\\r\\f]+', ' ', 'g')"
    c = f"regexp_replace(regexp_replace({c}, '(?i)<br\\b[^>]*>', chr(10), 'g'), '<[^>]*>', '', 'g')"
    c = f"regexp_replace(regexp_replace({c}, ' +', ' ', 'g'), ' ?\\n ?', chr(10), 'g')"
    for ent, ch in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"),
                    ("&nbsp;", "\u00a0"), ("&middot;", "\u00b7"), ("&copy;", "\u00a9"), ("&amp;", "&")):
        c = f"replace({c}, '{ent}', '{ch}')"
    return js_trim(c)


# The names of all tags after which a paragraph is over, looked up one by one in the page's tags.
ELEMENTS = rf"""
WITH src AS (
  SELECT page_id, url,
         regexp_replace(html, '(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->', '', 'g') AS body
  FROM pages
),
tags AS (  -- what stands between two '<': a tag and the text after it
  SELECT page_id, url, unnest(string_split(body, '<')) AS part, generate_subscripts(string_split(body, '<'), 1) AS k FROM src
),
named AS (
  SELECT *, lower(regexp_extract(part, '^/?([A-Za-z][A-Za-z0-9]*)', 1)) AS tag, starts_with(part, '/') AS closing FROM tags WHERE k > 1
),
marked AS (
  SELECT *, tag = 'p' AND NOT closing AND regexp_matches(part, '(?i)^p[\s>]') AS opens,
         list_contains(string_split('{_CLOSERS}', ','), tag) OR (closing AND list_contains(string_split('{_AROUND}', ','), tag)) AS ends
  FROM named
),
runs AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS p_no,
         sum(CASE WHEN ends THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY k) AS e_no
  FROM marked
),
inside AS (  -- parts of a paragraph: no ending tag since its start
  SELECT *, min(e_no) OVER (PARTITION BY page_id, p_no) AS own FROM runs WHERE p_no > 0
),
texts AS (
  SELECT page_id, url, p_no - 1 AS pos,
         string_agg(CASE WHEN opens THEN regexp_replace(part, '(?s)^[^>]*>', '') ELSE '<' || part END, '' ORDER BY k) AS frag
  FROM inside WHERE e_no = own GROUP BY page_id, url, p_no
)
SELECT page_id, url, CAST(pos AS BIGINT) AS pos, txt FROM (SELECT page_id, url, pos, {_clean('frag')} AS txt FROM texts) t
WHERE txt <> ''
"""

ORACLE["page_elements"] = ELEMENTS

def scan(words: str, threshold: float, blur: str) -> str:
    return rf"""
WITH e AS ({ELEMENTS}),
h AS (SELECT e.* FROM e JOIN pages p ON p.page_id = e.page_id WHERE regexp_matches({HOST.replace('url', 'p.url')}, '\.example\.(com|net)$')),
d AS (
  SELECT sha256(concat_ws('|', CAST(page_id AS VARCHAR), CAST(pos AS VARCHAR), txt)) AS element_id, page_id, pos, txt,
         CASE WHEN regexp_matches(txt, '\b(?:{words})\b', 'i') THEN 'blocklist'
              WHEN {lex('txt')} AND CAST(0.925 AS DOUBLE) >= CAST({threshold} AS DOUBLE) THEN 'classifier' END AS reason,
         {blur} AS blur,
         {lex('txt')} AS queued
  FROM h
)
"""


SCAN = scan("la|on|idiot", 0.8, "false")

ORACLE["rescan_pages"] = scan("und|trash", 0.95, "true") + "SELECT * FROM d WHERE reason IS NOT NULL"

ORACLE["scan_pages"] = SCAN + "SELECT * FROM d WHERE reason IS NOT NULL"

# --- a graded score: 0.75, and 0.05 for each different word -------------------------
def graded(t: str) -> str:
    words = ["stupid", "idiot", "hate", "dumb", "jerk", "kill", "garbage", "trash", "ugly", "shut up"]
    n = " + ".join(f"CAST(coalesce(contains(lower({t}), '{w}'), false) AS INTEGER)" for w in words)
    return f"CAST(least(75 + 5 * ({n}), 100) AS DOUBLE) / 100.0::DOUBLE"


ORACLE["gate_graded"] = f"""
SELECT CAST(doc_id AS VARCHAR) AS comment_id, text, 'cyberbully' AS label, {graded('text')} AS confidence
FROM documents WHERE {lex('text')} AND {graded('text')} >= CAST(0.85 AS DOUBLE)
"""

ORACLE["scan_pages_graded"] = scan("la|on|idiot", 0.85, "false").replace(
    "CAST(0.925 AS DOUBLE) >=", f"{graded('txt')} >=") + "SELECT * FROM d WHERE reason IS NOT NULL"

ORACLE["queue_graded"] = REPLAY_CTE.replace(f"{lex('text')} AS toxic", f"{lex('text')} AND {graded('text')} >= CAST(0.85 AS DOUBLE) AS toxic").replace(
    "CAST(0.925 AS DOUBLE) AS confidence", f"{graded('d.text')} AS confidence") + "SELECT * FROM queue"

ORACLE["dedupe_flags"] = SCAN + "SELECT DISTINCT element_id, page_id, pos FROM d WHERE reason IS NOT NULL"

# --- training progress, log and report ---------------------------------------------
STEPS_CTE = """
WITH steps AS (
  SELECT CAST(event_id % 3 + 1 AS INTEGER) AS epoch, CAST(floor(event_id / 24) AS BIGINT) AS batch, value AS loss
  FROM events
),
al AS (
  SELECT epoch, round(avg(m), 4) AS avg_loss, CAST(count(*) AS BIGINT) AS n_batches
  FROM (SELECT epoch, batch, avg(loss) AS m FROM steps GROUP BY epoch, batch) b GROUP BY epoch
),
nb AS (SELECT max(batch) + 1 AS n_batches, max(epoch) AS n_epochs FROM steps),
g AS (
  SELECT CAST(s.epoch AS BIGINT) AS epoch, (s.epoch - 1) * nb.n_batches + s.batch + 1 AS step,
         nb.n_epochs * nb.n_batches AS total
  FROM (SELECT DISTINCT epoch, batch FROM steps) s, nb
),
gp AS (SELECT epoch, step, CAST(floor(CAST(step AS DOUBLE) / CAST(total AS DOUBLE) * 100.0) AS BIGINT) AS progress FROM g),
ticks AS (
  SELECT epoch, CAST(step AS BIGINT) AS step, progress FROM (
    SELECT *, lag(progress) OVER (ORDER BY step) AS prev FROM gp) t
  WHERE progress > coalesce(prev, -1)
)
"""

ORACLE["avg_loss"] = STEPS_CTE + "SELECT * FROM al"

ORACLE["progress_ticks"] = STEPS_CTE + "SELECT * FROM ticks"

ORACLE["total_steps"] = FEEDBACK_CTE + """
SELECT CAST(count(*) AS BIGINT) AS n_train, CAST(3 AS BIGINT) AS epochs, CAST(8 AS BIGINT) AS batch_size,
       CAST(ceil(count(*) / 8) AS BIGINT) AS steps_per_epoch, CAST(3 * ceil(count(*) / 8) AS BIGINT) AS total_steps
FROM merged
"""

# A line that is not a JSON object is raw, stripped; the objects of events carry no known field.
_NO_FIELDS = """CAST(NULL AS BIGINT) AS epochs, CAST(NULL AS BIGINT) AS batch_size, CAST(NULL AS BIGINT) AS total_steps,
       CAST(NULL AS VARCHAR) AS device, CAST(NULL AS BIGINT) AS epoch, CAST(NULL AS BIGINT) AS step,
       CAST(NULL AS BIGINT) AS progress, CAST(NULL AS DOUBLE) AS avg_loss, CAST(NULL AS DOUBLE) AS f1,
       CAST(NULL AS DOUBLE) AS best_f1, CAST(NULL AS BIGINT) AS cm_tn, CAST(NULL AS BIGINT) AS cm_fp,
       CAST(NULL AS BIGINT) AS cm_fn, CAST(NULL AS BIGINT) AS cm_tp"""


def log_events(lines: str) -> str:
    obj = "coalesce(json_valid(s) AND json_type(CASE WHEN json_valid(s) THEN s END) = 'OBJECT', false)"
    return f"""
SELECT line_no, CASE WHEN {obj} THEN json_extract_string(CASE WHEN {obj} THEN s END, '$.type') ELSE 'raw' END AS type,
       {_NO_FIELDS}, CASE WHEN NOT {obj} THEN s END AS raw_line
FROM (SELECT line_no, {js_trim('line')} AS s FROM ({lines}) l) t
"""


ORACLE["train_log"] = log_events("""
    SELECT event_id AS line_no, props AS line FROM events
    UNION ALL SELECT (SELECT max(event_id) + 1 FROM events) + doc_id, text FROM documents""")

# --- unique-key load ------------------------------------------------------------------
ORACLE["load_unique"] = """
WITH ex AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0),
inc AS (SELECT doc_id, text FROM documents WHERE doc_id % 2 = 1),
firsts AS (SELECT text, min(doc_id) AS first_id FROM inc GROUP BY text)
SELECT i.doc_id,
       CASE WHEN EXISTS (SELECT 1 FROM ex WHERE ex.text IS NOT DISTINCT FROM i.text) THEN 'exists'
            WHEN i.doc_id = f.first_id THEN 'inserted' ELSE 'duplicate' END AS status
FROM inc i JOIN firsts f ON i.text IS NOT DISTINCT FROM f.text
"""

# --- sources and sinks ----------------------------------------------------------------
ORACLE["actions_table"] = REPLAY_CTE + """
SELECT id, comment_id, action, timestamp FROM acts WHERE action IN ('approved', 'rejected')
"""

ORACLE["train_log_file"] = log_events("""
    SELECT CAST(row_number() OVER (ORDER BY doc_id, pos) - 1 AS BIGINT) AS line_no, line FROM (
        SELECT doc_id, generate_subscripts(a, 1) AS pos, unnest(a) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d) x""")

# --- streams: the end of a stream equals the batch query over the same table ------------
ORACLE["stream_classify"] = ORACLE["flagged"]

ORACLE["stream_queue"] = REPLAY_CTE + "SELECT id, comment_id, action, timestamp, doc_id FROM acts"

ORACLE["stream_flags"] = ORACLE["scan_pages"]

# The parser path must give the same rows on pages that hold only <p> comments.
ORACLE["page_elements_dom"] = ELEMENTS

ORACLE["actions_appended"] = REPLAY_CTE + """
SELECT sha256(concat_ws('|', comment_id, coalesce(strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f'), ''), CAST(id AS VARCHAR))) AS action_key,
       id, comment_id, action, strftime(timestamp, '%Y-%m-%d') AS action_date, 'odd-' || (id % 2) AS batch FROM acts
"""

# --- the comment feed: what each line is made of decides its fate -------------------------
ORACLE["comment_feed"] = f"SELECT * FROM ({CLASSIFIED_DOCS}) c WHERE CAST(comment_id AS BIGINT) % 2 = 0 AND text IS NOT NULL"

ORACLE["comment_feed_rejects"] = """
SELECT reason, count(*) AS n FROM (
    SELECT CASE WHEN doc_id % 4 = 1 THEN 'comment_id not a string' ELSE 'text missing' END AS reason
    FROM documents WHERE doc_id % 2 = 1 OR text IS NULL
    UNION ALL
    SELECT CASE WHEN NOT coalesce(json_valid(props), false) THEN 'not JSON' WHEN json_type(props) <> 'OBJECT' THEN 'not an object'
                ELSE 'comment_id missing' END FROM events) r
GROUP BY reason
"""

ORACLE["precision_records"] = f"""
WITH p AS ({ORACLE["flag_precision"]})
SELECT day, precision AS f1, precision > greatest(coalesce(max(precision) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0), 0.0) AS saved
FROM p
"""

ORACLE["step_report"] = STEPS_CTE + """
SELECT true AS started, (SELECT max(progress) FROM ticks) AS progress, nullif(greatest(max(avg_loss), 0.0), 0.0) AS best_f1,
       count(*) AS epochs_reported, false AS complete
FROM al
"""
