"""Row filters and display projections.

All are narrow (no shuffle) and built from JVM expressions. Parameters that a
user types (search term, minimum confidence, block list) are parsed once on
the driver and enter the plan as literals, so Catalyst can fold them.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import (
    DEFAULT_THRESHOLD_PERCENT,
    LABEL_TOXIC,
    blocklist_hit,
    js_trim_py,
    parse_comma_list,
    parse_float_js,
    upper_first,
)


def search(df: DataFrame, term: str | None) -> DataFrame:
    """Dashboard search: trimmed, lower-cased term in lower(text) or in the raw id.

    The id is not lower-cased (so upper-case ids cannot be found); an empty
    term keeps every row.
    """
    t = js_trim_py(term or "").lower()
    if not t:
        return df
    return df.where(F.lower(F.col("text")).contains(t) | F.col("comment_id").contains(t))


def min_confidence(df: DataFrame, v: str | float | None) -> DataFrame:
    """``confidence * 100 >= parseFloat(v)``; blank means no filter, NaN means no rows."""
    if v is None or (isinstance(v, str) and v == ""):
        return df
    x = parse_float_js(v)
    if math.isnan(x):
        return df.where(F.lit(False))
    return df.where((F.col("confidence") * F.lit(100.0)) >= F.lit(x))


def gate(df: DataFrame, threshold_percent: int = DEFAULT_THRESHOLD_PERCENT) -> DataFrame:
    """Extension threshold: toxic label and ``confidence >= pct / 100`` (inclusive)."""
    return df.where(gate_expr(threshold_percent))


def gate_expr(threshold_percent: int = DEFAULT_THRESHOLD_PERCENT) -> Column:
    thr = threshold_percent / 100
    return (F.col("label") == LABEL_TOXIC) & (F.col("confidence") >= F.lit(thr))


def blocklist(df: DataFrame, words: Iterable[str], text_col: str = "text") -> DataFrame:
    """Rows whose text matches any block-list entry as a whole word, ignoring case."""
    return df.where(blocklist_hit(text_col, list(words)))


def parse_blocklist(df: DataFrame, col: str, out: str = "entries") -> DataFrame:
    """Add ``out`` = the comma list in ``col``, trimmed, without blanks."""
    return df.withColumn(out, parse_comma_list(col))


def host_of(url: Column | str) -> Column:
    """Lower-cased host of a URL, null when it cannot be parsed."""
    u = F.col(url) if isinstance(url, str) else url
    return F.lower(F.try_parse_url(u, F.lit("HOST")))


def host_filter(df: DataFrame, regex: str, url_col: str = "url") -> DataFrame:
    """Keep pages whose hostname matches ``regex`` (the reference: ``\\.reddit\\.com$``)."""
    return df.where(F.coalesce(host_of(url_col).rlike(regex), F.lit(False)))


def iso_timestamp(ts: Column | str) -> Column:
    """Python ``datetime.isoformat()``: fraction printed only when non-zero."""
    c = F.col(ts) if isinstance(ts, str) else ts
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    frac = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return F.when(F.date_format(c, "SSSSSS") == "000000", whole).otherwise(frac)


def history_display(df: DataFrame) -> DataFrame:
    """History row as the dashboard shows it: ``Approved``, ``-`` for empty text, ISO time."""
    return df.select(
        "comment_id",
        F.coalesce(F.nullif(F.col("text"), F.lit("")), F.lit("-")).alias("text"),
        upper_first("action").alias("action"),
        iso_timestamp("timestamp").alias("timestamp"),
    )


def detection_display(df: DataFrame) -> DataFrame:
    """Notification of a manual detect: ``CYBERBULLY`` and ``Confidence: 92.5%``."""
    return df.select(
        "comment_id",
        F.upper(F.col("label")).alias("title"),
        F.format_string("Confidence: %.1f%%", F.col("confidence") * F.lit(100.0)).alias("message"),
    )
