"""Page scan (P10, P11, T3, T5): elements of crawled pages against the block
list and the classifier.

Elements are those of the whole selector list (``[data-test-id="comment"],
.Comment, .comment, p``). Plain pages, which hold ``p`` only, are read by JVM
regex expressions; the others go through an HTML walker in Arrow batches.

The scan is narrow: host filter, element explode and the flag decision are
all per-page / per-element expressions, so the plan has no shuffle. Each
page's whole HTML is processed (no prefix); the element array is exploded
inside the task that read the page.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions import html as H
from vigil.functions.text import (
    CONFIDENCE_CLEAN,
    CONFIDENCE_TOXIC,
    DEFAULT_THRESHOLD_PERCENT,
    LABEL_TOXIC,
    blocklist_hit,
    lexicon_hit,
    parse_comma_list_py,
)
from vigil.operators.classify import Scorer
from vigil.operators.filters import gate_expr, host_filter
from vigil.session import ship_package


@dataclass(frozen=True)
class Settings:
    """Extension settings (defaults as in the reference)."""

    threshold_percent: int = DEFAULT_THRESHOLD_PERCENT
    privacy_mode: bool = False
    auto_scan: bool = False
    block_list: tuple[str, ...] = field(default_factory=tuple)

    @staticmethod
    def from_text(block_list: str, **kw) -> Settings:
        return Settings(block_list=tuple(parse_comma_list_py(block_list)), **kw)


def element_id(*cols) -> F.Column:
    """Deterministic element id: ``sha2(page_id | pos | txt)``."""
    return F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in cols]), 256)


def _elements(html: F.Column) -> F.Column:
    """``array<struct<pos, txt>>`` of non-empty ``p`` elements; each piece is cleaned once.

    Cleaning inside ``transform`` (instead of a Filter over an exploded
    column) keeps Catalyst from inlining the regex chain into both the
    filter and the projection.
    """
    pieces = H.paragraph_pieces(html)
    cleaned = F.transform(
        pieces, lambda p, i: F.struct(i.cast("bigint").alias("pos"), H.paragraph_text(p).alias("txt"))
    )
    return F.filter(cleaned, lambda e: e["txt"] != F.lit(""))


_ELEMS = T.ArrayType(T.StringType())


@F.pandas_udf(_ELEMS)
def _element_texts(html: pd.Series) -> pd.Series:
    return html.map(H.element_texts)


def _elements_of(pages: DataFrame, rows) -> DataFrame:
    """``rows(pages, elements)`` of plain pages and of the others, each read the cheapest exact way.

    ``rows`` has to explode the elements itself: a generator over the union of both would get a filter on
    the array's size, which Catalyst pushes below it, regex chain, Python call and all.
    """
    ship_package(pages.sparkSession)
    plain = H.is_plain(F.col("html"))
    walked = F.transform(_element_texts(F.col("html")), lambda t, i: F.struct(i.cast("bigint").alias("pos"), t.alias("txt")))
    walked = F.filter(walked, lambda e: e["txt"] != F.lit(""))
    return rows(pages.where(plain), _elements(F.col("html"))).unionByName(rows(pages.where(~plain), walked))


def page_elements(pages: DataFrame) -> DataFrame:
    """``(page_id, url, pos, txt)``: one row per non-empty element of the selector list."""
    return _elements_of(pages, lambda p, elements: p.select("page_id", "url", F.inline(elements)))


def page_elements_dom(pages: DataFrame) -> DataFrame:
    """The same by the HTML walker alone, for every page; rows stay in the task that read the page."""
    ship_package(pages.sparkSession)
    exploded = pages.select("page_id", "url", F.posexplode(_element_texts(F.col("html"))).alias("pos", "txt"))
    return exploded.select("page_id", "url", F.col("pos").cast("bigint").alias("pos"), "txt").where(
        F.col("txt") != ""
    )


def _flag(settings: Settings):
    """Per element struct -> the same struct plus ``reason`` and ``queued`` (JVM expressions)."""
    thr = settings.threshold_percent / 100

    def fn(e: F.Column) -> F.Column:
        txt = e["txt"]
        block = blocklist_hit(txt, list(settings.block_list))
        toxic = lexicon_hit(e["low"], lowered=True)
        conf = F.when(toxic, F.lit(CONFIDENCE_TOXIC)).otherwise(F.lit(CONFIDENCE_CLEAN))
        by_model = (toxic & (conf >= F.lit(thr))) if settings.auto_scan else F.lit(False)
        reason = F.when(block, F.lit("blocklist")).when(by_model, F.lit("classifier"))
        return F.struct(e["pos"].alias("pos"), txt.alias("txt"), reason.alias("reason"), toxic.alias("queued"))

    return fn


def _flagged(elements: F.Column, settings: Settings) -> F.Column:
    # Lambdas are evaluated without common-subexpression elimination: lower the text once first.
    lowered = F.transform(elements, lambda e: F.struct(e["pos"].alias("pos"), e["txt"].alias("txt"),
                                                       F.lower(e["txt"]).alias("low")))
    return F.filter(F.transform(lowered, _flag(settings)), lambda e: e["reason"].isNotNull())


def _scan_out(df: DataFrame, settings: Settings, carry: tuple[str, ...] = ()) -> DataFrame:
    return df.select(
        *carry,
        element_id("page_id", "pos", "txt").alias("element_id"),
        "page_id", "pos", "txt", "reason",
        F.lit(bool(settings.privacy_mode)).alias("blur"),
        "queued",
    )


def scan_elements(elements: DataFrame, settings: Settings) -> DataFrame:
    """Flag elements ``(page_id, pos, txt)``: block list first (short-circuits), else
    classifier + threshold when autoScan.

    Output ``element_id, page_id, pos, txt, reason, blur, queued`` for flagged
    elements only. ``queued``: the text would also enter the moderation
    queue (the backend's own classifier calls it toxic).
    """
    flagged = elements.select(
        "page_id", F.inline(_flagged(F.array(F.struct("pos", "txt")), settings))
    )
    return _scan_out(flagged, settings)


def scan_scored(elements: DataFrame, settings: Settings, scorer: Scorer) -> DataFrame:
    """:func:`scan_elements` with any scorer in place of the word list.

    The scorer gets ``page_id, pos, text`` and adds ``label`` and ``confidence``; it is asked once an element, the
    gate on its confidence comes after it. ``queued``: it calls the text toxic, whatever the confidence.
    """
    scored = scorer(elements.select("page_id", "pos", F.col("txt").alias("text")))
    toxic = F.coalesce(F.col("label") == LABEL_TOXIC, F.lit(False))
    by_model = (toxic & gate_expr(settings.threshold_percent)) if settings.auto_scan else F.lit(False)
    reason = F.when(blocklist_hit("text", list(settings.block_list)), F.lit("blocklist")).when(by_model, F.lit("classifier"))
    decided = scored.select("page_id", "pos", F.col("text").alias("txt"), F.inline(F.array(F.struct(reason.alias("reason"), toxic.alias("queued")))))
    return _scan_out(decided.where("reason IS NOT NULL"), settings)


def scan_pages(pages: DataFrame, settings: Settings, host_regex: str, scorer: Scorer | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Host filter -> element extraction -> flag decision, in one narrow projection per page.

    A settings change is a plain re-run with the new ``settings`` (the scan is
    stateless, so the re-run is exact). ``scorer`` replaces the word list (see :func:`scan_scored`).
    ``carry``: page columns that come along (with the word list only).
    """
    kept = host_filter(pages, host_regex)
    if scorer is not None:
        return scan_scored(page_elements(kept), settings, scorer)
    return _scan_out(_elements_of(kept, lambda p, elements: p.select(*carry, "page_id", F.inline(_flagged(elements, settings)))), settings, carry)


def dedupe_flags(flags: DataFrame) -> DataFrame:
    """Flag each element once: rows with one ``element_id`` are identical, keep one."""
    return flags.dropDuplicates(["element_id"])
