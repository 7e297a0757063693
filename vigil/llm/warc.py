"""WARC derivatives: responses become linked metadata and plain-text conversion records.

Each response gives two records. The *conversion* record holds the page's plain text; the *metadata*
record holds title, language, the kept response headers and the outlinks as warc-fields. Both name
the response in ``WARC-Refers-To``, keep its target, date and payload digest, and carry the digest of
their own block; the metadata record also names the conversion record (``WARC-Concurrent-To``). Digests are
``sha256:`` of the bytes in hexadecimal; record ids are ``urn:uuid`` of a SHA-256 of type and source.

*Plain text.* Comments, ``script``, ``style``, ``template`` and ``noscript`` elements go with their content; a tag
of a block element ends a line, other tags vanish; character references are decoded; white space runs
become one space and empty lines go. An element or comment without an end runs to the end.

The responses come from WARC files (:mod:`vigil.llm.warcfiles`): identifiers, dates, digests and HTTP headers are those of
the records read. :func:`responses` makes response records of a table of pages, for :func:`write_warc`; a table without
crawl times gives them all one date, a parameter.

One pass over the records without a shuffle; the tags are read in Arrow batches. The payload's bytes are read in the
charset that ``Content-Type`` names, UTF-8 without one or with an unknown one; wrong bytes become U+FFFD. HTML, and a
payload without a type, becomes plain text; ``text/plain`` is its own text; other types give an empty text without links.

Defined results: a null page is an empty payload; a null target has no ``WARC-Target-URI``; pages without text or links
give empty blocks or fields; a missing date has no ``WARC-Date``. Rows that repeat give equal records, with equal ids. Line
ends and tabs in header values become spaces. Of a table of pages only ``page_id, url, html`` are read.
"""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.llm.warcfiles import END, field

DATE = "1970-01-01T00:00:00Z"

# --- Fixed values: HTML elements that are not text, and those that end a line -----------------------
_DROPPED = "script style template noscript".split()
_BLOCK = frozenset(
    "address article aside blockquote body br caption dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 head header hr html legend li main nav ol option p pre section summary table tbody td tfoot th"
    " thead title tr ul".split()
)
# --------------------------------------------------------------------------------------------------
_ATTRS = r"""[^"'>]*+(?:"[^"]*+"[^"'>]*+|'[^']*+'[^"'>]*+)*+>"""
_GONE = "|".join(rf"<{t}\b(?:{_ATTRS}|[^>]*+>).*?(?:</{t}\s*+>|\Z)" for t in _DROPPED)
_MARKUP = re.compile(rf"<!--.*?(?:-->|\Z)|{_GONE}|<!{_ATTRS}|<\?[^>]*+>|</?+([a-z][a-z0-9:-]*+)(?:{_ATTRS}|[^>]*+>)", re.I | re.S)
_HREF = re.compile(r"""<a\b[^>]*?\shref\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_TITLE = re.compile(r"<title\b[^>]*>(.*?)(?:</title\s*>|\Z)", re.I | re.S)
_CHARSET = re.compile(r"""charset\s*=\s*["']?([A-Za-z0-9_.:-]+)""", re.I)
_LANG = re.compile(r"""<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z0-9-]+)""", re.I)


def plain_text(page: str) -> str:
    """The page's text, a line for each run between block tags."""
    body = _MARKUP.sub(lambda m: "\n" if m[1] and m[1].lower() in _BLOCK else "", page)
    if "&" in body:
        body = html.unescape(body)
    return "\n".join(x for x in (" ".join(line.split()) for line in body.split("\n")) if x)


def _shown(page: str) -> str:
    """The page without comments and elements that are not text."""
    return _MARKUP.sub(lambda m: m[0] if m[1] else "", page)


def _decoded(payload: str | bytes | None, kind: str) -> str:
    if payload is None or isinstance(payload, str):
        return payload or ""
    charset = _CHARSET.search(kind)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def page_column(payload: Column, content_type: Column) -> Column:
    """``struct<text, title, lang, links>`` of each payload, text or bytes."""

    @F.pandas_udf("text string, title string, lang string, links array<string>")
    def read(s: pd.Series, kinds: pd.Series) -> pd.DataFrame:
        out = []
        for page, kind in zip(s, kinds, strict=True):
            kind = (kind or "text/html").lower()
            page = _decoded(page, kind)
            if "html" not in kind:
                out.append((page if kind.startswith("text/plain") else "", "", "", []))
                continue
            shown = _shown(page)
            title, lang = _TITLE.search(shown), _LANG.search(shown)
            links = [html.unescape(a or b or c) for a, b, c in _HREF.findall(shown)]
            out.append((plain_text(page), " ".join(html.unescape(title[1]).split()) if title else "", lang[1] if lang else "", links))
        return pd.DataFrame(out, columns=["text", "title", "lang", "links"], index=s.index)

    return read(payload, content_type)


def _value(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\x00-\x20\x7F]+", " "))


def _uuid(kind: str, source: Column) -> Column:
    h = F.sha2(F.concat(F.lit(f"{kind}|"), source), 256)
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-a"), part(18, 3), F.lit("-"), part(21, 12), F.lit(">"))


def _digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c, 256))


def responses(pages: DataFrame, date: str = DATE) -> DataFrame:
    """Pages as response records: ``page_id, record_id, target_uri, date, http_status, http_headers, payload, payload_digest``."""
    payload = F.coalesce("html", F.lit(""))
    url = _value(F.col("url"))
    source = F.concat_ws("|", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce(url, F.lit("")), F.sha2(payload, 256))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"), _uuid("response", source).alias("record_id"), url.alias("target_uri"), F.lit(date).alias("date"),
        F.lit("HTTP/1.1 200 OK").alias("http_status"), F.concat(F.lit("Content-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string")).alias("http_headers"),
        payload.alias("payload"), _digest(payload).alias("payload_digest"),
    )


def derivatives(records: DataFrame) -> DataFrame:
    """The metadata and the conversion record of each response.

    ``page_id, type, record_id, refers_to, target_uri, payload_digest, block_digest, content_length, header, block``.
    """
    page = page_column(F.col("payload"), field(F.col("http_headers"), "Content-Type"))
    base = records.withColumn("page", page).select("page_id", "record_id", "target_uri", "date", "http_status", "http_headers", "payload_digest", "page")
    conversion, metadata = _uuid("conversion", F.col("record_id")), _uuid("metadata", F.col("record_id"))
    line = lambda name, c: F.concat(F.lit(f"{name}: "), c, F.lit(END))
    kept = F.array_join(F.transform(F.filter(F.split("http_headers", END), lambda x: x != ""), lambda x: F.concat(F.lit("http-header: "), _value(x), F.lit(END))), "")
    kept = F.concat(line("http-status", _value(F.col("http_status"))), kept)
    links = F.array_join(F.transform("page.links", lambda x: F.concat(F.lit("outlink: "), _value(x), F.lit(END))), "")
    fields = F.concat(line("title", _value(F.col("page.title"))), line("language", F.col("page.lang")), kept, links)
    record = lambda kind, ident, content, block, linked: F.struct(
        F.lit(kind).alias("type"), ident.alias("record_id"), F.lit(content).alias("content_type"), block.alias("block"), linked.alias("concurrent_to")
    )
    both = F.array(
        record("metadata", metadata, "application/warc-fields", fields, conversion),
        record("conversion", conversion, "text/plain; charset=utf-8", F.col("page.text"), F.lit(None).cast("string")),
    )
    rows = base.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(both))
    length = F.octet_length("block").cast("long")
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), line("WARC-Type", F.col("type")), line("WARC-Record-ID", F.col("record_id")), line("WARC-Refers-To", F.col("refers_to")),
        F.coalesce(line("WARC-Concurrent-To", F.col("concurrent_to")), F.lit("")), F.coalesce(line("WARC-Target-URI", F.col("target_uri")), F.lit("")),
        F.coalesce(line("WARC-Date", F.col("date")), F.lit("")), line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", _digest(F.col("block"))),
        line("Content-Type", F.col("content_type")), line("Content-Length", length.cast("string")),
    )
    return rows.select("page_id", "type", "record_id", "refers_to", "target_uri", "payload_digest", _digest(F.col("block")).alias("block_digest"), length.alias("content_length"), header.alias("header"), "block")


def response_records(rows: DataFrame) -> DataFrame:
    """``header`` and ``block`` of the WARC record of each of :func:`responses`, for :func:`write_warc`."""
    line = lambda name, c: F.coalesce(F.concat(F.lit(f"{name}: "), c, F.lit(END)), F.lit(""))
    made = rows.withColumn("block", F.concat("http_status", F.lit(END), "http_headers", F.lit(END * 2), F.col("payload").cast("string")))
    header = F.concat(
        F.lit(f"WARC/1.1{END}WARC-Type: response{END}"), line("WARC-Record-ID", F.col("record_id")), line("WARC-Target-URI", F.col("target_uri")),
        line("WARC-Date", F.col("date")), line("WARC-Payload-Digest", F.col("payload_digest")), line("WARC-Block-Digest", _digest(F.col("block"))),
        line("X-Page-ID", F.col("page_id").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length("block").cast("string")),
    )
    return made.select(header.alias("header"), "block")


def write_warc(records: DataFrame, path: str, compression: str = "none") -> None:
    """WARC files, one a partition: each record ends with two line ends, Spark's text sink does the rest."""
    whole = records.select(F.concat("header", F.lit(END), "block").alias("record"))
    whole.write.option("lineSep", END * 2).option("compression", compression).text(path)
