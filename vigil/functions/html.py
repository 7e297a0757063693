"""Visible text of page elements.

One rule, two ways to compute it:

* ``paragraph_pieces`` / ``paragraph_text`` -- JVM-side regex expressions for
  plain pages, whose only matching elements are ``p``: strip script/style/
  comments, split on ``<p ...>``, cut each piece where a block element closes
  the paragraph, ``<br>`` ends a line, other tags vanish, white space
  collapses, entities are decoded, the text is trimmed.
* ``ElementText`` -- a small ``html.parser`` walker for the full selector
  list (``[data-test-id="comment"], .Comment, .comment, p``) with nesting and
  all character references, used by an Arrow-batched pandas UDF.

``is_plain`` tells which pages the first way is enough for. Malformed pages on
which a block end tag stands without its start may still differ: the first way
ends the paragraph there.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.functions.text import js_trim, js_trim_py

# --- Fixed values: start tags that close an open p (HTML parsing rules) --------
_CLOSES_P = frozenset(
    "address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr li listing main menu nav ol p plaintext pre search section summary table ul xmp".split()
)
# Further elements whose end tag closes a p inside them, and elements without an end tag.
_CONTAINERS = frozenset("body button caption html object tbody td tfoot th thead tr".split())
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# Named entities that the regex way decodes (&amp; last).
ENTITIES = (
    ("&lt;", "<"),
    ("&gt;", ">"),
    ("&quot;", '"'),
    ("&#39;", "'"),
    ("&apos;", "'"),
    ("&nbsp;", "\u00a0"),
    ("&middot;", "\u00b7"),
    ("&copy;", "\u00a9"),
    ("&amp;", "&"),
)
# -------------------------------------------------------------------------------

_NOISE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->"
_P_OPEN = r"(?i)<p(?:\s[^>]*)?>"
_CUT = rf"(?is)(?:<(?:{'|'.join(sorted(_CLOSES_P))})\b|</(?:{'|'.join(sorted(_CLOSES_P | _CONTAINERS))})\b).*$"
_BR = r"(?i)<br\b[^>]*>"
_TAG = r"<[^>]*>"
_CSS_WS = r"[ \t\n\r\f]+"
_KNOWN = "|".join(e[1:] for e, _ in ENTITIES)
_OTHER_ENTITY = rf"&(?!(?:{_KNOWN}))(?:#|[A-Za-z])"


def is_plain(html: Column) -> Column:
    """No element but ``p`` can match, and all character references are in ``ENTITIES``."""
    return ~html.contains("omment") & ~html.rlike(_OTHER_ENTITY)


def decode_entities(c: Column) -> Column:
    for ent, ch in ENTITIES:
        c = F.replace(c, F.lit(ent), F.lit(ch))
    return c


def clean_fragment(c: Column) -> Column:
    """Collapse CSS white space, ``<br>`` -> line end, other tags -> nothing, decode entities, JS trim."""
    c = F.regexp_replace(c, _CSS_WS, " ")
    c = F.regexp_replace(c, _BR, "\n")
    c = F.regexp_replace(c, _TAG, "")
    c = F.regexp_replace(F.regexp_replace(c, " +", " "), " ?\n ?", "\n")
    return js_trim(decode_entities(c))


def paragraph_pieces(html: Column | str) -> Column:
    """``array<string>``: raw HTML of every ``p`` element in document order."""
    h = F.col(html) if isinstance(html, str) else html
    body = F.regexp_replace(h, _NOISE, "")
    parts = F.split(body, _P_OPEN, -1)
    # Piece 0 is everything before the first <p>.
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def paragraph_text(piece: Column) -> Column:
    return clean_fragment(F.regexp_replace(piece, _CUT, ""))


# --- full selector list via html.parser ----------------------------------------

_WS_RE = re.compile(_CSS_WS)


def _matches(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    """``[data-test-id="comment"], .Comment, .comment, p``."""
    if tag == "p":
        return True
    for k, v in attrs:
        if k == "data-test-id" and v == "comment":
            return True
        if k == "class" and v and ({"Comment", "comment"} & set(v.split())):
            return True
    return False


class ElementText(HTMLParser):
    """Collect the visible text of every matching element, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int | None]] = []  # (tag, element index or None)
        self.texts: list[list[str]] = []
        self.skip = 0

    def _open_indices(self) -> list[int]:
        return [i for _, i in self.stack if i is not None]

    def _close(self, tag: str) -> None:
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                return

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
            return
        if tag in _CLOSES_P and any(t == "p" for t, _ in self.stack):
            self._close("p")
        if tag == "br":
            for i in self._open_indices():
                self.texts[i].append("\n")
            return
        if tag in _VOID:
            return
        idx = None
        if _matches(tag, attrs):
            idx = len(self.texts)
            self.texts.append([])
        self.stack.append((tag, idx))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID and tag not in ("script", "style"):
            self._close(tag)

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
            return
        self._close(tag)

    def handle_data(self, data):
        if self.skip:
            return
        data = _WS_RE.sub(" ", data)  # only <br> ends a line
        for i in self._open_indices():
            self.texts[i].append(data)

    def elements(self) -> list[str]:
        return [js_trim_py(re.sub(" ?\n ?", "\n", re.sub(" +", " ", "".join(parts)))) for parts in self.texts]


def element_texts(html: str | None) -> list[str]:
    """Visible text of each ``[data-test-id="comment"], .Comment, .comment, p`` element."""
    if not html:
        return []
    p = ElementText()
    p.feed(html)
    p.close()
    return p.elements()
