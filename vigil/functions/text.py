"""Column expressions for text: lexicon match, JS-style trim, block-list regex.

All of these build JVM-side expressions (no Python in the hot path).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the reference for identical results) ----------
# Lexicon of the live classifier, in the reference's order. Matching is on the
# lower-cased text, as a plain substring (so "hate" also fires inside "whatever").
DEFAULT_LEXICON: tuple[str, ...] = (
    "stupid", "idiot", "hate", "dumb", "jerk", "kill", "garbage", "trash", "ugly", "shut up",
)
LABEL_TOXIC = "cyberbully"
LABEL_CLEAN = "non-cyberbully"
CONFIDENCE_TOXIC = 0.925
CONFIDENCE_CLEAN = 0.991
DEFAULT_THRESHOLD_PERCENT = 80
# ----------------------------------------------------------------------------

# White space stripped by String.prototype.trim / Python str.strip on the
# characters that occur in practice: ASCII controls, NBSP, the Unicode space
# separators, line/paragraph separators and the BOM. Spark's trim() strips
# only U+0020, so trim is rebuilt from regexp_replace.
_WS_CLASS = (
    "[\\t\\n\\x{0B}\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}"
    "\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]"
)
_TRIM_RE = f"^{_WS_CLASS}+|{_WS_CLASS}+$"
_PY_WS = (
    "\t\n\x0b\f\r \xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# ASCII word characters, as JavaScript's \b sees them (no Unicode letters).
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


def js_trim(col: Column | str) -> Column:
    """Strip leading/trailing white space the way JavaScript's trim() does."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_replace(c, _TRIM_RE, "")


def js_trim_py(s: str) -> str:
    """Driver-side twin of :func:`js_trim` for scalar parameters."""
    return s.strip(_PY_WS)


def lexicon_hit(text: Column | str, lexicon: Sequence[str] = DEFAULT_LEXICON, lowered: bool = False) -> Column:
    """True iff lower(text) contains any lexicon word as a substring.

    An OR-chain of ``contains`` short-circuits per row and stays inside
    whole-stage codegen; ``lower`` is evaluated once per row by subexpression
    elimination.
    """
    if not lexicon:
        return F.lit(False)
    c = F.col(text) if isinstance(text, str) else text
    low = c if lowered else F.lower(c)
    cond = None
    for w in lexicon:
        c = low.contains(w.lower())
        cond = c if cond is None else (cond | c)
    # A null text is not toxic (the reference requires text, so this only
    # guards malformed rows).
    return F.coalesce(cond, F.lit(False))


def lexicon_word_count(text: Column | str, lexicon: Sequence[str] = DEFAULT_LEXICON) -> Column:
    """Number of distinct lexicon words present in lower(text) (graded score)."""
    low = F.lower(F.col(text) if isinstance(text, str) else text)
    total = F.lit(0).cast("bigint")
    for w in lexicon:
        total = total + F.when(low.contains(w.lower()), 1).otherwise(0).cast("bigint")
    return F.coalesce(total, F.lit(0).cast("bigint"))


_LITERAL_WORD = re.compile(r"[A-Za-z0-9_](?:[A-Za-z0-9_ ]*[A-Za-z0-9_])?")


def blocklist_regex(words: Iterable[str]) -> str | None:
    """One Java regex equal to ``any(new RegExp('\\\\b'+w.trim()+'\\\\b','i'))``.

    Each entry is a regex (not escaped), wrapped between ASCII word
    boundaries and grouped so an alternation inside an entry stays local.
    Entries that are plain ASCII words start and end with a word character,
    so their boundaries reduce to one look-behind and one look-ahead around
    a single alternation. Each entry has its own case rule, like JavaScript's
    ``i`` without ``u``: an ASCII entry matches case-insensitively on ASCII
    only, whatever else is in the list. Returns None for an empty list.
    """
    plain, other = [], []
    for w in words:
        w = js_trim_py(w)
        (plain if _LITERAL_WORD.fullmatch(w) else other).append(w)
    parts = []
    if plain:
        parts.append(f"(?i:(?<!{_WORD})(?:{'|'.join(plain)})(?!{_WORD}))")
    parts += [f"(?{'i' if w.isascii() else 'iu'}:{_BOUNDARY}{w}{_BOUNDARY})" for w in other]
    return "|".join(parts) or None


def blocklist_hit(text: Column | str, words: Iterable[str]) -> Column:
    rx = blocklist_regex(words)
    if rx is None:
        return F.lit(False)
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.rlike(rx), F.lit(False))


def parse_comma_list(col: Column | str) -> Column:
    """'a, b,,c ' -> ['a','b','c']: split on commas, trim, drop blanks."""
    c = F.col(col) if isinstance(col, str) else col
    parts = F.split(c, ",", -1)
    return F.filter(F.transform(parts, lambda x: js_trim(x)), lambda x: x != F.lit(""))


def parse_comma_list_py(s: str) -> list[str]:
    return [t for t in (js_trim_py(p) for p in s.split(",")) if t]


_JS_FLOAT = re.compile(r"[+-]?(?:Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)")


def parse_float_js(v: str | float | int | None) -> float:
    """JavaScript parseFloat: longest numeric prefix after leading white space, else NaN."""
    if v is None:
        return math.nan
    if isinstance(v, (int, float)):
        return float(v)
    s = v.lstrip(_PY_WS)
    m = _JS_FLOAT.match(s)
    if not m:
        return math.nan
    tok = m.group(0)
    if tok.endswith("Infinity"):
        return -math.inf if tok.startswith("-") else math.inf
    # A dangling exponent marker is not part of the number ("1e" -> 1).
    return float(tok)


def upper_first(col: Column | str) -> Column:
    """JS ``s.charAt(0).toUpperCase() + s.slice(1)``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 30))
