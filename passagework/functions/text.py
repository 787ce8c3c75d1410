"""Text cleaning as Column expressions.

All patterns run in linear time on any input: quantifiers are possessive and every match is
anchored where a run begins, so a megabyte of junk without a single space costs one pass.
"""

from __future__ import annotations

from functools import reduce
from unicodedata import normalize

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Whitespace, as the body of a character class and as a list of characters. Java's
# \s alone is ASCII, and trim without a list knows U+0020 only.
WS = r"\s\u001c-\u001f\u0085\p{Z}"
WS_CHARS = ("\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
            "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
            "\u2028\u2029\u202f\u205f\u3000")

# Characters of damaged text and what replaces them.
GLYPHS = {
    "\ufb01": "fi",
    "\ufb02": "fl",
    "\ufb00": "ff",
    "\ufb03": "ffi",
    "\ufb04": "ffl",
    "\u2019": "'",
    "\u2018": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2013": "-",
    "\u2014": "-",
    "\u2026": "...",
    "\u00a0": " ",
    "\u200b": "",
}

# Ranges that hold all of them: three comparisons a character.
GLYPH = r"[\u00a0\u200b-\u2026\ufb00-\ufb04]"

# Lines that are page furniture. Matched against single lines.
_S = rf"[{WS}]"
FURNITURE_LINE = (
    rf"(?iu)\A(?:"
    rf"{_S}*+page{_S}++\p{{Nd}}++{_S}*+(?:of{_S}++\p{{Nd}}++)?+{_S}*+"
    rf"|{_S}*+\p{{Nd}}++{_S}*+"
    rf"|{_S}*+-{_S}*+\p{{Nd}}++{_S}*+-{_S}*+"
    rf"|{_S}*+©(?s:.*+)"
    rf"|{_S}*+confidential{_S}*+"
    rf")\z"
)

# Control characters without tab, line feed and carriage return. Listed one by one,
# which Java looks up in a table; ranges would be tried one after the other.
CONTROL_CHARS = "[" + "".join(
    rf"\x{code:02x}" for code in [*range(0x20), *range(0x7F, 0xA0)]
    if code not in (0x09, 0x0A, 0x0D)) + "]++"
URL = rf"https?://[^{WS}]++"
EMAIL = rf"(?<![^{WS}])[^{WS}][^{WS}@]*+@[^{WS}][^{WS}.]*+\.[^{WS}]++"


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use).getItem(0)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _text(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def _replace_in(lines: Column, signs: tuple[str, ...], pattern: str, replacement: str) -> Column:
    """Regular expression replacement in each line that contains one of the signs.

    Most lines contain none, and looking for a fixed string is far cheaper than matching.
    """
    return F.transform(lines, lambda line: F.when(
        reduce(lambda a, b: a | b, [line.contains(s) for s in signs]),
        F.regexp_replace(line, pattern, replacement)).otherwise(line))


def _nfkc(text: pa.Array) -> pa.Array:
    # Arrow's own utf8_normalize leaves NFKC decomposed.
    return pa.array([t and normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def normalize_unicode(text: Column) -> Column:
    """NFKC. ASCII rows are their own normal form and are not sent to Python."""
    wide = F.when(F.octet_length(text) > F.char_length(text), text)
    return F.coalesce(F.arrow_udf(_nfkc, T.StringType())(wide), text)


def fix_encoding(text: Column) -> Column:
    """Replace ligatures, curly quotes, long dashes, ellipsis, no-break and zero-width spaces."""

    def repair(bound: Column) -> Column:
        fixed = bound
        for glyph, plain in GLYPHS.items():
            fixed = F.replace(fixed, F.lit(glyph), F.lit(plain))
        # ASCII text holds none of them, and most other text neither.
        ascii_only = F.octet_length(bound) == F.char_length(bound)
        return F.when(ascii_only | ~bound.rlike(GLYPH), bound).otherwise(fixed)

    return _bound(text, repair)


def drop_furniture_lines(text: Column) -> Column:
    """Remove page-number, copyright and confidentiality lines."""
    return _text(F.filter(_lines(text), lambda line: ~line.rlike(FURNITURE_LINE)))


def _squeeze(lines: Column) -> Column:
    # A single space already is what it becomes, so only longer runs and tabs are matched.
    return _replace_in(lines, ("  ", "\t"), r" [ \t]++|\t[ \t]*+", " ")


def _end_lines(lines: Column) -> Column:
    """At most two line feeds in a row, then every line right-stripped."""
    joined = _bound(_text(lines), lambda text: F.when(
        text.contains("\n\n\n"), F.regexp_replace(text, r"\n{3,}+", "\n\n")).otherwise(text))
    return F.transform(_lines(joined), lambda line: F.rtrim(line, F.lit(WS_CHARS)))


def normalize_whitespace(text: Column) -> Column:
    """Spaces and tabs to one space, three or more line feeds to two, then right-strip lines."""
    return _text(_end_lines(_squeeze(_lines(text))))


def strip_control(text: Column) -> Column:
    """Remove control characters except tab, line feed and carriage return."""
    return F.regexp_replace(text, CONTROL_CHARS, "")


def strip(text: Column) -> Column:
    """Remove Unicode whitespace from both ends."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-whitespace text."""
    return F.coalesce(~text.rlike(rf"[^{WS}]"), F.lit(True))


def clean_text(text: Column) -> Column:
    """The full cleaning sequence; null becomes the empty string."""
    out = fix_encoding(normalize_unicode(F.coalesce(text, F.lit(""))))
    return strip(strip_control(normalize_whitespace(drop_furniture_lines(out))))


def _drop_urls(lines: Column) -> Column:
    return _replace_in(lines, ("http",), URL, "")


def _drop_emails(lines: Column) -> Column:
    return _replace_in(lines, ("@",), EMAIL, "")


def _shorten_runs(lines: Column) -> Column:
    return _replace_in(_replace_in(lines, ("....",), r"\.{4,}+", "..."), ("----",), r"-{4,}+", "---")


def strip_urls(text: Column) -> Column:
    return _text(_drop_urls(_lines(text)))


def strip_emails(text: Column) -> Column:
    """Remove each whitespace-delimited token with an ``@`` and a later dot."""
    return _text(_drop_emails(_lines(text)))


def collapse_punctuation(text: Column) -> Column:
    """Four or more dots or hyphens become three."""
    return _text(_shorten_runs(_lines(text)))


def clean_for_embedding(text: Column) -> Column:
    """What is done to cleaned text before it is chunked and embedded."""
    # Line by line, because none of these patterns can match across a line feed.
    lines = _squeeze(_shorten_runs(_drop_emails(_drop_urls(_lines(text)))))
    return strip(_text(_end_lines(lines)))
