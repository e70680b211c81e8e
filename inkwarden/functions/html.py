"""Visible text and link targets of an HTML column.  Nothing is rendered."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .core import LINE_BREAK, clean_line, let, strip
from .text import unescape

_CODE = r"(?is)<(script|style)\b[^>]*>.*?(?:</\1\s*>|$)"
_COMMENT = r"(?s)<!--.*?(?:-->|$)"
_HIDDEN = r"(?is)<(head|noscript|template)\b[^>]*>.*?(?:</\1\s*>|$)"
_BLOCK = r"(?i)<(?:p|div|br|tr|li|h[1-6]|table)\b[^>]*>"
_TAG = r"<[a-zA-Z/!?][^>]*>"


def _without_code(html: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(html, _CODE, ""), _COMMENT, "")


def html_text(html: Column) -> Column:
    """Visible lines, trimmed, without blank ones."""
    source = F.left(html, F.lit(fixed.MAX_HTML_SOURCE))
    shown = F.regexp_replace(_without_code(source), _HIDDEN, "")
    broken = F.regexp_replace(F.regexp_replace(shown, _BLOCK, "\n"), _TAG, "")
    lines = F.transform(F.split(unescape(broken), LINE_BREAK), strip)
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def _attribute(tag: Column, name: str) -> Column:
    # Fixed format: name="value", name='value' or name=value.
    raw = F.regexp_extract(
        tag, rf"(?is)(?:^|[\s\"'/]){name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", 1)
    return unescape(F.btrim(raw, F.lit("\"'")))


def html_links(html: Column, limit: int = fixed.MAX_LINKS) -> Column:
    """Anchors and form actions in document order: ``array<struct<href, text, source>>``."""
    source = _without_code(F.left(html, F.lit(fixed.MAX_HTML_SOURCE)))
    pieces = F.split(source, r"(?i)<(?=(?:a|form)[\s>/])")

    def link(piece: Column) -> Column:
        tag = F.substring_index(piece, ">", 1)
        is_form = F.regexp_like(piece, F.lit(r"(?i)^form"))
        closed = F.regexp_like(piece, F.lit(r"(?i)</a\s*>"))
        inner = F.regexp_extract(piece, r"(?is)^[^>]*>(.*?)</a\s*>", 1)
        shown = clean_line(unescape(F.regexp_replace(inner, _TAG, " ")), fixed.MAX_HEADER_CHARS)
        target = F.when(is_form, _attribute(tag, "action")).otherwise(_attribute(tag, "href"))
        return F.struct(
            F.when(is_form | closed, clean_line(target, fixed.MAX_URL_CHARS)).otherwise("").alias("href"),
            F.when(is_form, "").otherwise(shown).alias("text"),
            F.when(is_form, "form").otherwise("html").alias("source"))

    tagged = F.slice(pieces, 2, F.size(pieces))
    found = F.filter(F.transform(tagged, link), lambda k: k.href != "")
    return let(found, lambda f: F.slice(f, 1, limit))
