"""Text of mark-up. The page parser keeps state over a document, so it is an Arrow batch function."""

from __future__ import annotations

import html
import re
import unicodedata
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bohagi.functions.text import collapse

#: Tags that begin a line.
BLOCK_TAGS = frozenset("br div h1 h2 h3 h4 li p table tr".split())
#: Tags without an end; only strict scope knows them.
VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())


#: Kinds of events of a document: what they do to the depth of open elements; text does nothing to it.
OPENS, CLOSES, SINGLE, TEXT = 1, -1, 0, None


class _Events(HTMLParser):
    """A document as a list of (kind, tag, value): the value is an opening tag's class, or the text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.events: list[tuple[int | None, str, str]] = []
        note = self.events.append
        self.handle_starttag = lambda tag, attrs: note((OPENS, tag, dict(attrs).get("class") or ""))
        self.handle_endtag = lambda tag: note((CLOSES, tag, ""))
        self.handle_startendtag = lambda tag, attrs: note((SINGLE, tag, ""))
        self.handle_data = lambda data: note((TEXT, "", data))


def scope_text(markup: str, wanted: str = "pagetext", strict: bool = False) -> str:
    """Normalised text below elements of a class; empty where there is none. Tags that begin a line do so at either
    end. The depth below the element tells where it ends: void tags written without a slash add to it for good,
    unless strict. References are read twice and soft hyphens dropped; of a repeated attribute the last counts."""
    doc = _Events()
    doc.feed(markup)
    depth, parts = 0, []
    for kind, tag, value in doc.events:
        if not depth:
            depth = int(kind == OPENS and wanted in value.split())
        elif kind is TEXT:
            parts.append(value)
        else:
            parts.append("\n" if tag in BLOCK_TAGS else "")
            depth += 0 if strict and tag in VOID_TAGS else kind
    return " ".join(unicodedata.normalize("NFC", html.unescape("".join(parts)).replace("\u00ad", "")).split())


def page_text(c: Column, wanted: str = "pagetext", strict: bool = False) -> Column:
    """scope_text of a column; null stays null."""

    @F.arrow_udf(T.StringType())
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if t is None else scope_text(t, wanted, strict) for t in a.to_pylist()], pa.string())

    return run(c)


@F.arrow_udf(T.StringType())
def _unescape(a: pa.Array) -> pa.Array:
    return pa.array([None if t is None else html.unescape(t) for t in a.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def _unescape_nfc(a: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFC", re.sub(r"<[^>]+>", " ", html.unescape(t))) for t in a.to_pylist()], pa.string())


def unescape(c: Column) -> Column:
    return _unescape(c)


def strip_html(c: Column) -> Column:
    """References decoded, then tags as blanks, then normalised."""
    return collapse(_unescape_nfc(c))


def escape(c: Column) -> Column:
    """Text safe in mark-up and attributes."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c
