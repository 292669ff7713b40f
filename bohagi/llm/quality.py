"""Problem 10: text quality statistics of every document, and what kind of text it is.

Layout evidence comes from the lines as a whole: the vertical profile of delimiters (do cells begin in the same
columns of line after line), the periodicity of indentation and marks (do lines begin like the line one, two, three
or four before) and the autocorrelation of line lengths over the same lags. Weighted sums of these with the word,
symbol and punctuation ratios tell tables and lists from prose: TABLE needs a profile and lengths that recur,
LIST beginnings that recur and words that stand in entries.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.words import map_batches, pieces

#: Function words by which natural prose is known (a parameter of the operator).
COMMON_WORDS = frozenset(
    "আৰু এই সেই যে হয় নহয় কৰি কৰা পৰা বাবে কিন্তু যদি লগত আছে আছিল হৈছে এটা এখন এজন নাই তেওঁ তাৰ ইয়াৰ বা অথবা কোনো সকলো বহুতো দ্বাৰা মাজত ওপৰত তলত পিছত আগতে "
    "মতে মাত্ৰ কেৱল অতি তথা তেন্তে কাৰণে প্ৰতি হিচাপে ইত্যাদি সমেৎ আকৌ আরু করি করা পরা নয় তার মাত্র দ্বারা কারণে প্রতি ওপরত ইয়ার "
    "the of and to in a is was for on that with as by at from it an be are has had he his you or not this which".split()
)
#: What ends a sentence or a clause at the end of a line.
ENDINGS = "।৷.!?:;|,॥…！？"

#: Weights of the sums and what they must reach. Chosen so that no signal does it alone: a table's profile is worth 3
#: at most and its lengths 1; a list's entries, shortness, open ends and scattered lengths 3.6 without a period.
TABLE = {"aligned_lines": 3.0, "length_autocorrelation": 1.0, "sentences": -2.0, "least": 3.05}
LIST = {"begin_period": 3.0, "entry_words": 2.0, "short_lines": 0.5, "open_lines": 0.5, "scatter": 4.0, "most_scatter": 0.15, "least": 4.0}
#: Words of an entry at most.
ENTRY = 6
#: Lines back that periodicity and autocorrelation look.
LAGS = 4
_MARK = re.compile(r"\s*([•*‣◦▪–—·-]|\(?[0-9০-৯]{1,3}[.)।]|\([^\s()]{1,3}\)|[^\W\d_]\))\s+\S")
_DELIMS = {"\t": "\t", "|": "|", ";": ";", ",": ",", "gap": re.compile(r" {2,}")}
_CLAUSE = {k: re.compile(rf"(?<=\S){re.escape(k)}(?= |$)") for k in ",;|"}
_WORD = re.compile(r"\S+")
_LETTER = re.compile(r"[^\W\d_]|[ঁ-ঃ়া-্ৗৢৣ‍]")
_LATIN1 = re.compile(r"[-ÿ]")
_EDGE = "।৷|.,!?;:()[]{}\"'“”‘’…-–—"

FIELDS = (
    "n_words int, mean_word_length double, letter_ratio double, symbol_ratio double, digit_ratio double, n_lines int, ended_lines double, common_words double, "
    "marked_lines double, aligned_lines double, delimiter string, repeated_lines double, repeated_words double, short_lines double, length_autocorrelation double, single_letters double, mojibake double, entry_words double, begin_period double"
)
NAMES = [f.split(" ")[0] for f in FIELDS.split(", ")]


def _cells(line: str, d) -> list[int]:
    """Where the cells after each delimiter begin; those around a whole row don't count."""
    if isinstance(d, str):
        return [i + 1 for i, c in enumerate(line) if c == d]
    return [m.end() for m in d.finditer(line)]


def alignment(lines: list[str]) -> tuple[float, str]:
    """The best vertical profile of one delimiter, and that delimiter. Its columns are counted over the lines by
    their place in characters and by their number in the row; a row stands in the profile with the share of its
    delimiters that fall into a column most lines have, if it has as many as most lines do or falls into all of
    those columns. So padded tables, and those of separated values, have a profile near 1."""
    best, name, n = 0.0, "", len(lines)
    if n < 3:
        return best, name
    rows = [x.strip() for x in lines]
    for k, d in _DELIMS.items():
        cells = [_cells(x, d) for x in rows]
        counts = Counter(map(len, cells))
        usual = max(counts, key=lambda u: (counts[u] if u else 0, u))
        if not usual or k in ",;|" and usual < 2 and counts[usual] < 0.9 * n:
            continue
        if k in ",;|" and sum(len(_CLAUSE[k].findall(x)) for x in rows) > 0.3 * usual * counts[usual]:
            continue  # ends of clauses, not of cells
        profile = 0.0
        for places in (cells, [range(len(c)) for c in cells]):
            column = Counter(p for c in places for p in c)
            often = {p for p, m in column.items() if 2 * m > n}
            if often:
                profile = max(profile, sum(sum(p in often for p in c) / len(c) for c in places if len(c) == usual or c and often <= set(c)) / n)
        if profile > best:
            best, name = profile, k
    return best, name


def _beginning(line: str) -> tuple[int, str] | None:
    """Indentation and kind of mark of a line that begins an entry: one that is marked, set in, or short without an
    end; None for others."""
    indent, m = len(line) - len(line.lstrip()), _MARK.match(line)
    if not indent and not m and (len(line.split()) > ENTRY or line.rstrip()[-1:] in ENDINGS):
        return None
    return indent, (m[1] if m[1] in "•*‣◦▪–—·-" else "number") if m else ""


def period(lines: list[str]) -> float:
    """The greatest share, over lags of up to LAGS lines, of lines that begin an entry set in and marked like the one
    so many lines before."""
    b = [_beginning(x) for x in lines]
    n = len(b)
    if n < 3:
        return 0.0
    return max(sum(x is not None and x == y for x, y in zip(b, b[k:])) / (n - k) for k in range(1, min(LAGS, n - 2) + 1))


def length_regularity(lens: list[int]) -> float:
    """The greatest autocorrelation of line lengths, about 0, over lags of up to LAGS lines: 1 for equal lines or ones
    that alternate, less the more they scatter. The last line, which breaks off anywhere, does not count."""
    x = lens[:-1] if len(lens) > 3 else lens
    n = len(x)
    if n < 3:
        return 1.0
    return max(sum(a * b for a, b in zip(x, x[k:])) / math.sqrt(sum(a * a for a in x[:-k]) * sum(b * b for b in x[k:])) for k in range(1, min(LAGS, n - 2) + 1))


def statistics(text: str | None, common: frozenset[str] = COMMON_WORDS) -> tuple:
    """The fields of one text; zeros for null, empty and blank ones."""
    ws = _WORD.findall(text) if text else []
    if not ws:
        return (0, 0.0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, "", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    assert text is not None
    lines = [x for x in text.split("\n") if x.strip()]
    n, solid = len(lines), sum(map(len, ws))
    letters = len(_LETTER.findall(text))
    digits = sum(map(str.isdigit, text))
    share, delimiter = alignment(lines)
    counts = Counter(lines)
    lens = [len(x) for x in lines]
    wc = Counter(ws)
    sizes = [len(x.split()) for x in lines]
    marked = [bool(_MARK.match(x)) for x in lines]
    ended = [x.rstrip()[-1] in ENDINGS for x in lines]
    return (
        len(ws),
        solid / len(ws),
        letters / solid,
        1 - (letters + digits) / solid,
        digits / solid,
        n,
        sum(ended) / n,
        sum(c for w, c in wc.items() if w.strip(_EDGE) in common) / len(ws),
        sum(marked) / n,
        share,
        delimiter,
        1 - len(counts) / n,
        1 - len(wc) / len(ws),
        sum(x <= ENTRY for x in sizes) / n,
        length_regularity(lens),
        sum(len(w) <= 1 for w in ws) / len(ws),
        len(_LATIN1.findall(text)) / solid,
        sum(k for k, m, e in zip(sizes, marked, ended) if m or k <= ENTRY and not e) / len(ws),
        period(lines),
    )


def table_score(s: dict) -> float:
    """How much speaks for rows of cells: the vertical profile and lengths that recur; against it, sentences with gaps."""
    sentences = s["delimiter"] == "gap" and s["common_words"] > 0.25 and s["ended_lines"] > 0.3
    return TABLE["aligned_lines"] * s["aligned_lines"] + TABLE["length_autocorrelation"] * s["length_autocorrelation"] + TABLE["sentences"] * sentences


def list_score(s: dict) -> float:
    """How much speaks for entries: beginnings that recur, words in entries, short lines without an end, and lengths
    that scatter (wrapped prose and verse are regular)."""
    scatter = min(LIST["most_scatter"], 1 - s["length_autocorrelation"])
    return LIST["begin_period"] * s["begin_period"] + LIST["entry_words"] * s["entry_words"] + LIST["short_lines"] * s["short_lines"] + LIST["open_lines"] * (1 - s["ended_lines"]) + LIST["scatter"] * scatter


def kind_of(s: dict) -> str | None:
    """prose, list, table or junk by the statistics; None for texts without a word."""
    n = s["n_lines"]
    if not s["n_words"]:
        return None
    if s["mojibake"] > 0.2 or (s["single_letters"] > 0.6 and s["n_words"] >= 8 and s["aligned_lines"] < 0.7):
        return "junk"
    if n >= 4 and s["repeated_lines"] > 0.6:
        return "junk"
    if n >= 3 and table_score(s) >= TABLE["least"]:
        return "table"
    if s["letter_ratio"] < 0.5 and s["marked_lines"] < 0.6:
        return "junk"
    if s["mean_word_length"] > 25:
        return "junk"
    if s["n_words"] >= 30 and s["repeated_words"] > 0.85 and s["common_words"] < 0.9:
        return "junk"
    return "list" if n >= (3 if s["marked_lines"] >= 0.6 else 4) and list_score(s) >= LIST["least"] else "prose"


def text_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", common: frozenset[str] = COMMON_WORDS) -> DataFrame:
    """(key, statistics, kind) of every row: null, empty and blank texts have zeros and no kind; other
    columns are not read; texts are read whole. One narrow stage: no shuffle."""

    def run(b: pa.RecordBatch):
        for p in pieces(b, 512):
            rows = [statistics(t, common) for t in p.column(1).to_pylist()]
            kinds = [kind_of(dict(zip(NAMES, r))) for r in rows]
            cols = [pa.array(c) for c in zip(*rows)]
            types = {"n_words": pa.int32(), "n_lines": pa.int32()}
            yield pa.RecordBatch.from_arrays([p.column(0), *[c.cast(types.get(k, c.type)) for k, c in zip(NAMES, cols)], pa.array(kinds, pa.string())], [key, *NAMES, "kind"])

    return map_batches(df.select(F.col(key), F.col(text)), run, f"`{key}` {df.schema[key].dataType.simpleString()}, {FIELDS}, kind string")
