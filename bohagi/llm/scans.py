"""Problem 6: noise in text from scanned pages, and continuous paragraphs without it.

A page is one row with its lines in order, so everything local to a page is a narrow map. Over a book
only small facts are gathered: what its edge lines say (furniture repeats), the distance of printed
from running page numbers, and the first word of each page. A line end with a hyphen is decided by retrieval: a
Levenshtein automaton on the trie of all lines' vocabulary finds the word before the hyphen and every word within one
edit of it joined to the next. Misread pieces are repaired from all words within two edits. Candidates are ranked by
the word before, edits and frequency only after they have been retrieved.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bohagi.llm.leakage import _bare, compared_words
from bohagi.llm.trie import near_words
from bohagi.llm.words import map_batches
from bohagi.session import materialize

#: What the head and the foot of a page are: its first and last lines (a parameter of the operators).
EDGE = 3
#: The share of a joined word's letters that may differ from the word retrieved for it.
JOINED_EDITS = 0.2
#: What a word broken at a line's end may be followed by. The first three are no dashes.
BREAKS, DASHES = "‐¬­", "-‑–"
#: Letters and marks that digits are misread as.
AS_DIGIT = {"l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "D": "0", "Q": "0", "S": "5", "s": "5", "B": "8", "Z": "2", "z": "2", "b": "6", "G": "6", "g": "9", "q": "9", "T": "7"}
#: Word for page.
PAGE_WORD = "পৃষ্ঠা"
#: Pairs of letters that scans confuse, each put down as the first.
CONFUSED = {"ণ": "ন", "ল": "ন", "ৰ": "ব", "র": "ব", "ৱ": "ব", "ষ": "য", "প": "গ", "স": "ম", "শ": "ম", "ঙ": "ড", "ভ": "ত", "থ": "খ", "ঘ": "য", "ক": "ফ", "ছ": "চ", "জ": "ড"}

#: The letters and marks of the block; what may stand with a foreign sign between two of them; the signs that count.
_LETTER = "\u0980-\u0983\u0985-\u09b9\u09bc-\u09ce\u09d7-\u09e3\u09f0\u09f1\u09fc\u09fe"
_OTHER = f"[^\\s{_LETTER}]"
_SEEN = "[^\\s\u0980-\u09ff\\-\u2010\u2011'\u2019\u2018\u02bc./\u0964\u0965]"
MISREAD = re.compile(f"(?<=[{_LETTER}]){_OTHER}*?{_SEEN}{_OTHER}*(?=[{_LETTER}])")
#: What Unicode says is ignored where it is displayed, and control characters.
_HIDDEN = re.compile("[\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff0-\ufffb\U0001bca0-\U0001bca3\U0001d173-\U0001d17a\U000e0000-\U000e0fff]")
_CONTROL = re.compile("[\u0000-\u0008\u000e-\u001b\u007f-\u0084\u0086-\u009f]")
_LONG_DASH = re.compile("[\u2012-\u2015]")
_END = re.compile(f"(\\S*?)( *)([{BREAKS}{re.escape(DASHES)}])[\\s​‌‍⁠﻿]*$")
_NUMBER_AT_END = re.compile(r"^\s*[\d]{1,4}\s+|(?:\s{2,}|\s*[|·•]\s*)[\d]{1,4}\s*$")
_DECOR = re.compile(r"^[\s|\-–—~*·•\[\]().:]+|[\s|\-–—~*·•\[\]().:]+$")


def is_misread(text: str) -> bool:
    """Whether a visible character that is not of the block, nor a hyphen, apostrophe, full stop (danda) or slash, stands
    between two letters or signs of a word, alone or with any others. A dash is no hyphen."""
    return bool(MISREAD.search(_CONTROL.sub("", _HIDDEN.sub("", text))))


def misread_parts(before: str, after: str) -> tuple[bool, bool]:
    """Whether there is such a character in the first, and in the second, part of a word that goes on in another line."""
    b, a = (_CONTROL.sub("", _HIDDEN.sub("", x)) for x in (before, after))
    at = [m.start() + i for m in MISREAD.finditer(b + a) for i, c in enumerate(m[0]) if re.match(_SEEN, c)]
    return any(i < len(b) for i in at), any(i >= len(b) for i in at)


def _spoilt(piece: str) -> bool:
    """Whether a piece is one to repair: a dash by itself may part two words and stays as it is."""
    return is_misread(_LONG_DASH.sub("-", piece))


def furniture_core(text: str) -> str:
    """A line without decoration and without a page number set beside it."""
    t = _DECOR.sub("", text)
    return " ".join(_DECOR.sub("", _NUMBER_AT_END.sub("", t)).split())


def folded(core: str) -> str:
    """The letters of a line, those that scans confuse as one and without vowel signs."""
    t = unicodedata.normalize("NFC", core)
    return "".join(CONFUSED.get(c, c) for c in t if unicodedata.category(c) in ("Lo", "Ll", "Lu", "Nd"))


def number_text(text: str) -> str | None:
    """What a line has but for decoration and the word for page, if it may be a number: digits, characters that digits
    are misread as, and ? for others that are no letters of the block."""
    t = text.strip()
    t = re.sub(r"^\W*(?:" + PAGE_WORD + r"|page|p\.|পৃঃ|পৃ\.?)\s*", "", t, flags=re.I)
    t = re.sub(r"[\s\-–—~*·•\[\](){}.:=<>_,।]", "", t)
    if not t:
        return None
    out = []
    for c in t:
        if c.isdigit():
            out.append(str(unicodedata.digit(c, 0)))
        elif c in AS_DIGIT:
            out.append(AS_DIGIT[c])
        elif "ঀ" <= c <= "৿":
            return None
        else:
            out.append("?")
    return "".join(out)


def same_number(seen: str, wanted: str) -> bool:
    """Whether the digits are those of the number, unread ones counting for any but for all of them."""
    return len(seen) == len(wanted) and seen != "?" * len(seen) and all(a in ("?", b) for a, b in zip(seen, wanted))


def _books(detected: DataFrame, aligned: DataFrame, lines: DataFrame) -> DataFrame:
    """One row a page: (src, doc, pn, page, lines array<struct<no, d, a>>); d is the line's own text, a the
    transcription; both null where not delivered. A repeated line is one (the last ingested, then the
    greater text); lines without a page or number are left out."""
    d = detected.where("source_page is not null and line_index is not null").groupBy(F.col("source_page").alias("page"), F.col("line_index").alias("no")).agg(
        F.max_by(F.struct("source_document", "prediction"), F.struct("ingested_at", "prediction")).alias("x"), F.lit(1).alias("is_d"))
    a = aligned.where("source_page is not null and line_index is not null").groupBy(F.col("source_page").alias("page"), F.col("line_index").alias("no")).agg(
        F.max(F.struct("transcription", "source_document")).alias("y"), F.lit(1).alias("is_a"))
    w = d.join(a, ["page", "no"], "full_outer").select(F.lit("book").alias("src"), F.coalesce("x.source_document", "y.source_document").alias("doc"), "page", "no", F.col("x.prediction").alias("d"), F.col("y.transcription").alias("a"))
    t = lines.where("source_page is not null and line_order is not null").groupBy(F.col("source_page").alias("page"), F.col("line_order").alias("no")).agg(F.max(F.struct("text", "document_id")).alias("z")).select(
        F.lit("scan").alias("src"), F.col("z.document_id").alias("doc"), "page", "no", F.col("z.text").alias("d"), F.lit(None).cast("string").alias("a"))
    both = w.unionByName(t)
    pages = both.groupBy("src", "page").agg(F.max("doc").alias("doc"), F.sort_array(F.collect_list(F.struct("no", "d", "a"))).alias("lines"))
    return pages.select("src", "doc", F.regexp_extract("page", r"(\d+)$", 1).try_cast("int").alias("pn"), "page", "lines")


def _lines(b: pa.RecordBatch):
    names = b.schema.names
    cols = {n: b.column(i).to_pylist() for i, n in enumerate(names)}
    for i in range(b.num_rows):
        yield {n: cols[n][i] for n in names}


def _edges(pages: DataFrame, edge: int) -> DataFrame:
    def run(b: pa.RecordBatch):
        rows = []
        for p in _lines(b):
            ls = [(x["no"], x["d"] or x["a"] or "") for x in p["lines"]]
            for k, (no, t) in enumerate(ls):
                if (k < edge or k >= len(ls) - edge) and t.strip():
                    core = furniture_core(t)
                    f = folded(core)
                    if len(f) < 3:  # too few letters to go by: all signs count
                        f = core.replace(" ", "")
                    rows.append((p["src"], p["doc"], p["pn"], p["page"], no, core, f if 3 <= len(f) else None, number_text(t), k < edge))
        cols = list(zip(*rows)) or [()] * 9
        types = (pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["src", "doc", "pn", "page", "no", "core", "fold", "num", "top"])

    return map_batches(pages, run, "src string, doc string, pn int, page string, no int, core string, fold string, num string, top boolean")


def _halves(c: str, sizes: tuple[int, ...]):
    """Keys of a line's first and second half as lines of nearly its length have them: of two within one edit, one
    half is the same."""
    n = F.length(c)
    keys = []
    for d in sizes:
        size = n + d
        half = (size / 2).cast("int")
        keys += [F.concat(size.cast("string"), F.lit("f"), F.substr(F.col(c), F.lit(1), half)), F.concat(size.cast("string"), F.lit("l"), F.substr(F.col(c), half - size))]
    return F.array_distinct(F.array(*keys))


def furniture(pages: DataFrame, edge: int = EDGE) -> DataFrame:
    """(page, no, kind): header and page_number lines.

    A header repeats at the edge of two pages or more of its book; lines of which scans read one letter
    otherwise (or add or miss one) count as one. A running title that stands mostly on the pages of the side a chapter begins
    on (or that the book begins with) is a chapter's; on its first page it is the chapter's own heading."""
    edges = materialize(_edges(pages, edge), "edges")
    book = ["src", "doc"]
    # page numbers: the distance that most numbers of the book agree on
    digits = edges.where("num is not null and pn is not null and not contains(num, '?')").withColumn("shift", F.col("num").try_cast("long") - F.col("pn")).where("shift is not null")
    shifts = digits.groupBy(*book, "shift").agg(F.count_distinct("pn").alias("n")).groupBy(*book).agg(F.max_by("shift", F.struct("n", -F.abs("shift"))).alias("shift"), F.max("n").alias("n")).where("n > 1")
    numbered = edges.where("num is not null and pn is not null").join(shifts.select(*book, "shift"), book)
    wanted = (F.col("pn") + F.col("shift")).cast("string")
    fits = (F.length("num") == F.length(wanted)) & (F.length(F.replace("num", F.lit("?"), F.lit(""))) > 0) & F.rlike(wanted, F.concat(F.lit("^"), F.replace("num", F.lit("?"), F.lit(".")), F.lit("$")))
    page_numbers = numbered.where(fits).select("page", "no", F.lit("page_number").alias("kind"))
    # headers: prototypes are lines that two pages share, letter by letter but for confused ones
    lines = edges.where("fold is not null and doc is not null")
    protos = lines.groupBy(*book, "fold").agg(F.count_distinct("page").alias("n"), F.max("core").alias("proto")).where("n > 1")
    pv = protos.select(*book, F.col("fold").alias("pf"), "n", "proto", F.explode(_halves("fold", (0,))).alias("v"))
    ev = lines.select(*book, "pn", "page", "no", "fold", "core", "top", F.explode(_halves("fold", (-1, 0, 1))).alias("v"))
    one = F.call_function("levenshtein", F.col("fold"), F.col("pf"), F.lit(1)) >= 0  # -1 beyond the limit
    near = ev.join(pv, [*book, "v"]).where((F.col("fold") == F.col("pf")) | one & (F.levenshtein("core", "proto") <= F.greatest(F.lit(2), F.floor(F.length("proto") / 4))))
    best = near.groupBy(*book, "page", "no", "pn", "top").agg(F.max_by("pf", F.struct("n", "pf")).alias("pf"))
    odd = F.pmod("pn", F.lit(2)) == 1
    facts = best.groupBy(*book, "pf").agg(F.min("pn").alias("first"), F.count_if(odd).alias("odd"), F.count("*").alias("n"), F.count_if("top").alias("at_top"))
    chapter = (F.col("at_top") * 2 > F.col("n")) & (F.col("odd") * 2 >= F.col("n"))
    headers = best.join(facts, [*book, "pf"]).where(~(chapter & (F.col("pn") == F.col("first")))).select("page", "no", F.lit("header").alias("kind"))
    return headers.unionByName(page_numbers).distinct()


def _first_piece(t: str) -> str:
    return next((x for x in t.split() if _bare[x]), "")


def _last_part(t: str) -> tuple[str, str, str] | None:
    """(word before the break, class, the piece it stands in) of a line that ends in a hyphen: sure, open or dash."""
    m = _END.search(t)
    if not m:
        return None
    before = m[1] or (t[: m.start()].split() or [""])[-1]
    w = _bare[before]
    if not w or not any("ঀ" <= c <= "৿" or c.isalpha() for c in w[-1]):
        return None
    gap = bool(m[2]) or not m[1]
    kind = "sure" if m[3] in BREAKS else "dash" if m[3] == "–" and gap else "open"
    return w[-1], kind, before


def _line_facts(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """(what, src, doc, pn, page, no, own, w1, w2, sure): misread lines, line ends that may be broken words
    (w2 is null if the page ends there) and the first word of each page, furniture left out (no is its line, w1 the piece
    it stands in, sure whether the table has the line). Also line ends where the word is misread if it is a broken one: cut
    (w1 is the number of the misread line), or tail, with its last piece, where the page ends."""
    m = marks.groupBy("page").agg(F.collect_set("no").alias("out"))

    def run(b: pa.RecordBatch):
        rows = []
        for p in _lines(b):
            out = set(p["out"] or ())
            at = (p["src"], p["doc"], p["pn"], p["page"])
            for own in ("d", "a") if p["src"] == "book" else ("d",):
                body = [(x["no"], x[own] if x[own] is not None else (x["d"] or ""), x[own] is not None) for x in p["lines"]]
                for no, t, mine in body:
                    if mine and is_misread(t):
                        rows.append(("misread", *at, no, own, None, None, None))
                body = [x for x in body if x[0] not in out]
                first = next(((no, x, mine) for no, t, mine in body if (x := _first_piece(t))), None)
                if first:
                    rows.append(("first", *at, first[0], own, first[1], _bare[first[1]][0], first[2]))
                for k, (no, t, mine) in enumerate(body):
                    if mine and (e := _last_part(t)) and e[1] != "dash":
                        follow = next(((body[i][0], x, body[i][2]) for i in range(k + 1, len(body)) if (x := _first_piece(body[i][1]))), None)
                        rows.append(("end", *at, no, own, e[0], _bare[follow[1]][0] if follow else None, e[1] == "sure"))
                        if follow is None:
                            rows.append(("tail", *at, no, own, e[2], None, None))
                        else:
                            here, there = misread_parts(e[2], follow[1])
                            rows += [("cut", *at, no, own, str(n), None, None) for n, bad in ((no, here), (follow[0], there and follow[2])) if bad]
        cols = list(zip(*rows)) or [()] * 10
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["what", "src", "doc", "pn", "page", "no", "own", "w1", "w2", "sure"])

    return map_batches(pages.join(m, "page", "left"), run, "what string, src string, doc string, pn int, page string, no int, own string, w1 string, w2 string, sure boolean")


def _counted(batches, words_of):
    """Word counts of batches in bounded tables."""
    c: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    for b in batches:
        for value in b.column(0).to_pylist():
            if value:
                c.update(words_of(value))
        if len(c) > 300_000:
            yield out()
            c.clear()
    yield out()


def _line_words(lines: list[dict]):
    """Words of a page's lines, parts of words at a line's end and after one left out."""
    for own in ("d", "a"):
        broken = False
        for x in lines:
            t = x[own]
            if t is None or own == "a" and t == x["d"]:
                continue
            ps = t.split()
            end = bool(_END.search(t))
            for w in map(_bare.__getitem__, ps[1 if broken else 0 : len(ps) - 1 if end else len(ps)]):
                yield from w
            broken = end


def vocabulary(pages: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(word, n): the words of all lines as compared and those of another collection of texts (its column text),
    counted in each task before anything is shuffled."""
    rows = pages.select("lines").mapInArrow(lambda bs: _counted(bs, _line_words), "word string, n long")
    if more is not None:
        rows = rows.unionByName(more.select("text").mapInArrow(lambda bs: _counted(bs, compared_words), "word string, n long"))
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def _misread_breaks(facts: DataFrame, broken: DataFrame) -> DataFrame:
    """(src, own, page, no): lines with a misread character beside the break of a word, which stands between two letters of
    the word but not of the line."""
    keys = ["src", "own", "page", "no"]
    cut = facts.where("what = 'cut'").select(*keys, F.col("page").alias("at"), F.col("w1").cast("int").alias("bad"))
    nxt = facts.where("what = 'first'").select("src", "doc", (F.col("pn") - 1).alias("pn"), "own", F.col("page").alias("at"), F.col("no").alias("over"), F.col("w1").alias("after"), F.col("sure").alias("mine"))
    tail = facts.where("what = 'tail'").join(nxt, ["src", "doc", "pn", "own"]).select(*keys, F.col("w1").alias("before"), "at", "over", "after", "mine")

    def run(b: pa.RecordBatch):
        rows = []
        for x in _lines(b):
            here, there = misread_parts(x["before"], x["after"])
            rows += [(*(x[c] for c in keys), *at) for at, bad in (((x["page"], x["no"]), here), ((x["at"], x["over"]), there and x["mine"])) if bad]
        cols = list(zip(*rows)) or [()] * 6
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], [*keys, "at", "bad"])

    cut = cut.unionByName(map_batches(tail, run, "src string, own string, page string, no int, at string, bad int"))
    return cut.join(broken.hint("merge"), keys, "left_semi").select("src", "own", F.col("at").alias("page"), F.col("bad").alias("no"))


def _unspoilt(found: DataFrame) -> DataFrame:
    """Retrieved rows (query, word, edits, n) whose word has no misread sign, unless it is the query itself."""

    def run(b: pa.RecordBatch):
        q, w = b.column(0).to_pylist(), b.column(1).to_pylist()
        yield b.filter(pa.array([x == y or not _spoilt(y) for x, y in zip(q, w)], pa.bool_()))

    return map_batches(found.select("query", "word", "edits", "n"), run, "query string, word string, edits int, n long")


def broken_words(facts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(src, own, page, no, w1, w2, joined, by): the line ends at which a word is broken off. joined is the whole
    word, or the two parts with their hyphen where that belongs to the word. by says what decides: the sign (one that is
    only set where words are broken, or a repeated word), or the automaton. It looks for the part before the
    hyphen and, within one edit, for the parts joined, in the whole vocabulary: broken is what joins to a known
    word, or to one of which it differs in a fifth of its letters at most, and what is no word by itself."""
    nxt = facts.where("what = 'first'").select("src", "doc", (F.col("pn") - 1).alias("pn"), "own", F.col("w2").alias("over"))
    ends = facts.where("what = 'end'").join(nxt, ["src", "doc", "pn", "own"], "left")
    ends = ends.withColumn("w2", F.coalesce("w2", "over")).select("src", "own", "page", "no", "w1", "w2", "sure", F.concat("w1", "w2").alias("w12"))
    ends = materialize(ends, "ends")
    alone = near_words(ends.where("not sure").select(F.col("w1").alias("query")), vocab, 0).select(F.col("query").alias("w1"), F.lit(True).alias("known")).distinct()
    found = near_words(ends.where("w12 is not null").select(F.col("w12").alias("query")), vocab, 1).where(F.col("edits") <= JOINED_EDITS * F.length("query"))
    best = _unspoilt(found).groupBy(F.col("query").alias("w12")).agg(F.max_by("word", F.struct(-F.col("edits"), "n", "word")).alias("word"))
    e = ends.join(alone, "w1", "left").join(best, "w12", "left")
    twice = F.col("w1").eqNullSafe(F.col("w2"))
    broken = e.where(F.col("sure") | twice | F.col("word").isNotNull() | F.col("known").isNull())
    # the joined word stands as it is read where its first part is no word: a near one may be another
    word = F.when(F.col("sure") | F.col("known").isNull(), F.coalesce("w12", "w1")).otherwise(F.coalesce("word", "w12", "w1"))
    by = F.when(F.col("sure") | twice, "sign").otherwise("automaton")
    return broken.select("src", "own", "page", "no", "w1", "w2", F.when(twice, F.concat_ws("-", "w1", "w2")).otherwise(word).alias("joined"), by.alias("by"))


def _table_of(src, own):
    return F.when(src == "scan", "text_lines").when(own == "a", "aligned_lines").otherwise("detected_lines")


def noise(detected: DataFrame, aligned: DataFrame, lines: DataFrame, more: DataFrame | None = None, edge: int = EDGE) -> DataFrame:
    """(source_table, source_page, line_no, kind): header, page_number, hyphen and misread lines of the three
    tables. more: other texts of the domain, for the vocabulary; edge: lines of a head or foot. Repeated lines are one; null and empty texts are of no kind (their places still count in the
    order); pages whose name ends in no number have no page number and no next page; an empty table gives
    no rows."""
    pages = materialize(_books(detected, aligned, lines), "pages")
    marks = materialize(furniture(pages, edge), "furniture")
    facts = materialize(_line_facts(pages, marks), "facts")
    vocab = materialize(vocabulary(pages, more), "vocabulary")
    there = pages.select("src", "page", F.explode("lines").alias("x"))
    has = there.select("page", F.col("x.no").alias("no"), F.explode(F.array(F.when(F.col("x.d").isNotNull(), _table_of(F.col("src"), F.lit("d"))), F.when(F.col("x.a").isNotNull(), F.lit("aligned_lines")))).alias("source_table")).where("source_table is not null")
    placed = has.join(marks, ["page", "no"]).select("source_table", "page", "no", "kind")
    t = _table_of(F.col("src"), F.col("own")).alias("source_table")
    mis = facts.where("what = 'misread'").select(t, "page", "no", F.lit("misread").alias("kind"))
    broken = materialize(broken_words(facts, vocab), "broken")
    over = _misread_breaks(facts, broken).select(t, "page", "no", F.lit("misread").alias("kind"))
    hyph = broken.select(t, "page", "no", F.lit("hyphen").alias("kind"))
    return placed.unionByName(mis).unionByName(over).unionByName(hyph).select("source_table", F.col("page").alias("source_page"), F.col("no").alias("line_no"), "kind").distinct()


def _token_parts(token: str) -> tuple[str, str, str]:
    """What stands before and after a piece's letters, and its letters with one ? for each misread run."""
    t = _CONTROL.sub("", _HIDDEN.sub("", token))
    i, j = 0, len(t)
    while i < j and unicodedata.category(t[i])[0] not in "LMN":
        i += 1
    while i < j and unicodedata.category(t[j - 1])[0] not in "LMN":
        j -= 1
    return t[:i], t[j:], unicodedata.normalize("NFC", MISREAD.sub(lambda m: "?" if re.search(_SEEN, _LONG_DASH.sub("", m[0])) else m[0], t[i:j]))


def _suspects(pages: DataFrame) -> DataFrame:
    """(token, prev, query): pieces with a misread character, the word before each and what to look for."""

    def run(b: pa.RecordBatch):
        rows = set()
        for ls in b.column(0).to_pylist():
            for own in ("d", "a"):
                for x in ls:
                    if x[own] and _spoilt(x[own]):
                        ps = x[own].split()
                        rows.update((p, (_bare[ps[i - 1]] or ("",))[-1] if i else "") for i, p in enumerate(ps) if _spoilt(p))
        cols = list(zip(*rows)) or [(), ()]
        cols = [*cols, [_token_parts(t)[2] for t in cols[0]]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["token", "prev", "query"])

    return map_batches(pages.select("lines"), run, "token string, prev string, query string").distinct()


def _bigrams(pages: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prev, word, n): how often a candidate word follows the word before it."""

    def run(batches):
        c: Counter = Counter()

        def out():
            cols = list(zip(*((a, b, n) for (a, b), n in c.items()))) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], ["prev", "word", "n"])

        for b in batches:
            for ls in b.column(0).to_pylist():
                for x in ls:
                    ws = [w for p in (x["d"] or "").split() for w in _bare[p]]
                    c.update(zip(ws, ws[1:]))
            if len(c) > 300_000:
                yield out()
                c.clear()
        yield out()

    return pages.select("lines").mapInArrow(run, "prev string, word string, n long").join(wanted, ["prev", "word"], "left_semi").groupBy("prev", "word").agg(F.sum("n").alias("follows"))


def corrections(pages: DataFrame, vocab: DataFrame) -> DataFrame:
    """(token, prev, word): for each misread piece the vocabulary word within two edits (of those with at most
    a third of its letters changed) that follows the word before it most often, then has fewest edits, then is
    most frequent. Words met once or twice, often a scan's
    variants of another, rank behind all others; words with a misread sign are no candidates. Pieces without a candidate have no row."""
    s = materialize(_suspects(pages), "suspects")
    found = materialize(_unspoilt(near_words(s.select("query"), vocab, 2).where("edits > 0")).where("edits * 3 <= length(word)"), "near")
    options = s.join(found, "query")
    follows = _bigrams(pages, options.select("prev", "word").distinct())
    ranked = options.join(follows, ["prev", "word"], "left").withColumn("follows", F.coalesce("follows", F.lit(0)))
    return ranked.groupBy("token", "prev").agg(F.max_by("word", F.struct(F.col("n") > 2, "follows", -F.col("edits"), "n", "word")).alias("word"))


def _page_paragraphs(detected: DataFrame, aligned: DataFrame, lines: DataFrame, more: DataFrame | None, edge: int) -> DataFrame:
    """(src, own, doc, pn, page, paragraph, text, lead, open): the paragraphs of each page. lead is what belongs
    to the end of the page before, after the rest of its broken word. open is null but for a page's last paragraph,
    and there whether it runs on. A page of no text of its own has one row with an empty text and open null,
    unless there is text on it that this table lacks."""
    pages = materialize(_books(detected, aligned, lines), "pages")
    marks = materialize(furniture(pages, edge), "furniture")
    vocab = materialize(vocabulary(pages, more), "vocabulary")
    broken = materialize(broken_words(_line_facts(pages, marks), vocab), "broken")
    fixes = materialize(corrections(pages, vocab), "fixes")
    # what a page needs from elsewhere: marks, its breaks, its tokens' words, and the break before its first line
    out = marks.groupBy("page").agg(F.collect_set("no").alias("out"))
    breaks = broken.groupBy("page").agg(F.collect_list(F.struct("own", "no", "w2", "joined")).alias("breaks"))

    def tokens(b: pa.RecordBatch):
        rows = set()
        for page, ls in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for own in ("d", "a"):
                for x in ls:
                    if x[own] and _spoilt(x[own]):
                        ps = x[own].split()
                        rows.update((page, p, (_bare[ps[i - 1]] or ("",))[-1] if i else "") for i, p in enumerate(ps) if _spoilt(p))
        cols = list(zip(*rows)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["page", "token", "prev"])

    words = map_batches(pages.select("page", "lines"), tokens, "page string, token string, prev string").join(fixes, ["token", "prev"]).groupBy("page").agg(F.collect_set(F.struct("token", "prev", "word")).alias("words"))
    last = pages.select("src", "doc", "pn", "page").join(broken, ["src", "page"]).groupBy("src", "doc", (F.col("pn") + 1).alias("pn"), "own").agg(F.max_by(F.struct("w2", "no"), "no").alias("x"))
    before = last.groupBy("src", "doc", "pn").agg(F.collect_list(F.struct("own", F.col("x.w2").alias("w2"))).alias("before"))
    whole = pages.join(out, "page", "left").join(breaks, "page", "left").join(words, "page", "left").join(before, ["src", "doc", "pn"], "left")

    def run(b: pa.RecordBatch):
        rows = []
        for p in _lines(b):
            gone = set(p["out"] or ())
            fix = {(w["token"], w["prev"]): w["word"] for w in p["words"] or ()}
            for own in ("d", "a") if p["src"] == "book" else ("d",):
                body = [(x["no"], x[own].split()) for x in p["lines"] if x["no"] not in gone and x[own] and x[own].strip()]
                whole_words = {x["no"]: x for x in p["breaks"] or () if x["own"] == own}
                widths = sorted(sum(map(len, ps)) for _, ps in body)
                usual = widths[len(widths) // 2] if widths else 0
                taken = next((x["w2"] for x in p["before"] or () if x["own"] == own), None)
                text, par, lead = [], [], None
                for no, ps in body:
                    prev = ""
                    if taken and ps and _bare[ps[0]][:1] == (taken,):  # its rest went to the line before
                        tail = ps[0][ps[0].find(taken[-1]) + 1 :] if taken[-1] in ps[0] else ""
                        if tail and not any(c.isalnum() for c in tail):
                            if par:
                                par[-1] += tail
                            elif not text:
                                lead = tail
                        prev, ps = (_bare[ps[0]] or ("",))[-1], ps[1:]
                    taken = None
                    size, line = sum(map(len, ps)), []
                    for q in ps:
                        w = fix.get((q, prev))
                        if w:
                            head, end, _ = _token_parts(q)
                            w = head + w + end
                        line.append(w or q)
                        prev = (_bare[q] or ("",))[-1]
                    if no in whole_words and line:
                        if not _bare[line[-1]] and len(line) > 1:  # the hyphen stands by itself
                            line.pop()
                        line[-1] = whole_words[no]["joined"]
                        taken = whole_words[no]["w2"]
                    par += line
                    if line and taken is None and line[-1][-1:] in "।.?!৷|" and size < 0.75 * usual:
                        text.append(par)
                        par = []
                at = (p["src"], own, p["doc"], p["pn"], p["page"])
                ts = [" ".join(t) for t in ([*text, par] if par else text)]
                rows += [(*at, k, t, None if k else lead, bool(par) if k == len(ts) - 1 else None) for k, t in enumerate(ts)]
                if not ts and (body or not any(x["no"] not in gone and (x["d"] or x["a"] or "").strip() for x in p["lines"])):
                    rows.append((*at, 0, "", lead, None))
        cols = list(zip(*rows)) or [()] * 9
        types = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], ["src", "own", "doc", "pn", "page", "paragraph", "text", "lead", "open"])

    return map_batches(whole.select("src", "doc", "pn", "page", "lines", "out", "breaks", "words", "before"), run, "src string, own string, doc string, pn int, page string, paragraph int, text string, lead string, open boolean")


def paragraphs(detected: DataFrame, aligned: DataFrame, lines: DataFrame, more: DataFrame | None = None, edge: int = EDGE) -> DataFrame:
    """(source_table, document, source_page, paragraph, text): readable text of each page. Furniture is gone,
    broken words are whole on the page they begin on, misread pieces are replaced where a vocabulary word is
    near, and lines run on until one ends a sentence well before the others' width. Null and empty lines
    give nothing, a page without text has no row. Paragraphs end with the page; book_paragraphs joins them."""
    done = _page_paragraphs(detected, aligned, lines, more, edge).where("text <> ''")
    return done.select(_table_of(F.col("src"), F.col("own")).alias("source_table"), F.col("doc").alias("document"), F.col("page").alias("source_page"), "paragraph", "text")


def book_paragraphs(detected: DataFrame, aligned: DataFrame, lines: DataFrame, more: DataFrame | None = None, edge: int = EDGE) -> DataFrame:
    """(source_table, document, source_page, paragraph, last_page, text): the paragraphs of each book. One that
    is open at a page's end goes on with the first of the page of the next number, over pages of no running
    text as well; source_page and paragraph say where it begins. It ends where a page is missing, or lacks all
    lines of the table. Pages without a document or number stand by themselves."""
    done = materialize(_page_paragraphs(detected, aligned, lines, more, edge), "paragraphs")
    own = ["src", "own", "doc", F.when(F.col("doc").isNull() | F.col("pn").isNull(), F.col("page"))]
    facts = done.groupBy("src", "own", "doc", "pn", "page").agg(F.max("paragraph").alias("k"), F.bool_or("open").alias("open"), F.bool_or(F.col("text") != "").alias("full"))
    w = Window.partitionBy(*own).orderBy("pn", "page")
    facts = facts.withColumn("run", F.sum(F.when(F.col("pn") == F.lag("pn").over(w) + 1, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    w = Window.partitionBy(*own, "run").orderBy("pn", "page")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    facts = facts.withColumn("joined", F.coalesce(F.last("open", True).over(past), F.lit(False)))
    begun = F.when(F.col("full") & (~F.col("joined") | (F.col("k") > 0)), F.struct(F.col("page").alias("page"), F.col("k").alias("no")))
    facts = facts.withColumn("begun", begun).withColumn("start", F.last("begun", True).over(past))
    # only what is joined to another page is gathered
    x = done.drop("open").join(facts.select("src", "own", "page", "k", "joined", "start", F.coalesce("open", F.lit(False)).alias("open")), ["src", "own", "page"])
    goes_on, first = F.col("open") & (F.col("paragraph") == F.col("k")), F.col("joined") & (F.col("paragraph") == 0)
    x = x.withColumn("start", F.when(first, F.col("start")).otherwise(F.struct(F.col("page").alias("page"), F.col("paragraph").alias("no")))).withColumn("first", first).withColumn("alone", ~first & ~goes_on)
    names = ["src", "own", "doc", F.col("start.page").alias("source_page"), F.col("start.no").alias("paragraph")]
    alone = x.where("alone and text <> ''").select(*names, F.col("page").alias("last_page"), "text")
    parts = F.sort_array(F.collect_list(F.struct("pn", "page", F.when(F.col("first"), F.coalesce("lead", F.lit(""))).otherwise(F.lit("")).alias("lead"), "text")))
    text = F.aggregate("parts", F.lit(""), lambda a, p: F.concat(a, p["lead"], F.when((a == "") | (p["text"] == ""), F.lit("")).otherwise(F.lit(" ")), p["text"]))
    many = x.where("not alone").groupBy(*names).agg(parts.alias("parts"), F.max_by("page", F.when(F.col("text") != "", F.struct("pn", "page"))).alias("last_page")).select("src", "own", "doc", "source_page", "paragraph", "last_page", text.alias("text"))
    return alone.unionByName(many.where("text <> ''")).select(_table_of(F.col("src"), F.col("own")).alias("source_table"), F.col("doc").alias("document"), "source_page", "paragraph", "last_page", "text")
