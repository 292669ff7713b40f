"""Problem 4: one form for texts that look the same but are stored with differing characters.

The form is made in this order: full-width forms, mathematical letters and letters for numerals become plain ones;
characters that show nothing are dropped, but for joiners that change a conjunct's shape; NFC; letters written as
two signs that look like one become that one; marks for the full stop become one; then each token is resolved:
the script sets of its letters (their script extensions, augmented by the writing systems that mix scripts) are
intersected. Where nothing is left the token is mixed: of the scripts of the collection that all of it can be
written in, the one with most of its own letters is chosen and the others' look-alikes are respelt, into either script. A token
of one foreign script whose letters all have look-alikes in a script of the collection is a whole-script
look-alike and is respelt too. Letters with a twin in their own script become the usual one. Last, white space of
any kind becomes one blank.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.words import map_batches
from bohagi.session import materialize

# Letters and the Latin letter that looks the same, by script.
CYRILLIC = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "г": "r", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Ԍ": "G", "Н": "H", "І": "I", "Ӏ": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T", "Ѵ": "V", "Ԝ": "W", "Х": "X", "У": "Y", "Ү": "Y",
}
GREEK = {
    "α": "a", "γ": "y", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j",
    "Α": "A", "Β": "B", "Ϲ": "C", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Ϳ": "J", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
}
ARMENIAN = {"ց": "g", "հ": "h", "ո": "n", "օ": "o", "զ": "q", "ս": "u", "Լ": "L", "Օ": "O", "Տ": "S", "Ս": "U"}
CHEROKEE = {"Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮍ": "Y", "Ꮓ": "Z"}
COPTIC = {"ⲟ": "o", "ⲣ": "p", "ⲥ": "c", "ⲭ": "x", "Ⲏ": "H", "Ⲓ": "I", "Ⲕ": "K", "Ⲙ": "M", "Ⲛ": "N", "Ⲟ": "O", "Ⲣ": "P", "Ⲥ": "C", "Ⲧ": "T", "Ⲭ": "X", "Ⲩ": "Y"}
LISU = {
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓲ": "I", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V",
    "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
}
#: Letters of the Latin script that look like its usual ones.
LATIN_TWINS = {"ɑ": "a", "ɡ": "g", "ı": "i", "ɩ": "i", "ȷ": "j", "ʋ": "u", "ᴏ": "o", "ᴄ": "c", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "ꜱ": "s"}
#: Devanagari letters and signs and the one of the block that looks the same.
DEVANAGARI = {"घ": "ঘ", "ण": "ণ", "थ": "থ", "न": "ন", "म": "ম", "ल": "ল", "ँ": "ঁ", "ः": "ঃ", "ा": "া", "ि": "ি", "ी": "ী", "्": "্", "़": "়", "०": "০"}
#: What letters look like in each script of the collection.
LOOK = {"Beng": DEVANAGARI, "Latn": CYRILLIC | GREEK | ARMENIAN | CHEROKEE | COPTIC | LISU | LATIN_TWINS}
#: Scripts the collection is written in, the first preferred.
SCRIPTS = ("Beng", "Latn")
#: Scripts by their codes; for letters of others the first word of their name stands for one.
CODES = "Latn Beng Deva Cyrl Grek Armn Cher Copt Lisu Arab Hebr Hani Hira Kana Bopo Hang Thai Laoo Tibt Guru Gujr Orya Taml Telu Knda Mlym Sinh Mymr Khmr Geor Ethi Mong Cans Syrc Thaa Olck Mtei Cakm Newa Sylo Tirh".split()
#: What a script set is augmented by: writing systems that mix scripts.
AUGMENTED = {"Hani": {"Hanb", "Jpan", "Kore"}, "Hira": {"Jpan"}, "Kana": {"Jpan"}, "Bopo": {"Hanb"}, "Hang": {"Kore"}}
#: Signs of the block that are written in two ways which NFC keeps apart.
SEQUENCES = {"\u0985\u09be": "\u0986"}
#: Marks that look the same as another one.
MARKS = {"৷": "।", "|": "।", "ǀ": "।", "∣": "।", "॥": "।।", "‐": "-", "‑": "-"}
#: Characters without a glyph that Unicode counts as letters or marks.
BLANK_LETTERS = "\u034f\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u3164\uffa0"
_KEEP_J, _KEEP_N = "\ue000", "\ue001"
_JOIN = re.compile("(?<=[\u0995-\u09b9\u09dc-\u09df\u09f0\u09f1])\u200d(?=\u09cd)|(?<=\u09cd)\u200d(?=[\u0985-\u09b9\u09dc-\u09df\u09f0\u09f1])")
_NON_JOIN = re.compile("(?<=\u09cd)\u200c(?=[\u0985-\u09b9\u09dc-\u09df\u09f0\u09f1])")
_SEQ = re.compile("|".join(SEQUENCES))
#: Anything but Latin, the block and common marks: such tokens are looked at letter by letter.
_STRANGE = re.compile("[\u0131\u0237]|[^\\s\u0000-\u024f\u0300-\u036f\u0964\u0965\u0980-\u09ff\u2010-\u206f\ue000\ue001]")


def _is_styled(c: str) -> bool:
    """Whether it is a letter or digit in another typeface, a numeral made of letters, or letters set as one."""
    tag = unicodedata.decomposition(c).split(" ")[0]
    return tag in ("<font>", "<wide>", "<narrow>") or tag == "<compat>" and ("ROMAN NUMERAL" in (name := unicodedata.name(c, "")) or "LIGATURE" in name or "DIGRAPH" in name) and unicodedata.normalize("NFKC", c).isascii()


class _Chars(dict):
    """code point -> what it becomes before composition (None: dropped)."""

    def __missing__(self, cp: int):
        c = chr(cp)
        kind = unicodedata.category(c)
        if c.isspace():
            r: str | None = " "
        elif c in MARKS:
            r = MARKS[c]
        elif kind in ("Cf", "Cc") or c in BLANK_LETTERS or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF:
            r = None
        elif 0xFF01 <= cp <= 0xFFEE or _is_styled(c):
            r = "".join(MARKS.get(x, x) for x in unicodedata.normalize("NFKC", c))
        else:
            r = c
        self[cp] = r
        return r


_chars = _Chars()


_SCX = [(code, regex.compile(rf"\p{{scx={code}}}")) for code in CODES]
_SHARED = regex.compile(r"[\p{scx=Common}\p{scx=Inherited}]")


@lru_cache(maxsize=20_000)
def script_set(c: str) -> frozenset[str] | None:
    """Scripts a character may belong to, augmented; None for one that any script uses."""
    if _SHARED.match(c):
        return None
    own = {code for code, p in _SCX if p.match(c)}
    if not own:
        name = unicodedata.name(c, "")
        return frozenset({name.split(" ")[0]}) if name else None
    return frozenset(own.union(*(AUGMENTED.get(x, ()) for x in own)))


@lru_cache(maxsize=200_000)
def resolve_token(token: str) -> str:
    """The token in the script that all its letters can be written in; as it is where there is none, but for letters
    that look like a Latin one."""
    sets = [(c, script_set(c)) for c in token]
    known = [s for _, s in sets if s is not None]
    if not known:
        return token
    common = frozenset.intersection(*known)
    if not common.isdisjoint(SCRIPTS):
        return "".join(LATIN_TWINS.get(c, c) for c in token) if "Latn" in common else token

    def written(script: str) -> str | None:
        out = []
        for c, s in sets:
            if c in LOOK[script]:
                out.append(LOOK[script][c])
            elif s is None or script in s:
                out.append(c)
            else:
                return None
        return "".join(out)

    # whole-script look-alikes and mixed tokens with one consistent script
    for script in sorted(SCRIPTS, key=lambda x: -sum(x in s for s in known)):
        if (w := written(script)) is not None:
            return w
    if common:
        return token  # another script, not to be mistaken
    return "".join(LOOK["Latn"].get(c, c) for c in token)


#: Texts of these characters alone, if composed, are in their form but for blanks.
_SIMPLE = re.compile("(?:[ -{}~\u0964\u0980-\u09d6\u09e0-\u09f6\u09f8-\u09ff]|(?<=\u09f0)\u200d(?=\u09cd))*\\Z").match


def canonical(text: str) -> str:
    """The form in which texts that look the same are equal. Empty for texts that show nothing."""
    if _SIMPLE(text) and "\u0985\u09be" not in text and unicodedata.is_normalized("NFC", text):
        return " ".join(text.split(" ")).strip() if "  " not in text else " ".join(text.split())
    if "\u200d" in text:
        text = _JOIN.sub(_KEEP_J, text.replace("\u09a4\u09cd\u200d", "\u09ce"))
    if "\u200c" in text:
        text = _NON_JOIN.sub(_KEEP_N, text)
    t = unicodedata.normalize("NFC", text.translate(_chars))
    t = _SEQ.sub(lambda m: SEQUENCES[m[0]], t)
    if _STRANGE.search(t):
        t = " ".join(resolve_token(x) if _STRANGE.search(x) else x for x in t.split(" "))
    return " ".join(t.split()).replace(_KEEP_J, "\u200d").replace(_KEEP_N, "\u200c")


_BLANKS = re.compile(" +")


def plain(text: str) -> str:
    """The text but for the number of its plain blanks."""
    return _BLANKS.sub(" ", text).strip(" ")


def canonical_texts(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, form) of every row; null for a null text, empty for one that shows nothing."""

    def run(b: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else canonical(t) for t in b.column(1).to_pylist()], pa.string())], [key, "form"])

    return map_batches(df.select(key, text), run, f"`{key}` {df.schema[key].dataType.simpleString()}, form string")


def _keys(df: DataFrame, key: str, text: str, least: int) -> DataFrame:
    def run(b: pa.RecordBatch):
        ids, forms, plains = [], [], []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i is None or t is None or len(t) < least:
                continue
            ids.append(i)
            forms.append(xxhash.xxh128_digest(canonical(t)))
            plains.append(xxhash.xxh64_intdigest(plain(t)) - (1 << 63))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(forms, pa.binary()), pa.array(plains, pa.int64())], ["id", "form", "plain"])

    return map_batches(df.select(F.col(key).cast("string"), F.col(text)), run, "id string, form binary, plain long")


def same_looking(df: DataFrame, key: str = "id", text: str = "text", least: int = 20) -> DataFrame:
    """(id_a, id_b): rows of at least so many code points whose texts look the same although their
    characters differ in more than the number of plain blanks. Null keys and texts are no case,
    repeated rows one record, a key is never paired with itself, an empty table gives no rows.

    Hashes of 128 bits of the form and 64 of the text are all that is kept of a row. A form that is written in one
    way only (however many rows have it) is left out by a map-side aggregated minimum and maximum. Ways of
    writing a form meet, not its rows; rows are joined to the pairs of ways last, so copies of one way never
    meet each other."""
    rows = materialize(_keys(df, key, text, least), "forms")
    two = rows.groupBy("form").agg(F.min("plain").alias("lo"), F.max("plain").alias("hi")).where("lo <> hi").select("form")
    near = materialize(rows.join(two, "form", "left_semi").distinct(), "near")
    ways = near.select("form", "plain").distinct()
    pairs = ways.withColumnRenamed("plain", "pa").join(ways.withColumnRenamed("plain", "pb"), "form").where("pa < pb")
    a, b = near.select("form", F.col("plain").alias("pa"), F.col("id").alias("x")), near.select("form", F.col("plain").alias("pb"), F.col("id").alias("y"))
    found = pairs.join(a, ["form", "pa"]).join(b, ["form", "pb"]).where("x <> y")
    return found.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()
