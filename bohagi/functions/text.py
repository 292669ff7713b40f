"""Text functions: Column in, Column out. All are JVM expressions but for nfc, an Arrow batch function."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What Python counts as white space, as a class that Java and RE2 read alike.
WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


@dataclass(frozen=True)
class Script:
    """The script a corpus is in: its block, the letters that tell it from its neighbours and thresholds."""

    block: str = r"\x{0980}-\x{09FF}"
    distinctive: tuple[str, ...] = ("ৰ", "ৱ")
    label_ratio: float = 0.6
    line_ratio: float = 0.75


ASSAMESE = Script()
#: The characters every vocabulary has.
REPERTOIRE = (
    " !\"'()*+,-./:;?%&0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz।॥ঁংঃঅআইঈউঊঋএঐওঔকখগঘঙচছজঝঞটঠডঢণতথদধনপফবভমযরলশষসহ়ািীুূৃেৈোৌ্ৎড়ঢ়য়০১২৩৪৫৬৭৮৯ৰৱ৷‌‍–—…‘’“”"
)


@F.arrow_udf(T.StringType())
def _nfc(texts: pa.Array) -> pa.Array:
    # Arrow's own kernel leaves some sequences apart that compose (u and U+0308), so it can't take this over
    return pa.array([None if t is None else unicodedata.normalize("NFC", t) for t in texts.to_pylist()], pa.string())


def nfc(c: Column) -> Column:
    """Canonical composition. Null stays null."""
    return _nfc(c)


def collapse(c: Column) -> Column:
    """Runs of white space as one blank, ends stripped."""
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def normalize_label(c: Column) -> Column:
    """NFC, white space collapsed. Null stays null (the audit counts it), blank texts become empty."""
    return collapse(nfc(c))


def in_block(c: Column, script: Script = ASSAMESE) -> Column:
    """Whether it is one character of the script's block."""
    return F.regexp_like(c, F.lit(f"^[{script.block}]$"))


def has_control(c: Column) -> Column:
    """Whether it has a character of category C other than the two joiners."""
    return F.regexp_like(c, F.lit(r"[\p{C}&&[^\x{200c}\x{200d}]]"))


def script_ratio(c: Column, script: Script = ASSAMESE) -> Column:
    """Share of letters and marks in the block; 1 where there are none."""
    every = F.regexp_count(c, F.lit(r"[\p{L}\p{M}]"))
    own = F.regexp_count(c, F.lit(rf"[\p{{L}}\p{{M}}&&[{script.block}]]"))
    return F.when(every == 0, 1.0).otherwise(own / every)


def label_reason(normalized: Column, script: Script = ASSAMESE, ratio: float | None = None) -> Column:
    """Of a normalised text: empty, control_character, low_assamese_script_ratio or ok; the first that fails."""
    return (
        F.when(normalized.isNull(), None)
        .when(normalized == "", "empty")
        .when(has_control(normalized), "control_character")
        .when(script_ratio(normalized, script) < (script.label_ratio if ratio is None else ratio), "low_assamese_script_ratio")
        .otherwise("ok")
    )


def ctc_steps(normalized: Column) -> Column:
    """Length and one more for each pair of equal neighbours."""
    return F.length(normalized) + F.regexp_count(normalized, F.lit(r"(?s)(.)(?=\1)"))


def hash_bucket(key: Column, digits: int = 8) -> Column:
    """sha256's first hex digits as a number, modulo 100."""
    return (F.conv(F.substring(F.sha2(key, 256), 1, digits), 16, 10).cast("decimal(20,0)") % 100).cast("int")


def stable_split(key: Column) -> Column:
    """90 / 5 / 5 by hash."""
    b = hash_bucket(key)
    return F.when(b < 90, "train").when(b < 95, "validation").otherwise("test")


def document_split(title: Column, seed: int = 1337) -> Column:
    """80 / 10 / 10 by seeded hash."""
    b = hash_bucket(F.concat(F.lit(f"{seed}:"), title), 16)
    return F.when(b < 80, "train").when(b < 90, "validation").otherwise("test")


def stable_order(value: Column, seed: int = 1337) -> Column:
    """Sorts like the seeded 64-bit hash value."""
    return F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), value), 256), 1, 16)


def split_name(c: Column) -> Column:
    """A split without regard to case and outer blanks; null where blank."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def words(c: Column) -> Column:
    """The words of a text, empty ones dropped."""
    return F.filter(F.split(collapse(c), " "), lambda w: w != "")


def characters(c: Column) -> Column:
    """The code points of a text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def outside(c: Column, allowed: Column) -> Column:
    """Distinct characters that are not in the array allowed, sorted by code point."""
    return F.array_sort(F.array_except(F.array_distinct(characters(c)), allowed))


def occurrences(c: Column, part: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    return ((F.length(c) - F.length(F.replace(c, F.lit(part), F.lit("")))) / len(part)).cast("int")


#: Distinct words of a pair that have a code point each below the surrogates.
CODED_WORDS = 50_000


def sequence_distance(a: list[str], b: list[str]) -> int:
    """Edit distance of two lists of any length. What they begin and end with alike is left out; then a row of the
    table at a time, insertions being a running minimum."""
    lo = 0
    while lo < min(len(a), len(b)) and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < min(len(a), len(b)) - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    names: dict[str, int] = {}
    x, y = (np.array([names.setdefault(w, len(names)) for w in ws], np.int64) for ws in (a, b))
    place = np.arange(len(y) + 1)
    row = place.copy()
    for i, w in enumerate(x, 1):
        best = np.concatenate([[i], np.minimum(row[1:] + 1, row[:-1] + (y != w))])
        row = np.minimum.accumulate(best - place) + place
    return int(row[-1])


@F.arrow_udf(T.IntegerType())
def _sequence_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else sequence_distance(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.int32())


def word_distance(a: Column, b: Column) -> Column:
    """Edit distance of two arrays of words: each distinct word becomes one code point of a private order,
    then the JVM's edit distance of strings applies. Pairs of more than CODED_WORDS distinct words go through an Arrow
    batch function with the same result; for all others it gets nulls."""
    both = F.array_distinct(F.concat(a, b))
    large = F.size(both) > CODED_WORDS

    def coded(ws: Column) -> Column:
        return F.array_join(F.transform(ws, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(both, w) + 256), 4, "0")), "UTF-16BE")), "")

    return F.when(large, _sequence_distance(F.when(large, a), F.when(large, b))).otherwise(F.levenshtein(coded(F.when(~large, a)), coded(F.when(~large, b))))


def canonical_url(c: Column) -> Column:
    """// gets a scheme; the query to the end is dropped."""
    return F.regexp_replace(F.when(F.startswith(c, F.lit("//")), F.concat(F.lit("https:"), c)).otherwise(c), r"\?.*$", "")


def usable_license(c: Column) -> Column:
    """Public domain or a Creative Commons name with a blank, or cc0."""
    low = F.lower(c)
    return F.contains(low, F.lit("public domain")) | F.startswith(low, F.lit("cc ")) | (low == "cc0")


def region_id(index: Column, fallback: bool = False) -> Column:
    return F.format_string("region-fallback-%04d" if fallback else "region-%04d", index)


def line_id(page: Column, index: Column) -> Column:
    return F.format_string("p%d-line-%05d", page, index)
