"""Character vocabularies: build, check, encode, decode."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bohagi.functions.text import REPERTOIRE, characters, normalize_label, outside


def distinct_characters(df: DataFrame, text: str = "text") -> DataFrame:
    """(char) of the normalised texts; distinct in each task before anything is shuffled."""
    return df.select(F.explode(F.array_distinct(characters(normalize_label(F.col(text))))).alias("char")).distinct()


def build_vocabulary(df: DataFrame, text: str = "text", required: str = REPERTOIRE) -> DataFrame:
    """(char, id): the characters of the texts and the required ones, numbered from 1 by code point; 0 is the
    blank. One row for each character, so the numbering window is bounded by the script, not by the data."""
    from pyspark.sql.window import Window

    spark = df.sparkSession
    must = spark.createDataFrame([(c,) for c in dict.fromkeys(required)], "char string")
    every = distinct_characters(df, text).unionByName(must).distinct()
    return every.select("char", F.row_number().over(Window.orderBy("char")).alias("id"))


def checksum(vocab: DataFrame) -> DataFrame:
    """(size, sha256): size with the blank, digest of the characters in order, a line each."""
    return vocab.agg((F.count("*") + 1).alias("size"), F.sha2(F.array_join(F.array_sort(F.collect_list("char")), "\n"), 256).alias("sha256"))


@dataclass(frozen=True)
class Vocabulary:
    """A collected vocabulary (at most some hundred characters), as literals for expressions."""

    characters: tuple[str, ...]

    @classmethod
    def of(cls, vocab: DataFrame) -> Vocabulary:
        return cls(tuple(r["char"] for r in vocab.orderBy("char").collect()))

    @property
    def size(self) -> int:
        return len(self.characters) + 1

    @property
    def sha256(self) -> str:
        import hashlib

        return hashlib.sha256("\n".join(self.characters).encode()).hexdigest()

    def array(self) -> Column:
        return F.array(*[F.lit(c) for c in self.characters])

    def _ids(self) -> Column:
        return F.create_map(*[F.lit(x) for k, c in enumerate(self.characters) for x in (c, k + 1)])

    def missing(self, text: Column) -> Column:
        """Characters of a text that have no id."""
        return outside(text, self.array())

    def covers(self, text: Column) -> Column:
        return F.size(self.missing(text)) == 0

    def encode(self, text: Column, strict: bool = False) -> Column:
        """Ids of a text; null where a character has none, or an error that names them if strict."""
        ids = self._ids()
        coded = F.transform(characters(text), lambda c: F.element_at(ids, c))
        if strict:
            names = F.array_join(F.transform(self.missing(text), lambda c: F.concat(c, F.lit(" U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"))), ", ")
            return F.when(self.covers(text), coded).otherwise(F.raise_error(F.concat(F.lit("not in the vocabulary: "), names)).cast("array<int>"))
        return F.when(self.covers(text), coded)

    def decode_ctc(self, ids: Column) -> Column:
        """Text of best-path ids: repeats and blanks dropped, unknown ids nothing."""
        kept = F.filter(ids, lambda x, i: (x != 0) & ((i == 0) | (x != F.get(ids, i - 1))))
        chars = self.array()
        return F.array_join(F.transform(kept, lambda x: F.when((x > 0) & (x <= len(self.characters)), F.get(chars, x - 1)).otherwise("")), "")

    def to_json(self, language: str = "as") -> str:
        """The vocabulary file: its keys and their order are the format's."""
        fields = {"format_version": 1, "blank_id": 0, "normalization": "NFC", "language": language, "characters": list(self.characters), "sha256": self.sha256}
        return json.dumps(fields, ensure_ascii=False, indent=2) + "\n"

    @classmethod
    def from_json(cls, text: str) -> Vocabulary:
        """A missing blank counts as 0 and a missing or empty checksum as right."""
        d = json.loads(text)
        v = cls(tuple(d["characters"]))
        if d.get("blank_id", 0) != 0 or (d.get("sha256") or v.sha256) != v.sha256:
            raise ValueError("vocabulary file is damaged: blank or checksum differs")
        return v


def emit_confidence(probabilities: Column, ids: Column) -> Column:
    """Mean probability at the steps that CTC decoding keeps; 0 where it keeps none."""
    kept = F.filter(F.transform(ids, lambda x, i: F.when((x != 0) & ((i == 0) | (x != F.get(ids, i - 1))), F.get(probabilities, i))), lambda p: p.isNotNull())
    return F.when(F.size(kept) == 0, 0.0).otherwise(F.aggregate(kept, F.lit(0.0), lambda s, p: s + p) / F.size(kept))
