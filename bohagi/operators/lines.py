"""Lines of a corpus: sentences packed greedily to a width."""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.functions.text import ASSAMESE, Script, label_reason, stable_split


_SENTENCE = re.compile(r"(?<=[।!?])\s+")


def packed(text: str, width: int) -> list[tuple[str, bool]]:
    """(line, closed) of a text: its sentences' words joined while they fit. A word that doesn't fit closes a
    line; the rest of a sentence is not closed."""
    out = []
    for sentence in _SENTENCE.split(" ".join(unicodedata.normalize("NFC", text).split())):
        line = ""
        for w in sentence.split(" "):
            if not line:
                line = w
            elif len(line) + 1 + len(w) > width:
                out.append((line, True))
                line = w
            else:
                line += " " + w
        out.append((line, False))
    return out


def extract_lines(df: DataFrame, key: str, text: str, least: int = 8, width: int = 120, script: Script = ASSAMESE) -> DataFrame:
    """(key, line_no, line): the valid lines of each text, in order. A line that a word closed may be longer
    than width if it is one word; the rest of a sentence may not. Null texts give none. Normal form and packing
    are one Arrow pass, validation stays in the JVM. No shuffle."""

    def run(batches):
        for b in batches:
            at, no, lines = [], [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                for k, (line, done) in enumerate(packed(t, width)) if t else ():
                    if len(line) >= least and (done or len(line) <= width):
                        at.append(i)
                        no.append(k)
                        lines.append(line)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(no, pa.int32()), pa.array(lines, pa.string())], ["_key", "line_no", "line"])

    kind = df.schema[key].dataType.simpleString()
    got = df.select(F.col(key), F.col(text)).mapInArrow(run, f"_key {kind}, line_no int, line string")
    return got.where(label_reason(F.col("line"), script, script.line_ratio) == "ok").select(F.col("_key").alias(key), "line_no", "line")


def corpus_lines(articles: DataFrame, cap: int | None = None) -> DataFrame:
    """Corpus records of articles (id, title, text): id, text, split by article, language, title, licence. A cap
    keeps the first so many lines by article (a reported limit of the corpus)."""
    a = articles.withColumn("key", F.coalesce(F.col("id").cast("string"), "title"))
    lines = extract_lines(a, "key", "text").join(a.select("key", "title"), "key")
    out = lines.select(
        F.concat_ws(":", F.lit("wikipedia"), "key", "line_no").alias("id"), F.col("line").alias("text"), stable_split(F.col("key")).alias("split"),
        F.lit("as").alias("source_language"), F.col("title").alias("source_title"), F.lit("CC-BY-SA-3.0/GFDL").alias("license"), "key", "line_no")
    if cap is not None:
        out = out.orderBy("key", "line_no").limit(cap)
    return out.drop("key", "line_no")
