"""Recognition metrics: sums first, ratios last, so that partial results merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bohagi.functions.align import aligned_counts
from bohagi.functions.text import WS, occurrences, word_distance

COUNTS = ("samples", "char_errors", "characters", "word_errors", "words", "exact")


def pair_counts(df: DataFrame, reference: str, hypothesis: str, keep: list[str] | None = None) -> DataFrame:
    """The six counts of each pair. Null texts count as empty."""
    r, h = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(hypothesis), F.lit(""))
    rw, hw = (F.filter(F.split(x, WS + "+"), lambda w: w != "") for x in (r, h))
    return df.select(
        *(keep or []), F.lit(1).alias("samples"), F.when(r == h, 0).otherwise(F.levenshtein(r, h)).alias("char_errors"), F.length(r).alias("characters"),
        F.when(r == h, 0).otherwise(word_distance(rw, hw)).alias("word_errors"), F.size(rw).alias("words"), (r == h).cast("int").alias("exact"))


def merge(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the counts."""
    return counts.groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS])


def _ratio(a: str, b: str) -> Column:
    return F.round(F.col(a) / F.greatest(F.lit(1), F.col(b)), 6)


def rates(sums: DataFrame) -> DataFrame:
    """cer, wer and sequence_accuracy of merged counts."""
    return sums.withColumn("cer", _ratio("char_errors", "characters")).withColumn("wer", _ratio("word_errors", "words")).withColumn("sequence_accuracy", _ratio("exact", "samples"))


def ocr_metrics(df: DataFrame, reference: str, hypothesis: str, by: list[str]) -> DataFrame:
    return rates(merge(pair_counts(df, reference, hypothesis, by), by))


def character_recall(df: DataFrame, reference: str, hypothesis: str, chars: tuple[str, ...], by: list[str]) -> DataFrame:
    """(by, char, reference_count, matched, recall) from the alignment of each pair."""
    r, h = F.coalesce(F.col(reference), F.lit("")), F.coalesce(F.col(hypothesis), F.lit(""))
    pairs = df.select(*by, F.array(*[occurrences(r, c) for c in chars]).alias("_n"), aligned_counts(r, h, chars).alias("_m"))
    rows = pairs.select(*by, F.explode(F.arrays_zip(F.array(*[F.lit(c) for c in chars]).alias("char"), F.col("_n").alias("n"), F.col("_m").alias("m"))).alias("x"))
    s = rows.groupBy(*by, "x.char").agg(F.sum("x.n").cast("long").alias("reference_count"), F.sum("x.m").cast("long").alias("matched"))
    return s.withColumn("recall", _ratio("matched", "reference_count"))


def detection_rates(df: DataFrame) -> DataFrame:
    """precision, recall and f1 of true_positive, false_positive, false_negative."""
    p = F.col("true_positive") / F.greatest(F.lit(1), F.col("true_positive") + F.col("false_positive"))
    r = F.col("true_positive") / F.greatest(F.lit(1), F.col("true_positive") + F.col("false_negative"))
    return df.withColumn("precision", F.round(p, 6)).withColumn("recall", F.round(r, 6)).withColumn("f1", F.round(2 * p * r / F.greatest(F.lit(1e-9), p + r), 6))
