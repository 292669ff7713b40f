"""Corpus lines for rendering: vocabulary and width filters with their counters, ids, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bohagi.functions.text import ctc_steps, normalize_label, outside


def fit_reason(text: Column, allowed: Column, most_width: int = 768, stride: int = 4) -> Column:
    """outside_vocabulary, too_many_steps or ok. Steps are looked at only where the vocabulary covers the text."""
    return F.when(F.size(outside(text, allowed)) > 0, "outside_vocabulary").when(ctc_steps(text) * stride > most_width, "too_many_steps").otherwise("ok")


def renderable(lines: DataFrame, allowed: Column, most_width: int = 768, stride: int = 4) -> DataFrame:
    """Training lines in normal form with their reason. Null texts are left out."""
    d = lines.where("split = 'train'").withColumn("text", normalize_label(F.col("text"))).where("text is not null")
    return d.withColumn("reason", fit_reason(F.col("text"), allowed, most_width, stride))


def fit_counts(rows: DataFrame) -> DataFrame:
    """(kept, outside_vocabulary, too_many_steps) in one pass."""
    return rows.agg(*[F.count_if(F.col("reason") == r).alias(n) for r, n in (("ok", "kept"), ("outside_vocabulary", "outside_vocabulary"), ("too_many_steps", "too_many_steps"))])


def synthetic_id(index: Column) -> Column:
    return F.format_string("synthetic:%09d", index)


def image_digest(width: Column, height: Column, gray: Column) -> Column:
    """Digest of a gray image with its size before its bytes."""
    return F.sha2(F.concat(F.encode(F.concat(width.cast("string"), F.lit("x"), height.cast("string"), F.lit(":L")), "UTF-8"), gray), 256)


def silver_id(*parts: Column) -> Column:
    """Id of a line by its title, box and text."""
    return F.concat(F.lit("wikisource:"), F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 24))
