"""Leakage between splits, its removal, and first-wins deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bohagi.functions.text import characters, normalize_label

PAIRS = (("train", "validation"), ("train", "test"), ("validation", "test"))


def leakage(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """(pair, shared): distinct keys that both splits of a pair hold. One aggregation: a key's splits are
    gathered as three flags, so no split is shuffled twice. Null keys and other splits count for none."""
    flags = [F.max(F.when(F.col(split) == s, 1).otherwise(0)).alias(s) for s in ("train", "validation", "test")]
    k = df.where(F.col(key).isNotNull()).groupBy(key).agg(*flags)
    sums = k.agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).cast("long").alias(f"{a}_{b}") for a, b in PAIRS])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(f"{a}_{b}").alias("pair"), F.col(f"{a}_{b}").alias("shared")) for a, b in PAIRS])).alias("x")).select("x.*")


def without_overlap(df: DataFrame, key: str, split: str = "split") -> DataFrame:
    """Rows of validation without keys of train, rows of test without keys of either; the rest as it is.
    Repeats within a split stay. A key goes to the first split that holds it: one aggregate, one join, past which rows
    without a key are led, as they would all meet in one task."""
    rank = F.when(F.col(split) == "train", 0).when(F.col(split) == "validation", 1).when(F.col(split) == "test", 2)
    first = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_k")).agg(F.min(rank).alias("_first"))
    joined = df.where(F.col(key).isNotNull()).join(first, F.col(key) == F.col("_k"), "left")
    kept = joined.where(F.col("_first").isNull() | rank.isNull() | (rank <= F.col("_first"))).drop("_k", "_first")
    return kept.unionByName(df.where(F.col(key).isNull()))


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by order; rows with a null key are all kept."""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = df.where(F.col(key).isNotNull()).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return keyed.unionByName(df.where(F.col(key).isNull()))


def unseen_characters(df: DataFrame, text: str = "text", split: str = "split") -> DataFrame:
    """(split, char): characters of validation and test that train never has."""
    c = df.select(F.col(split).alias("split"), F.explode(F.array_distinct(characters(normalize_label(F.col(text))))).alias("char")).distinct()
    return c.where("split in ('validation', 'test')").join(c.where("split = 'train'").select("char"), "char", "left_anti").select("split", "char")
