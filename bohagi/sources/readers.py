"""Sources, each with a declared schema."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bohagi import schemas


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A corpus in JSON lines."""
    return spark.read.schema(schemas.CORPUS_LINE).json(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents, one JSON object a file, with the file as doc."""
    return spark.read.schema(schemas.DOCUMENT).option("multiLine", True).json(path).withColumn("doc", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))


def read_dataset(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A data set kept by split; a split that isn't there is an error."""
    df = spark.read.parquet(path)
    if split is None:
        return df
    one = df.where(F.col("split") == split)
    if one.isEmpty():
        raise KeyError(f"no split {split!r} in {path}")
    return one


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, bytes, sha256, content) of files."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return d.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), "content")


def read_articles(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Articles (id, title, text)."""
    return spark.read.schema("id string, title string, text string").format(fmt).load(path)


def read_config(text: str) -> dict:
    """A configuration, which must be a mapping: YAML where a reader is installed, else JSON."""
    try:
        import yaml

        value = yaml.safe_load(text)
    except ImportError:
        value = json.loads(text)
    if not isinstance(value, dict):
        raise ValueError("a configuration must be a mapping")
    return value


def covers_glyphs(manifest: DataFrame, needed: str) -> DataFrame:
    """Fonts (name, codepoints array<int>) with whether they have every needed character."""
    want = F.array(*[F.lit(ord(c)) for c in needed])
    return manifest.withColumn("covers", F.size(F.array_except(want, F.col("codepoints"))) == 0)
