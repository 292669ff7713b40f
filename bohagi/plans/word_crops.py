"""Word crops: normalise, validate, measure leakage, remove it, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.functions.text import ctc_steps, label_reason, normalize_label, split_name
from bohagi.operators.audit import audit_texts, width_audit
from bohagi.operators.cross_split import leakage, unseen_characters, without_overlap
from bohagi.operators.vocabulary import build_vocabulary, checksum


def assert_config(config: str, wanted: str = "assamese") -> None:
    if config != wanted:
        raise ValueError(f"only accepts '{wanted}', not {config!r}")


def normalized(df: DataFrame) -> DataFrame:
    """Labels in normal form with their validity, reason and CTC steps; splits in one spelling."""
    d = df.withColumn("text", F.coalesce(normalize_label(F.col("text")), F.lit(""))).withColumn("split", split_name(F.col("split")))
    return d.withColumn("validation_reason", label_reason(F.col("text"))).withColumn("valid", F.col("validation_reason") == "ok").withColumn("ctc_required_steps", ctc_steps(F.col("text")))


def prepare(df: DataFrame, config: str = "assamese") -> dict[str, DataFrame]:
    """rows, excluded, leakage_before, leakage_after, unseen, vocabulary, checksum, audit and widths of word crops.
    Leakage and unseen characters are measured on valid rows before the cleanup."""
    assert_config(config)
    n = normalized(df)
    valid = n.where("valid")
    by_hash = valid.withColumn("_h", F.lower("image_sha256"))
    clean = without_overlap(by_hash, "_h")
    vocab = build_vocabulary(valid.where("split = 'train'"))
    return {
        "rows": clean.drop("_h"),
        "excluded": n.where("not valid").groupBy("split", F.col("validation_reason").alias("reason")).agg(F.count("*").alias("n")),
        "leakage_before": leakage(by_hash, "_h"),
        "leakage_after": leakage(clean, "_h"),
        "unseen": unseen_characters(valid),
        "vocabulary": vocab,
        "checksum": checksum(vocab),
        "audit": audit_texts(clean, "text", ["split"]),
        "widths": width_audit(clean, "image_width", "image_height", ["split"]),
    }
