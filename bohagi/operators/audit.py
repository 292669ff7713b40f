"""Audits of texts, widths, pages and releases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bohagi.functions.geometry import resized_width
from bohagi.functions.text import ASSAMESE, Script, characters, label_reason, normalize_label
from bohagi.session import materialize


def audit_texts(df: DataFrame, text: str, by: list[str], script: Script = ASSAMESE) -> DataFrame:
    """samples, empty, invalid, with_ra, with_wa by group. Null texts count as samples that are empty and invalid."""
    t = F.coalesce(normalize_label(F.col(text)), F.lit(""))
    d = df.select(*by, t.alias("t"))
    return d.groupBy(*by).agg(
        F.count("*").alias("samples"), F.count_if(F.col("t") == "").alias("empty"), F.count_if(label_reason(F.col("t"), script) != "ok").alias("invalid"),
        F.count_if(F.contains("t", F.lit(script.distinctive[0]))).alias("with_ra"), F.count_if(F.contains("t", F.lit(script.distinctive[1]))).alias("with_wa"))


def character_histogram(df: DataFrame, text: str) -> DataFrame:
    """(char, n) over the normalised texts; counted in each task first."""
    return df.select(F.explode(characters(normalize_label(F.col(text)))).alias("char")).groupBy("char").agg(F.count("*").alias("n"))


def reason_counts(df: DataFrame, text: str, by: list[str], script: Script = ASSAMESE) -> DataFrame:
    """(by, reason, n): why labels are left out; valid ones are not listed."""
    return df.select(*by, label_reason(normalize_label(F.col(text)), script).alias("reason")).where("reason <> 'ok'").groupBy(*by, "reason").agg(F.count("*").alias("n"))


def lower_percentile(values: str, fraction: float) -> Column:
    """The element at int((n - 1) * fraction) of the sorted values, 0 where there are none. For columns of few
    distinct values (widths, lengths): the sorted histogram is walked, never the values."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(values).alias("v"), F.col("n"))))
    total = F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x["n"])
    place = F.floor((total - 1) * fraction).cast("long")
    walk = F.aggregate(pairs, F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("hit")), lambda a, x: F.struct(
        (a["seen"] + x["n"]).alias("seen"), F.when(a["hit"].isNull() & (a["seen"] + x["n"] > place), x["v"].cast("long")).otherwise(a["hit"]).alias("hit")))
    return F.coalesce(walk["hit"], F.lit(0))


def width_audit(df: DataFrame, width: str, height: str, by: list[str], limit: int = 768) -> DataFrame:
    """median, p95, maximum and number over the limit of widths at height 48."""
    h = df.where(F.col(width).isNotNull() & F.col(height).isNotNull()).select(*by, resized_width(F.col(width), F.col(height)).alias("w")).groupBy(*by, "w").agg(F.count("*").alias("n"))
    return h.groupBy(*by).agg(lower_percentile("w", 0.5).alias("median"), lower_percentile("w", 0.95).alias("p95"), F.coalesce(F.max("w"), F.lit(0)).alias("maximum"), F.coalesce(F.sum(F.when(F.col("w") > limit, F.col("n")).otherwise(0)), F.lit(0)).alias("over_limit"))


def sorted_elements(df: DataFrame, value: str, places: Callable[[int], list[int]]) -> list:
    """The elements at given places (from 0) of the sorted non-null values. Values are sorted over the tasks and
    one count a task tells where a place lies; no list of values is gathered."""
    d = df.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    rows = materialize(d.repartitionByRange("v").sortWithinPartitions("v").withColumn("at", F.monotonically_increasing_id()), "sorted")
    counts = [(r["task"], r["n"]) for r in rows.groupBy(F.shiftright("at", 33).alias("task")).agg(F.count("*").alias("n")).orderBy("task").collect()]
    wanted = places(sum(n for _, n in counts))
    ids = []
    for p in wanted:
        for task, n in counts:
            if p < n:
                ids.append((task << 33) + p)
                break
            p -= n
    got = {r["at"]: r["v"] for r in rows.where(F.col("at").isin(ids)).collect()}
    return [got[i] for i in ids]


def latency_summary(df: DataFrame, value: str) -> DataFrame:
    """(median, p95): p95 is the element at int(n * 0.95), the median the mean of the middle two; null where
    there are no values."""
    v = sorted_elements(df, value, lambda n: [(n - 1) // 2, n // 2, min(n - 1, int(n * 0.95))] if n else [])
    return df.sparkSession.createDataFrame([((v[0] + v[1]) / 2, float(v[2])) if v else (None, None)], "median double, p95 double")


def page_audit(detected: DataFrame, accepted: DataFrame) -> DataFrame:
    """(document, page, detected_lines, accepted_lines): distinct lines of each page that were found and kept."""
    d = detected.groupBy(F.col("source_document").alias("document"), F.col("source_page").alias("page")).agg(F.count_distinct("line_index").alias("detected_lines"))
    a = accepted.groupBy(F.col("source_page").alias("page")).agg(F.count_distinct("line_index").alias("accepted_lines"))
    return d.join(a, "page", "left").select("document", "page", "detected_lines", F.coalesce("accepted_lines", F.lit(0)).alias("accepted_lines"))


def release_gates(values: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """(gate, value, limit, passed) of a one-row table: limits maps a column to at_most or at_least and a number."""
    rows = [F.struct(F.lit(k).alias("gate"), F.col(k).cast("double").alias("value"), F.lit(float(x)).alias("limit"), (F.col(k) <= x if how == "at_most" else F.col(k) >= x).alias("passed")) for k, (how, x) in limits.items()]
    return values.select(F.explode(F.array(*rows)).alias("g")).select("g.*")


def released(gates: DataFrame) -> DataFrame:
    return gates.agg(F.bool_and("passed").alias("passed"))
