"""Deterministic selection: documents for splits, eligible pages, prefixes, sampling weights and draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bohagi.functions.text import document_split, stable_order


def select_documents(titles: DataFrame, title: str, counts: dict[str, int], seed: int = 1337) -> DataFrame:
    """(split, title): of each split the first so many distinct titles by hash, then title. Only the first
    rows of each partition are shuffled (window group limit)."""
    t = titles.where(F.col(title).isNotNull()).select(F.col(title).alias("title")).distinct().withColumn("split", document_split(F.col("title"), seed)).where(F.col("split").isin(*counts))
    want = F.create_map(*[F.lit(x) for kv in counts.items() for x in kv])
    most = max(counts.values(), default=0)
    w = Window.partitionBy("split").orderBy(stable_order(F.col("title"), seed), "title")
    return t.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).where(F.col("n") <= F.element_at(want, F.col("split"))).select("split", "title")


def require_counts(selected: DataFrame, counts: dict[str, int]) -> None:
    """An error that names the splits that are short. The result has one row a split."""
    have = {r["split"]: r["n"] for r in selected.groupBy("split").agg(F.count("*").alias("n")).collect()}
    short = {s: n - have.get(s, 0) for s, n in counts.items() if have.get(s, 0) < n}
    if short:
        raise ValueError(f"not enough documents for the splits: {short}")


def candidate_budget(k: int) -> int:
    """How many documents are looked at to find k good ones."""
    return min(max(12 * k, k + 8), 200)


def first_eligible(pages: DataFrame, document: str, page: str, eligible: str, k: int, seed: int = 1337) -> DataFrame:
    """The pages of each document by hash up to the k-th eligible one, with their rank; what comes later was
    never looked at and counts for nothing."""
    w = Window.partitionBy(document).orderBy(stable_order(F.col(page), seed), page)
    before = F.coalesce(F.sum(F.col(eligible).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.withColumn("rank", F.row_number().over(w)).withColumn("_before", before).where(F.col("_before") < k).drop("_before")


def accepted_documents(docs: DataFrame, split: str, order: list, accepted: str, k: int) -> DataFrame:
    """Documents of each split in order, with at least one accepted line, up to k."""
    w = Window.partitionBy(split).orderBy(*order)
    return docs.where(F.col(accepted) > 0).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def split_prefix(df: DataFrame, split: str, order: list, n: int) -> DataFrame:
    """The first n rows of each split by order (a sampling operator)."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(split).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def sampling_weights(df: DataFrame, text: str, source: str, mass: dict[str, float], hard: str, boost: float) -> DataFrame:
    """weight of each row: its source's mass in proportion to boost (texts with a hard character) or 1; null where the
    source has no mass. The sums of the sources that have one, as many rows at most as mass has entries, are broadcast; no
    window over a source. Rows without a source are left out."""
    if boost < 1:
        raise ValueError("boost must be at least 1")
    if any(not 0 <= m <= 1 for m in mass.values()):
        raise ValueError("a mass must be between 0 and 1")
    factor = F.when(F.regexp_like(F.col(text), F.lit("[" + "".join(f"\\x{{{ord(c):x}}}" for c in hard) + "]")), boost).otherwise(1.0) if hard else F.lit(1.0)
    d = df.withColumn("_f", F.coalesce(factor, F.lit(1.0)))
    total = d.where(F.col(source).isin(list(mass))).groupBy(source).agg(F.sum("_f").alias("_total"))
    m = F.element_at(F.create_map(*[F.lit(x) for kv in mass.items() for x in (kv[0], float(kv[1]))]), F.col(source))
    return d.where(F.col(source).isNotNull()).join(F.broadcast(total), source, "left").withColumn("weight", m * F.col("_f") / F.greatest(F.lit(1.0), F.col("_total"))).drop("_f", "_total")


def draw(df: DataFrame, weight: str, n: int, order: list[str], seed: int = 0) -> DataFrame:
    """copies of each row in a draw of n with replacement, by one seeded offset on the cumulative weights
    (systematic resampling): row order and seed decide it. Sums before a task are added to sums within it."""
    from bohagi.session import materialize

    spark = df.sparkSession
    rows = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_task", F.shiftright("_at", 33)), "draw")
    sums = rows.groupBy("_task").agg(F.sum(weight).alias("s")).orderBy("_task").collect()
    total, before = sum(r["s"] or 0.0 for r in sums), []
    run = 0.0
    for r in sums:
        before.append((r["_task"], run))
        run += r["s"] or 0.0
    if not before or not total:
        return df.withColumn("copies", F.lit(0))
    import hashlib

    offset = int(hashlib.sha256(str(seed).encode()).hexdigest()[:13], 16) / 16**13
    w = Window.partitionBy("_task").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    d = rows.join(F.broadcast(spark.createDataFrame(before, "_task long, _before double")), "_task").withColumn("_end", (F.col("_before") + F.sum(weight).over(w)) * (n / total))
    start = F.col("_end") - F.col(weight) * (n / total)
    return d.withColumn("copies", (F.floor(F.col("_end") + offset) - F.floor(start + offset)).cast("int")).drop("_at", "_task", "_before", "_end")
