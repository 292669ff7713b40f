"""Problem 5: splits that keep related records together.

Records are related if they share a source id or a normalised title, directly or through a chain.
Groups come from distributed union-find over distinct (source, title) links. They are assigned
largest first to the split furthest below its target. Groups of one size are interchangeable, so the
greedy choice is made on the histogram of sizes (at most sqrt(2 n) entries for n records) and handed
out by a group's place within its size, without a sort in one task.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.union_find import components
from bohagi.llm.words import map_batches, normal
from bohagi.session import materialize

TARGETS = {"train": 0.9, "validation": 0.05, "test": 0.05}


def _facts(df: DataFrame, id_col: str, title: str, split: str) -> DataFrame:
    """(source_id, title, split, records) for each distinct combination, titles in normal form."""
    d = df.groupBy(F.split_part(F.col(id_col), F.lit(":"), F.lit(2)).alias("source_id"), F.col(title).alias("title"), F.nullif(F.lower(F.trim(F.col(split))), F.lit("")).alias("split")).agg(F.count_distinct(id_col).alias("records"))

    def run(b: pa.RecordBatch):
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if t is None else normal(t) or None for t in b.column(1).to_pylist()], pa.string()), b.column(2), b.column(3)], ["source_id", "title", "split", "records"])

    return map_batches(d.where("source_id is not null and source_id <> ''"), run, "source_id string, title string, split string, records long")


def related_groups(df: DataFrame, id_col: str = "id", title: str = "source_title", split: str = "split") -> tuple[DataFrame, DataFrame]:
    """(facts, groups): facts as above; groups holds (source_id, grp) for each source id, grp being the
    least source id related to it. Titles that are null or blank relate nothing."""
    facts = materialize(_facts(df, id_col, title, split), "facts")
    links = facts.where("title is not null").groupBy("title").agg(F.min("source_id").alias("a"))
    edges = facts.join(links, "title").select("a", F.col("source_id").alias("b")).distinct()
    c = components(edges)
    groups = facts.select("source_id").distinct().join(c.withColumnRenamed("node", "source_id"), "source_id", "left").select("source_id", F.coalesce("root", "source_id").alias("grp"))
    return facts, groups


def torn_sources(df: DataFrame, id_col: str = "id", title: str = "source_title", split: str = "split") -> DataFrame:
    """(source_id): every source whose related records lie in more than one split. Case and outer
    blanks of splits don't count; null and blank splits count for none. Rows without a source id
    (null ids) are no record; repeated rows change nothing; an empty table gives no rows."""
    facts, groups = related_groups(df, id_col, title, split)
    seen = facts.where("split is not null").select("source_id", "split").distinct().join(groups, "source_id")
    torn = seen.groupBy("grp").agg(F.min("split").alias("lo"), F.max("split").alias("hi")).where("lo <> hi").select("grp")
    return groups.join(torn, "grp", "left_semi").select("source_id")


def plan_sizes(sizes: list[tuple[int, int]], targets: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """size -> [(split, how many groups of that size)], largest size first, each group to the split
    furthest below its target in records (ties: the split named first). Long runs of one size are
    handed out in steps that keep the greedy order."""
    total = sum(s * c for s, c in sizes)
    names = list(targets)
    whole = sum(targets.values())
    heap = [(-total * targets[n] / whole, k) for k, n in enumerate(names)]
    heapq.heapify(heap)
    out: dict[int, list[tuple[str, int]]] = {}
    for s, c in sorted(sizes, reverse=True):
        given: dict[int, int] = {}
        while c:
            need, k = heap[0]
            second = min((x for x in heap if x[1] != k), default=(float("inf"), 0))[0] if len(heap) > 1 else float("inf")
            n = c if len(heap) == 1 else max(1, min(c, int((second - need) // s)))
            heapq.heapreplace(heap, (need + n * s, k))
            given[k] = given.get(k, 0) + n
            c -= n
            if c > 10_000 and max(x[0] for x in heap) - min(x[0] for x in heap) <= s:
                each = c // len(heap)  # level now: the same number for each split in turn
                heap = [(x + each * s, j) for x, j in heap]
                heapq.heapify(heap)
                for _, j in heap:
                    given[j] = given.get(j, 0) + each
                c -= each * len(heap)
        out[s] = [(names[k], n) for k, n in sorted(given.items())]
    return out


def grouped_splits(df: DataFrame, targets: dict[str, float] | None = None, id_col: str = "id", title: str = "source_title", split: str = "split") -> DataFrame:
    """(source_id, grp, records, split): the split that each source's records go to. All related
    sources get the same one; proportions of records follow targets as closely as groups allow.
    Null ids are left out; an empty table gives no rows."""
    facts, groups = related_groups(df, id_col, title, split)
    per_source = facts.groupBy("source_id").agg(F.sum("records").alias("records")).join(groups, "source_id")
    sized = per_source.groupBy("grp").agg(F.sum("records").alias("size"))
    # sorted by size over the tasks; a group's place in its size is its place in the task plus what lies before
    placed = materialize(sized.repartitionByRange(F.col("size").desc(), F.col("grp")).sortWithinPartitions(F.col("size").desc(), F.col("grp")).withColumn("at", F.monotonically_increasing_id()), "sized")
    part = F.shiftright("at", 33)
    runs = placed.groupBy(part.alias("part"), "size").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("size", "part").collect()
    hist: dict[int, int] = {}
    rows = []
    for r in runs:
        rows.append((r["part"], r["size"], r["first"], hist.get(r["size"], 0)))
        hist[r["size"]] = hist.get(r["size"], 0) + r["n"]
    plan = plan_sizes(list(hist.items()), targets or TARGETS)
    spans = []
    for s, parts in plan.items():
        lo = 0
        for name, n in parts:
            spans.append((s, lo, lo + n, name))
            lo += n
    spark = df.sparkSession
    starts = spark.createDataFrame(rows, "part long, size long, first long, before long")
    ranges = spark.createDataFrame(spans, "size long, lo long, hi long, split string")
    ranked = placed.withColumn("part", part).join(starts, ["part", "size"]).select("grp", "size", (F.col("at") - F.col("first") + F.col("before")).alias("rank"))
    chosen = ranked.join(ranges, "size").where("rank >= lo and rank < hi").select("grp", "split")
    return per_source.join(chosen, "grp").select("source_id", "grp", "records", "split")
