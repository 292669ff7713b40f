"""Problem 9: items in containers of fixed capacity by pattern packing.

Lengths are counted in BINS units of capacity / BINS, rounded up. Patterns are all multisets of few
units that fill a container exactly. Non-negative least squares fits how often each pattern is to be
used to the histogram of units; the counts are rounded down and lowered where a unit would run out.
An item's place among the items of its unit names its pattern, copy and slot, so items are assigned
by a join with a table of a few hundred rows. What no pattern takes, and items shorter than SMALL
units, then go best-fit, longest first, into the room that rounding left and into new containers,
block by block (a block has a bounded number of items).
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.encoding import count_ids
from bohagi.session import materialize

#: Units of a container, most items of a pattern, shortest item (in units) that patterns take, and how
#: many items and containers one block of the second stage has.
BINS, DEPTH, SMALL, BLOCK = 128, 5, 4, 50_000


@lru_cache(maxsize=4)
def patterns(bins: int, depth: int, least: int) -> tuple[tuple[int, ...], ...]:
    """All multisets of at most depth numbers >= least that sum to bins, in descending order."""
    out: list[tuple[int, ...]] = []

    def grow(left: int, most: int, have: tuple[int, ...]) -> None:
        if not left:
            out.append(have)
        elif len(have) < depth:
            for x in range(min(left, most), least - 1, -1):
                if x * (depth - len(have)) < left:
                    break
                grow(left - x, x, (*have, x))

    grow(bins, bins, ())
    return tuple(out)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active-set method."""
    x, passive = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tol = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(rounds):
        w = a.T @ (b - a @ x)
        w[passive] = -np.inf
        j = int(np.argmax(w))
        if w[j] <= tol:
            break
        passive[j] = True
        while True:
            p = np.flatnonzero(passive)
            z = np.linalg.lstsq(a[:, p], b, rcond=None)[0]
            if (z > 0).all():
                x[:] = 0
                x[p] = z
                break
            bad = z <= 0
            step = np.min(x[p][bad] / np.maximum(x[p][bad] - z[bad], 1e-300))
            x[p] += step * (z - x[p])
            passive[p[x[p] <= 1e-12]] = False
            x[~passive] = 0
            if not passive.any():
                break
    return x


def plan(histogram: dict[int, int], bins: int = BINS, depth: int = DEPTH, least: int = SMALL) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, copies) such that no unit is used more often than the histogram has it."""
    ps = patterns(bins, depth, least)
    b = np.zeros(bins + 1)
    for u, n in histogram.items():
        b[u] = n
    a = np.zeros((bins + 1, len(ps)), np.float32)
    for j, p in enumerate(ps):
        for u in p:
            a[u, j] += 1
    n = np.floor(nnls(a, b) + 1e-6).astype(np.int64)
    used = a @ n
    for u in np.argsort(b - used):
        while used[u] > b[u]:
            j = max((j for j in np.flatnonzero(n) if a[u, j]), key=lambda j: n[j])
            k = max(1, min(int(n[j]), int(-(-(used[u] - b[u]) // a[u, j]))))
            n[j] -= k
            used -= k * a[:, j]
    left = b - used
    for j in sorted(np.flatnonzero(n), key=lambda j: -n[j]):  # what rounding down left over
        k = int(min(left[u] // a[u, j] for u in set(ps[j])))
        if k > 0:
            n[j] += k
            left -= k * a[:, j]
    return [(ps[j], int(n[j])) for j in np.flatnonzero(n)]


def _fill(block: pa.Table, capacity: int) -> pa.Table:
    """Best fit, longest item first, into the rooms of a block and into new containers."""
    rooms = sorted((r, c) for r, c in zip(block["room"].to_pylist(), block["container"].to_pylist()) if r > 0)
    items = block.filter(pc.equal(block["room"], 0))
    items = items.take(pc.sort_indices(items, [("length", "descending"), ("doc_id", "ascending"), ("part", "ascending"), ("start", "ascending")]))
    out, fresh, number = [], 0, block["block"][0].as_py()
    for n in items["length"].to_pylist():
        i = bisect_left(rooms, (n, -1 << 62))
        if i < len(rooms):
            room, c = rooms.pop(i)
        else:
            room, c = capacity, -(1 + number * (1 << 32) + fresh)
            fresh += 1
        out.append(c)
        if room > n:
            insort(rooms, (room - n, c))
    return items.select(["doc_id", "part", "start", "length"]).append_column("container", pa.array(out, pa.int64()))


def pack(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_ids") -> DataFrame:
    """(doc_id, part, start, length, container): where every item lies. An item longer than the capacity
    is cut in parts of the capacity and a rest; no other is cut. Items of no length (null, empty) have one
    row without a container. No container holds more than the capacity. Container numbers are distinct,
    not successive; those of the second stage are negative. Repeated keys are items of their own; null
    keys stay null; an empty table gives no rows."""
    spark = sizes.sparkSession
    s = sizes.select(F.col(key).alias("doc_id"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n"))
    parts = s.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}")))))
    start = F.col("part") * capacity
    items = parts.select("doc_id", F.col("part").cast("int").alias("part"), start.alias("start"), F.least(F.col("n") - start, F.lit(capacity).cast("long")).alias("length"))
    unit = F.ceil(F.col("length") * BINS / capacity).cast("int")
    items = items.withColumn("unit", unit)
    # sorted by unit and length over the tasks: the place in the unit is the place in the task plus what lies before
    placed = materialize(items.repartitionByRange("unit", "length", "doc_id", "part").sortWithinPartitions("unit", "length", "doc_id", "part").withColumn("at", F.monotonically_increasing_id()), "items")
    task = F.shiftright("at", 33)
    runs = placed.groupBy(task.alias("task"), "unit").agg(F.count("*").alias("n"), F.min("at").alias("first")).orderBy("unit", "task").collect()
    histogram: dict[int, int] = {}
    firsts = []
    for r in runs:
        firsts.append((r["task"], r["unit"], r["first"], histogram.get(r["unit"], 0)))
        histogram[r["unit"]] = histogram.get(r["unit"], 0) + r["n"]
    total = sum(histogram.values())
    chosen = plan({u: n for u, n in histogram.items() if u >= SMALL})
    slots, at, base = [], dict.fromkeys(histogram, 0), 0
    for p, n in chosen:
        for k, u in enumerate(p):
            slots.append((u, at[u], at[u] + n, base, k % 2))
            at[u] += n
        base += n
    lo = spark.createDataFrame(slots, "unit int, lo long, hi long, base long, back int")
    starts = spark.createDataFrame(firsts, "task long, unit int, first long, before long")
    ranked = placed.withColumn("task", task).join(F.broadcast(starts), ["task", "unit"]).withColumn("rank", F.col("at") - F.col("first") + F.col("before")).drop("at", "first", "before", "task")
    met = ranked.join(F.broadcast(lo.withColumnRenamed("unit", "u")), (F.col("unit") == F.col("u")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")), "left")
    spot = F.when(F.col("back") == 1, F.col("hi") - 1 - F.col("rank")).otherwise(F.col("rank") - F.col("lo"))  # long with short
    first = materialize(met.select("doc_id", "part", "start", "length", (F.col("base") + spot).alias("container")), "first")
    fitted = first.where("container is not null")
    rooms = fitted.groupBy("container").agg((F.lit(capacity) - F.sum("length")).alias("room")).where("room > 0")
    blocks = max(1, -(-total // BLOCK))
    null = F.lit(None)
    rest = first.where("container is null and length > 0").select("doc_id", "part", "start", "length", F.lit(0).cast("long").alias("room"), null.cast("long").alias("container"), F.pmod(F.xxhash64("doc_id", "part"), F.lit(blocks)).alias("block"))
    free = rooms.select(null.cast(first.schema["doc_id"].dataType).alias("doc_id"), null.cast("int").alias("part"), null.cast("long").alias("start"), null.cast("long").alias("length"), "room", "container", F.pmod(F.xxhash64("container"), F.lit(blocks)).alias("block"))
    kind = first.schema["doc_id"].dataType.simpleString()
    second = rest.unionByName(free).groupBy("block").applyInArrow(lambda t: _fill(t, capacity), f"doc_id {kind}, part int, start long, length long, container long")
    nothing = first.where("length = 0 and container is null")
    return fitted.unionByName(second).unionByName(nothing)


def pack_documents(docs: DataFrame, capacity: int = 8192, tokenizer: str = "byte_bpe_50k", folder: str | None = None) -> DataFrame:
    """pack() of the documents by their number of ids."""
    return pack(materialize(count_ids(docs, tokenizer=tokenizer, folder=folder), "sizes"), capacity)
