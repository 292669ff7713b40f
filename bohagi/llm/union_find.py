"""Connected components by distributed union-find.

Level 0: each task joins its own edges in a local forest, so what leaves it is at most one link for
each node it saw. The forests are merged hierarchically, a few at a time, as long as a merged one has
at most BLOCK links. Where even so more than one forest is left, the rest is done by rounds of star
contraction (every node links to the least label around it, by map-side aggregated minima), which
hold no forest in one task. Both ways give the same labels: the least node of the component.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.session import materialize

#: Links one task may hold as a forest.
BLOCK = 2_000_000
#: Forests merged at once.
FAN_IN = 8


def _forest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        r = x
        while (p := parent.get(r, r)) != r:
            r = p
        while (p := parent.get(x, x)) != r:
            parent[x] = r
            x = p
        return r

    kind = None

    def links() -> pa.RecordBatch:
        nodes = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array([parent[x] for x in nodes], kind), pa.array(nodes, kind)], ["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
        if len(parent) > BLOCK:  # hand the forest on; the next level joins its parts
            yield links()
            parent.clear()
    if kind is not None:
        yield links()


def components(edges: DataFrame, a: str = "a", b: str = "b", block: int = BLOCK) -> DataFrame:
    """(node, root) of every node with an edge to another; root is the least node of its component.
    Edges with a null end relate nothing; loops and repeated edges change nothing; an empty table
    gives no rows. Nodes are compared as their type is (strings by code point)."""
    kind = edges.schema[a].dataType.simpleString()
    schema = f"a {kind}, b {kind}"
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    links = materialize(e.mapInArrow(_forest, schema), "forest")
    parts = max(1, links.rdd.getNumPartitions())
    n = links.count()
    while parts > 1 or n > block:
        parts = max(1, parts // FAN_IN)
        if n > block * parts:
            return _stars(links)
        links = materialize(links.coalesce(parts).mapInArrow(_forest, schema), "forest")
        n = links.count()
    return links.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def _stars(links: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until no link changes."""
    e = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = materialize(e, "stars")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low2 = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low2, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        new = materialize(small, "stars")
        if new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty():
            break
        e = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
