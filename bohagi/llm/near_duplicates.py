"""Problem 2: pairs of documents of which most word runs are shared, and their groups.

1. Every document becomes its set of 64-bit hashes of runs of k words. Rows (hash, document, size)
   are shuffled by hash once; only hashes of two or more documents are kept, with their frequency.
   Hashes that by a sample have more than HOT_ROWS rows keep the sample's estimate as their frequency and
   are spread by document, so none fills one task however large the collection.
2. Documents too few of whose hashes are shared can be in no pair and are gone. Documents of the
   same set are represented by one.
3. Each document goes to the tile of every hash in the rarest-first prefix that a partner must hit,
   and of its size band and the next. In a tile, sizes and bitmap signatures bound the overlap from
   above: |A n B| <= (|A| + |B| - bits(A xor B)) / 2. What passes is a candidate pair, once. A tile of
   more than TILE documents is a grid: one side is dealt to its rows, the other to its columns, and
   each pair of documents meets in one cell.
4. Candidates are decided by exact intersection of the sorted hash arrays.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bohagi.llm.union_find import components
from bohagi.llm.words import HashCache, map_batches, pieces, windows, words
from bohagi.session import materialize

#: Documents looked at to find hashes that very many share, least number of them that must have a hash for the
#: estimate to count, and rows above which a hash is hot. Which are hot changes the order of work only, never
#: the result.
HOT_SAMPLE, HOT_SEEN, HOT_ROWS = 20_000, 5, 100_000
#: Documents of a tile, or of a side of a cell of its grid.
TILE = 20_000
_hashes = HashCache()


def shingles(text: str | None, k: int, least_words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of k words; none for texts of fewer words than asked for."""
    if not text:
        return np.empty(0, np.int64)
    ws = words(text)
    if len(ws) < max(least_words, k):
        return np.empty(0, np.int64)
    return np.unique(windows(_hashes.array(ws), k)).view(np.int64)


def _tokens(df: DataFrame, key: str, text: str, k: int, least: int, hot: dict[int, int]) -> DataFrame:
    """(h, hot, doc, n): hot is how many rows the hash has by the sample, 0 if it is not hot."""
    names = np.array(sorted(hot), np.int64)
    shared = df.sparkSession.sparkContext.broadcast((names, np.array([hot[x] for x in names.tolist()], np.int64)))

    def run(b: pa.RecordBatch):
        names, rows = shared.value
        for p in pieces(b, 512):
            sets = [shingles(t, k, least) for t in p.column(1).to_pylist()]
            n = np.array([len(s) for s in sets], np.int32)
            h = np.concatenate(sets)
            d = np.repeat(p.column(0).to_numpy(zero_copy_only=False), n)
            much = np.zeros(len(h), np.int64)
            if len(names):
                at = np.minimum(np.searchsorted(names, h), len(names) - 1)
                much = np.where(names[at] == h, rows[at], 0)
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(much), pa.array(d.astype(np.int64)), pa.array(np.repeat(n, n))], ["h", "hot", "doc", "n"])

    return map_batches(df, run, "h long, hot long, doc long, n int")


def _hot_hashes(df: DataFrame, text: str, k: int, least: int, rows: int) -> dict[int, int]:
    """hash -> estimated rows, of hashes that more than HOT_ROWS rows have. There are at most as many as the sample has
    runs, divided by HOT_SEEN."""
    scale = max(1.0, rows / HOT_SAMPLE)
    wanted = max(HOT_SEEN, int(HOT_ROWS / scale))
    if wanted > min(rows, 2 * HOT_SAMPLE):
        return {}
    part = df.sample(min(1.0, 1 / scale), seed=7).select(text)

    def run(b: pa.RecordBatch):
        for p in pieces(b, 4_000):
            u, c = np.unique(np.concatenate([shingles(t, k, least) for t in p.column(0).to_pylist()]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(u[c > 1]), pa.array(c[c > 1])], ["h", "c"])

    seen = map_batches(part, run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")).where(F.col("c") >= wanted)
    return {r[0]: int(r[1] * scale) for r in seen.select("h", "c").collect()}


def _bitmap(word: int):
    """One of four 64-bit words of the signature of a document's shared hashes."""
    return F.aggregate(
        F.filter("hs", lambda h: F.pmod(F.shiftrightunsigned(h, 6), F.lit(4)) == word),
        F.lit(0).cast("long"),
        lambda acc, h: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))),
    ).alias(f"b{word}")


def near_duplicate_classes(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, least_words: int = 1) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, overlap, union_size) between representatives of differing sets with
    overlap / union >= threshold, a < b; members (rep, doc) of every document that shares its set with
    another or has a link. Null keys, null, empty and short texts have no runs and are in neither; rows
    repeated with the same key count once (their sets are united if texts differ). Whole texts count."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = docs.count()
    tokens = _tokens(docs, "doc", "text", k, least_words, _hot_hashes(docs, "text", k, least_words, rows))
    spread = F.pmod("doc", F.greatest(F.lit(1), F.ceil(F.col("hot") / HOT_ROWS)))
    over = F.count("*").over(Window.partitionBy("h", spread))
    counted = tokens.withColumn("df", F.when(F.col("hot") > 0, F.col("hot")).otherwise(over)).where("df > 1")
    t = F.lit(threshold)
    need = F.ceil(t * F.col("n")).cast("int")  # |A n B| >= t |A u B| >= t |A|
    sets = counted.groupBy("doc").agg(F.max("n").alias("n"), F.array_sort(F.collect_set(F.struct("df", "h"))).alias("toks"))
    sets = sets.withColumn("need", need).where("size(toks) >= need").withColumn("hs", F.array_sort(F.col("toks.h")))
    sets = sets.withColumn("n", F.greatest("n", F.size("hs")))
    fp = F.when(F.size("hs") == F.col("n"), F.struct(F.xxhash64("hs").alias("x"), F.xxhash64(F.lit(1), "hs", F.lit(2)).alias("y"))).otherwise(F.struct(F.col("doc").alias("x"), F.lit(0).cast("long").alias("y")))
    sets = materialize(sets.select("doc", "n", "need", "toks", "hs", fp.alias("fp")), "sets")
    reps = sets.groupBy("fp").agg(F.min("doc").alias("rep"), F.count("*").alias("copies"))
    whole = sets.join(reps.select("fp", "rep"), "fp").select("rep", "doc")
    one = materialize(sets.join(reps.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", "n", "need", "toks", "hs", *[_bitmap(w) for w in range(4)]), "reps")
    band = F.floor(F.log(max(1 / threshold, 1.01), F.col("n").cast("double")) + 1e-9).cast("int")
    prefix = F.explode(F.expr("slice(toks, 1, size(hs) - need + 1)")).alias("t")
    sign = ("doc", "n", "s", "b0", "b1", "b2", "b3")
    tiles = one.select(prefix, "doc", "n", F.size("hs").alias("s"), "b0", "b1", "b2", "b3", band.alias("band"))
    tiles = tiles.select(F.col("t.h").alias("h"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("t.df") / TILE)).alias("grid"), "band", *sign)
    mine, all_cells = (lambda seed: F.pmod(F.xxhash64("doc", F.lit(seed)), F.col("grid"))), F.explode(F.sequence(F.lit(0).cast("long"), F.col("grid") - 1))
    small = tiles.select("h", "band", mine(1).alias("row"), all_cells.alias("column"), *[F.col(c).alias(f"{c}_a") for c in sign])
    small = small.withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    tiles = tiles.select("h", "band", all_cells.alias("row"), mine(2).alias("column"), *sign)
    xor = sum((F.bit_count(F.col(f"b{w}").bitwiseXOR(F.col(f"b{w}_a"))) for w in range(1, 4)), F.bit_count(F.col("b0").bitwiseXOR(F.col("b0_a"))))
    most = (F.col("s") + F.col("s_a") - xor) / 2
    floor = F.lit(threshold / (1 + threshold)) * (F.col("n") + F.col("n_a")) - 1e-6
    later = (F.col("n_a") < F.col("n")) | ((F.col("n_a") == F.col("n")) & (F.col("doc_a") < F.col("doc")))
    cand = small.join(tiles, ["h", "band", "row", "column"]).where(later & (F.col("n_a") >= t * F.col("n") - 1e-6) & (most >= floor))
    cand = materialize(cand.select(F.col("doc_a").alias("x"), F.col("doc").alias("y")).distinct(), "candidates")
    left = one.select(F.col("doc").alias("x"), F.col("n").alias("nx"), F.col("hs").alias("hx"))
    right = one.select(F.col("doc").alias("y"), F.col("n").alias("ny"), F.col("hs").alias("hy"))

    def exact(b: pa.RecordBatch):
        cols = {c: b.column(i) for i, c in enumerate(b.schema.names)}
        hx, hy = cols["hx"], cols["hy"]
        n = [len(np.intersect1d(hx[i].values.to_numpy(), hy[i].values.to_numpy(), assume_unique=True)) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([cols["x"], cols["y"], cols["nx"], cols["ny"], pa.array(n, pa.int32())], ["x", "y", "nx", "ny", "overlap"])

    pairs = map_batches(cand.join(left, "x").join(right, "y").select("x", "y", "nx", "ny", "hx", "hy"), exact, "x long, y long, nx int, ny int, overlap int")
    links = pairs.withColumn("union_size", F.col("nx") + F.col("ny") - F.col("overlap")).where(F.col("overlap") >= t * F.col("union_size") - 1e-9)
    links = materialize(links.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap", "union_size"), "links")
    linked = links.select(F.col("a").alias("rep")).unionByName(links.select(F.col("b").alias("rep"))).distinct()
    several = reps.where("copies > 1").select("rep")
    members = whole.join(linked.unionByName(several).distinct(), "rep", "left_semi")
    return links, members


def near_duplicate_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, least_words: int = 1) -> DataFrame:
    """(doc_id_a, doc_id_b): all pairs, smaller key first, copies of one set expanded."""
    links, members = near_duplicate_classes(df, key, text, k, threshold, least_words)
    members = materialize(members, "members")
    ma, mb = members.select(F.col("rep").alias("a"), F.col("doc").alias("da")), members.select(F.col("rep").alias("b"), F.col("doc").alias("db"))
    across = links.select("a", "b").join(ma, "a").join(mb, "b").select("da", "db")
    inside = ma.join(mb, F.col("a") == F.col("b")).where("da < db").select("da", "db")
    return across.unionByName(inside).select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"))


def near_duplicate_groups(df: DataFrame, key: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8, least_words: int = 1) -> DataFrame:
    """(doc_id, class_id, links): every document that is in a group of two or more, the least key of its
    group (chains count) and its number of links to other documents, copies included."""
    links, members = near_duplicate_classes(df, key, text, k, threshold, least_words)
    members = materialize(members, "members")
    c = components(links)
    size = members.groupBy("rep").agg(F.count("*").alias("copies"), F.min("doc").alias("first"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    far = both.join(size.select(F.col("rep").alias("b"), "copies"), "b").groupBy(F.col("a").alias("rep")).agg(F.sum("copies").alias("far"))
    reps = size.join(far, "rep", "left").join(c.withColumnRenamed("node", "rep"), "rep", "left")
    return members.join(reps, "rep").select(F.col("doc").alias("doc_id"), F.coalesce("root", "rep").alias("class_id"), (F.coalesce("far", F.lit(0)) + F.col("copies") - 1).alias("links"))
