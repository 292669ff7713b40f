"""Problem 7: documents that hold passages of evaluation items.

Words are compared in the form of problem 4 and without outer punctuation. The hashes of all runs of
k words of the items are broadcast as a sorted array, whose size is that of the evaluation material
and is measured first; the documents are scanned once, window by window, and every hit is verified
word by word. Of item sets above the bound a bitmap of fixed size is broadcast instead; windows that
pass it meet the items' windows in a shuffle join by hash and by the words themselves, so hits are
verified there as well. Searching and removing have the same hits in both ways.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.lookalikes import canonical
from bohagi.llm.words import CACHE_ENTRIES, HashCache, map_batches, pieces, windows

#: Windows of evaluation items that may be broadcast (16 bytes each, and at most TEXT code points a window
#: of words); bits of the bitmap that is broadcast instead (8 MB).
BROADCAST_WINDOWS, TEXT, BITMAP = 2_000_000, 32, 1 << 26


class _Bare(dict):
    """piece of a text -> its words as compared (none for punctuation alone)."""

    def __missing__(self, piece: str) -> tuple[str, ...]:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        out = []
        for w in canonical(piece).split(" "):
            i, j = 0, len(w)
            while i < j and unicodedata.category(w[i])[0] not in "LMN":
                i += 1
            while i < j and unicodedata.category(w[j - 1])[0] not in "LMN":
                j -= 1
            if i < j:
                out.append(w[i:j])
        r = self[piece] = tuple(out)
        return r


_bare, _hashes = _Bare(), HashCache()


def compared_words(text: str) -> list[str]:
    """The words of a text as they are compared."""
    out: list[str] = []
    for t in map(_bare.__getitem__, text.split()):
        out += t
    return out


class _Known:
    """The windows of the items: sorted hashes, where each stands, and a sieve by which most windows of a
    document are told apart without a search."""

    def __init__(self, items: list[tuple[int, str]], k: int) -> None:
        self.k, self.ids, self.words = k, [i for i, _ in items], [compared_words(t) for _, t in items]
        hs = [windows(_hashes.array(w), k) for w in self.words]
        flat = np.concatenate([*hs, np.empty(0, np.uint64)])
        order = np.argsort(flat, kind="stable")
        self.flat = flat[order]
        self.which = np.repeat(np.arange(len(hs)), [len(h) for h in hs]).astype(np.int32)[order]
        self.place = np.concatenate([*(np.arange(len(h)) for h in hs), np.empty(0, np.int64)]).astype(np.int32)[order]
        self.mask = np.uint64((1 << max(16, (8 * len(flat)).bit_length())) - 1)
        self.sieve = np.zeros(int(self.mask) + 1, bool)
        self.sieve[(self.flat & self.mask).astype(np.int64)] = True

    def hits(self, ws: list[str], h: np.ndarray):
        """(place in the document, item) of every window that is one of an item, word by word."""
        if not len(self.flat):
            return
        at = np.flatnonzero(self.sieve[(h & self.mask).astype(np.int64)])
        lo, hi = np.searchsorted(self.flat, h[at], "left"), np.searchsorted(self.flat, h[at], "right")
        met = hi > lo
        for p, x, y in zip(at[met].tolist(), lo[met].tolist(), hi[met].tolist()):
            run = ws[p : p + self.k]
            for j in range(x, y):
                i, q = int(self.which[j]), int(self.place[j])
                if run == self.words[i][q : q + self.k]:
                    yield p, self.ids[i]


def _items(items: DataFrame, item_key: str, text: str) -> DataFrame:
    return items.where(F.col(item_key).isNotNull() & F.col(text).isNotNull()).select(F.col(item_key).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()


def _size(items: DataFrame, k: int) -> tuple[int, int]:
    """(windows, code points) of the items that have a window."""

    def run(b: pa.RecordBatch):
        n = [(len(compared_words(t)) - k + 1, len(t)) for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in n if x > 0], pa.int64()), pa.array([y for x, y in n if x > 0], pa.int64())], ["n", "chars"])

    r = map_batches(items, run, "n long, chars long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("chars"), F.lit(0))).first()
    return r[0], r[1]


def _known(items: DataFrame, k: int, limit: int):
    """The items' windows as a broadcast, or None if there are too many."""
    n, chars = _size(items, k)
    if n > limit or chars > TEXT * limit:
        return None
    return items.sparkSession.sparkContext.broadcast(_Known([(r[0], r[1]) for r in items.collect()], k))


def _bitmap(items: DataFrame, k: int):
    """A broadcast bitmap of the hashes of all items' windows: tasks set their own bits, which are then joined."""

    def run(batches):
        have = np.zeros(BITMAP // 8, np.uint8)
        for b in batches:
            for t in b.column(1).to_pylist():
                at = (windows(_hashes.array(compared_words(t)), k) & np.uint64(BITMAP - 1)).astype(np.int64)
                np.bitwise_or.at(have, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        w = have.view(np.int64)
        i = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(w[i])], ["w", "bits"])

    got = items.mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITMAP // 64, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return items.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _window_rows(df: DataFrame, k: int, bits=None) -> DataFrame:
    """(key, h, run): the distinct windows of each row (key long, text), with their words; only those the bitmap has."""

    def run(b: pa.RecordBatch):
        for p in pieces(b, 64):
            keys, hs, runs = [], [], []
            for d, t in zip(p.column(0).to_pylist(), p.column(1).to_pylist()):
                ws = compared_words(t) if t else []
                h = windows(_hashes.array(ws), k)
                at = np.arange(len(h))
                if bits is not None:
                    x = (h & np.uint64(BITMAP - 1)).astype(np.int64)
                    at = np.flatnonzero((bits.value[x >> 3] >> (x & 7).astype(np.uint8)) & 1)
                seen = {" ".join(ws[i : i + k]): i for i in at.tolist()}
                keys += [d] * len(seen)
                runs += seen
                hs.append(h[list(seen.values())])
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(np.concatenate(hs).view(np.int64)), pa.array(runs, pa.string())], ["key", "h", "run"])

    return map_batches(df, run, "key long, h long, run string")


def leaked(docs: DataFrame, items: DataFrame, k: int = 12, key: str = "doc_id", item_key: str = "item_id", text: str = "text", limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id): documents with at least k successive words of an item, unbroken and in order.
    Null or empty texts, null keys and items of fewer than k words are no case; repeated rows count
    once; empty tables give no rows. Items of more windows than limit are met by a shuffle join; both ways
    verify every hit word by word and give the same rows."""
    it, d = _items(items, item_key, text), docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long"), F.col(text))
    known = _known(it, k, limit)
    if known is None:
        a, b = _window_rows(d, k, _bitmap(it, k)).withColumnRenamed("key", "doc_id"), _window_rows(it, k).withColumnRenamed("key", "item_id")
        return a.join(b, ["h", "run"]).select("doc_id", "item_id").distinct()

    def run(b: pa.RecordBatch):
        rows: list[tuple[int, int]] = []
        for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if t:
                ws = compared_words(t)
                rows += {(d, i) for _, i in known.value.hits(ws, windows(_hashes.array(ws), k))}
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(2)], ["doc_id", "item_id"])

    return map_batches(d, run, "doc_id long, item_id long").distinct()


def _cut(text: str, k: int, at: list[int]) -> tuple[str, int]:
    """The text without the pieces that hold a word of the runs of k words that begin at these places."""
    ps = text.split()
    owner = [i for i, p in enumerate(ps) for _ in _bare[p]]
    bad = {owner[j] for s in at for j in range(s, s + k)}
    return " ".join(p for i, p in enumerate(ps) if i not in bad), len(bad)


def without_leaks(docs: DataFrame, items: DataFrame, k: int = 12, key: str = "doc_id", text: str = "text", limit: int = BROADCAST_WINDOWS) -> DataFrame:
    """(doc_id, text, removed): every document, the pieces that hold a word of a leaked run taken out (removed
    counts them), whatever its key. Documents without a leak keep their text as it is, null and empty ones
    too. Item sets of more windows than limit are met by a shuffle join: the leaked runs of each distinct text
    are found, and come back to it as words, so neither a repeated key nor a hash that two texts share
    can take out anything else. Both ways give the same rows."""
    it = _items(items, "item_id", text)
    d = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names, schema = ["doc_id", "text", "removed"], "doc_id long, text string, removed int"

    def rows(b: pa.RecordBatch, places):
        out, gone = [], []
        for i, t in enumerate(b.column(1).to_pylist()):
            at = places(i, t) if t else []
            t, n = _cut(t, k, at) if at else (t, 0)
            out.append(t)
            gone.append(n)
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array(gone, pa.int32())], names)

    known = _known(it, k, limit)
    if known is None:
        some = F.coalesce(F.col("text") != "", F.lit(False))
        named = d.where(some).withColumn("tk", F.xxhash64("text"))
        # a text's windows carry its hash; equal texts and colliding ones just share a list
        found = _window_rows(named.select("tk", "text"), k, _bitmap(it, k)).join(_window_rows(it, k).select("h", "run").distinct(), ["h", "run"], "left_semi")
        found = found.groupBy(F.col("key").alias("tk")).agg(F.collect_set("run").alias("runs"))

        def apply(b: pa.RecordBatch):
            lists = b.column(2)

            def places(i: int, t: str) -> list[int]:
                runs = lists[i].as_py()
                if not runs:
                    return []
                ws, runs = compared_words(t), set(runs)
                return [p for p in range(len(ws) - k + 1) if " ".join(ws[p : p + k]) in runs]

            yield rows(b, places)

        done = map_batches(named.join(found, "tk", "left").select("doc_id", "text", "runs"), apply, schema)
        return done.unionByName(d.where(~some).withColumn("removed", F.lit(0)))

    def run(b: pa.RecordBatch):
        def places(_: int, t: str) -> list[int]:
            ws = compared_words(t)
            return sorted({p for p, _ in known.value.hits(ws, windows(_hashes.array(ws), k))})

        yield rows(b, places)

    return map_batches(d, run, schema)
