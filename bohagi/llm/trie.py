"""Complete retrieval of vocabulary words within k edits: a Levenshtein automaton walks a trie.

The automaton of a query is run bit-parallel: for each number of edits a bit set of the query
positions reached; a branch of the trie is left as soon as all sets are empty. So exactly the prefixes
that some word within k edits has are visited.

Queries and words meet by segments: a word of n characters is cut in k + 1 even ones, and k edits leave one of them
as it is, at a place that the edits before and after it can reach. So every word within k edits, of any
length and frequency, shares a key with the query, and a query meets the tries of its own keys only.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.words import map_batches
from bohagi.session import materialize

#: Words of one key that one trie holds (and queries that go through it), and rows of a group of keys.
BLOCK_WORDS, GROUP_ROWS = 100_000, 200_000


class Trie:
    """Nested maps from character to node; the empty string leads to the word that ends there."""

    def __init__(self, words) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, query: str, k: int) -> list[tuple[str, int]]:
        """(word, edits) of every word within k edits of the query."""
        n = len(query)
        masks: dict[str, int] = {}
        for i, c in enumerate(query):
            masks[c] = masks.get(c, 0) | 1 << i
        full, last = (1 << (n + 1)) - 1, 1 << n

        def closed(states: list[int]) -> list[int]:
            for e in range(1, k + 1):  # a character of the query left out
                states[e] |= (states[e - 1] << 1) & full
            return states

        out: list[tuple[str, int]] = []
        stack = [(self.root, closed([1] + [0] * k))]
        while stack:
            node, states = stack.pop()
            for c, child in node.items():
                if c == "":
                    for e in range(k + 1):
                        if states[e] & last:
                            out.append((child, e))
                            break
                    continue
                m = masks.get(c, 0)
                new = [((states[0] & m) << 1) & full]
                for e in range(1, k + 1):  # the same, another or an added character
                    new.append(((states[e] & m) << 1 | states[e - 1] << 1 | states[e - 1]) & full)
                if any(closed(new)):
                    stack.append((child, new))
        return out


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(place, length) of the k + 1 segments of a word of n characters."""
    cut = [i * n // (k + 1) for i in range(k + 2)]
    return [(a, b - a) for a, b in zip(cut, cut[1:])]


def word_keys(word: str, k: int) -> list[str]:
    return [f"{len(word)}.{i}.{word[p : p + n]}" for i, (p, n) in enumerate(segments(len(word), k))]


def query_keys(query: str, k: int) -> set[str]:
    """The keys of all words within k edits: i edits at most lie before segment i, k - i after it, or else another
    segment is left as well."""
    n, out = len(query), set()
    for size in range(max(1, n - k), n + k + 1):
        for i, (p, m) in enumerate(segments(size, k)):
            for at in range(max(0, p - i, p + n - size - (k - i)), min(n - m, p + i, p + n - size + k - i) + 1):
                out.add(f"{size}.{i}.{query[at : at + m]}")
    return out


def _keyed(df: DataFrame, c: str, more: str, keys) -> DataFrame:
    """A row (key, c, n) for each key."""

    def run(b: pa.RecordBatch):
        ks = [list(keys(x)) for x in b.column(0).to_pylist()]
        of = pa.array([i for i, x in enumerate(ks) for _ in x], pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([y for x in ks for y in x], pa.string()), *[b.column(i).take(of) for i in range(b.num_columns)]], ["key", *b.schema.names])

    return map_batches(df, run, f"key string, {c} string{more}")


def near_words(queries: DataFrame, vocabulary: DataFrame, k: int = 1) -> DataFrame:
    """(query, word, edits, n): every vocabulary word within k edits of each query, k = 0 being the word itself.
    queries has the column query, vocabulary the columns word and n. A key of more than BLOCK_WORDS words, or
    queries, is split, and the others go to each part. Null and empty queries and words have no row; repeated queries count
    once, and so does a repeated word with its n."""
    q = materialize(_keyed(queries.select("query").where("query <> ''").distinct(), "query", "", lambda x: query_keys(x, k)), "query-keys")
    v = materialize(_keyed(vocabulary.select("word", "n").where("word <> ''").distinct(), "word", ", n long", lambda x: word_keys(x, k)), "word-keys")

    def crowded(x: DataFrame, name: str) -> DataFrame:
        return x.groupBy("key").agg(F.ceil(F.count("*") / BLOCK_WORDS).alias(name)).where(F.col(name) > 1)

    groups = F.lit(max(int(v.sparkSession.conf.get("spark.sql.shuffle.partitions")), (v.count() + q.count()) // GROUP_ROWS))
    words_of, queries_of = crowded(v, "nw"), crowded(q, "nq")
    one = F.lit(1).cast("long")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, one) - 1))
    q, v = (x.join(words_of, "key", "left").join(queries_of, "key", "left") for x in (q, v))
    q = q.withColumn("qp", F.pmod(F.xxhash64("query"), F.coalesce("nq", one))).withColumn("wp", each(F.col("nw")))
    v = v.withColumn("wp", F.pmod(F.xxhash64("word"), F.coalesce("nw", one))).withColumn("qp", each(F.col("nq")))
    q, v = (x.drop("nw", "nq").withColumn("part", F.concat_ws(".", "wp", "qp")).withColumn("grp", F.pmod(F.xxhash64("key", "part"), groups)) for x in (q, v))

    def match(a: pa.Table, b: pa.Table) -> pa.Table:
        asked: dict[tuple, list[str]] = {}
        for key, part, x in zip(*(a[c].to_pylist() for c in ("key", "part", "query"))):
            asked.setdefault((key, part), []).append(x)
        held: dict[tuple, dict[str, list[int]]] = {}
        for key, part, w, n in zip(*(b[c].to_pylist() for c in ("key", "part", "word", "n"))):
            if (key, part) in asked:
                held.setdefault((key, part), {}).setdefault(w, []).append(n)
        rows = set()
        for at, words in held.items():
            trie = Trie(words)
            for x in asked[at]:
                rows.update((x, w, e, n) for w, e in trie.near(x, k) for n in words[w])
        cols = list(zip(*rows)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, kind) for c, kind in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int64()))], ["query", "word", "edits", "n"])

    return q.groupBy("grp").cogroup(v.groupBy("grp")).applyInArrow(match, "query string, word string, edits int, n long").distinct()
