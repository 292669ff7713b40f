"""Problem 1: how often every term occurs and in how many records, kept up to date by signed deltas.

A change is a row (old_text, new_text): null old text is an added record, null new text a deleted one. Each task sums
the signed counts of its rows in a bounded table before anything is shuffled. The summed delta is kept as a run,
partitioned by term; the state is a list of runs, and a term's counts are the sums over them. A run is merged with the
one before it as soon as that is less than RATIO times as large, so there are never more than a logarithm of
runs, an update writes little more than itself, and a term is rewritten a logarithm of times at most.

A manifest names the runs. Each has a number of its own and none is ever changed or replaced: the one
of the highest number is the state, so a job that breaks off anywhere leaves the state before it or the one after.
Runs that neither of the last two manifests names are removed.
"""

from __future__ import annotations

import json
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bohagi.llm.words import normal

#: Distinct terms a task holds before it hands them on; memory only.
FLUSH = 200_000
#: How much larger than the next a run is left alone; terms of a partition.
RATIO, PARTITION = 4, 1_000_000
SCHEMA = "term string, occurrences long, records long"


def word_terms(text: str) -> list[str]:
    """The pieces between blanks of the normal form."""
    return unicodedata.normalize("NFC", text).split()


def character_terms(text: str) -> str:
    """The characters of the normal form, the blank included."""
    return normal(text)


UNITS = {"words": word_terms, "characters": character_terms}


def signed_counts(changes: DataFrame, unit: str) -> DataFrame:
    """(term, occurrences, records): what the changes add to or take from each term's counts; the
    term null holds the number of records. Unchanged records cancel out before any count."""
    terms = UNITS[unit]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occ: Counter = Counter()
        rec: Counter = Counter()
        n = 0

        def out(last: bool) -> pa.RecordBatch:
            rows = [(t, occ[t], rec[t]) for t in occ.keys() | rec.keys() if occ[t] or rec[t]]
            if last:
                rows.append((None, n, n))
            occ.clear()
            rec.clear()
            cols = list(zip(*rows)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["term", "occurrences", "records"])

        for b in batches:
            for old, new in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if new is not None:
                    ts = terms(new)
                    occ.update(ts)
                    rec.update(set(ts))
                    n += 1
                if old is not None:
                    ts = terms(old)
                    occ.subtract(ts)
                    rec.subtract(set(ts))
                    n -= 1
            if len(occ) > FLUSH:
                yield out(False)
        yield out(True)

    rows = changes.where("not (old_text <=> new_text)").select("old_text", "new_text").mapInArrow(run, SCHEMA)
    return rows.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0 or records <> 0")


def changes_between(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(old_text, new_text) of the keys whose text was added, changed or deleted between two states
    of a table with one row for each key."""
    a, b = old.select(F.col(key).alias("k"), F.col(text).alias("old_text")), new.select(F.col(key).alias("k"), F.col(text).alias("new_text"))
    return a.join(b, "k", "full_outer").where("not (old_text <=> new_text)").select("old_text", "new_text")


class TermCounts:
    """Counts of one collection under path, a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str, unit: str = "words") -> None:
        self.spark, self.path, self.unit = spark, path.rstrip("/"), unit
        self._jvm = spark.sparkContext._jvm
        self._fs = self._p(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.state = self._last_manifest()

    def _p(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _names(self) -> list[str]:
        return [f.getPath().getName() for f in self._fs.listStatus(self._p(self.path))] if self._fs.exists(self._p(self.path)) else []

    def _manifests(self) -> list[str]:
        """Their names, the last one first."""
        return sorted((n for n in self._names() if n.startswith("manifest-") and n.endswith(".json")), reverse=True)

    def _read_manifest(self, name: str) -> dict:
        s = self._fs.open(self._p(f"{self.path}/{name}"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(s, "UTF-8"))
        finally:
            s.close()

    def _last_manifest(self) -> dict:
        names = self._manifests()
        return self._read_manifest(names[0]) if names else {"generation": 0, "records": 0, "runs": []}

    def _write_manifest(self, state: dict) -> None:
        name = f"{self.path}/manifest-{state['generation']:012d}.json"
        s = self._fs.create(self._p(name + ".new"), True)
        s.write(bytearray(json.dumps(state).encode()))
        s.close()
        if self._fs.exists(self._p(name)) or not self._fs.rename(self._p(name + ".new"), self._p(name)):
            raise OSError(f"{name} is there already: another job has changed these counts")
        self.state = state

    def _clean(self) -> None:
        """Removes manifests but the last two, and runs that neither names."""
        names = self._manifests()
        keep = set(names[:2]) | {r["name"] for n in names[:2] for r in self._read_manifest(n)["runs"]}
        for n in self._names():
            if n not in keep:
                self._fs.delete(self._p(f"{self.path}/{n}"), True)

    def _write_run(self, rows: DataFrame, name: str, terms: int) -> None:
        """Writes (term, occurrences, records) by partitions of the term's hash; the row of no term apart."""
        n = max(1, -(-terms // PARTITION))
        part = F.when(F.col("term").isNull(), -1).otherwise(F.pmod(F.xxhash64("term"), F.lit(n)))
        rows.withColumn("part", part).write.mode("overwrite").partitionBy("part").option("compression", "zstd").parquet(f"{self.path}/{name}")

    def _read_run(self, name: str) -> DataFrame:
        return self.spark.read.schema(SCHEMA + ", part int").parquet(f"{self.path}/{name}")

    def _sum(self, names: list[str]) -> DataFrame:
        rows = [self._read_run(n).where("part >= 0").select("term", "occurrences", "records") for n in names]
        if len(rows) < 2:
            return rows[0] if rows else self.spark.createDataFrame([], SCHEMA)
        every = rows[0]
        for r in rows[1:]:
            every = every.unionByName(r)
        return every.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")).where("occurrences <> 0 or records <> 0")

    def apply(self, changes: DataFrame) -> None:
        """Adds the changes (old_text, new_text). Null on both sides and equal texts change nothing."""
        g = self.state["generation"] + 1
        name = f"run-{g:012d}"
        self._write_run(signed_counts(changes, self.unit), name, sum(r["terms"] for r in self.state["runs"]))
        facts = {r[0]: (r[1], r[2]) for r in self._read_run(name).groupBy((F.col("part") < 0).alias("none")).agg(F.count("*"), F.sum("records")).collect()}
        runs, records = list(self.state["runs"]), self.state["records"] + facts.get(True, (0, 0))[1]
        if facts.get(False, (0, 0))[0]:
            runs.append({"name": name, "terms": facts[False][0]})
        first = len(runs)
        size = 0
        while first > 0 and (size == 0 or runs[first - 1]["terms"] < RATIO * size):
            first -= 1
            size += runs[first]["terms"]
        if len(runs) - first > 1:
            merged = f"{name}-merged"
            self._write_run(self._sum([r["name"] for r in runs[first:]]), merged, size)
            terms = self._read_run(merged).count()
            runs[first:] = [{"name": merged, "terms": terms}] if terms else []
        self._write_manifest({"generation": g, "records": records, "runs": runs})
        self._clean()

    @property
    def records(self) -> int:
        return self.state["records"]

    def counts(self) -> DataFrame:
        """(term, occurrences, records) of every term that occurs."""
        return self._sum([r["name"] for r in self.state["runs"]])

    def marked(self, rare_below: int = 3, common_above: float = 0.5) -> DataFrame:
        """(term, occurrences, records, mark): terms in fewer records than rare_below and in more than
        the share common_above of all records; a term that is both gets a row for each mark."""
        c = self.counts()
        rare = c.where(F.col("records") < rare_below).withColumn("mark", F.lit("rare"))
        return rare.unionByName(c.where(F.col("records") > F.lit(common_above) * F.lit(self.records)).withColumn("mark", F.lit("common")))


def added(df: DataFrame, text: str) -> DataFrame:
    """Every row of a table as an added record."""
    return df.select(F.lit(None).cast("string").alias("old_text"), F.col(text).alias("new_text"))
