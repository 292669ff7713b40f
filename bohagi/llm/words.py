"""Text helpers shared by the operators of this subpackage: normal form, words and their hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

#: Entries a worker's cache may hold before it is emptied; only speed depends on it.
CACHE_ENTRIES = 400_000


def normal(text: str) -> str:
    """NFC, runs of white space as one blank, ends stripped."""
    return " ".join(unicodedata.normalize("NFC", text).split())


def words(text: str) -> list[str]:
    """The pieces between blanks of the normal form; none for blank texts."""
    return unicodedata.normalize("NFC", text).split()


class HashCache(dict):
    """word -> 64-bit hash, computed once per word."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_ENTRIES:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def array(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, ws), np.uint64, len(ws))


_MULT = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k successive elements, in order of place."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _MULT + h[i : i + n]
    out ^= out >> np.uint64(31)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def char_codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow with fn(batch) -> iterable of columns lists or record batches."""
    return df.mapInArrow(lambda batches: _each(batches, fn), schema)


def _each(batches: Iterable[pa.RecordBatch], fn) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield from fn(b)


def pieces(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many rows, so that what is made of a part stays small."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)
