"""Alignments that no JVM expression gives, as Arrow batch functions over arrays."""

from __future__ import annotations

import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def _table(a: str, b: str) -> np.ndarray:
    """Edit distances of all prefixes, a row at a time: what insertions add is a running minimum."""
    y = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.frombuffer(a.encode("utf-32-le", "surrogatepass"), np.uint32)
    place = np.arange(len(y) + 1, dtype=np.int32)
    t = np.empty((len(x) + 1, len(y) + 1), np.int32)
    t[0] = place
    for i, c in enumerate(x, 1):
        best = np.empty(len(y) + 1, np.int32)
        best[0] = i
        best[1:] = np.minimum(t[i - 1, 1:] + 1, t[i - 1, :-1] + (y != c))
        t[i] = np.minimum.accumulate(best - place) + place
    return t


def edit_distance(a: str, b: str) -> int:
    """By bit vectors: a column of the table is two whole numbers, where it rises and where it falls by one."""
    if a == b or not a or not b:
        return 0 if a == b else max(len(a), len(b))
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, last, score = (1 << len(a)) - 1, 1 << (len(a) - 1), len(a)
    rise, fall = full, 0
    for c in b:
        same = at.get(c, 0)
        level = same | fall
        across = (((same & rise) + rise) ^ rise) | same
        up, down = fall | (full & ~(across | rise)), rise & across
        score += bool(up & last) - bool(down & last)
        up, down = (up << 1 | 1) & full, (down << 1) & full
        rise, fall = down | (full & ~(level | up)), up & level
    return score


def align_pair(ref: str, hyp: str) -> list[tuple[str | None, str | None]]:
    """Pairs of a least-cost alignment. From the end, a diagonal step goes before a deletion and that before
    an insertion; recall depends on this order."""
    t, i, j, out = _table(ref, hyp), len(ref), len(hyp), []
    while i or j:
        if i and j and t[i, j] == t[i - 1, j - 1] + (ref[i - 1] != hyp[j - 1]):
            i, j = i - 1, j - 1
            out.append((ref[i], hyp[j]))
        elif i and t[i, j] == t[i - 1, j] + 1:
            i -= 1
            out.append((ref[i], None))
        else:
            j -= 1
            out.append((None, hyp[j]))
    return out[::-1]


def align_characters(ref: Column, hyp: Column) -> Column:
    """array<struct<ref, hyp>> of two texts; null where either is."""

    @F.arrow_udf("array<struct<ref: string, hyp: string>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        rows = [None if x is None or y is None else [{"ref": r, "hyp": h} for r, h in align_pair(x, y)] for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array(rows, pa.list_(pa.struct([("ref", pa.string()), ("hyp", pa.string())])))

    return run(ref, hyp)


def aligned_counts(ref: Column, hyp: Column, chars: tuple[str, ...]) -> Column:
    """array<int>: how many occurrences of each character are aligned with themselves. One alignment a pair, and
    none where the texts are equal or have none of the characters."""

    @F.arrow_udf("array<int>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        out: list[list[int] | None] = []
        for x, y in zip(a.to_pylist(), b.to_pylist()):
            if x is None or y is None:
                out.append(None)
            elif x == y:
                out.append([x.count(c) for c in chars])
            elif not any(c in x and c in y for c in chars):
                out.append([0] * len(chars))
            else:
                same = [r for r, h in align_pair(x, y) if r == h]
                out.append([same.count(c) for c in chars])
        return pa.array(out, pa.list_(pa.int32()))

    return run(ref, hyp)


def boundary_map(source: str, target: str) -> list[int]:
    """For each boundary of source its place in target: along matching blocks, in proportion between them,
    never going back; the last is the end."""
    if source == target:
        return list(range(len(source) + 1))
    at: dict[int, int] = {}
    for _, i, j, p, q in SequenceMatcher(None, source, target, autojunk=False).get_opcodes():
        if i == j:
            at[i] = max(at.get(i, 0), q)
        else:
            at.update((i + k, round(p + k / (j - i) * (q - p))) for k in range(j - i + 1))
    seen = np.maximum.accumulate([min(len(target), at.get(i, 0)) for i in range(len(source) + 1)]).tolist()
    seen[-1] = len(target)
    return seen


def _normal(t: str) -> str:
    return " ".join(unicodedata.normalize("NFC", t).split())


def align_lines(predictions: list[str], transcription: str) -> list[tuple[int, str, str, float]]:
    """(index, prediction, reference, score) of each line: its part of the transcription and how near it is."""
    ps, whole = [_normal(p) for p in predictions], _normal(transcription)
    joined = " ".join(ps)
    if not joined or not whole:
        return []
    places, at, out = boundary_map(joined, whole), 0, []
    for k, p in enumerate(ps):
        ref = _normal(whole[places[at] : places[at + len(p)]])
        out.append((k, p, ref, max(0.0, 1.0 - edit_distance(ref, p) / max(1, len(ref), len(p)))))
        at += len(p) + 1
    return out


def align_transcription(predictions: Column, transcription: Column) -> Column:
    """array<struct<index, prediction, transcription, score>> of a page; empty where either side is."""

    @F.arrow_udf("array<struct<index: int, prediction: string, transcription: string, score: double>>")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("index", pa.int32()), ("prediction", pa.string()), ("transcription", pa.string()), ("score", pa.float64())]))
        rows = [None if x is None or y is None else [{"index": i, "prediction": p, "transcription": r, "score": s} for i, p, r, s in align_lines([t or "" for t in x], y)] for x, y in zip(a.to_pylist(), b.to_pylist())]
        return pa.array(rows, kind)

    return run(predictions, transcription)
