"""Byte-level byte-pair encoding by a segment tree over byte positions.

Leaves hold the rank of the pair that starts at a live position (a large number where none does);
inner nodes hold the least rank below them, ties going left, so the root names the leftmost pair
of least rank. A merge joins two live neighbours of a linked list of positions and updates at most
three leaves, each in logarithmic time. So a piece of n bytes takes O(n log n), however long.
"""

from __future__ import annotations

import base64

import numpy as np
import regex

#: The public splitting pattern of the rank file.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: White space is never in one piece with what follows it but for one blank, so the pieces of a
#: text are those of these parts, one after the other.
PART = r" ?\S+|\s+(?!\S)|\s+"

_NONE = 1 << 30


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: a line for each token, its bytes in base64 and its id."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece of the splitting pattern."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    get = ranks.get
    for i in range(n - 1):
        tree[size + i] = get(piece[i : i + 2], _NONE)
    for k in range(size - 1, 0, -1):
        a, b = tree[2 * k], tree[2 * k + 1]
        tree[k] = a if a <= b else b

    def put(i: int, rank: int) -> None:
        k = size + i
        tree[k] = rank
        k >>= 1
        while k:
            a, b = tree[2 * k], tree[2 * k + 1]
            m = a if a <= b else b
            if tree[k] == m:
                break
            tree[k] = m
            k >>= 1

    while (least := tree[1]) != _NONE:
        k = 1
        while k < size:
            k *= 2
            if tree[k] != least:
                k += 1
        i = k - size
        j = nxt[i]
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        put(j, _NONE)
        put(i, get(piece[i : end[nxt[i]]], _NONE) if nxt[i] < n else _NONE)
        if prv[i] >= 0:
            put(prv[i], get(piece[prv[i] : end[i]], _NONE))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = nxt[i]
    return out


class PartEncoder(dict):
    """part of a text -> its number; the ids of every part seen lie in one flat array."""

    #: Ids kept before the store is emptied (at the start of a text); only speed depends on it.
    KEEP = 8_000_000
    #: Longer parts are encoded afresh, as they hardly come again.
    LONG = 400

    def __init__(self, path: str) -> None:
        super().__init__()
        self.ranks = load_ranks(path)
        self.split = regex.compile(PATTERN).findall
        self.parts = regex.compile(PART).findall
        self.pieces: dict[str, list[int]] = {}
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.pieces.clear()
        self.used, self.flat = 0, np.zeros(1 << 16, np.int32)
        self.starts: list[int] = []
        self.lens: list[int] = []
        self._at: np.ndarray | None = None

    def encode_part(self, part: str) -> list[int]:
        out: list[int] = []
        for p in self.split(part):
            ids = self.pieces.get(p)
            if ids is None:
                ids = merge_piece(p.encode("utf-8", "replace"), self.ranks)
                if len(p) <= self.LONG:
                    self.pieces[p] = ids
            out += ids
        return out

    def __missing__(self, part: str) -> int:
        ids = self.encode_part(part)
        if self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.starts.append(self.used)
        self.lens.append(len(ids))
        self.used += len(ids)
        n = self[part] = len(self.lens) - 1
        return n

    def numbers(self, text: str) -> np.ndarray:
        ps = self.parts(text)
        return np.fromiter(map(self.__getitem__, ps), np.int64, len(ps))

    def encode_texts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts, as of an Arrow list array; none for null and empty ones."""
        if self.used > self.KEEP:
            self.reset()
        nums = [self.numbers(t) if t else np.empty(0, np.int64) for t in texts]
        starts, lens = np.array(self.starts, np.int64), np.array(self.lens, np.int64)
        every = np.concatenate(nums) if nums else np.empty(0, np.int64)
        ln = lens[every] if len(every) else np.empty(0, np.int64)
        ends = np.cumsum(ln)
        total = int(ends[-1]) if len(ends) else 0
        shift = (starts[every] - (ends - ln)) if len(every) else ln
        ids = self.flat[np.repeat(shift, ln) + np.arange(total)] if total else np.empty(0, np.int32)
        per = np.cumsum([0] + [len(x) for x in nums])
        return np.concatenate([[0], ends])[per], ids

    def count_texts(self, texts: list[str | None]) -> np.ndarray:
        """Number of ids of each text."""
        if self.used > self.KEEP:
            self.reset()
        nums = [self.numbers(t) if t else None for t in texts]
        lens = np.array(self.lens, np.int64)
        return np.array([0 if x is None or not len(x) else int(lens[x].sum()) for x in nums], np.int64)
