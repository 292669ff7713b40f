"""Problem 3: records of evaluation splits that lie in the training split as well, exactly or almost.

Images meet by hash. Texts meet in a weighted cosine join between the splits, over distinct texts. A text's
vector has a term for each run of Q characters; the squared weight of a term is 1 less its share of the
texts, so that rare runs weigh most. e edits destroy at most Q runs each, so a match keeps a dot product of at least
|x|_1 - (the Q e greatest squared weights), for either side: that is the bound the edit limit gives the cosine.

1. Inverted lists hold a part of each evaluation text's vector: of all sets of e + 1 runs that don't overlap the
   one of maximum weight. An edit destroys one of them at most, so e edits leave a dot product over the listed part
   that is above 0, whatever the residual: the residual never needs a list.
2. All runs of the training texts probe the lists, within the bounds of length and place that e edits leave;
   signatures, counts of characters and of pairs of them by classes, which an edit changes by two and four at
   most, bound the distance from below. A bitmap of the listed runs, with their length and place, keeps
   training runs that can meet none of them from being shuffled. Runs that are in very many texts are
   salted: the training rows are spread, the listed ones repeated.
3. A candidate is dropped where the norms bound its dot product below the threshold (|x . y| <= |x| |y|), or where
   listed terms met and the norms of the two residuals do; what is left has its exact dot product, and what
   reaches the bound its edit distance, which decides. Equal texts are candidates like all others.

The weights come from a table of fixed size in which the runs of all texts are counted (runs that share a cell are
counted as one); they decide how much work there is, never the result. A second bitmap, of the candidates, keeps texts without any from being shuffled. The bitmap of runs has some 64 bits for each cell of a listed run up to 2^29 in all (64 MB); beyond, it
fills up and more training runs are shuffled, with the same result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.llm.words import char_codes, map_batches, normal, pieces, windows
from bohagi.session import materialize

#: Characters in a run; cells of the table of their counts, and of the parts it is sent in; least and most bits of the bitmap.
Q, TABLE, TABLE_PART, BITMAPS = 6, 1 << 22, 1 << 12, (1 << 20, 1 << 29)
#: Texts up to this length have their best set of runs; longer ones the best run of each of e + 1 stretches.
PLANNED = 400
#: Cells of the bitmap's length (a logarithm) and place.
LENGTH_BASE, PLACE_CELL = 1.25, 16
#: Texts with a run above which its rows are spread over more tasks.
HOT_ROWS = 200_000


def _split_class(c: str):
    s = F.lower(F.trim(F.col(c)))
    return F.when(s == "train", 0).when(s.isin("validation", "test"), 1)


def flat_runs(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, place, lengths): the runs of Q characters of many texts at once."""
    codes = [char_codes(t) for t in texts]
    lens = np.array([len(c) for c in codes], np.int64)
    flat = np.concatenate(codes).astype(np.uint64) + np.uint64(1)
    owner = np.repeat(np.arange(len(codes)), lens)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(lens) - lens, lens)
    h = windows(flat, Q)
    whole = place[: len(h)] + Q <= lens[owner[: len(h)]]
    return h[whole], owner[: len(h)][whole], place[: len(h)][whole], lens


def _planned(cost: np.ndarray, edits: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, place) of the e + 1 runs of each text that don't overlap and cost least in all. cost has a
    row for each place and a column for each text (infinite where a text has no run)."""
    m, n = cost.shape
    most = int(edits.max(initial=0)) + 1
    before = np.zeros((m + Q, n), np.float32)
    take = np.zeros((most + 1, m, n), bool)
    for k in range(1, most + 1):
        now = np.full((m + Q, n), np.inf, np.float32)
        run = np.full(n, np.inf, np.float32)
        for i in range(m):
            c = before[i] + cost[i]
            better = c < run
            take[k, i] = better
            run = np.where(better, c, run)
            now[i + Q] = run
        before = now
    who, where, col = [], [], np.arange(n)
    k, at = edits + 1, lens - Q
    live = k > 0
    while live.any():
        hit = live & take[np.where(live, k, 1), np.where(live, at, 0), col]
        who.append(col[hit])
        where.append(at[hit])
        at = np.where(hit, at - Q, at - 1)
        k = np.where(hit, k - 1, k)
        live = live & (k > 0) & (at >= 0)
    return np.concatenate(who), np.concatenate(where)


def listed_runs(h: np.ndarray, owner: np.ndarray, place: np.ndarray, lens: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """Which runs are listed: of each text e + 1 that don't overlap. A match of a text of n characters has at
    most 10/9 n, so e is n // 9."""
    f = freq[(h & np.uint64(TABLE - 1)).astype(np.int64)]
    edits = lens // 9
    out = []
    short = np.flatnonzero(lens <= PLANNED)
    if len(short):
        column = np.full(len(lens), -1)
        column[short] = np.arange(len(short))
        k = np.flatnonzero(column[owner] >= 0)
        m = int(lens[short].max()) - Q + 1
        cost, number = np.full((m, len(short)), np.inf, np.float32), np.zeros((m, len(short)), np.int64)
        cost[place[k], column[owner[k]]] = f[k] + np.float32(0.05)
        number[place[k], column[owner[k]]] = k
        who, where = _planned(cost, edits[short], lens[short])
        out.append(number[where, who])
    k = np.flatnonzero(lens[owner] > PLANNED)
    if len(k):
        step = lens // (edits + 1)
        cell = np.minimum(place[k] // step[owner[k]], edits[owner[k]])
        within = place[k] + Q <= np.where(cell == edits[owner[k]], lens[owner[k]], (cell + 1) * step[owner[k]])
        k, cell = k[within], cell[within]
        order = np.lexsort((h[k], f[k], cell, owner[k]))
        first = np.ones(len(order), bool)
        first[1:] = (cell[order][1:] != cell[order][:-1]) | (owner[k][order][1:] != owner[k][order][:-1])
        out.append(k[order[first]])
    return np.concatenate(out)


def cells(h: np.ndarray, length: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """Numbers below bits, a power of two, of runs with a cell of length and one of place."""
    x = h ^ (length.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + place.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    return ((x ^ (x >> np.uint64(29))) & np.uint64(bits - 1)).astype(np.int64)


def length_cell(n: np.ndarray) -> np.ndarray:
    return np.floor(np.log(n) / np.log(LENGTH_BASE)).astype(np.int64)


def listed_cells(h: np.ndarray, n: np.ndarray, place: np.ndarray, bits: int) -> np.ndarray:
    """All bits that a match of listed runs may have: lengths of 0.9 to 1.12 n and places within e."""
    e = n // 9
    out = []
    lo, hi = length_cell(np.maximum(1, np.floor(0.9 * n))), length_cell(np.ceil(1.112 * n))
    plo, phi = np.maximum(0, place - e) // PLACE_CELL, (place + e) // PLACE_CELL
    for i in range(int((hi - lo).max(initial=0)) + 1):
        for j in range(int((phi - plo).max(initial=0)) + 1):
            m = (lo + i <= hi) & (plo + j <= phi)
            out.append(cells(h[m], (lo + i)[m], (plo + j)[m], bits))
    return np.concatenate(out) if out else np.empty(0, np.int64)


#: Two bits for a count modulo 4, so that counts differ in as many bits as they are apart (0 and 3 in one).
CIRCLE = np.array([0, 1, 3, 2], np.uint64)


def signatures(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of each text how many characters, and pairs of neighbours, fall into each of 32 classes, modulo 4, in 64 bits. An
    edit changes two and four of these bits at most."""
    codes = [char_codes(t) for t in texts]
    lens = np.array([len(c) for c in codes], np.int64)
    owner, flat = np.repeat(np.arange(len(codes)), lens), np.concatenate(codes)
    inner = owner[:-1] == owner[1:]
    out = []
    for values, of in ((flat, owner), (flat[:-1][inner] * np.uint32(31) + flat[1:][inner], owner[1:][inner])):
        mixed = values.astype(np.uint32) * np.uint32(2654435761) >> np.uint32(26) & np.uint32(31)
        counts = np.bincount(of * 32 + mixed, minlength=32 * len(codes)).reshape(-1, 32) & 3
        out.append((CIRCLE[counts] << np.arange(0, 64, 2, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64))
    return out[0], out[1]


def _records(df: DataFrame, key: str, text: str, split: str, least: int, texts: bool) -> DataFrame:
    """(side, tid, t) of the rows long enough, or (id, side, tid); tid is a 128-bit hash of the normal form."""
    names = ["side", "tid", "t"] if texts else ["id", "side", "tid"]

    def run(b: pa.RecordBatch):
        ts = [None if t is None else normal(t) for t in b.column(1).to_pylist()]
        keep = [i for i, t in enumerate(ts) if t is not None and len(t) >= least]
        at = pa.array(keep, pa.int32())
        cols = {"id": b.column(0).take(at), "side": b.column(2).take(at), "tid": pa.array([xxhash.xxh128_digest(ts[i]) for i in keep], pa.binary())}
        if texts:
            cols["t"] = pa.array([ts[i] for i in keep], pa.string())
        yield pa.RecordBatch.from_arrays([cols[n] for n in names], names)

    d = df.select(F.col(key).cast("string").alias("id"), F.col(text), _split_class(split).alias("side")).where(F.col("id").isNotNull() & F.col("side").isNotNull())
    kinds = {"id": "string", "side": "int", "tid": "binary", "t": "string"}
    return map_batches(d, run, ", ".join(f"{n} {kinds[n]}" for n in names))


def _salts(f: np.ndarray) -> np.ndarray:
    """Over how many tasks the rows of runs of these counts are spread."""
    return np.clip(np.ceil(f / HOT_ROWS), 1, 4096).astype(np.int64)


def _salted(h: np.ndarray, salt: np.ndarray) -> np.ndarray:
    return h + salt.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _runs(texts: DataFrame, side: int, freq, bits=None) -> DataFrame:
    """(h, tk, at, chars, pairs), at being length and place and tk the beginning of tid: the runs chosen by weight, one for
    each of their salts, or all runs that the bitmap has, with one salt."""

    def run(b: pa.RecordBatch):
        for p in pieces(b, 2_000):
            ts = p.column(1).to_pylist()
            keys = np.array([int.from_bytes(t[:8], "big", signed=True) for t in p.column(0).to_pylist()], np.int64)
            h, owner, place, lens = flat_runs(ts)
            k = np.arange(len(h)) if bits is not None else listed_runs(h, owner, place, lens, freq.value)
            n = _salts(freq.value[(h[k] & np.uint64(TABLE - 1)).astype(np.int64)])
            if bits is None:
                k = np.repeat(k, n)
                salt = np.arange(len(k)) - np.repeat(np.cumsum(n) - n, n)
                salted = _salted(h[k], salt)
            else:
                salted = _salted(h, keys[owner] % n)
                at = cells(salted, length_cell(lens)[owner], place // PLACE_CELL, 8 * len(bits.value))
                k = _has(bits.value, at)
                salted = salted[k]
            chars, neighbours = signatures(ts)
            cols = (salted.view(np.int64), keys[owner[k]], lens[owner[k]] << 32 | place[k], chars[owner[k]], neighbours[owner[k]])
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h", "tk", "at", "chars", "pairs"])

    return map_batches(texts.where(F.col("side") == side).select("tid", "t"), run, "h long, tk long, at long, chars long, pairs long")


def pack(a: np.ndarray) -> bytes:
    """The bytes of an array compressed, the first of all numbers before the second: the high ones are mostly 0."""
    return pa.compress(a.view(np.uint8).reshape(-1, a.itemsize).T.tobytes(), codec="zstd", asbytes=True)


def unpack(x: bytes, n: int, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    flat = np.frombuffer(pa.decompress(x, n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(size, n).T).reshape(-1).view(kind)


class Packed:
    """An array to broadcast: compressed in the driver and in the files that it and each executor keep, and the array
    itself where it is read."""

    def __init__(self, a: np.ndarray) -> None:
        self.args = pack(a), len(a), a.dtype.str

    def __reduce__(self):
        return unpack, self.args


def _frequencies(texts: DataFrame) -> np.ndarray:
    """How many runs of all texts fall into each cell of the table. A task counts its own in one table, and its parts
    are sent compressed and added up, so what is shuffled follows the tasks and not the runs."""

    def count(batches):
        have = np.zeros(TABLE, np.uint32)
        for b in batches:
            for p in pieces(b, 2_000):
                np.add.at(have, (flat_runs(p.column(0).to_pylist())[0] & np.uint64(TABLE - 1)).astype(np.int64), np.uint32(1))
        parts = have.reshape(-1, TABLE_PART)
        k = np.flatnonzero(parts.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array([pack(parts[i]) for i in k], pa.binary())], ["part", "n"])

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(TABLE_PART, np.uint64)
        for x in t.column("n").to_pylist():
            total += unpack(x, TABLE_PART, "uint32")
        n = pack(np.minimum(total, 0xFFFFFFFF).astype(np.uint32))
        return pa.Table.from_arrays([t.column("part").combine_chunks()[:1], pa.array([n], pa.binary())], ["part", "n"])

    got = texts.select("t").mapInArrow(count, "part long, n binary").groupBy("part").applyInArrow(add, "part long, n binary").toArrow()
    out = np.zeros((TABLE // TABLE_PART, TABLE_PART), np.uint32)
    for k, x in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
        out[k] = unpack(x, TABLE_PART, "uint32")
    return out.reshape(-1)


def _shares(freq: np.ndarray, rows: int) -> np.ndarray:
    """The counts as shares of so many texts, in 65,536ths below 1."""
    return np.minimum(freq * (65_536 / max(rows, 1)), 65_535).astype(np.uint16)


def _bitmap(df: DataFrame, columns: list[str], wanted: int, places) -> np.ndarray:
    """The bits that places(size, *columns) names, of some so many: each task sets its own in words of 64, which are then
    joined."""
    size = BITMAPS[0]
    while size < min(wanted, BITMAPS[1]):
        size *= 2

    def run(batches):
        have = np.zeros(size // 8, np.uint8)
        for b in batches:
            at = places(size, *(b.column(i).to_numpy() for i in range(len(columns))))
            np.bitwise_or.at(have, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        w = have.view(np.int64)
        k = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(w[k])], ["w", "bits"])

    got = df.select(*columns).mapInArrow(run, "w long, bits long").groupBy("w").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[got.column(0).to_numpy()] = got.column(1).to_numpy()
    return out.view(np.uint8)


def _has(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)


def _listed_bits(listed: DataFrame) -> np.ndarray:
    """The bitmap of all listed runs; a run has some four cells."""
    return _bitmap(listed, ["h", "at"], 256 * listed.count(), lambda size, h, at: listed_cells(h.view(np.uint64), at >> 32, at & 0xFFFFFFFF, size))


def _wanted(texts: DataFrame, side: int, cand: DataFrame, x: str) -> DataFrame:
    """(tk_x, tid_x, t_x): the texts of a side that candidates have, and the few others that share a bit with them: only
    these are shuffled."""
    bits = texts.sparkSession.sparkContext.broadcast(Packed(_bitmap(cand, [f"tk_{x}"], 64 * cand.count(), lambda size, tk: tk & (size - 1))))

    def run(b: pa.RecordBatch):
        tk = np.frombuffer(b"".join(b.column(0).to_pylist()), ">i8")[::2].astype(np.int64)
        k = _has(bits.value, tk & (8 * len(bits.value) - 1))
        yield pa.RecordBatch.from_arrays([pa.array(tk[k]), *[b.column(i).take(pa.array(k)) for i in range(2)]], [f"tk_{x}", f"tid_{x}", f"t_{x}"])

    return map_batches(texts.where(F.col("side") == side).select("tid", "t"), run, f"tk_{x} long, tid_{x} binary, t_{x} string")


def may_match(x: list[str], y: list[str], freq: np.ndarray) -> np.ndarray:
    """For each pair whether the dot product of the vectors reaches what the edit limit leaves of both. Pairs are bounded
    by their norms first; what passes has its exact product, for all pairs at once."""
    names = {t: i for i, t in enumerate(dict.fromkeys([*x, *y]))}
    a, b = np.array([names[t] for t in x], np.int64), np.array([names[t] for t in y], np.int64)
    h, owner, _, lens = flat_runs(list(names))
    w = 1.0 - freq[(h & np.uint64(TABLE - 1)).astype(np.int64)] / 65_536.0
    # sums of each text's greatest squared weights: sums[first + m] - sums[first] are the m greatest
    first = np.searchsorted(owner, np.arange(len(lens) + 1))
    sums = np.concatenate([[0.0], np.cumsum(w[np.lexsort((-w, owner))])])
    edits = np.maximum(lens[a], lens[b]) // 10

    def left(t: np.ndarray) -> np.ndarray:
        return sums[first[t + 1]] - sums[np.minimum(first[t] + Q * edits, first[t + 1])]

    least = np.maximum(left(a), left(b)) - 1e-6
    runs, number = np.unique(h, return_inverse=True)
    terms, at, counts = np.unique(owner * len(runs) + number, return_index=True, return_counts=True)
    start = np.searchsorted(terms, np.arange(len(lens) + 1) * len(runs))
    squares = np.concatenate([[0.0], np.cumsum(counts.astype(np.float64) ** 2 * w[at])])
    norm = np.sqrt(squares[start[1:]] - squares[start[:-1]])
    live = np.flatnonzero(norm[a] * norm[b] >= least)
    n = (start[1:] - start[:-1])[a[live]]
    mine = np.repeat(start[a[live]], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wanted = terms[mine] % len(runs) + np.repeat(b[live], n) * len(runs)
    met = np.minimum(np.searchsorted(terms, wanted), len(terms) - 1)
    dot = np.bincount(np.repeat(np.arange(len(live)), n), np.where(terms[met] == wanted, counts[mine] * counts[met] * w[at[mine]], 0.0), len(live))
    out = np.zeros(len(x), bool)
    out[live] = dot >= least[live]
    return out


def _scored(pairs: DataFrame, freq) -> DataFrame:
    """The pairs (.., t_a, t_b) whose exact dot product reaches the bound."""

    def run(b: pa.RecordBatch):
        for p in pieces(b, 1_000):
            ta, tb = (p.column(p.schema.get_field_index(c)).to_pylist() for c in ("t_a", "t_b"))
            yield p.filter(pa.array(may_match(ta, tb, freq.value)))

    return map_batches(pairs, run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema.fields))


def text_links(df: DataFrame, key: str = "id", text: str = "text", split: str = "split", least: int = 30) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (tid_a, tid_b) between distinct texts, the first of an evaluation split and the
    second of train; members (id, side, tid) of every record, side 1 being evaluation. See text_overlap."""
    spark = df.sparkSession
    texts = materialize(_records(df, key, text, split, least, True).groupBy("side", "tid").agg(F.first("t").alias("t")), "texts")
    counts = _frequencies(texts)
    freq, shares = (spark.sparkContext.broadcast(Packed(x)) for x in (counts, _shares(counts, texts.count())))
    listed = materialize(_runs(texts, 1, freq), "listed")
    met = _runs(texts, 0, freq, spark.sparkContext.broadcast(Packed(_listed_bits(listed))))
    a = listed.select("h", *[F.col(c).alias(f"{c}_a") for c in ("tk", "at", "chars", "pairs")])
    b = met.select("h", *[F.col(c).alias(f"{c}_b") for c in ("tk", "at", "chars", "pairs")])
    len_a, len_b = F.shiftright("at_a", 32), F.shiftright("at_b", 32)
    place_a, place_b = (F.col(c).bitwiseAND(F.lit(0xFFFFFFFF)) for c in ("at_a", "at_b"))
    e = F.floor(F.greatest(len_a, len_b) / 10)
    apart = lambda c: F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    near = (F.abs(len_a - len_b) <= e) & (F.abs(place_a - place_b) <= e) & (apart("chars") <= 2 * e) & (apart("pairs") <= 4 * e)
    cand = materialize(a.join(b, "h").where(near).select("tk_a", "tk_b").distinct(), "candidates")
    # texts are fetched by the beginning of their hash: two that share it are both fetched, and looked at
    both = cand.join(_wanted(texts, 1, cand, "a"), "tk_a").join(_wanted(texts, 0, cand, "b"), "tk_b")
    limit = F.floor(F.greatest(F.length("t_a"), F.length("t_b")) / 10).cast("int")
    close = _scored(both, shares).where((F.col("t_a") == F.col("t_b")) | (F.call_function("levenshtein", F.col("t_a"), F.col("t_b"), limit) >= 0))  # -1 beyond the limit
    return materialize(close.select("tid_a", "tid_b"), "close"), _records(df, key, text, split, least, False)


def text_overlap(df: DataFrame, key: str = "id", text: str = "text", split: str = "split", least: int = 30) -> DataFrame:
    """(id_a, id_b): one record in train, the other in validation or test, whose normal forms both have at
    least so many code points and differ by at most a tenth of the longer one's length in edits of one
    character. Case and outer blanks of splits don't count; null ids, texts and splits, and shorter texts
    are no case; repeated rows count once; a key is never paired with itself; an empty table gives no rows.
    Copies of a text meet as one and are expanded last."""
    links, members = text_links(df, key, text, split, least)
    mine = lambda k, x, y: members.where(F.col("side") == k).join(links.select(f"tid_{x}").distinct(), F.col("tid") == F.col(f"tid_{x}"), "left_semi").select(F.col("tid").alias(f"tid_{x}"), F.col("id").alias(y)).distinct()
    pairs = links.join(mine(1, "a", "x"), "tid_a").join(mine(0, "b", "y"), "tid_b")
    return pairs.where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def _meets_another(train: DataFrame, on: str, evaluation: DataFrame) -> DataFrame:
    """(id): of the evaluation rows (on, id) those that a training row (on, id) of another key meets. The least and the
    greatest key of a group tell that, so no pair is made."""
    ends = train.groupBy(on).agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return evaluation.join(ends, on).where("id <> lo or id <> hi").select("id").distinct()


def overlapping_texts(df: DataFrame, key: str = "id", text: str = "text", split: str = "split", least: int = 30) -> DataFrame:
    """(id): the evaluation records of text_overlap, without any pair of copies being made."""
    links, members = text_links(df, key, text, split, least)
    near = members.where("side = 0").join(links, F.col("tid") == F.col("tid_b")).groupBy("tid_a").agg(F.min("id").alias("lo"), F.max("id").alias("hi"))
    return members.where("side = 1").join(near, F.col("tid") == F.col("tid_a")).where("id <> lo or id <> hi").select("id").distinct()


def _images(df: DataFrame, key: str, image: str, split: str) -> DataFrame:
    d = df.select(F.col(key).cast("string").alias("id"), F.lower(F.trim(F.col(image))).alias("h"), _split_class(split).alias("side")).where("id is not null and h <> '' and side is not null")
    return d.groupBy("h", "id", "side").agg(F.lit(1).alias("one"))


def overlapping_images(df: DataFrame, key: str = "id", image: str = "image_sha256", split: str = "split") -> DataFrame:
    """(id): the evaluation records of image_overlap, without any pair of copies being made."""
    d = _images(df, key, image, split)
    return _meets_another(d.where("side = 0").select("h", "id"), "h", d.where("side = 1").select("h", "id"))


def image_overlap(df: DataFrame, key: str = "id", image: str = "image_sha256", split: str = "split") -> DataFrame:
    """(id_a, id_b): one record in train, the other in validation or test, with the same hash but for the
    case of its letters. Null and blank hashes, null ids and splits are no case; repeated rows count once."""
    d = _images(df, key, image, split)
    x, y = d.where("side = 1").select("h", F.col("id").alias("x")), d.where("side = 0").select("h", F.col("id").alias("y"))
    return x.join(y, "h").where("x <> y").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def overlap_report(ids: DataFrame, df: DataFrame, key: str, split: str, source: str) -> DataFrame:
    """(split, source, records): evaluation records with these ids by split and source (null sources count as one)."""
    d = df.select(F.col(key).cast("string").alias("id"), F.lower(F.trim(F.col(split))).alias("split"), F.col(source).alias("source")).where("split in ('validation', 'test')")
    return d.join(ids, "id", "left_semi").groupBy("split", "source").agg(F.count_distinct("id").alias("records"))
