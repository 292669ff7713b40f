import os
import random
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from bohagi.llm import bpe, encoding, grouped_splits, leakage, lookalikes, near_duplicates, packing, quality, scans, split_overlap, term_counts, trie, union_find

RANKS = encoding.rank_file("byte_bpe_50k")
LETTERS = "কখগঘচজটডতদনপফবমযৰলসহ"


def made_up(rnd, n):
    return ["".join(rnd.choice(LETTERS) for _ in range(rnd.randint(2, 6))) for _ in range(n)]


def test_encoding_equals_the_library(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = bpe.load_ranks(RANKS)
    lib = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["", " ", "মই অসমীয়া কওঁ।", "a" * 5000, "ab  \n\n c\t\t d  ", "<|endoftext|>", "🙂 it's  we'll 123", "ল া ট", "x y z", "\x00\x01", "ক" * 3000]
    d = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(99, None, 1), (99, None, 1)], "doc_id long, text string, ids int")
    got = encoding.encode_corpus(d).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert r["ids"] == (lib.encode_ordinary(texts[r["doc_id"]]) if r["doc_id"] < 99 else [])
    n = {r["doc_id"]: r["n_ids"] for r in encoding.count_ids(d).collect()}
    assert all(n[r["doc_id"]] == len(r["ids"]) for r in got)
    assert encoding.encode_corpus(d.limit(0)).count() == 0


def test_term_counts(spark, tmp_path):
    rnd = random.Random(1)
    words = made_up(rnd, 60)
    old = {i: " ".join(rnd.choices(words, k=rnd.randint(0, 12))) if i % 9 else None for i in range(80)}
    new = {i: t for i, t in old.items() if i % 7} | {i: "  ".join(rnd.choices(words, k=5)) for i in range(70, 95)} | {3: None}
    frame = lambda d: spark.createDataFrame(list(d.items()), "k int, text string")
    c = term_counts.TermCounts(spark, str(tmp_path / "a"), "words")
    c.apply(term_counts.added(frame(old), "text"))
    c.apply(term_counts.changes_between(frame(old), frame(new), "k", "text"))
    want_occ, want_rec = Counter(), Counter()
    for t in new.values():
        if t is not None:
            want_occ.update(t.split())
            want_rec.update(set(t.split()))
    again = term_counts.TermCounts(spark, str(tmp_path / "a"), "words")
    assert {r["term"]: (r["occurrences"], r["records"]) for r in again.counts().collect()} == {w: (want_occ[w], want_rec[w]) for w in want_occ}
    assert again.records == sum(t is not None for t in new.values())
    c.apply(term_counts.changes_between(frame(new), frame(new), "k", "text"))
    c.apply(term_counts.changes_between(frame(new), frame(new).limit(0), "k", "text"))
    assert c.counts().count() == 0 and c.records == 0
    e = term_counts.TermCounts(spark, str(tmp_path / "b"), "characters")
    e.apply(term_counts.added(spark.createDataFrame([(" a  b ",), ("",), (None,), ("a" * 5000,)], "text string"), "text"))
    assert {r["term"]: (r["occurrences"], r["records"]) for r in e.counts().collect()} == {"a": (5001, 2), "b": (1, 1), " ": (1, 1)}
    assert {(r["term"], r["mark"]) for r in e.marked().collect()} == {("a", "rare"), ("a", "common"), ("b", "rare"), (" ", "rare")}
    assert term_counts.TermCounts(spark, str(tmp_path / "c")).counts().count() == 0


def test_small_changes_write_little_and_breaks_lose_nothing(spark, tmp_path, monkeypatch):
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string")
    path = tmp_path / "a"
    c = term_counts.TermCounts(spark, str(path), "words")
    old = [f"w{i} w{i + 1} x" for i in range(1000)]
    c.apply(term_counts.added(frame(old), "text"))
    whole = c.state["runs"][0]
    c.apply(term_counts.added(frame(old[:10]), "text"))
    assert c.state["runs"][0] == whole and c.state["runs"][1]["terms"] == 12  # the state is not written again
    want = Counter(w for t in old + old[:10] for w in t.split())
    held = lambda x: {r["term"]: r["occurrences"] for r in x.counts().collect()}
    assert held(c) == want and c.records == 1010
    # broken off before, and after, the manifest is in its place
    for step in ("_write_manifest", "_clean"):
        with monkeypatch.context() as m:
            m.setattr(term_counts.TermCounts, step, lambda *a: (_ for _ in ()).throw(OSError("killed")))
            with pytest.raises(OSError):
                term_counts.TermCounts(spark, str(path), "words").apply(term_counts.added(frame(["x y"]), "text"))
        if step == "_clean":
            want.update(["x", "y"])
        assert held(term_counts.TermCounts(spark, str(path), "words")) == want
    (path / "manifest-000000000009.json.new").write_text("{")  # half a manifest
    c = term_counts.TermCounts(spark, str(path), "words")
    for _ in range(6):
        c.apply(term_counts.added(frame(["x y"]), "text"))
        want.update(["x", "y"])
    assert held(c) == want and len(c.state["runs"]) <= 3 and sum(1 for _ in path.iterdir()) <= 12
    two = term_counts.TermCounts(spark, str(path), "words")
    c.apply(term_counts.added(frame(["z"]), "text"))
    with pytest.raises(OSError):  # a second writer does not overwrite
        two.apply(term_counts.added(frame(["z"]), "text"))


def shingle_pairs(docs, k, threshold, least):
    s = {}
    for i, t in docs:
        w = unicodedata.normalize("NFC", t or "").split()
        if len(w) >= max(least, k):
            s[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    ids = sorted(s)
    return {(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if len(s[a] & s[b]) >= threshold * len(s[a] | s[b]) - 1e-12}


@pytest.mark.parametrize("k,threshold,small", [(3, 0.5, False), (5, 0.8, False), (3, 0.5, True)])
def test_near_duplicates_against_brute_force(spark, monkeypatch, k, threshold, small):
    if small:  # hot hashes and grids as a large collection has them
        monkeypatch.setattr(near_duplicates, "HOT_ROWS", 10)
        monkeypatch.setattr(near_duplicates, "TILE", 2)
    rnd = random.Random(k)
    words = made_up(rnd, 40)
    docs, hot = [], " ".join(rnd.choices(words, k=30))
    for i in range(60):
        t = rnd.choices(words, k=rnd.randint(10, 60))
        docs.append((i * 10, " ".join(t)))
        for j in range(rnd.randint(0, 3)):
            u = list(t)
            for _ in range(rnd.randint(0, 6)):
                u[rnd.randrange(len(u))] = rnd.choice(words)
            docs.append((i * 10 + j + 1, " ".join(u)))
    docs += [(5000 + i, hot) for i in range(40)] + [(6000 + i, hot + " " + rnd.choice(words)) for i in range(10)]  # a third of all
    docs += [(7000, None), (7001, ""), (7002, "  "), (7003, "a b"), (None, hot), (8000, "w " * 3000), (8001, "w " * 3000)]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, h string, n int")
    d = d.unionByName(d.where("doc_id = 5000"))
    want = shingle_pairs([x for x in docs if x[0] is not None], k, threshold, 20)
    got = {tuple(r) for r in near_duplicates.near_duplicate_pairs(d, k=k, threshold=threshold, least_words=20).collect()}
    assert got == want
    g = {r["doc_id"]: r for r in near_duplicates.near_duplicate_groups(d, k=k, threshold=threshold, least_words=20).dropDuplicates(["doc_id"]).collect()}
    degree = Counter(x for p in want for x in p)
    assert {i: r["links"] for i, r in g.items()} == dict(degree)
    assert all(g[a]["class_id"] == g[b]["class_id"] for a, b in want)
    assert near_duplicates.near_duplicate_pairs(d.limit(0), k=k, threshold=threshold).count() == 0


def test_components_both_ways(spark):
    rnd = random.Random(2)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, None), (7, 7)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if b is not None and a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    want = {x: root(x) for x in list(parent)}
    d = spark.createDataFrame(edges, "a long, b long").repartition(12)
    for block in (union_find.BLOCK, 3):
        rows = union_find.components(d, block=block).collect()
        assert len(rows) == len(want) and {r["node"]: r["root"] for r in rows} == want
    assert union_find.components(d.limit(0)).count() == 0


def test_grouped_splits(spark):
    rows = [("w:1:0", "A", "train"), ("w:2:0", "A ", "test"), ("w:3:0", None, "train"), ("w:3:1", None, " Train"), ("w:4:0", None, None), ("w:5:0", "", "test"), ("w:6:0", " ", "train"), ("w:7:0", "B", "train"), ("w:7:1", "C", "train"), ("w:8:0", "C", "validation"), (None, "A", "test")]
    rows += [(f"w:{100 + i}:{j}", f"T{i}", "train") for i in range(40) for j in range(i % 5 + 1)] + [("w:900:" + str(j), "big", "train") for j in range(60)]
    d = spark.createDataFrame([(*r, 1) for r in rows + rows[:2]], "id string, source_title string, split string, grp int")
    assert sorted(r[0] for r in grouped_splits.torn_sources(d).collect()) == ["1", "2", "7", "8"]
    got = grouped_splits.grouped_splits(d, {"train": 0.6, "validation": 0.2, "test": 0.2}).collect()
    assert len({r["source_id"] for r in got}) == len(got) == len({r[0].split(":")[1] for r in rows if r[0]})
    by_group = defaultdict(set)
    for r in got:
        by_group[r["grp"]].add(r["split"])
    assert all(len(s) == 1 for s in by_group.values()) and next(r for r in got if r["source_id"] == "900")["split"] == "train"
    size = Counter()
    for r in got:
        size[r["split"]] += r["records"]
    total = sum(size.values())
    assert abs(size["test"] / total - 0.2) < 0.03 and abs(size["validation"] / total - 0.2) < 0.03
    assert grouped_splits.torn_sources(d.limit(0)).count() == 0 and grouped_splits.grouped_splits(d.limit(0)).count() == 0


def test_plan_of_sizes_is_the_greedy_one():
    sizes, targets = [(9, 3), (4, 7), (1, 25)], {"a": 0.7, "b": 0.2, "c": 0.1}
    total = sum(s * c for s, c in sizes)
    have = dict.fromkeys(targets, 0)
    want = defaultdict(Counter)
    for s, c in sizes:
        for _ in range(c):
            k = max(targets, key=lambda n: targets[n] * total - have[n])
            have[k] += s
            want[s][k] += 1
    got = grouped_splits.plan_sizes(sizes, targets)
    sums = Counter()
    for s, parts in got.items():
        assert sum(n for _, n in parts) == dict(sizes)[s]
        for k, n in parts:
            sums[k] += s * n
    assert all(abs(sums[k] - have[k]) <= 4 for k in targets)


def test_look_alikes(spark):
    same = [("wеа", "wea"), ("сара", "capa"), ("অা​ম", "আম"), ("a b", "a b"), ("কে​া", "কো"), ("１２３，", "123,"), ("শেষ৷", "শেষ|"), ("ড়", "ড়"), ("é", "é"), ("ক­⁠খ", "কখ"), ("ﬁn", "fin"), ("ৎ", "ত্‍")]
    same += [("ɡood", "good"), ("кino", "kino"), ("κai", "kai"), ("оօn", "oon"), ("ıt", "it"), ("Ꭺbc", "Abc"), ("𝐚bc𝐝", "abcd"), ("Ⅳ", "IV"), ("মनা", "মনা"), ("नাम", "নাম"), ("मन", "মন"), ("ꓐꓳꓫ", "BOX"), ("ⲟⲣ", "op"), ("ｶ", "カ")]
    for a, b in same:
        assert lookalikes.canonical(a) == lookalikes.canonical(b), (a, b)
    other = [("ৰ‍্য", "ৰ্য"), ("a b", "ab"), ("১০", "10"), ("ব", "ৰ"), ("жа", "жa"), ("ক্‌ষ", "ক্ষ"), ("é", "e"), ("²", "2"), ("भाषा", "ভাষা"), ("日本ゴ", "日本ㄅ"), ("ς", "s"), ("ß", "B"), ("ſ", "f")]
    for a, b in other:
        assert lookalikes.canonical(a) != lookalikes.canonical(b), (a, b)
    assert lookalikes.canonical("") == "" == lookalikes.canonical("​ ﻿") and len(lookalikes.canonical("ক" * 100_000)) == 100_000
    t = "এই কথা সকলোৱে জানে আৰু মানে"
    rows = [("a", t), ("b", t.replace(" ", " ", 1)), ("c", t.replace(" ", "  ", 2)), ("d", t), ("e", t + "x"), ("f", None), (None, t), ("g", "short"), ("g2", "sh​ort"), ("h", ""), ("a", t)]
    d = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "id string, text string, form int, plain int")
    assert sorted(map(tuple, lookalikes.same_looking(d).collect())) == [("a", "b"), ("b", "c"), ("b", "d")]
    assert lookalikes.same_looking(d.limit(0)).count() == 0
    assert {r["form"] for r in lookalikes.canonical_texts(d, "id", "text").where("id = 'f'").collect()} == {None}


def test_leakage(spark, monkeypatch):
    rnd = random.Random(4)
    words = made_up(rnd, 500)
    items = [(i, " ".join(rnd.sample(words, 30))) for i in range(12)] + [(50, None), (51, "few words"), (52, "")]
    stock = " ".join(rnd.sample(words, 14))
    items[3] = (3, items[3][1] + " " + stock)
    items[4] = (4, stock + ", " + items[4][1])
    docs = [(i, " ".join(rnd.choices(words, k=80))) for i in range(20)]
    cut = lambda i, a, b: " ".join(items[i][1].split()[a:b])
    docs += [(100, "x " + cut(0, 5, 17) + " y"), (101, cut(0, 5, 16)), (102, "(" + cut(1, 0, 30).replace(" ", ", ", 9) + ")"), (103, stock), (104, cut(2, 0, 6) + " zzz " + cut(2, 6, 18)), (105, cut(5, 0, 20).replace("ক", "ক​")), (106, None), (107, ""), (108, "a " * 20_000), (None, cut(0, 0, 20))]
    d = spark.createDataFrame([(*r, "t") for r in docs + docs[20:21]], "doc_id long, text string, item_id string")
    e = spark.createDataFrame(items + items[:1], "item_id long, text string")
    want = set()
    grams = defaultdict(set)
    for i, t in items:
        w = leakage.compared_words(t or "")
        for j in range(len(w) - 11):
            grams[tuple(w[j : j + 12])].add(i)
    for i, t in docs:
        w = leakage.compared_words(t or "")
        want |= {(i, x) for j in range(len(w) - 11) for x in grams.get(tuple(w[j : j + 12]), ()) if i is not None}
    assert {(100, 0), (102, 1), (103, 3), (103, 4), (104, 2), (105, 5)} == want
    assert sorted(map(tuple, leakage.leaked(d, e).collect())) == sorted(want)
    assert sorted(map(tuple, leakage.leaked(d, e, limit=0).collect())) == sorted(want)
    assert leakage.leaked(d, e.limit(0)).count() == 0 and leakage.leaked(d.limit(0), e).count() == 0
    clean = {r["doc_id"]: r for r in leakage.without_leaks(d, e).collect()}
    assert clean[100]["text"] == "x y" and clean[100]["removed"] == 12 and clean[101]["removed"] == 0 and clean[106]["text"] is None
    assert leakage.leaked(leakage.without_leaks(d, e), e).count() == 0
    clean = sorted(map(repr, leakage.without_leaks(d, e).collect()))
    assert sorted(map(repr, leakage.without_leaks(d, e, limit=0).collect())) == clean
    # hashes that collide wherever they can change nothing, on either side of the limit
    whole = leakage.windows
    monkeypatch.setattr(leakage, "windows", lambda h, k: whole(h, k) & np.uint64(7))
    for limit in (0, leakage.BROADCAST_WINDOWS):
        assert sorted(map(tuple, leakage.leaked(d, e, limit=limit).collect())) == sorted(want)
        assert sorted(map(repr, leakage.without_leaks(d, e, limit=limit).collect())) == clean


def test_leakage_size_is_counted_in_windows(spark):
    e = spark.createDataFrame([(1, " ".join("কখগঘচজটডতদনপফ")), (2, "ক খ")], "item_id long, text string")
    assert leakage._size(e, 12) == (2, 25)


def distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        c = [i]
        for j, y in enumerate(b, 1):
            c.append(min(p[j] + 1, c[-1] + 1, p[j - 1] + (x != y)))
        p = c
    return p[-1]


def test_split_overlap_against_brute_force(spark, monkeypatch):
    rnd = random.Random(6)
    words = made_up(rnd, 30)
    rows = []
    for i in range(70):
        t = " ".join(rnd.choices(words, k=rnd.randint(5, 18)))
        rows.append((f"a{i}", t, "train"))
        for j in range(rnd.randint(0, 2)):
            u = list(t)
            for _ in range(rnd.randint(0, len(t) // 8)):
                k = rnd.randrange(len(u))
                u[k : k + 1] = rnd.choice(([], [rnd.choice(LETTERS)], [u[k], rnd.choice(LETTERS)]))
            rows.append((f"b{i}.{j}", "".join(u), rnd.choice([" Test", "VALIDATION", "validation", "train"])))
    hot = " ".join(rnd.choices(words, k=10))
    rows += [(f"h{i}", hot, "train" if i % 2 else "test") for i in range(30)]
    long = " ".join(rnd.choices(words, k=400))
    rows += [("l1", long, "train"), ("l2", long.replace("ক", "খ"), "test"), ("l3", long[:-150], "validation")]
    rows += [("n1", None, "train"), ("n2", hot, None), (None, hot, "test"), ("s1", "short", "train"), ("s2", "short", "test"), ("x", hot + "।", " "), *rows[:3]]
    d = spark.createDataFrame([(*r, 1, 2) for r in rows], "id string, text string, split string, side int, tk int")
    norm = lambda t: " ".join(unicodedata.normalize("NFC", t).split())
    recs = {(i, norm(t), s.strip().lower()) for i, t, s in rows if i and t and s and s.strip() and len(norm(t)) >= 30}
    want = {tuple(sorted((a[0], b[0]))) for a in recs for b in recs if a[2] == "train" != b[2] and a[0] != b[0] and abs(len(a[1]) - len(b[1])) <= max(len(a[1]), len(b[1])) // 10 and (a[1] == b[1] or distance(a[1], b[1]) <= max(len(a[1]), len(b[1])) // 10)}
    got = [tuple(r) for r in split_overlap.text_overlap(d).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 250
    held = {i for i, _, s in recs if s != "train"}
    assert {r["id"] for r in split_overlap.overlapping_texts(d).collect()} == {x for p in want for x in p} & held
    assert split_overlap.text_overlap(d.limit(0)).count() == 0
    # salts, a bitmap that is full and hashes that collide change nothing
    monkeypatch.setattr(split_overlap, "HOT_ROWS", 3)
    monkeypatch.setattr(split_overlap, "BITMAPS", (64, 64))
    assert sorted(map(tuple, split_overlap.text_overlap(d).collect())) == sorted(want)


def test_signatures_bound_the_distance():
    rnd = random.Random(5)
    for t in ["".join(rnd.choices(LETTERS + " ", k=rnd.randint(1, 120))) for _ in range(200)] + ["a" * 500]:
        u = list(t)
        k = rnd.randrange(len(u))
        u[k : k + 1] = rnd.choice(([], ["z"], [u[k], "z"]))
        (c, x), (e, y) = (a.tolist() for a in split_overlap.signatures([t, "".join(u) or "z"]))
        assert ((c ^ x) & (1 << 64) - 1).bit_count() <= 2 and ((e ^ y) & (1 << 64) - 1).bit_count() <= 4


def test_weighted_vectors_keep_every_match():
    rnd = random.Random(12)
    freq = np.array([rnd.choice((0, 0, 3, 900, 60_000)) for _ in range(split_overlap.TABLE // 64)] * 64, np.uint16)
    xs, ys, cs = [], [], []
    for _ in range(300):
        x = [rnd.choice("abcd ") for _ in range(rnd.randint(30, 90))]
        y = list(x)
        for _ in range(rnd.randint(0, len(x) // 10)):
            k = rnd.randrange(len(y))
            y[k : k + 1] = rnd.choice(([], ["z"], [y[k], "z"]))
        if distance("".join(x), "".join(y)) <= max(len(x), len(y)) // 10:
            xs.append("".join(x))
            ys.append("".join(y))
            cs.append("".join(rnd.sample(x, len(x))))
    assert split_overlap.may_match(xs, ys, freq).all() and split_overlap.may_match(xs, cs, freq).mean() < 0.1

    def terms(t):
        h = split_overlap.flat_runs([t])[0]
        return Counter(h.tolist())

    def weight(h):
        return 1 - int(freq[h & (split_overlap.TABLE - 1)]) / 65_536

    def expected(x, y):
        e, a, b = max(len(x), len(y)) // 10, terms(x), terms(y)
        left = [sum(sorted((weight(h) for h in t.elements()), reverse=True)[split_overlap.Q * e :]) for t in (a, b)]
        return sum(n * b[h] * weight(h) for h, n in a.items()) >= max(left) - 1e-6

    mixed = list(zip(xs, ys))[:60] + list(zip(xs, cs))[:60] + list(zip(xs, ys[1:]))[:60] + [("ab" * 30, "ab" * 31)]
    assert split_overlap.may_match(*map(list, zip(*mixed)), freq).tolist() == [expected(x, y) for x, y in mixed]


def test_runs_of_all_texts_are_counted(spark):
    d = spark.range(0, 50_000, 1, 4).select(F.concat(F.lit("ABCDEF"), F.lpad(F.col("id").cast("string"), 6, "x")).alias("t"))
    d = d.unionByName(spark.createDataFrame([("GHIJKL",)], "t string"))
    freq = split_overlap._frequencies(d)
    want = np.zeros(split_overlap.TABLE, np.int64)
    np.add.at(want, (split_overlap.flat_runs([r["t"] for r in d.collect()])[0] & np.uint64(split_overlap.TABLE - 1)).astype(np.int64), 1)
    cell = lambda t: int(split_overlap.flat_runs([t])[0][0] & np.uint64(split_overlap.TABLE - 1))
    assert (freq == want).all() and freq[cell("ABCDEF")] >= 50_000 and freq[cell("GHIJKL")] >= 1
    assert not split_overlap._frequencies(d.limit(0)).any()


def test_only_texts_of_candidates_are_shuffled(spark):
    key = lambda i: f"{i:016d}".encode()
    texts = spark.createDataFrame([(i % 2, key(i), f"t{i}") for i in range(4_000)], "side int, tid binary, t string")
    tk = lambda i: int.from_bytes(key(i * 10**10)[:8], "big", signed=True)
    texts = texts.unionByName(spark.createDataFrame([(s, key(i * 10**10), f"c{i}{s}") for i in range(3, 6) for s in (0, 1)], "side int, tid binary, t string"))
    cand = spark.createDataFrame([(tk(3), tk(4)), (tk(5), tk(4))], "tk_a long, tk_b long")
    a, b = (split_overlap._wanted(texts, side, cand, x).collect() for side, x in ((1, "a"), (0, "b")))
    assert {(r["tk_a"], r["tid_a"], r["t_a"]) for r in a} >= {(tk(i), key(i * 10**10), f"c{i}1") for i in (3, 5)} and len(a) < 10
    assert {r["t_b"] for r in b} >= {"c40"} and len(b) < 10
    assert split_overlap._wanted(texts, 0, cand.limit(0), "b").count() == 0


def test_image_overlap(spark):
    d = spark.createDataFrame([("1", "AB", "train"), ("2", "ab", "Test "), ("3", None, "test"), ("4", "ab", None), ("2", "ab", "Test "), ("5", "", "train"), ("6", "", "test")], "id string, image_sha256 string, split string")
    assert [tuple(r) for r in split_overlap.image_overlap(d).collect()] == [("1", "2")]
    assert [tuple(r) for r in split_overlap.overlap_report(split_overlap.overlapping_images(d), d.withColumn("s", F.lit(None).cast("string")), "id", "split", "s").collect()] == [("test", None, 1)]


@pytest.mark.parametrize("shape", ["long tail", "all short", "all long", "third alike"])
def test_packing(spark, shape):
    rnd = random.Random(8)
    sizes = {"long tail": [int(min(9000, rnd.paretovariate(1.1) * 90)) for _ in range(1500)], "all short": [rnd.randint(1, 20) for _ in range(900)], "all long": [rnd.randint(4500, 30_000) for _ in range(60)], "third alike": [3000] * 200 + [rnd.randint(1, 8192) for _ in range(400)]}[shape]
    big = (1 << 60) + 1  # keys beyond a double's precision
    d = spark.createDataFrame([(big + i, n, 1) for i, n in enumerate(sizes)] + [(7, None, 1), (8, 0, 1), (None, 5, 1)], "doc_id long, n_ids long, unit int")
    rows = packing.pack(d, 8192).collect()
    parts = defaultdict(list)
    load = Counter()
    for r in rows:
        parts[r["doc_id"]].append((r["part"], r["start"], r["length"]))
        if r["length"]:
            load[r["container"]] += r["length"]
        else:
            assert r["container"] is None
    assert max(load.values()) <= 8192 and sum(load.values()) == sum(sizes) + 5 and parts[None] == [(0, 0, 5)] and parts[7] == parts[8] == [(0, 0, 0)]
    for i, n in enumerate(sizes):
        ps = sorted(parts[big + i])
        assert sum(x[2] for x in ps) == n and len(ps) == max(1, -(-n // 8192)) and all(s == k * 8192 for k, (_, s, _) in enumerate(ps))
    assert len(load) <= {"third alike": 1.15}.get(shape, 1.06) * -(-sum(load.values()) // 8192) + (60 if shape == "all long" else 3)
    assert packing.pack(d.limit(0), 8192).count() == 0


def test_nnls_against_normal_equations():
    rnd = np.random.default_rng(0)
    for _ in range(5):
        a, b = rnd.random((12, 20)), rnd.random(12)
        x = packing.nnls(a, b)
        g = a.T @ (a @ x - b)
        assert (x >= 0).all() and (g > -1e-7).all() and abs(g @ x) < 1e-7


def test_trie_against_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 7))) for _ in range(300)})
    t = trie.Trie(words)
    for q in words[:40] + ["", "abcabcabc", "zz"]:
        for k in (0, 1, 2):
            assert sorted(t.near(q, k)) == sorted((w, e) for w in words if (e := distance(q, w)) <= k)
    v = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    q = spark.createDataFrame([("abca",), (None,), ("abca",)], "query string")
    assert {(r["word"], r["edits"]) for r in trie.near_words(q, v, 1).collect()} == {(w, e) for w in words if (e := distance("abca", w)) <= 1}
    asked = ["", "a", "b", "ab", "abc", "cabca", "x", "zz"] + words[::9]
    got = sorted(tuple(r)[:3] for r in trie.near_words(spark.createDataFrame([(x,) for x in asked], "query string"), v, 1).collect())
    assert got == sorted((x, w, e) for x in set(asked) - {""} for w in words if (e := distance(x, w)) <= 1)
    for k in (0, 2, 3):  # any query, with a sign no word has or without
        asked = ["a", "bc", "a?b", "?", "cab?a", "bbbbbb", *words[::17]]
        got = sorted(tuple(r)[:3] for r in trie.near_words(spark.createDataFrame([(x,) for x in asked], "query string"), v, k).collect())
        assert got == sorted((x, w, e) for x in set(asked) for w in words if (e := distance(x, w)) <= k)
    monkeypatch.setattr(trie, "BLOCK_WORDS", 2)
    assert {(r["word"], r["edits"]) for r in trie.near_words(q, v, 1).collect()} == {(w, e) for w in words if (e := distance("abca", w)) <= 1}
    assert trie.near_words(q.limit(0), v, 1).count() == 0 == trie.near_words(q, v.limit(0), 1).count()


def test_quality(spark):
    prose = "আৰু এই কথা সকলোৱে জানে যে মানুহ ভাল। তেওঁ পিছত কৈছিল, কিন্তু নাই। "
    docs = {
        1: prose * 3, 2: "- এটা\n- দুটা কথা\n- তিনিটা\n- চাৰিটা", 3: "নাম,মূল্য,বছৰ\n1,ক,22\n2,খ,N/A\n3,গ,5\n4,ঘ,6", 4: "ক খ গ ঘ চ ছ জ ঝ ট ঠ ড ঢ", 5: "4hYmL+yy8CIESlhClJCDjbWfT0ba/e+eNGZwukm5u0rYKOpiyvq8lmfbUYUiS5enAsoCb7YOFUS2\nrz8+JVe5sr23nXNHz3ISAhzBUpKqLwn7CGvE22r04TuTeGlTXc6C",
        6: None, 7: "", 8: " \n\t ", 9: prose + "\n- এটা\n- দুটা\n- তিনি", 10: "একে কথা\n" * 20, 11: "ক" * 200_000, 12: "সৰু কথা", 13: "\n".join((prose * 4)[i : i + 60] for i in range(0, 240, 60)), 14: "}@\\/>< $#__>>+ ~}&& ~\\[ /%[¤ <§[~~%", 15: "শীৰ্ষ:\nকলম\nকিতাপ পুথি\nঘৰ\nগছ পাত", 16: "তালিকা\n  এটা দীঘল কথা ইয়াত আছে\n  আৰু এটা\n  তিনি নম্বৰ\n  চাৰি",
    }
    d = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id long, text string, kind string")
    k = {r["doc_id"]: r["kind"] for r in quality.text_statistics(d).collect()}
    assert k == {1: "prose", 2: "list", 3: "table", 4: "junk", 5: "junk", 6: None, 7: None, 8: None, 9: "prose", 10: "junk", 11: "junk", 12: "prose", 13: "prose", 14: "junk", 15: "list", 16: "list"}
    assert quality.text_statistics(d.limit(0)).count() == 0


def test_every_layout_signal_decides(spark):
    table = "নাম   মূল্য  বছৰ\nকলম   12    1990\nকিতাপ  7     2001\nঘৰ    150   1985"
    listed = "কলম কিনা\nদোকানৰ পৰা কিতাপ অনা\nঘৰ\nগছৰ তলত পাত গোটোৱা\nনদী"
    marked = "- আজি ৰাতিপুৱা সোনকালে উঠি নদীৰ পাৰলৈ গৈ গা ধুই আহিব লাগে।\n- দোকানৰ পৰা চাউল, দাইল আৰু তেল কিনি আনিব লাগে।\n- গধূলি চোতাল সাৰি চাকি জ্বলাব লাগে।"
    wrapped = "\n".join(["আৰু এই কথা সকলোৱে জানে", "যে মানুহ ভাল হ'ব পাৰে।", "তেওঁ পিছত কৈছিল নাই বুলি", "কিন্তু কোনো কথা শুনা নগ'ল।"])
    facts = lambda t: dict(zip(quality.NAMES, quality.statistics(t)))
    off = lambda t, f: quality.kind_of({**facts(t), f: 0.0})
    assert [quality.kind_of(facts(t)) for t in (table, listed, marked, wrapped)] == ["table", "list", "list", "prose"]
    assert off(table, "aligned_lines") != "table" != off(table, "length_autocorrelation")
    assert off(listed, "begin_period") == off(marked, "begin_period") == "prose"
    # columns, not counts: as many delimiters a line, but nowhere the same place or number
    assert quality.alignment(["a;b;c", "aa;b;c", "a;bbb;c"]) == (1.0, ";") and quality.alignment(["ab  c", "a  bcd", "abcd  e  f", "xy z"])[0] < 0.7
    assert quality.period(["a", "- b", "a.", "- b", "x.", "- c"]) == 0.5 and quality.length_regularity([10, 40, 10, 40, 10, 40]) > 0.99 > 0.9 > quality.length_regularity([5, 40, 70, 11, 33, 9, 60])


def book(rnd):
    """Pages of a made-up book: (page, line, text) and the kinds that must be found."""
    words = made_up(rnd, 50)
    words = [w + "াত" for w in words]
    lines, want = [], set()
    carry = None
    for pn in range(1, 13):
        page, out = f"পৃষ্ঠা:book.pdf/{pn}", []
        head = "কাব্য সংগ্ৰহ মালা" if pn % 2 == 0 else "প্ৰথম অধ্যায় কথা"
        out.append(head if pn != 6 else "| " + head.replace("ল", "ন"))
        if pn != 1:
            want.add((page, 0, "header"))
        for k in range(8):
            ws = rnd.choices(words, k=6)
            if carry:
                ws[0], carry = carry, None
            if k % 3 == 2:
                w = rnd.choice(words)
                ws.append(w[:2] + "-")
                carry = w[2:]
                want.add((page, len(out), "hyphen"))
            elif k == 4:
                ws.append(ws[1] + " —")
            elif k == 5:
                ws[2] = ws[2][:2] + "#" + ws[2][2:]
                want.add((page, len(out), "misread"))
            out.append(" ".join(ws))
        out.append(f"- {pn + 4} -")
        want.add((page, len(out) - 1, "page_number"))
        lines += [(page, i, t) for i, t in enumerate(out)]
    return lines, want


def test_scans(spark):
    lines, want = book(random.Random(9))
    stamp = F.timestamp_micros(F.lit(1_700_000_000_000_000))
    d = spark.createDataFrame([("book.pdf", p, i, t) for p, i, t in lines] + [("book.pdf", "পৃষ্ঠা:book.pdf/x", 0, None), (None, None, None, "a"), ("book.pdf", lines[0][0], 40, "")], "source_document string, source_page string, line_index int, prediction string").withColumn("ingested_at", stamp)
    d = d.unionByName(d)
    gone = lambda i: i % 5 == 3
    a = spark.createDataFrame([("book.pdf", p, i, t) for p, i, t in lines if not gone(i)], "source_document string, source_page string, line_index int, transcription string")
    none = spark.createDataFrame([], "document_id string, source_page string, line_order int, text string")
    got = {(r["source_table"], r["source_page"], r["line_no"], r["kind"]) for r in scans.noise(d, a, none).collect()}
    assert {x[1:] for x in got if x[0] == "detected_lines"} == want
    assert {x[1:] for x in got if x[0] == "aligned_lines"} == {x for x in want if not gone(x[1])}
    text = {r["source_page"]: r["text"] for r in scans.paragraphs(d, a, none).where("source_table = 'detected_lines'").collect()}
    whole = " ".join(text[f"পৃষ্ঠা:book.pdf/{n}"] for n in range(1, 13))
    assert "- " not in whole and "#" not in whole and "সংগ্ৰহ" not in whole
    assert scans.noise(d.limit(0), a.limit(0), none).count() == 0 == scans.paragraphs(d.limit(0), a.limit(0), none).count()


def test_the_automaton_decides_line_ends(spark):
    ends = [("a", 0, "পথা", "ৰত", False), ("a", 1, "গছ", "বোন", False), ("a", 2, "গছ", "বোল", False), ("a", 3, "গছ", "নদী", False), ("a", 4, "মা", "টি", False), ("a", 5, "নদী", "নদী", False), ("a", 6, "গছ", "xz", True), ("a", 7, "চকু", None, False)]
    facts = spark.createDataFrame([("end", "book", "d", 1, p, n, "d", w1, w2, sure) for p, n, w1, w2, sure in ends], "what string, src string, doc string, pn int, page string, no int, own string, w1 string, w2 string, sure boolean")
    vocab = spark.createDataFrame([("গছ", 9), ("নদী", 9), ("গছবোন", 1), ("মাটি", 1), ("মা", 5), ("চকু", 2)], "word string, n long")
    got = {r["no"]: (r["joined"], r["by"]) for r in scans.broken_words(facts, vocab).collect()}
    # a first part that is no word; a known word joined; one within an edit; a dash; a short rare word; a pair; a sign; a word at the end
    assert got == {0: ("পথাৰত", "automaton"), 1: ("গছবোন", "automaton"), 2: ("গছবোন", "automaton"), 4: ("মাটি", "automaton"), 5: ("নদী-নদী", "sign"), 6: ("গছxz", "sign")}


def test_furniture_has_no_size(spark):
    long, other = "দীঘল শিৰোনাম " * 12, "পথাৰ গছ নদী " * 3
    rows = [(f"p/{n}", i, t) for n in range(12341, 12346) for i, t in enumerate([long if n != 12343 else long.replace("ঘ", "থ", 1), *[f"{other}{n}{k} কথা" for k in range(8)], "-" * 40 + f" {n + 7} " + "-" * 40])]
    d = spark.createDataFrame([("b", *r) for r in rows], "source_document string, source_page string, line_index int, prediction string").withColumn("ingested_at", F.timestamp_micros(F.lit(1)))
    a = spark.createDataFrame([], "source_document string, source_page string, line_index int, transcription string")
    none = spark.createDataFrame([], "document_id string, source_page string, line_order int, text string")
    got = {(r["source_page"], r["line_no"], r["kind"]) for r in scans.noise(d, a, none).collect()}
    assert got == {(f"p/{n}", 9, "page_number") for n in range(12341, 12346)} | {(f"p/{n}", 0, "header") for n in range(12342, 12346)}


def test_paragraphs_go_on_over_pages(spark):
    pages = {
        1: ["কমল নদী পাৰত গছৰ তলত", "মানুহ আহি বহি গান গাই থাকে", "বতাহত ফুলৰ গোন্ধ ভাহি আহে আৰু"],
        2: ["চৰাই মাতে।", "ডাৱৰ গৰজি বৰষুণ আহিল মাঘত পথা‐"],
        3: ["ৰত। ধান চপাই ঘৰলৈ অনা হয় সোনকালে", "লৰাহঁতে উমলে।", "শীতৰ দিনত জুই পুৱাই থকা বুঢ়াবোৰ"],
        4: ["   "],
        5: ["গল্প কয়।", "হাটত বেপাৰী আহি দোকান মেলি বহিছে"],
        7: ["আকাশত তৰা জিলিকি উঠিল সন্ধিয়া পৰত"],
    }
    stamp = F.timestamp_micros(F.lit(1_700_000_000_000_000))
    rows = [("b.pdf", f"পৃষ্ঠা:b.pdf/{n}", i, t) for n, ls in pages.items() for i, t in enumerate(ls)]
    d = spark.createDataFrame(rows, "source_document string, source_page string, line_index int, prediction string").withColumn("ingested_at", stamp)
    a = spark.createDataFrame([r for r in rows if not r[1].endswith("/3")], "source_document string, source_page string, line_index int, transcription string")
    none = spark.createDataFrame([], "document_id string, source_page string, line_order int, text string")
    got = {(r["source_table"][0], r["source_page"][-1], r["paragraph"], r["last_page"][-1], r["text"]) for r in scans.book_paragraphs(d, a, none).collect()}
    first, second = " ".join([*pages[1], pages[2][0]]), "ডাৱৰ গৰজি বৰষুণ আহিল মাঘত পথাৰত। ধান চপাই ঘৰলৈ অনা হয় সোনকালে লৰাহঁতে উমলে।"
    want = {("1", 0, "2", first), ("2", 1, "3", second), ("3", 1, "5", f"{pages[3][2]} {pages[5][0]}"), ("5", 1, "5", pages[5][1]), ("7", 0, "7", pages[7][0])}
    assert {x[1:] for x in got if x[0] == "d"} == want
    # the transcription lacks page 3, so what is open before it ends there
    assert {(x[1], x[3]) for x in got if x[0] == "a"} == {("1", "2"), ("2", "2"), ("5", "5"), ("7", "7")}
    assert scans.book_paragraphs(d.limit(0), a.limit(0), none).count() == 0


def page_text(spark, lines, more):
    """The text of one page of detected lines, with a vocabulary of other texts."""
    rows = [("b.pdf", "পৃষ্ঠা:b.pdf/1", i, t) for i, t in enumerate(lines)]
    d = spark.createDataFrame(rows, "source_document string, source_page string, line_index int, prediction string").withColumn("ingested_at", F.timestamp_micros(F.lit(1)))
    a = spark.createDataFrame([], "source_document string, source_page string, line_index int, transcription string")
    none = spark.createDataFrame([], "document_id string, source_page string, line_order int, text string")
    return " ".join(r["text"] for r in scans.paragraphs(d, a, none, spark.createDataFrame([(t,) for t in more], "text string")).collect())


def test_misread_after_the_rest_of_a_broken_word(spark):
    assert page_text(spark, ["মাঘত পথা‐", "ৰত গছ#বোন আছে"], ["গছবোন"] * 3) == "মাঘত পথাৰত গছবোন আছে"


def test_rare_words_correct_misread_ones(spark):
    assert page_text(spark, ["মাঘত গছ#বোন আছে"], ["গছবোন"]) == "মাঘত গছবোন আছে"


def test_misread_definition():
    assert scans.is_misread("ধDচি") and scans.is_misread("প0oিছত") and scans.is_misread("ধ​Dচি")
    for t in ("ক-খ", "ক’খ", "ক.খ", "ক/খ", "কD", "D খ", "ক D খ", "ৰ‍্য", "ক​খ", "১D২", ""):
        assert not scans.is_misread(t), t


def test_misread_leaves_no_visible_sign_out():
    # dashes are no hyphens; rare letters and marks of the block; digits and signs of the block beside the foreign one
    for t in ("ক—খ", "ক–খ", "ক\u2012খ", "ক\u2015খ", "\u0980#ক", "\u09fc#ক", "ক\u09fe#খ", "ক#\u09fe", "ক১#খ", "ক#১খ", "ক\u09f3#খ", "ক\u202a#\u202cখ"):
        assert scans.is_misread(t), ascii(t)
    for t in ("ক\u202aখ", "ক\ufe0fখ", "ক\u061cখ", "ক\u034fখ", "ক।খ", "ক১খ", "ক\u09f3খ", "১#খ", "ক —খ"):
        assert not scans.is_misread(t), ascii(t)


def test_misread_beside_the_break_of_a_word(spark):
    assert scans.misread_parts("পথা#", "ৰত") == (True, False) and scans.misread_parts("পথা", "#ৰত") == (False, True) and scans.misread_parts("পথা", "ৰত#") == (False, False)
    pages = {1: ["মাঘত পথা#‐", "ৰত আহি গছ-", "^বোন আছে মাঘত", "মানুহ আহি পথা@-"], 2: ["*ৰত আহি মানুহ", "আছে মানুহ%-", "নদী আহি"]}
    rows = [("b.pdf", f"পৃষ্ঠা:b.pdf/{n}", i, t) for n, ls in pages.items() for i, t in enumerate(ls)]
    d = spark.createDataFrame(rows, "source_document string, source_page string, line_index int, prediction string").withColumn("ingested_at", F.timestamp_micros(F.lit(1)))
    a = spark.createDataFrame([], "source_document string, source_page string, line_index int, transcription string")
    none = spark.createDataFrame([], "document_id string, source_page string, line_order int, text string")
    more = spark.createDataFrame([("মানুহ নদী গছ গছবোন পথাৰত",)], "text string")
    got = {(r["source_page"][-1], r["line_no"], r["kind"]) for r in scans.noise(d, a, none, more).collect()}
    # after মানুহ stands a dash, as no word begins so and goes on with নদী
    assert got == {("1", 0, "misread"), ("1", 0, "hyphen"), ("1", 1, "hyphen"), ("1", 2, "misread"), ("1", 3, "hyphen"), ("1", 3, "misread"), ("2", 0, "misread")}


def test_dashes_are_not_repaired_away(spark):
    assert page_text(spark, ["মাঘত মানুহ—যি আছে", "গছ#বোন আছে"], ["মানুহটি গছবোন"] * 3) == "মাঘত মানুহ—যি আছে গছবোন আছে"


TABLES = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables here")
def test_queries_have_their_columns(spark):
    from bohagi.llm.queries import QUERIES

    want = {
        "p1_found": ["collection", "term", "mark"], "p2_found": ["doc_id_a", "doc_id_b"], "p3_found": ["kind", "id_a", "id_b"], "p4_found": ["source_table", "id_a", "id_b"], "p5_found": ["source_id"],
        "p6_found": ["source_table", "source_page", "line_no", "kind"], "p7_found": ["doc_id", "item_id"], "p8_ids": ["doc_id", "ids"], "p10_found": ["doc_id", "kind"]}
    for name, columns in want.items():
        df = QUERIES[name](spark, TABLES)
        assert df.columns == columns, name
        rows = df.count()
        assert rows > 0 and (name == "p8_ids" or df.distinct().count() == rows), name
