import json

import pytest
from pyspark.sql import functions as F

from bohagi.operators import audit, cross_split, layout, metrics, selection, vocabulary
from bohagi.operators.evaluation import evaluate_documents
from bohagi.plans import recognition
from bohagi.sources import readers, writers
from bohagi import schemas


def test_vocabulary(spark):
    d = spark.createDataFrame([("অসমীয়া",), ("ভাষা",), (None,)], "text string")
    built = vocabulary.build_vocabulary(d)
    v = vocabulary.Vocabulary.of(built)
    assert built.count() == len(v.characters) and {"ৰ", "ৱ"} <= set(v.characters) and 0 not in {r["id"] for r in built.collect()}
    assert vocabulary.checksum(built).first()["sha256"] == v.sha256
    assert vocabulary.Vocabulary.from_json(v.to_json()) == v
    with pytest.raises(ValueError):
        vocabulary.Vocabulary.from_json(json.dumps({"blank": 0, "characters": ["a"], "sha256": "x"}))
    w = vocabulary.Vocabulary(("অ", "স"))
    r = spark.range(1).select(w.decode_ctc(F.array(*[F.lit(x) for x in (0, 1, 1, 0, 2, 2)])), w.encode(F.lit("সঅ")), w.encode(F.lit("x")), w.missing(F.lit("axস"))).first()
    assert r[0] == "অস" and r[1] == [2, 1] and r[2] is None and r[3] == ["a", "x"]
    with pytest.raises(Exception, match="U\\+0078"):
        spark.createDataFrame([("x",)], "t string").select(w.encode(F.col("t"), strict=True)).collect()


def test_metrics(spark):
    d = spark.createDataFrame([("অসম", "অসম", 1), ("মই যাওঁ", "মই যাও", 2), (None, "a", 3)], "r string, h string, k int")
    got = {x["k"]: x for x in metrics.ocr_metrics(d, "r", "h", ["k"]).collect()}
    assert got[1]["cer"] == 0 and got[1]["sequence_accuracy"] == 1 and got[2]["char_errors"] == 1 and got[2]["sequence_accuracy"] == 0 and got[3]["cer"] == 1
    p = spark.createDataFrame([("ৰক", "কৰ")], "r string, h string")
    x = metrics.character_recall(p, "r", "h", ("ৰ",), []).first()
    assert (x["reference_count"], x["matched"]) == (1, 0)


def test_leakage_cleanup(spark):
    d = spark.createDataFrame([("a", "train"), ("a", "validation"), ("b", "validation"), ("b", "test"), ("c", "test"), ("c", "test"), (None, "test")], "h string, split string")
    assert {r["pair"]: r["shared"] for r in cross_split.leakage(d, "h").collect()} == {"train_validation": 1, "train_test": 0, "validation_test": 1}
    clean = cross_split.without_overlap(d, "h")
    assert {r["shared"] for r in cross_split.leakage(clean, "h").collect()} == {0} and clean.count() == 5
    assert cross_split.leakage(d.limit(0), "h").count() == 3


def test_percentiles(spark):
    d = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 3, 1), (1, 4, 1)], "g int, w int, n long")
    assert d.groupBy("g").agg(audit.lower_percentile("w", 0.95).alias("p")).first()["p"] == 3
    v = spark.createDataFrame([(x,) for x in (5.0, 1.0, 3.0, 2.0, 2.0, None, 9.0, 4.0)], "v double")
    assert tuple(audit.latency_summary(v, "v").first()) == (3.0, 9.0)
    assert tuple(audit.latency_summary(v.limit(0), "v").first()) == (None, None)


def _regions(*rows):
    return [(i, label, tuple(map(float, box)), sure, 0, []) for i, label, box, sure in rows]


def _arranged(spark, regions, lines, w=1000.0, h=None):
    kind = f"k int, regions array<struct<{schemas.REGION}>>, lines array<struct<{schemas.LINE}>>, width double, height double"
    d = spark.createDataFrame([(1, regions, lines, w, h)], kind)
    return layout.arrange_pages(d, ["k"]).first()["regions"]


def _line(i, box, text="কথা"):
    return (i, tuple(map(float, box)), [], text, 0.9, 0)


def test_reading_order(spark):
    rows = _regions(("rb", "text", (550, 320, 950, 500), 0.9), ("lb", "text", (50, 320, 450, 500), 0.9), ("t", "title", (50, 10, 950, 80), 0.9), ("rt", "text", (550, 120, 950, 300), 0.9), ("lt", "text", (50, 120, 450, 300), 0.9))
    own = [_line(r[0], r[2]) for r in rows]
    assert [r["id"] for r in _arranged(spark, rows, own)] == ["t", "lt", "lb", "rt", "rb"]
    same = _regions(("low", "text", (10, 10, 100, 50), 0.4), ("high", "section_header", (10, 10, 100, 50), 0.9))
    assert [r["id"] for r in _arranged(spark, same, [_line("x", (10, 10, 100, 50))])] == ["high"]
    hold = _regions(("table", "key_value_region", (10, 100, 900, 900), 0.9), ("tiny", "text", (20, 120, 200, 150), 0.8))
    got = _arranged(spark, hold, [_line("e", (20, 120, 200, 150))])
    assert [(r["id"], [x["id"] for x in r["lines"]]) for r in got] == [("table", ["e"])]
    two = _regions(("low", "text", (100, 120, 300, 150), 0.9), ("up", "text", (600, 50, 900, 80), 0.9))
    assert [r["id"] for r in _arranged(spark, two, [_line(r[0], r[2]) for r in two])] == ["up", "low"]
    band = _regions(("head", "text", (550, 220, 900, 250), 0.9), ("ll", "text", (100, 350, 400, 390), 0.9), ("bl", "text", (100, 500, 400, 800), 0.9))
    assert [r["id"] for r in _arranged(spark, band, [_line(r[0], r[2]) for r in band], h=1900.0)][0] == "head"
    pic = _regions(("p", "picture", (0, 0, 200, 200), 0.9))
    for noise in ("QR-12X", "C 3! 2% প্ৰ"):
        got = _arranged(spark, pic, [_line("n", (20, 20, 180, 50), noise)])
        assert [(r["id"], len(r["lines"])) for r in got] == [("p", 0)]
    orphan = _arranged(spark, [], [_line("a", (0, 0, 100, 20)), _line("b", (0, 0, 100, 18))])
    assert [(r["id"], len(r["lines"])) for r in orphan] == [("region-fallback-0000", 2)]
    assert _arranged(spark, [], []) == []


def test_line_order():
    left = [(0, 10 * i, 100, 10 * i + 8) for i in range(3)]
    right = [(300, 10 * i, 400, 10 * i + 8) for i in range(3)]
    boxes = [x for pair in zip(left, right) for x in pair]
    assert layout.line_order(boxes, 500) == [0, 2, 4, 1, 3, 5]
    assert layout.line_order(boxes[:4], 500) == [0, 1, 2, 3] and layout.line_order([], 10) == []


def _doc(spark, name, regions):
    page = [(1, 100.0, 100.0, regions)]
    return spark.createDataFrame([("d", page)], f"doc string, pages array<struct<{schemas.PAGE}>>")


def test_evaluation(spark):
    line = ("l", (0.0, 0.0, 10.0, 10.0), [], "অসম", 0.9, 0)
    regions = [("r", "text", (0.0, 0.0, 10.0, 10.0), 0.9, 0, [line]), ("s", "table", (20.0, 20.0, 30.0, 30.0), 0.9, 1, [])]
    r = evaluate_documents(_doc(spark, "a", regions), _doc(spark, "b", regions))
    assert r["layout"].first()["f1"] == 1.0 and r["order"].first()["accuracy"] == 1.0 and r["ocr"].first()["cer"] == 0.0
    other = spark.createDataFrame([("d", [(2, 1.0, 1.0, regions)])], f"doc string, pages array<struct<{schemas.PAGE}>>")
    with pytest.raises(Exception, match="one side only"):
        evaluate_documents(_doc(spark, "a", regions), other)["ocr"].collect()


def test_greedy_match_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    box = lambda: (x := rnd.randint(0, 30), y := rnd.randint(0, 30), x + rnd.randint(10, 40), y + rnd.randint(10, 40))
    e = [(p, i, rnd.choice("ab"), tuple(map(float, box()))) for p in range(6) for i in range(8)]
    q = [(p, i, rnd.choice("ab"), tuple(map(float, box()))) for p in range(6) for i in range(8)]
    kind = "page int, idx int, label string, bbox struct<x0:double,y0:double,x1:double,y1:double>"
    got = {(r["page"], r["e"], r["p"]) for r in layout.match_regions(spark.createDataFrame(e, kind), spark.createDataFrame(q, kind), ["page"], 0.2).collect()}

    def iou(a, b):
        i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return i / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - i)

    want = set()
    for p in range(6):
        c = sorted(((iou(x[3], y[3]), x[1], y[1]) for x in e for y in q if x[0] == y[0] == p and x[2] == y[2] and iou(x[3], y[3]) >= 0.2), reverse=True)
        for _, i, j in c:
            if not any((p, i, k) in want or (p, k, j) in want for k in range(8)):
                want.add((p, i, j))
    assert got == want


def test_selection(spark):
    d = spark.createDataFrame([(f"সূচী:book-{i}.pdf",) for i in range(100)], "t string")
    counts = {"train": 5, "validation": 2, "test": 2}
    a = selection.select_documents(d, "t", counts, 9)
    assert {tuple(r) for r in a.collect()} == {tuple(r) for r in selection.select_documents(d.orderBy(F.desc("t")), "t", counts, 9).collect()}
    selection.require_counts(a, counts)
    with pytest.raises(ValueError, match="not enough"):
        selection.require_counts(a, {"train": 6})
    w = spark.createDataFrame([("s", "অসম"), ("s", "ভাষা"), ("s", "সাহিত্য")], "source string, text string")
    got = [r["weight"] for r in selection.sampling_weights(w, "text", "source", {"s": 0.9}, "ষ", 2.0).orderBy("text").collect()]
    assert abs(sum(got) - 0.9) < 1e-9 and abs(max(got) - 2 * min(got)) < 1e-9
    with pytest.raises(ValueError):
        selection.sampling_weights(w, "text", "source", {"s": 0.9}, "ষ", 0.5)
    drawn = selection.draw(selection.sampling_weights(w, "text", "source", {"s": 1.0}, "ষ", 2.0), "weight", 100, ["text"], 3)
    assert drawn.agg(F.sum("copies")).first()[0] == 100


def test_sinks_and_sources(spark, tmp_path):
    d = spark.createDataFrame([("1", "x", "train", "as", None, "c")], schemas.CORPUS_LINE)
    writers.write_dataset(d, str(tmp_path / "set"))
    assert readers.read_dataset(spark, str(tmp_path / "set"), "train").count() == 1
    with pytest.raises(KeyError):
        readers.read_dataset(spark, str(tmp_path / "set"), "test")
    with pytest.raises(Exception):
        writers.write_dataset(d, str(tmp_path / "set"))
    with pytest.raises(FileExistsError):
        writers.guard(str(tmp_path))
    with pytest.raises(ValueError):
        writers.guard("/")
    writers.write_jsonl(d, str(tmp_path / "lines"))
    assert readers.read_corpus(spark, str(tmp_path / "lines")).first()["id"] == "1"
    writers.write_report(d.select("id"), str(tmp_path / "r.json"))
    assert json.loads((tmp_path / "r.json").read_text())["id"] == "1"
    assert readers.read_files(spark, str(tmp_path / "set"), "*.parquet").count() >= 1
    with pytest.raises(ValueError):
        readers.read_config("[1]")
    writers.promote(spark, str(tmp_path / "lines"), str(tmp_path / "final"))
    assert readers.read_corpus(spark, str(tmp_path / "final")).count() == 1


def _fakes():
    def layout():
        return lambda image, w, h: [{"id": "r", "label": "text", "bbox": {"x0": 5.0, "y0": 5.0, "x1": 95.0, "y1": 50.0}, "confidence": 0.9}]

    def detector():
        return lambda image, w, h: [[[10.0, 10.0], [90.0, 10.0], [90.0, 35.0], [10.0, 35.0]]]

    def recognizer():
        return lambda image, polygon: ("অসমীয়া", 0.99)

    return layout, detector, recognizer


def test_pages_end_to_end(spark):
    d = spark.createDataFrame([("a", 1, 100, 100, bytearray(b"x"))], "doc string, number int, width int, height int, content binary")
    docs = recognition.documents(recognition.recognise(d, *_fakes()))
    r = docs.select("language", writers.document_text(F.col("pages")).alias("t"), writers.html_page(F.transform("pages", lambda p: writers.page_overlay(p, F.lit(b"x")))).alias("h")).first()
    assert r["language"] == "as" and r["t"] == "অসমীয়া\n" and 'data-confidence="0.990000"' in r["h"] and ">অসমীয়া</span>" in r["h"]


def test_wiki_source(spark, tmp_path):
    from bohagi.sources.wiki import Client, WikiError, WikiSource

    answers = [{"query": {"allpages": [{"title": "a.pdf"}]}, "continue": {"apcontinue": "b"}}, {"query": {"allpages": [{"title": "b.pdf"}]}}]
    pages = {"query": {"pages": [{"title": "a.pdf", "revisions": [{"revid": 3, "slots": {"main": {"content": "text"}}}]}, {"title": "none", "missing": True}]}}

    class Reply:
        def __init__(self, x):
            self.x = x

        def __enter__(self):
            return self

        def __exit__(self, *a):
            return False

        def read(self):
            return json.dumps(self.x).encode()

    book = {"query": {"proofreadpagesinindex": [{"title": "P/1", "formattedPageNumber": "1"}, {"title": "P/2"}]}}
    part = {"query": {"pages": [{"title": "P/1", "proofread": {"quality": 4}}, {"title": "P/2"}]}, "continue": {"rvcontinue": "x"}}
    rest = {"query": {"pages": [{"title": "P/1", "revisions": [{"revid": 9, "timestamp": "t"}], "imagesforpage": {"fullsize": "//i/1"}}]}}
    info = {"query": {"pages": [{"title": "File:a", "imageinfo": [{"url": "u", "sha1": "s", "extmetadata": {"LicenseShortName": {"value": "CC0"}}}]}, {"title": "File:none"}]}}
    asked = []

    def opener(request, timeout):
        url = request.full_url
        asked.append(url)
        assert timeout and request.headers["User-agent"]
        for sign, reply in (("proofreadpagesinindex", book), ("rvcontinue", rest), ("imageforpage", part), ("imageinfo", info), ("action=parse", {"parse": {"text": "<p>x</p>"}} if "oldid=7" in url else {"error": {"code": "nosuchrevid"}}), ("revisions", pages), ("apcontinue", answers[1]), ("allpages", answers[0])):
            if sign in url:
                return Reply(reply)

    c = Client("http://x/api", str(tmp_path), opener=opener)
    assert list(c.titles("", "106")) == [("a.pdf",), ("b.pdf",)]
    assert list(c.pages(["a.pdf", "none"])) == [("a.pdf", 3, "text"), ("none", None, None)]
    assert list(c.index("B")) == [("B", "P/1", "1", 0), ("B", "P/2", None, 1)]
    assert list(c.details(["P/1", "P/2"])) == [("P/1", 4, 9, "t", "//i/1"), ("P/2", None, None, None, None)]
    assert list(c.text("7")) == [(7, "<p>x</p>")]
    assert list(c.files(["a", "none"])) == [("File:a", "u", "s", "CC0", None, None, None), ("File:none", *[None] * 6)]
    for n in (1, 2):  # an error is asked for again, anything else is not
        before = len(asked)
        with pytest.raises(WikiError):
            list(c.text("8"))
        list(c.details(["P/1", "P/2"]))
        assert len(asked) == before + 1
    broken = iter([b"<html>", json.dumps(book).encode()])
    waits = []

    class Half(Reply):
        def read(self):
            return next(broken)

    assert len(list(Client("http://y/api", None, opener=lambda r, timeout: Half(None), sleep=waits.append).index("B"))) == 2 and len(waits) == 1
    spark.dataSource.register(WikiSource)  # from the cache alone
    read = lambda **o: spark.read.format("wiki").options(endpoint="http://x/api", cache=tmp_path.as_uri(), **o).load().collect()
    assert sorted(r["title"] for r in read()) == ["a.pdf", "b.pdf"]
    assert {(r["title"], r["revision"]) for r in read(kind="pages", titles=json.dumps(["a.pdf", "none"]))} == {("a.pdf", 3), ("none", None)}
    assert [(r["title"], r["quality"], r["revision"]) for r in read(kind="details", titles=json.dumps(["P/1", "P/2"]))] == [("P/1", 4, 9), ("P/2", None, None)]
    assert [tuple(r) for r in read(kind="texts", revisions="[7]")] == [(7, "<p>x</p>")]
    assert len(read(kind="index", titles='["B"]')) == 2 == len(read(kind="files", names='["a", "none"]')) and read(kind="files") == []


def test_silver_lines_from_a_list_of_pages(spark):
    from bohagi.plans import silver_lines as s

    rows = lambda data, schema: spark.createDataFrame(data, schema)
    text = "নদীৰ পাৰত ধান পকিছে আজি আৰু মানুহ আহিছে"
    listed = rows([("d", f"p{i}") for i in range(5)], "source_document string, source_page string")
    details = rows([("p0", 4, "i", 1), ("p1", 4, "i", 2), ("p2", 3, "i", 3), ("p3", 4, None, 4)], "source_page string, quality int, image string, revision long")
    files = rows([("d", "CC0", "x")], "source_document string, license string, artist string")
    texts = rows([("p0", text), ("p1", text), ("p2", text)], "source_page string, text string")
    detected = rows([(p, k, t, 100, 20, h) for p in ("p0", "p1") for k, (t, h) in enumerate([("নদীৰ পাৰট ধান পকিছে", f"{p}a"), ("আজি আৰু মানুহ আহিছে", "same"), ("", None)])] + [("p2", 0, "নদীৰ", 1, 1, "z")], "source_page string, line_index int, prediction string, width int, height int, image_hash string")
    got = s.build(listed, details, files, texts, detected, F.lit(True))
    assert {(r["source_page"], r["line_index"], r["transcription"]) for r in got["accepted"].collect()} == {("p0", 0, "নদীৰ পাৰত ধান পকিছে"), ("p1", 0, "নদীৰ পাৰত ধান পকিছে"), ("p0", 1, "আজি আৰু মানুহ আহিছে")}
    assert {r["reason"]: r["n"] for r in got["ledger"].collect()} == {"not_validated": 2, "missing_image": 1, "duplicate": 1}
    assert {(r["source_page"], r["detected"], r["accepted"]) for r in got["page_audit"].collect()} == {("p0", 3, 2), ("p1", 3, 1)}
    assert [r["artist"] for r in got["attributions"].collect()] == ["x"]


def test_stream(spark, tmp_path):
    from bohagi.streaming import corpus

    d = spark.createDataFrame([("1", "অসমীয়া  ভাষা", "Train "), ("2", "অসমীয়া ভাষা", "test"), ("3", "only English", None)], "id string, text string, split string").withColumn("ingested_at", F.timestamp_micros(F.lit(1_700_000_000_000_000)))
    d.write.parquet(str(tmp_path / "in"))
    s = corpus.first_seen(corpus.validated(corpus.read_lines(spark, str(tmp_path / "in"))).where("reason = 'ok'"))
    corpus.run_once(s.select("id", "text", "split"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert len(got) == 1 and got[0]["text"].count(" ") == 1


def test_training_curve(spark):
    from bohagi.operators import curves

    steps = spark.createDataFrame([("a", e, float(x)) for e in range(1, 6) for x in (e, e + 2)], "run string, epoch int, loss double")
    ev = spark.createDataFrame([("a", e, r) for e, r in zip(range(1, 6), (0.5, 0.4, 0.45, 0.4, 0.6))], "run string, epoch int, rate double")
    c = curves.training_curve(steps, ev).orderBy("epoch").collect()
    assert [r["best"] for r in c] == [0.5, 0.4, 0.4, 0.4, 0.4] and [r["stale"] for r in c] == [0, 0, 1, 2, 3] and c[0]["mean_loss"] == 2.0
    assert curves.stopped_at(curves.training_curve(steps, ev), 2).first()["epoch"] == 4


def test_commands(spark, tmp_path):
    from bohagi.__main__ import main

    spark.createDataFrame([("1", "t", "অসমীয়া আমাৰ মাতৃভাষা। This sentence is English.")], "id string, title string, text string").write.parquet(str(tmp_path / "articles"))
    assert main(["prepare-corpus", str(tmp_path / "articles"), str(tmp_path / "corpus")]) == 0
    got = readers.read_corpus(spark, str(tmp_path / "corpus")).collect()
    assert [(r["id"], r["source_title"]) for r in got] == [("wikipedia:1:0", "t")]
    (tmp_path / "m.json").write_text(json.dumps({"cer": 0.02, "size_mb": 3.0, "ra_coverage": 120, "wa_coverage": 99}))
    assert main(["check-release", str(tmp_path / "m.json")]) == 1
    rows = [("1", "অসম", "aa", "train", 10, 5), ("2", "অসম", "AA", "test", 10, 5), ("3", "only", "bb", "train", 10, 5)]
    spark.createDataFrame(rows, "id string, text string, image_sha256 string, split string, image_width int, image_height int").write.parquet(str(tmp_path / "crops"))
    assert main(["prepare-words", str(tmp_path / "crops"), str(tmp_path / "words")]) == 0
    assert spark.read.parquet(str(tmp_path / "words/rows")).count() == 1


def test_silver_line_gates(spark):
    from bohagi.plans import silver_lines as s

    d = spark.createDataFrame([(4, "i", 1, "CC BY-SA", "x" * 30), (4, "i", 1, "cc-by", "x" * 30), (3, "i", 1, "cc0", ""), (4, None, 1, "cc0", ""), (4, "i", None, "cc0", ""), (4, "i", 1, "cc0", "short"), (4, "i", 1, "cc0", "অসমীয়া ভাষা আৰু সাহিত্যৰ কথা")], "q int, i string, r long, l string, t string")
    got = [r[0] for r in d.select(s.page_reason(*[F.col(c) for c in "qirlt"])).collect()]
    assert got == ["low_assamese_script_ratio", "unusable_license", "not_validated", "missing_image", "missing_revision", "short_text", "ok"]
    lines = spark.createDataFrame([("অসম", 0.5), ("অস", 0.9), ("word", 0.9), ("অসম", 0.9)], "t string, s double")
    assert [r[0] for r in lines.select(s.line_reason(F.col("t"), F.col("s"), F.lit(True), F.lit(10), F.lit(10))).collect()] == ["low_alignment", "short_text", "low_assamese_script_ratio", "ok"]
    t = spark.createDataFrame([("a.PDF",), ("b.djvu",), ("c.txt",)], "t string")
    assert [r[0] for r in t.select(s.is_scan_title(F.col("t"), True)).collect()] == [True, True, False]
