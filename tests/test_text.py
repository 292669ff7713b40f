import math
import random

import pytest
from pyspark.sql import functions as F

from bohagi.functions import geometry as g
from bohagi.functions import text as t
from bohagi.functions.html import scope_text, strip_html
from bohagi.functions.align import _table, align_lines, align_pair, boundary_map, edit_distance
from bohagi.operators import lines
from bohagi.plans.word_crops import assert_config


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_normalize(spark):
    assert one(spark, "\t কুকুৰা  আৰু\u00a0 হাঁহ \n", t.normalize_label) == "কুকুৰা আৰু হাঁহ"
    assert len(one(spark, "u\u0308", t.normalize_label)) == 1
    assert len(one(spark, "\u09dd", t.normalize_label)) == 2  # the block's composed letters come apart
    assert one(spark, "a  \x1cb", t.normalize_label) == "a b"
    assert one(spark, None, t.normalize_label) is None


def test_ratio_and_reason(spark):
    assert one(spark, "পথাৰ ৭৮ 56", t.script_ratio) == 1.0
    assert one(spark, "rice fields", t.script_ratio) == 0.0
    assert one(spark, "56 !", t.script_ratio) == 1.0
    assert one(spark, "ধান a", t.script_ratio) == 0.75
    assert one(spark, "নদীৰ পাৰত ঘৰ", t.label_reason) == "ok"
    assert one(spark, "by the river", t.label_reason) == "low_assamese_script_ratio"
    assert one(spark, "", t.label_reason) == "empty"
    assert one(spark, "ক\u0003", t.label_reason) == "control_character"
    assert one(spark, "ৰ\u200d্য", t.label_reason) == "ok"


def test_steps_and_splits(spark):
    assert one(spark, "নদী", t.ctc_steps) == 3  # all differ: as many as characters
    assert one(spark, "গগণ", t.ctc_steps) == 4
    assert one(spark, "aabbb", t.ctc_steps) == 8
    import hashlib

    for key in ("page 7", "নদী", "x"):
        b = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 100
        assert one(spark, key, t.stable_split) == ("train" if b < 90 else "validation" if b < 95 else "test")
    with pytest.raises(ValueError, match="only accepts 'assamese'"):
        assert_config("hindi")


def test_word_distance(spark, monkeypatch):
    long = [f"w{i}" for i in range(60_000)]
    other = [*long[:100], "x", *long[101:30_000], *long[30_002:40_000], "y", *long[40_000:]]
    rows = [(["নদীৰ", "পাৰত"], ["নদীৰ", "পাৰ"]), ([], ["a"]), (["a", "b"], ["b", "a"]), ([], []), (long, long[:-1]), (None, ["a"])]
    d = spark.createDataFrame(rows, "a array<string>, b array<string>")
    distances = [r[0] for r in d.select(t.word_distance(F.col("a"), F.col("b"))).collect()]
    assert distances == [1, 1, 2, 0, 1, None]
    assert t.sequence_distance(long[:3000], [w for w in other[:3000]]) == 1 and t.sequence_distance(long[29_000:41_000], other[29_000:40_999]) == 3
    monkeypatch.setattr(t, "CODED_WORDS", 1)
    assert [r[0] for r in d.select(t.word_distance(F.col("a"), F.col("b"))).collect()] == distances


def test_extract_lines(spark):
    d = spark.createDataFrame([(1, "পথাৰত ধান পকিছে আজি। The harvest begins tomorrow morning."), (2, None), (3, "")], "k int, t string")
    assert [r["line"] for r in lines.extract_lines(d, "k", "t").collect()] == ["পথাৰত ধান পকিছে আজি।"]
    long = spark.createDataFrame([(1, " ".join(["কলমবোৰ"] * 40))], "k int, t string")
    got = [r["line"] for r in lines.extract_lines(long, "k", "t").orderBy("line_no").collect()]
    assert " ".join(got) == " ".join(["কলমবোৰ"] * 40) and all(len(x) <= 120 for x in got)


def test_markup(spark):
    page = '<ul class="menu"><li>top</li></ul><section class="big pagetext"><h2>নদী</h2>পাৰ<b>ত</b><ul><li>গছ</li></ul></section><p>end</p>'
    assert scope_text(page) == "নদী পাৰত গছ"
    assert scope_text("<p>none</p>") == "" == scope_text('<p class="pagetext"/>x')
    leaky = '<div class="pagetext">a<br>b</div><p>c</p>'
    assert scope_text(leaky) == "a b c" and scope_text(leaky, strict=True) == "a b"
    assert scope_text('<i class="pagetext">a&amp;lt;</i> b <i class="pagetext">c\u00ad</i>') == "a<c"
    assert scope_text('<i class="pagetext" class="x">a</i>') == "" and scope_text('<i class="x" class="pagetext">a</i>') == "a"
    assert one(spark, "&lt;b&gt;x&amp;y", strip_html) == "x&y"
    assert one(spark, "//a.org/b?c=1#d", t.canonical_url) == "https://a.org/b"


def test_edit_distance_by_bits_is_that_of_the_table():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ("".join(rnd.choices("abc", k=rnd.randint(0, 90))) for _ in range(2))
        assert edit_distance(a, b) == int(_table(a, b)[-1, -1])
    assert boundary_map("abc", "abc") == [0, 1, 2, 3]


def test_alignment():
    assert edit_distance("নদী", "নী") == 1 and edit_distance("", "ab") == 2
    assert ("প", "প") not in align_pair("পথ", "থপ")  # of two equal costs, substitutions are taken
    got = align_lines(["নদীৰ পাৰট", "ধান পকিছে"], "নদীৰ পাৰত ধান পকিছে আজি।")
    assert [x[2] for x in got] == ["নদীৰ পাৰত", "ধান পকিছে আজি।"] and got[0][3] > 0.8
    assert align_lines([], "x") == [] and align_lines(["a"], " ") == []


def test_geometry(spark):
    d = spark.createDataFrame([((0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0))], "a struct<x0:double,y0:double,x1:double,y1:double>, b struct<x0:double,y0:double,x1:double,y1:double>")
    r = d.select(g.iou(F.col("a"), F.col("b"), 1e-9), g.line_overlap(F.col("a"), F.col("b")), g.layout_label(F.lit(99)), g.layout_label(F.lit(8)), g.canvas_width(F.lit(101), F.lit(20), F.lit(5)) % 4, g.resized_width(F.lit(101), F.lit(20))).first()
    assert math.isclose(r[0], 1 / 3) and r[1] == 0.5 and r[2:4] == ("unknown", "table") and r[4] == 0 and r[5] == 242
