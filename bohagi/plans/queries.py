"""Queries of the reference operators over the test tables, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from bohagi.functions import geometry as g
from bohagi.functions import text as t
from bohagi.functions.html import strip_html
from bohagi.operators import audit, cross_split, layout, lines, metrics, selection, vocabulary
from bohagi.plans import silver_lines, word_crops
from bohagi.session import table
from bohagi.sources import writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The same class of white space for DuckDB.
_WS = t.WS
_NORM = f"trim(regexp_replace(nfc_normalize(text), '{_WS}+', ' ', 'g'))"
_JOINERS = "replace(replace({0}, chr(8204), ''), chr(8205), '')"
_RATIO = "CASE WHEN length(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}]', '', 'g')) = 0 THEN 1.0 ELSE length(regexp_replace(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}]', '', 'g'), '[^\\x{{0980}}-\\x{{09FF}}]', '', 'g')) / length(regexp_replace({0}, '[^\\p{{L}}\\p{{M}}]', '', 'g')) END"


def _reason(n: str, ratio: float = 0.6) -> str:
    return f"CASE WHEN {n} IS NULL THEN NULL WHEN {n} = '' THEN 'empty' WHEN regexp_matches({_JOINERS.format(n)}, '\\p{{C}}') THEN 'control_character' WHEN {_RATIO.format(n)} < {ratio} THEN 'low_assamese_script_ratio' ELSE 'ok' END"


_SPLIT = "nullif(lower(trim(split)), '')"
_CHARS = "unnest(regexp_extract_all({0}, '(?s).'))"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@_query(f"SELECT id, {_NORM} AS text FROM corpus_lines")
def normalize_text(spark, sf):
    return table(spark, sf, "corpus_lines").select("id", t.normalize_label(F.col("text")).alias("text"))


@_query(f"SELECT id, CASE WHEN n IS NULL THEN NULL ELSE round({_RATIO.format('n')}, 6) END AS ratio FROM (SELECT id, {_NORM} AS n FROM corpus_lines)")
def script_ratio(spark, sf):
    n = t.normalize_label(F.col("text"))
    return table(spark, sf, "corpus_lines").select("id", n.alias("n")).select("id", F.round(t.script_ratio(F.col("n")), 6).alias("ratio"))


@_query(f"SELECT id, {_reason('n')} AS reason FROM (SELECT id, {_NORM} AS n FROM mozhi_words)")
def validate_label(spark, sf):
    return table(spark, sf, "mozhi_words").select("id", t.normalize_label(F.col("text")).alias("n")).select("id", t.label_reason(F.col("n")).alias("reason"))


@_query(f"SELECT id, CAST(length(n) + coalesce(list_sum(list_transform(list_zip(c, c[2:]), lambda p: CAST(p[1] = p[2] AS INT))), 0) AS INT) AS steps FROM (SELECT id, n, regexp_extract_all(n, '(?s).') AS c FROM (SELECT id, {_NORM} AS n FROM mozhi_words)) WHERE n IS NOT NULL")
def ctc_steps(spark, sf):
    return table(spark, sf, "mozhi_words").select("id", t.normalize_label(F.col("text")).alias("n")).where("n is not null").select("id", t.ctc_steps(F.col("n")).alias("steps"))


_B8 = "CAST(CAST(('0x' || substr(sha256({0}), 1, 8)) AS UBIGINT) % 100 AS INT)"
_B16 = "CAST(CAST(('0x' || substr(sha256('1337:' || {0}), 1, 16)) AS UBIGINT) % 100 AS INT)"


@_query(f"SELECT id, CASE WHEN b < 90 THEN 'train' WHEN b < 95 THEN 'validation' ELSE 'test' END AS split FROM (SELECT id, {_B8.format('id')} AS b FROM corpus_lines)")
def stable_split(spark, sf):
    return table(spark, sf, "corpus_lines").select("id", t.stable_split(F.col("id")).alias("split"))


@_query(f"SELECT source_document, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT DISTINCT source_document, {_B16.format('source_document')} AS b FROM detected_lines)")
def document_split(spark, sf):
    return table(spark, sf, "detected_lines").select("source_document").distinct().select("source_document", t.document_split(F.col("source_document")).alias("split"))


@_query(f"SELECT id, contains(n, 'ৰ') AS has_ra, contains(n, 'ৱ') AS has_wa, CAST(length(n) - length(replace(n, 'ৰ', '')) AS INT) AS n_ra FROM (SELECT id, {_NORM} AS n FROM corpus_lines) WHERE n IS NOT NULL")
def distinctive_letters(spark, sf):
    d = table(spark, sf, "corpus_lines").select("id", t.normalize_label(F.col("text")).alias("n")).where("n is not null")
    return d.select("id", F.contains("n", F.lit("ৰ")).alias("has_ra"), F.contains("n", F.lit("ৱ")).alias("has_wa"), t.occurrences(F.col("n"), "ৰ").alias("n_ra"))


@_query()
def extract_lines(spark, sf):
    return lines.extract_lines(table(spark, sf, "documents"), "doc_id", "text")


@_query(f"SELECT {_SPLIT} AS split, count(*) AS samples, CAST(count_if(n = '') AS BIGINT) AS empty, CAST(count_if({_reason('n')} <> 'ok') AS BIGINT) AS invalid, CAST(count_if(contains(n, 'ৰ')) AS BIGINT) AS with_ra, CAST(count_if(contains(n, 'ৱ')) AS BIGINT) AS with_wa FROM (SELECT split, coalesce({_NORM}, '') AS n FROM mozhi_words) GROUP BY 1")
def audit_texts(spark, sf):
    return audit.audit_texts(table(spark, sf, "mozhi_words").withColumn("split", t.split_name(F.col("split"))), "text", ["split"])


@_query(f"SELECT char, count(*) AS n FROM (SELECT {_CHARS.format('n')} AS char FROM (SELECT {_NORM} AS n FROM mozhi_words)) GROUP BY 1")
def char_histogram(spark, sf):
    return audit.character_histogram(table(spark, sf, "mozhi_words"), "text")


@_query(f"SELECT split, reason, count(*) AS n FROM (SELECT {_SPLIT} AS split, {_reason('n')} AS reason FROM (SELECT split, {_NORM} AS n FROM corpus_lines)) WHERE reason <> 'ok' GROUP BY 1, 2")
def excluded_by_reason(spark, sf):
    return audit.reason_counts(table(spark, sf, "corpus_lines").withColumn("split", t.split_name(F.col("split"))), "text", ["split"])


def _required() -> str:
    return ", ".join("('" + c.replace("'", "''") + "')" for c in dict.fromkeys(t.REPERTOIRE))


_VOCAB = f"SELECT char, CAST(row_number() OVER (ORDER BY unicode(char)) AS INT) AS id FROM (SELECT DISTINCT {_CHARS.format('n')} AS char FROM (SELECT {_NORM} AS n FROM mozhi_words WHERE {_SPLIT} = 'train') UNION SELECT * FROM (VALUES {_required()}) v(char))"


def _train_vocab(spark, sf):
    return vocabulary.build_vocabulary(table(spark, sf, "mozhi_words").where(t.split_name(F.col("split")) == "train"))


@_query(_VOCAB)
def build_vocab(spark, sf):
    return _train_vocab(spark, sf)


@_query(f"SELECT count(*) + 1 AS size, sha256(string_agg(char, chr(10) ORDER BY id)) AS sha256 FROM ({_VOCAB})")
def vocab_checksum(spark, sf):
    return vocabulary.checksum(_train_vocab(spark, sf))


@_query(f"WITH c AS (SELECT DISTINCT {_SPLIT} AS split, {_CHARS.format('n')} AS char FROM (SELECT split, {_NORM} AS n FROM mozhi_words)) SELECT split, char FROM c WHERE split IN ('validation', 'test') AND char NOT IN (SELECT char FROM c WHERE split = 'train')")
def unseen_chars(spark, sf):
    return cross_split.unseen_characters(table(spark, sf, "mozhi_words").withColumn("split", t.split_name(F.col("split"))))


_HASHED = f"SELECT id, text, {_SPLIT} AS split, lower(image_sha256) AS h FROM mozhi_words"


def _hashed(spark, sf):
    return table(spark, sf, "mozhi_words").select("id", "text", t.split_name(F.col("split")).alias("split"), F.lower("image_sha256").alias("h"))


def _leak_sql(src: str) -> str:
    pair = "SELECT '{0}_{1}' AS pair, (SELECT count(*) FROM (SELECT DISTINCT h FROM d WHERE split = '{0}' AND h IS NOT NULL INTERSECT SELECT DISTINCT h FROM d WHERE split = '{1}')) AS shared"
    return f"WITH d AS ({src}) " + " UNION ALL ".join(pair.format(a, b) for a, b in cross_split.PAIRS)


@_query(_leak_sql(_HASHED))
def leakage_before(spark, sf):
    return cross_split.leakage(_hashed(spark, sf), "h")


_CLEAN = f"SELECT * FROM ({_HASHED}) x WHERE coalesce(split, '') NOT IN ('validation', 'test') OR h IS NULL OR (split = 'validation' AND h NOT IN (SELECT h FROM ({_HASHED}) WHERE split = 'train' AND h IS NOT NULL)) OR (split = 'test' AND h NOT IN (SELECT h FROM ({_HASHED}) WHERE split IN ('train', 'validation') AND h IS NOT NULL))"


@_query(_CLEAN)
def dedup_splits(spark, sf):
    return cross_split.without_overlap(_hashed(spark, sf), "h")


@_query(_leak_sql(_CLEAN))
def leakage_after(spark, sf):
    return cross_split.leakage(cross_split.without_overlap(_hashed(spark, sf), "h"), "h")


@_query(f"SELECT id, h FROM (SELECT id, h, row_number() OVER (PARTITION BY h ORDER BY id) AS n FROM (SELECT DISTINCT id, h FROM ({_HASHED}))) WHERE n = 1 OR h IS NULL")
def first_wins_dedup(spark, sf):
    return cross_split.first_wins(_hashed(spark, sf).select("id", "h").distinct(), "h", ["id"])


@_query(f"""WITH w AS (SELECT {_SPLIT} AS split, CAST(round_even(image_width * 48 / greatest(1, image_height), 0) AS INT) AS w FROM mozhi_words WHERE image_width IS NOT NULL AND image_height IS NOT NULL),
l AS (SELECT split, list_sort(list(w)) AS v FROM w GROUP BY 1)
SELECT split, CAST(v[CAST(floor((len(v) - 1) * 0.5) AS INT) + 1] AS BIGINT) AS median, CAST(v[CAST(floor((len(v) - 1) * 0.95) AS INT) + 1] AS BIGINT) AS p95, v[len(v)] AS maximum, CAST(len(list_filter(v, lambda x: x > 768)) AS BIGINT) AS over_limit FROM l""")
def width_percentiles(spark, sf):
    return audit.width_audit(table(spark, sf, "mozhi_words").withColumn("split", t.split_name(F.col("split"))), "image_width", "image_height", ["split"])


@_query("""WITH v AS (SELECT list_sort(list(value)) AS v, median(value) AS m FROM events WHERE value IS NOT NULL) SELECT m AS median, v[least(len(v), CAST(floor(len(v) * 0.95) AS INT) + 1)] AS p95 FROM v""")
def latency_percentiles(spark, sf):
    return audit.latency_summary(table(spark, sf, "events").where("value is not null"), "value")


_CODED = f"WITH v AS ({_VOCAB}), w AS (SELECT id AS key, n, regexp_extract_all(n, '(?s).') AS c FROM (SELECT DISTINCT id, {_NORM} AS n FROM mozhi_words) WHERE n IS NOT NULL), m AS (SELECT map(list(char), list(id)) AS m FROM v), e AS (SELECT key AS id, n AS text, CASE WHEN len(list_filter(c, lambda x: m[x] IS NULL)) = 0 THEN array_to_string(list_transform(c, lambda x: CAST(m[x] AS VARCHAR)), ' ') END AS ids FROM w, m)"


def _labels(spark, sf):
    return table(spark, sf, "mozhi_words").select("id", t.normalize_label(F.col("text")).alias("text")).distinct().where("text is not null")


@_query(_CODED + " SELECT * FROM e")
def encode_text(spark, sf):
    """Ids of every label; null where the training vocabulary lacks a character."""
    v = vocabulary.Vocabulary.of(_train_vocab(spark, sf))
    return _labels(spark, sf).select("id", "text", F.array_join(v.encode(F.col("text")), " ").alias("ids"))


@_query(_CODED + " SELECT id, text, text AS decoded FROM e WHERE ids IS NOT NULL")
def decode_round_trip(spark, sf):
    """Every label that the vocabulary covers, encoded with a blank between and decoded again."""
    v = vocabulary.Vocabulary.of(_train_vocab(spark, sf))
    e = _labels(spark, sf).withColumn("ids", v.encode(F.col("text"))).where("ids is not null")
    spaced = F.flatten(F.transform("ids", lambda x: F.array(x, F.lit(0))))
    return e.select("id", "text", v.decode_ctc(spaced).alias("decoded"))


@_query("""SELECT vec_id, CAST(list_position(e, list_max(e)) - 1 AS INT) AS best, round(1.0 / list_sum(list_transform(e, lambda x: exp(CAST(x AS DOUBLE) - CAST(list_max(e) AS DOUBLE)))), 6) AS confidence FROM (SELECT vec_id, embedding AS e FROM embeddings)""")
def softmax_confidence(spark, sf):
    d = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"))
    return d.select("vec_id", g.argmax(F.col("e")).alias("best"), F.round(F.array_max(g.softmax(F.col("e"))), 6).alias("confidence"))


@_query()
def cer_wer_exact(spark, sf):
    d = table(spark, sf, "aligned_lines").withColumn("split", t.split_name(F.col("split")))
    return metrics.ocr_metrics(d, "transcription", "prediction", ["split"])


@_query()
def char_recall(spark, sf):
    d = table(spark, sf, "aligned_lines").withColumn("split", t.split_name(F.col("split")))
    return metrics.character_recall(d, "transcription", "prediction", t.ASSAMESE.distinctive, ["split"])


@_query(f"SELECT {_SPLIT} AS split, count(DISTINCT source_document) AS documents, count(*) AS samples, round(coalesce(min(CAST(alignment_score AS DOUBLE)), 0), 5) AS least, round(coalesce(sum(CAST(alignment_score AS DOUBLE)), 0) / greatest(1, count(*)), 5) AS mean FROM aligned_lines GROUP BY 1")
def bootstrap_report(spark, sf):
    s = F.col("alignment_score").cast("double")
    return table(spark, sf, "aligned_lines").groupBy(t.split_name(F.col("split")).alias("split")).agg(
        F.count_distinct("source_document").alias("documents"), F.count("*").alias("samples"),
        F.round(F.coalesce(F.min(s), F.lit(0.0)), 5).alias("least"), F.round(F.coalesce(F.sum(s), F.lit(0.0)) / F.greatest(F.lit(1), F.count("*")), 5).alias("mean"))


@_query("SELECT source_license, coalesce(contains(lower(source_license), 'public domain') OR starts_with(lower(source_license), 'cc ') OR lower(source_license) = 'cc0', false) AS usable, count(*) AS n FROM aligned_lines GROUP BY 1, 2")
def license_gate(spark, sf):
    u = F.coalesce(t.usable_license(F.col("source_license")), F.lit(False)).alias("usable")
    return table(spark, sf, "aligned_lines").groupBy("source_license", u).agg(F.count("*").alias("n"))


@_query(r"SELECT id, regexp_replace('https:' || '//upload/' || source_document || '/' || id || '?width=' || line_index, '\?.*$', '') AS url FROM aligned_lines")
def canonical_url(spark, sf):
    u = F.concat(F.lit("//upload/"), F.col("source_document"), F.lit("/"), F.col("id"), F.lit("?width="), F.col("line_index").cast("string"))
    return table(spark, sf, "aligned_lines").select("id", t.canonical_url(u).alias("url"))


@_query()
def strip_markup(spark, sf):
    return table(spark, sf, "documents").select("doc_id", strip_html(F.col("text")).alias("text"))


@_query("""SELECT d.document, d.page, d.detected_lines, coalesce(a.n, 0) AS accepted_lines FROM (SELECT source_document AS document, source_page AS page, count(DISTINCT line_index) AS detected_lines FROM detected_lines GROUP BY 1, 2) d LEFT JOIN (SELECT source_page AS page, count(DISTINCT line_index) AS n FROM aligned_lines GROUP BY 1) a ON d.page = a.page""")
def page_audit(spark, sf):
    return audit.page_audit(table(spark, sf, "detected_lines"), table(spark, sf, "aligned_lines"))


_OFF = """WITH a AS (SELECT document, page, detected_lines, accepted_lines, row_number() OVER (PARTITION BY page ORDER BY audited_at DESC, detected_lines DESC, accepted_lines DESC) AS n FROM page_audit),
c AS (SELECT d.page, d.n AS detected, coalesce(x.n, 0) AS accepted FROM (SELECT source_page AS page, count(DISTINCT line_index) AS n FROM detected_lines GROUP BY 1) d LEFT JOIN (SELECT source_page AS page, count(DISTINCT line_index) AS n FROM aligned_lines GROUP BY 1) x ON d.page = x.page)
SELECT a.page, a.detected_lines, c.detected, a.accepted_lines, c.accepted FROM a JOIN c ON a.page = c.page WHERE a.n = 1 AND (a.detected_lines <> c.detected OR a.accepted_lines <> c.accepted)"""


@_query(_OFF)
def page_audit_differences(spark, sf):
    """Pages whose last audit does not agree with the lines that are there."""
    w = Window.partitionBy("page").orderBy(F.desc("audited_at"), F.desc("detected_lines"), F.desc("accepted_lines"))
    a = table(spark, sf, "page_audit").withColumn("n", F.row_number().over(w)).where("n = 1").select("page", "detected_lines", "accepted_lines")
    c = page_audit(spark, sf).select("page", F.col("detected_lines").alias("detected"), F.col("accepted_lines").alias("accepted"))
    return a.join(c, "page").where("detected_lines <> detected or accepted_lines <> accepted")


@_query("""SELECT source_page, line_index, list_min(list_transform(polygon, lambda p: p[1])) AS x0, list_min(list_transform(polygon, lambda p: p[2])) AS y0, list_max(list_transform(polygon, lambda p: p[1])) AS x1, list_max(list_transform(polygon, lambda p: p[2])) AS y1 FROM detected_lines""")
def polygon_boxes(spark, sf):
    d = table(spark, sf, "detected_lines").select("source_page", "line_index", g.polygon_box(F.col("polygon")).alias("b"))
    return d.select("source_page", "line_index", "b.x0", "b.y0", "b.x1", "b.y1")


_EDGE = "sqrt(pow(polygon[{0}][1] - polygon[{1}][1], 2) + pow(polygon[{0}][2] - polygon[{1}][2], 2))"


@_query(f"""SELECT source_page, line_index, w AS width, h AS height, h > w * 1.5 AS rotate FROM (SELECT source_page, line_index, greatest(2, CAST(round_even(greatest({_EDGE.format(1, 2)}, {_EDGE.format(4, 3)}), 0) AS INT)) AS w, greatest(2, CAST(round_even(greatest({_EDGE.format(1, 4)}, {_EDGE.format(2, 3)}), 0) AS INT)) AS h FROM detected_lines)""")
def quad_extents(spark, sf):
    d = table(spark, sf, "detected_lines").select("source_page", "line_index", g.quad_extent(F.col("polygon")).alias("q"))
    return d.select("source_page", "line_index", "q.width", "q.height", "q.rotate")


def _once(df: DataFrame, *keys: str) -> DataFrame:
    """Of rows repeated with the same keys the greatest; rows without a key are left out."""
    other = [c for c in df.columns if c not in keys]
    d = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(F.max(F.struct(*other)).alias("_x"))
    return d.select(*keys, "_x.*")


#: Pages of boxes derived from lineitem: a page for each order, expected and predicted regions. Boxes are 8 apart and 40
#: high, so a region has several candidates and the greedy choice decides.
_PAGES = """WITH o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS idx FROM lineitem),
e AS (SELECT l_orderkey AS page, CAST(idx AS INT) AS idx, (l_partkey % 2) * 20.0 AS x0, idx * 8.0 AS y0, (l_partkey % 2) * 20.0 + 150 + l_quantity AS x1, idx * 8.0 + 40 AS y1, CASE l_returnflag WHEN 'A' THEN 'table' WHEN 'N' THEN 'text' ELSE 'picture' END AS label, l_suppkey, l_partkey, l_discount, l_linestatus, l_tax FROM o),
p AS (SELECT page, idx, x0 + l_suppkey % 7 AS x0, y0 + (l_partkey % 3) * 12 AS y0, x1 + l_suppkey % 7 AS x1, y1 + (l_partkey % 3) * 12 AS y1, CASE WHEN l_partkey % 11 = 0 THEN 'title' ELSE label END AS label, round(0.5 + l_discount * 4, 6) AS confidence FROM e WHERE NOT (l_linestatus = 'F' AND l_tax > 0.065))"""


def _boxes(spark, sf) -> tuple[DataFrame, DataFrame]:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    o = table(spark, sf, "lineitem").withColumn("idx", F.row_number().over(w) - 1)
    x0, y0 = (F.col("l_partkey") % 2) * 20.0, F.col("idx") * 8.0
    label = F.when(F.col("l_returnflag") == "A", "table").when(F.col("l_returnflag") == "N", "text").otherwise("picture")
    e = o.select(F.col("l_orderkey").alias("page"), "idx", g.box(x0, y0, x0 + 150 + F.col("l_quantity"), y0 + 40).alias("bbox"), label.alias("label"), "l_suppkey", "l_partkey", "l_discount", "l_linestatus", "l_tax")
    dx, dy = F.col("l_suppkey") % 7, (F.col("l_partkey") % 3) * 12
    p = e.where("not (l_linestatus = 'F' and l_tax > 0.065)").select(
        "page", "idx", g.box(F.col("bbox.x0") + dx, F.col("bbox.y0") + dy, F.col("bbox.x1") + dx, F.col("bbox.y1") + dy).alias("bbox"),
        F.when(F.col("l_partkey") % 11 == 0, "title").otherwise(F.col("label")).alias("label"), F.round(0.5 + F.col("l_discount") * 4, 6).alias("confidence"))
    return e.select("page", "idx", "bbox", "label"), p


_IOU = """{pages}, c AS (SELECT e.page, e.idx AS e, p.idx AS p, greatest(0, least(e.x1, p.x1) - greatest(e.x0, p.x0)) * greatest(0, least(e.y1, p.y1) - greatest(e.y0, p.y0)) AS i, (e.x1 - e.x0) * (e.y1 - e.y0) + (p.x1 - p.x0) * (p.y1 - p.y0) AS s FROM e JOIN p ON e.page = p.page AND e.label = p.label), m AS (SELECT page, e, p, i / greatest(1e-9, s - i) AS iou FROM c WHERE i / greatest(1e-9, s - i) >= 0.5)""".format(pages=_PAGES)


@_query(_IOU + " SELECT page, e, p, round(iou, 6) AS iou FROM m")
def iou_pairs(spark, sf):
    e, p = _boxes(spark, sf)
    c = e.select("page", "label", F.col("idx").alias("e"), F.col("bbox").alias("eb")).join(p.select("page", "label", F.col("idx").alias("p"), F.col("bbox").alias("pb")), ["page", "label"])
    return c.select("page", "e", "p", g.iou(F.col("eb"), F.col("pb"), 1e-9).alias("iou")).where("iou >= 0.5").withColumn("iou", F.round("iou", 6))


_GREEDY = _IOU.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + """, q AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, e DESC, p DESC) AS k FROM m),
w AS (SELECT page, k, e, p, iou, true AS taken, [e] AS es, [p] AS ps FROM q WHERE k = 1 UNION ALL
SELECT page, k, e, p, iou, free, CASE WHEN free THEN list_append(es, e) ELSE es END, CASE WHEN free THEN list_append(ps, p) ELSE ps END FROM (SELECT q.*, w.es, w.ps, NOT list_contains(w.es, q.e) AND NOT list_contains(w.ps, q.p) AS free FROM w JOIN q ON q.page = w.page AND q.k = w.k + 1)),
g AS (SELECT page, e, p, iou FROM w WHERE taken)"""


@_query(_GREEDY + " SELECT page, e, p, round(iou, 6) AS iou FROM g")
def match_regions(spark, sf):
    e, p = _boxes(spark, sf)
    return layout.match_regions(e, p, ["page"]).withColumn("iou", F.round("iou", 6))


@_query(_GREEDY + """, l AS (SELECT label, sum(tp) AS tp, sum(en) AS en, sum(pn) AS pn FROM (SELECT e.label, 1 AS tp, 0 AS en, 0 AS pn FROM g JOIN e ON g.page = e.page AND g.e = e.idx UNION ALL SELECT label, 0, 1, 0 FROM e UNION ALL SELECT label, 0, 0, 1 FROM p) GROUP BY 1),
r AS (SELECT label, CAST(tp AS BIGINT) AS true_positive, CAST(pn - tp AS BIGINT) AS false_positive, CAST(en - tp AS BIGINT) AS false_negative, tp / greatest(1, pn) AS pr, tp / greatest(1, en) AS re FROM l)
SELECT label, true_positive, false_positive, false_negative, round(pr, 6) AS precision, round(re, 6) AS recall, round(2 * pr * re / greatest(1e-9, pr + re), 6) AS f1 FROM r""")
def layout_prf(spark, sf):
    e, p = _boxes(spark, sf)
    m = layout.match_regions(e, p, ["page"]).join(e.select("page", F.col("idx").alias("e"), "label"), ["page", "e"])
    z, o = F.lit(0), F.lit(1)
    n = m.select("label", o.alias("tp"), z.alias("en"), z.alias("pn")).unionByName(e.select("label", z.alias("tp"), o.alias("en"), z.alias("pn"))).unionByName(p.select("label", z.alias("tp"), z.alias("en"), o.alias("pn")))
    s = n.groupBy("label").agg(F.sum("tp").cast("long").alias("true_positive"), (F.sum("pn") - F.sum("tp")).cast("long").alias("false_positive"), (F.sum("en") - F.sum("tp")).cast("long").alias("false_negative"))
    return metrics.detection_rates(s)


_OVERLAP = "greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0))"


@_query()
def suppress_regions(spark, sf):
    """Predicted regions of each page together with the expected ones as a second detector, duplicates suppressed."""
    e, p = _boxes(spark, sf)
    both = p.select("page", "idx", "label", "bbox", "confidence").unionByName(e.select("page", (F.col("idx") + 1000).alias("idx"), "label", "bbox", F.lit(0.45).alias("confidence")))
    pages = both.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("idx", "label", "bbox", "confidence"))).alias("r"))
    return pages.select("page", F.posexplode(layout.suppress_duplicates(F.col("r"))).alias("rank", "x")).select("page", "rank", "x.idx", "x.label", "x.confidence")


@_query()
def arranged_pages(spark, sf):
    """Regions of text_lines pages with their lines, in reading order."""
    d = _once(table(spark, sf, "text_lines"), "source_page", "line_order")
    poly = F.array(*[F.array(F.col(f"bbox.{x}"), F.col(f"bbox.{y}")) for x, y in (("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1"))])
    line = F.struct("id", "bbox", poly.alias("polygon"), "text", F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.col("line_order").alias("order"))
    r = d.groupBy("source_page", "region_id").agg(F.min("region_label").alias("label"), F.struct(*[f(f"bbox.{k}").alias(k) for k, f in (("x0", F.min), ("y0", F.min), ("x1", F.max), ("y1", F.max))]).alias("bbox"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("confidence"), F.array_sort(F.collect_list(line), lambda a, b: a["order"] - b["order"]).alias("l"))
    none = F.filter("l", lambda x: F.lit(False))
    region = F.struct(F.col("region_id").alias("id"), "label", "bbox", "confidence", F.lit(0).alias("order"), none.alias("lines"))
    pages = r.groupBy("source_page").agg(F.array_sort(F.collect_list(region), lambda a, b: F.when(a["id"] < b["id"], -1).otherwise(1)).alias("regions"), F.flatten(F.collect_list("l")).alias("lines"))
    pages = pages.withColumn("lines", F.array_sort("lines", lambda a, b: a["order"] - b["order"])).withColumn("width", F.lit(1000.0)).withColumn("height", F.lit(1400.0))
    a = layout.arrange_pages(pages, ["source_page"])
    return a.select("source_page", F.explode("regions").alias("r")).select("source_page", F.col("r.id").alias("region_id"), F.col("r.order").alias("region_order"), F.explode("r.lines").alias("x")).select("source_page", "region_id", "region_order", F.col("x.id").alias("line_id"), F.col("x.order").alias("line_order"))


_LINES = "SELECT DISTINCT source_page, id, region_id, line_order, bbox.x0 AS x0, bbox.y0 AS y0 FROM text_lines"


@_query(f"SELECT source_page, region_id, id, CAST(row_number() OVER (PARTITION BY source_page, region_id ORDER BY y0, x0, id) - 1 AS INT) AS place FROM ({_LINES})")
def line_places(spark, sf):
    d = table(spark, sf, "text_lines").select("source_page", "id", "region_id", "line_order", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0")).distinct()
    return d.select("source_page", "region_id", "id", (F.row_number().over(Window.partitionBy("source_page", "region_id").orderBy("y0", "x0", "id")) - 1).alias("place"))


@_query(f"""WITH d AS (SELECT source_page, line_order AS e, row_number() OVER (PARTITION BY source_page ORDER BY y0, x0, id) AS p FROM ({_LINES})),
s AS (SELECT count(*) AS comparable, count_if(a.p < b.p) AS concordant FROM d a JOIN d b ON a.source_page = b.source_page AND a.e < b.e) SELECT CAST(concordant AS BIGINT) AS concordant, CAST(comparable AS BIGINT) AS comparable, round(concordant / greatest(1, comparable), 6) AS accuracy FROM s""")
def order_pair_accuracy(spark, sf):
    d = table(spark, sf, "text_lines").select("source_page", "id", "region_id", "line_order", F.col("bbox.x0").alias("x0"), F.col("bbox.y0").alias("y0")).distinct()
    m = d.withColumn("p", F.row_number().over(Window.partitionBy("source_page").orderBy("y0", "x0", "id")))
    return layout.order_pairs(m, ["source_page"], "line_order", "p")


_HARD = "ৰৱষ"
_MASS = {"real": 0.8, "synthetic": 0.2}


@_query(f"WITH d AS (SELECT DISTINCT 'real' AS source, id, text FROM mozhi_words UNION ALL SELECT DISTINCT 'synthetic', id, text FROM corpus_lines), f AS (SELECT source, id, CASE WHEN coalesce(regexp_matches(text, '[{_HARD}]'), false) THEN 2.0 ELSE 1.0 END AS f FROM d) SELECT source, id, round(1e6 * CASE source WHEN 'real' THEN 0.8 ELSE 0.2 END * f / greatest(1.0, sum(f) OVER (PARTITION BY source)), 6) AS weight_ppm FROM f")
def sampler_weights(spark, sf):
    a = table(spark, sf, "mozhi_words").select(F.lit("real").alias("source"), "id", "text").distinct()
    b = table(spark, sf, "corpus_lines").select(F.lit("synthetic").alias("source"), "id", "text").distinct()
    w = selection.sampling_weights(a.unionByName(b), "text", "source", _MASS, _HARD, 2.0)
    return w.select("source", "id", F.round(F.col("weight") * 1e6, 6).alias("weight_ppm"))


@_query("""SELECT document_id, string_agg(p, chr(10) || chr(10) || chr(12) || chr(10) || chr(10) ORDER BY page_number) || chr(10) AS text FROM (SELECT document_id, page_number, string_agg(trim(text), chr(10) ORDER BY line_order) AS p FROM (SELECT DISTINCT document_id, page_number, line_order, text FROM text_lines WHERE trim(text) <> '') GROUP BY 1, 2) GROUP BY 1""")
def document_text(spark, sf):
    """Text of each scanned document in line order, a form feed between pages."""
    d = table(spark, sf, "text_lines").select("document_id", "page_number", "line_order", "text").where("trim(text) <> ''").distinct()
    p = d.groupBy("document_id", "page_number").agg(F.array_sort(F.collect_list(F.struct(F.col("line_order").alias("order"), F.col("text").alias("text")))).alias("lines"))
    region = F.array(F.struct(F.lit(0).alias("order"), F.col("lines").alias("lines")))
    pages = p.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("page_number").alias("number"), region.alias("regions")))).alias("pages"))
    return pages.select("document_id", writers.document_text(F.col("pages")).alias("text"))


@_query("""WITH v AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT id, text FROM mozhi_words) WHERE contains(text, 'ৰ')) AS ra, (SELECT count(*) FROM (SELECT DISTINCT id, text FROM mozhi_words) WHERE contains(text, 'ৱ')) AS wa)
SELECT 'ra_coverage' AS gate, CAST(ra AS DOUBLE) AS value, 100.0::DOUBLE AS limit, ra >= 100 AS passed FROM v UNION ALL SELECT 'wa_coverage', CAST(wa AS DOUBLE), 100.0::DOUBLE, wa >= 100 FROM v""")
def release_gates(spark, sf):
    d = table(spark, sf, "mozhi_words").select("id", "text").distinct().agg(F.count_if(F.contains("text", F.lit("ৰ"))).alias("ra_coverage"), F.count_if(F.contains("text", F.lit("ৱ"))).alias("wa_coverage"))
    return audit.release_gates(d, {"ra_coverage": ("at_least", 100), "wa_coverage": ("at_least", 100)})


_ORDERED = "SELECT source_document AS title, substr(sha256('1337:' || source_document), 1, 16) AS h, {0} AS b FROM (SELECT DISTINCT source_document FROM detected_lines)".format(_B16.format("source_document"))


@_query(f"SELECT split, title FROM (SELECT CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split, title, row_number() OVER (PARTITION BY CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END ORDER BY h, title) AS n FROM ({_ORDERED})) WHERE n <= CASE split WHEN 'train' THEN 5 ELSE 2 END")
def select_documents(spark, sf):
    return selection.select_documents(table(spark, sf, "detected_lines"), "source_document", {"train": 5, "validation": 2, "test": 2})


@_query("""WITH p AS (SELECT document, page, max(accepted_lines) >= 20 AS eligible FROM page_audit GROUP BY 1, 2), r AS (SELECT *, row_number() OVER w AS rank, coalesce(sum(CAST(eligible AS INT)) OVER (PARTITION BY document ORDER BY substr(sha256('1337:' || page), 1, 16), page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p WINDOW w AS (PARTITION BY document ORDER BY substr(sha256('1337:' || page), 1, 16), page)) SELECT document, page, eligible, CAST(rank AS INT) AS rank FROM r WHERE before < 3""")
def rank_eligible_pages(spark, sf):
    p = table(spark, sf, "page_audit").groupBy("document", "page").agg((F.max("accepted_lines") >= 20).alias("eligible"))
    return selection.first_eligible(p, "document", "page", "eligible", 3)


@_query(f"SELECT split, id FROM (SELECT split, id, row_number() OVER (PARTITION BY split ORDER BY id) AS n FROM (SELECT DISTINCT {_SPLIT} AS split, id FROM mozhi_words)) WHERE n <= 100")
def split_prefix(spark, sf):
    d = table(spark, sf, "mozhi_words").select(t.split_name(F.col("split")).alias("split"), "id").distinct()
    return selection.split_prefix(d, "split", ["id"], 100)


_EXTENT = [f"greatest(2, CAST(round_even(greatest({_EDGE.format(*a)}, {_EDGE.format(*b)}), 0) AS INT))" for a, b in (((1, 2), (4, 3)), ((1, 4), (2, 3)))]
#: Pages, their facts and their lines from the tables: every tenth revision is not proofread; an image hash is that of the first words.
_SILVER = f"""WITH v AS ({_VOCAB}), va AS (SELECT list(char) AS a FROM v),
a AS (SELECT source_page, line_index, max({{'transcription': transcription, 'document': source_document, 'license': source_license, 'score': alignment_score}}) AS x FROM aligned_lines WHERE source_page IS NOT NULL AND line_index IS NOT NULL GROUP BY 1, 2),
al AS (SELECT source_page, line_index, coalesce({_NORM.replace('text', 'x.transcription')}, '') AS text, coalesce(CAST(x.score AS DOUBLE), 0.0) AS score FROM a),
dq AS (SELECT source_page, line_index, max({{'polygon': polygon, 'document': source_document}}) AS y FROM detected_lines WHERE source_page IS NOT NULL AND line_index IS NOT NULL GROUP BY 1, 2),
de AS (SELECT source_page, line_index, y.polygon AS polygon FROM dq),
ds AS (SELECT source_page, line_index, {_EXTENT[0]} AS w, {_EXTENT[1]} AS h FROM de),
pq AS (SELECT page, max({{'audited_at': audited_at, 'document': document, 'revision': revision, 'image': source_image_sha256}}) AS z FROM page_audit WHERE page IS NOT NULL GROUP BY 1),
li AS (SELECT x.document AS document, max(x.license) AS license FROM a GROUP BY 1),
tx AS (SELECT source_page, string_agg(text, ' ' ORDER BY line_index) AS text FROM al GROUP BY 1),
pf AS (SELECT pq.page, z.document AS document, CASE WHEN z.revision % 10 = 0 THEN 3 ELSE 4 END AS quality, z.image AS image, z.revision AS revision, li.license, coalesce(tx.text, '') AS text FROM pq LEFT JOIN li ON li.document = z.document LEFT JOIN tx ON tx.source_page = pq.page),
pr AS (SELECT page, document, CASE WHEN quality <> 4 THEN 'not_validated' WHEN image IS NULL THEN 'missing_image' WHEN revision IS NULL THEN 'missing_revision' WHEN NOT coalesce(contains(lower(license), 'public domain') OR starts_with(lower(license), 'cc ') OR lower(license) = 'cc0', false) THEN 'unusable_license' WHEN length(text) < 24 THEN 'short_text' ELSE {_reason('text', 0.75)} END AS reason FROM pf),
l AS (SELECT pr.document, al.*, regexp_extract_all(al.text, '(?s).') AS c, ds.w, ds.h FROM al JOIN pr ON pr.page = al.source_page AND pr.reason = 'ok' JOIN ds ON ds.source_page = al.source_page AND ds.line_index = al.line_index),
lr AS (SELECT document, source_page, line_index, sha256(text) AS hash, CASE WHEN score < 0.68 THEN 'low_alignment' WHEN length(text) < 3 THEN 'short_text' WHEN {_reason('text', 0.75)} <> 'ok' THEN {_reason('text', 0.75)} WHEN len(list_filter(c, lambda x: NOT list_contains(va.a, x))) > 0 THEN 'outside_vocabulary' WHEN (length(text) + coalesce(list_sum(list_transform(list_zip(c, c[2:]), lambda p: CAST(p[1] = p[2] AS INT))), 0)) * 4 > 768 THEN 'too_many_steps' WHEN round_even(w * 48 / greatest(1, h), 0) > 883 THEN 'too_wide' ELSE 'ok' END AS reason FROM l, va),
f AS (SELECT *, row_number() OVER (PARTITION BY hash ORDER BY document, source_page, line_index) AS k FROM lr WHERE reason = 'ok'),
r AS (SELECT document, source_page, line_index, reason FROM lr WHERE reason <> 'ok' UNION ALL SELECT document, source_page, line_index, CASE WHEN k = 1 THEN 'ok' ELSE 'duplicate' END FROM f)"""

def _silver(spark, sf) -> dict[str, DataFrame]:
    """silver_lines.build over the tables: page_audit lists the pages, aligned_lines has the alignment."""
    keyed = lambda name, *c: table(spark, sf, name).where("source_page is not null and line_index is not null").groupBy("source_page", "line_index").agg(F.max(F.struct(*c)).alias("x"))
    a = keyed("aligned_lines", "transcription", F.col("source_document").alias("document"), F.col("source_license").alias("license"), F.col("alignment_score").alias("score"))
    al = a.select("source_page", "line_index", F.coalesce(t.normalize_label(F.col("x.transcription")), F.lit("")).alias("transcription"), F.coalesce(F.col("x.score").cast("double"), F.lit(0.0)).alias("score"))
    d = keyed("detected_lines", "polygon", F.col("source_document").alias("document")).select("source_page", "line_index", F.lit("").alias("prediction"), g.quad_extent(F.col("x.polygon")).alias("q"))
    detected = d.join(al.select("source_page", "line_index", F.sha2("transcription", 256).alias("image_hash")), ["source_page", "line_index"], "left").select("source_page", "line_index", "prediction", "q.width", "q.height", "image_hash")
    p = table(spark, sf, "page_audit").where("page is not null").groupBy(F.col("page").alias("source_page")).agg(F.max(F.struct("audited_at", "document", "revision", F.col("source_image_sha256").alias("image"))).alias("z"))
    details = p.select("source_page", F.when(F.col("z.revision") % 10 == 0, 3).otherwise(4).alias("quality"), "z.image", "z.revision")
    files = a.groupBy(F.col("x.document").alias("source_document")).agg(F.max("x.license").alias("license"))
    texts = al.groupBy("source_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "transcription"))), lambda r: r["transcription"]), " ").alias("text"))
    v = vocabulary.Vocabulary.of(_train_vocab(spark, sf))
    return silver_lines.build(p.select(F.col("z.document").alias("source_document"), "source_page"), details, files, texts, detected, v.covers(F.col("transcription")), al)


@_query(_SILVER + " SELECT reason, count(*) AS n FROM (SELECT reason FROM pr UNION ALL SELECT reason FROM r) WHERE reason <> 'ok' GROUP BY 1")
def rejection_ledger(spark, sf):
    """Why pages and lines are left out, over all gates of the silver-line plan."""
    return _silver(spark, sf)["ledger"]


@_query(_SILVER + " SELECT pr.document AS source_document, pr.page AS source_page, coalesce(d.n, 0) AS detected, coalesce(k.n, 0) AS accepted FROM pr LEFT JOIN (SELECT source_page, count(*) AS n FROM ds GROUP BY 1) d ON d.source_page = pr.page LEFT JOIN (SELECT source_page, count(*) AS n FROM r WHERE reason = 'ok' GROUP BY 1) k ON k.source_page = pr.page WHERE pr.reason = 'ok'")
def silver_page_audit(spark, sf):
    """Detected and accepted lines of every page that passes."""
    return _silver(spark, sf)["page_audit"].select("source_document", "source_page", "detected", "accepted")


@_query(_SILVER + " SELECT document AS source_document, source_page, line_index FROM r WHERE reason = 'ok'")
def silver_accepted(spark, sf):
    """The lines that the silver-line plan accepts."""
    return _silver(spark, sf)["accepted"].select("source_document", "source_page", "line_index")


@_query()
def corpus_records(spark, sf):
    """Corpus records of the documents as articles, under the corpus' limit of 250,000 lines (a reported limit)."""
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "title", "text")
    return lines.corpus_lines(d, 250_000)


@_query()
def realigned_lines(spark, sf):
    """Detected lines of each page aligned anew with the page's transcription."""
    a = table(spark, sf, "aligned_lines").where("source_page is not null and line_index is not null").groupBy("source_page", "line_index").agg(F.max("transcription").alias("x"))
    pages = a.groupBy("source_page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_index", "x"))), lambda r: r["x"]), " ").alias("text"))
    d = table(spark, sf, "detected_lines").where("source_page is not null and line_index is not null").groupBy("source_page", "line_index").agg(F.max("prediction").alias("prediction"))
    r = silver_lines.aligned(d, pages)
    return r.select("source_page", "line_index", "prediction", "transcription", F.round("score", 6).alias("score"))


@_query(f"SELECT {_SPLIT} AS split, {_reason('n')} AS reason, count(*) AS n FROM (SELECT split, coalesce({_NORM}, '') AS n FROM mozhi_words) WHERE {_reason('n')} <> 'ok' GROUP BY 1, 2")
def word_crop_exclusions(spark, sf):
    return word_crops.prepare(table(spark, sf, "mozhi_words"))["excluded"]


@_query("SELECT source_document, coalesce(CAST(regexp_extract(source_page, '([0-9]+)$', 1) AS INT), -1) AS page, count(*) AS n, count(DISTINCT line_index) AS lines, count(prediction) AS predicted FROM detected_lines GROUP BY ALL")
def lines_by_page(spark, sf):
    p = F.coalesce(F.regexp_extract("source_page", r"(\d+)$", 1).cast("int"), F.lit(-1)).alias("page")
    return table(spark, sf, "detected_lines").groupBy("source_document", p).agg(F.count("*").alias("n"), F.count_distinct("line_index").alias("lines"), F.count("prediction").alias("predicted"))


@_query(f"""WITH v AS ({_VOCAB}), a AS (SELECT list(char) AS a FROM v), t AS (SELECT DISTINCT id, {_NORM} AS n FROM corpus_lines WHERE {_SPLIT} = 'train'), d AS (SELECT n, regexp_extract_all(n, '(?s).') AS c FROM t WHERE n IS NOT NULL),
r AS (SELECT CASE WHEN len(list_filter(c, lambda x: NOT list_contains(a, x))) > 0 THEN 1 WHEN (length(n) + coalesce(list_sum(list_transform(list_zip(c, c[2:]), lambda p: CAST(p[1] = p[2] AS INT))), 0)) * 4 > 400 THEN 2 ELSE 0 END AS r FROM d, a)
SELECT CAST(count_if(r = 0) AS BIGINT) AS kept, CAST(count_if(r = 1) AS BIGINT) AS outside_vocabulary, CAST(count_if(r = 2) AS BIGINT) AS too_many_steps FROM r""")
def synthetic_fit(spark, sf):
    """How many training lines a vocabulary and a canvas of 400 pixels can take."""
    from bohagi.plans import synthetic

    v = vocabulary.Vocabulary.of(_train_vocab(spark, sf))
    d = table(spark, sf, "corpus_lines").withColumn("split", t.split_name(F.col("split"))).select("id", "text", "split")
    rows = synthetic.renderable(d, v.array(), 400).select("id", "text", "reason").distinct()
    return synthetic.fit_counts(rows)


@_query(f"SELECT split, count(*) AS n FROM (SELECT {_SPLIT} AS split, row_number() OVER (ORDER BY id, split) AS n FROM (SELECT DISTINCT id, {_SPLIT} AS split FROM corpus_lines)) WHERE n <= 5000 GROUP BY 1")
def capped_split_counts(spark, sf):
    """Lines of each split under a cap of 5,000 lines in order of id (the cap is the reported limit)."""
    d = table(spark, sf, "corpus_lines").select("id", t.split_name(F.col("split")).alias("split")).distinct()
    return d.orderBy(F.col("id"), F.col("split").asc_nulls_last()).limit(5000).groupBy("split").agg(F.count("*").alias("n"))


@_query(f"SELECT a.char FROM (SELECT DISTINCT {_CHARS.format('n')} AS char FROM (SELECT {_NORM} AS n FROM corpus_lines)) a INTERSECT SELECT DISTINCT {_CHARS.format('n')} FROM (SELECT {_NORM} AS n FROM mozhi_words)")
def shared_characters(spark, sf):
    return vocabulary.distinct_characters(table(spark, sf, "corpus_lines")).intersect(vocabulary.distinct_characters(table(spark, sf, "mozhi_words")))


@_query("SELECT source_page, line_index, array_to_string(list_transform(range(1, len(w) + 1), lambda i: w[i]), ' ') AS words, CAST(len(w) AS INT) AS n FROM (SELECT DISTINCT source_page, line_index, list_filter(string_split(trim(regexp_replace(transcription, '" + _WS + "+', ' ', 'g')), ' '), lambda x: x <> '') AS w FROM aligned_lines WHERE transcription IS NOT NULL)")
def line_words(spark, sf):
    d = table(spark, sf, "aligned_lines").where("transcription is not null").select("source_page", "line_index", t.words(F.col("transcription")).alias("w")).distinct()
    return d.select("source_page", "line_index", F.array_join("w", " ").alias("words"), F.size("w").alias("n"))


@_query(f"""WITH w AS (SELECT id, image_width AS w, image_height AS h, CAST(length(n) + coalesce(list_sum(list_transform(list_zip(c, c[2:]), lambda p: CAST(p[1] = p[2] AS INT))), 0) AS INT) * 4 AS need FROM (SELECT DISTINCT id, image_width, image_height, n, regexp_extract_all(n, '(?s).') AS c FROM (SELECT id, image_width, image_height, {_NORM} AS n FROM mozhi_words)) WHERE n IS NOT NULL AND image_height > 0)
SELECT id, CASE WHEN need <= 768 THEN CAST(least(768, greatest(4, ceil(greatest(32, round_even(w * 48 / h, 0), need) / 4.0) * 4)) AS INT) END AS canvas, CAST(floor(least(768, greatest(4, ceil(greatest(32, round_even(w * 48 / h, 0), need) / 4.0) * 4)) / 4) AS INT) AS steps FROM w""")
def canvas_widths(spark, sf):
    """Canvas of each word crop and how many steps a recogniser makes on it."""
    d = table(spark, sf, "mozhi_words").select("id", "image_width", "image_height", t.normalize_label(F.col("text")).alias("n")).where("n is not null and image_height > 0").distinct()
    d = d.withColumn("canvas", g.canvas_width(F.col("image_width"), F.col("image_height"), t.ctc_steps(F.col("n"))))
    return d.select("id", "canvas", g.output_length(F.col("canvas")).alias("steps"))


@_query("""WITH b AS (SELECT DISTINCT source_page, id, confidence, greatest(0.0, bbox.x0) AS x0, greatest(0.0, bbox.y0) AS y0, least(700.0, bbox.x1) AS x1, least(1200.0, bbox.y1) AS y1 FROM text_lines) SELECT source_page, id, x0, y0, x1, y1 FROM b WHERE x1 > x0 AND y1 > y0 AND confidence >= 0.5""")
def clipped_boxes(spark, sf):
    """Boxes within a page of 700 by 1200 of a confidence of a half or more, those outside dropped."""
    d = table(spark, sf, "text_lines").select("source_page", "id", "confidence", g.clip_detection(F.col("bbox"), F.lit(700), F.lit(1200), F.col("confidence"), 0.5).alias("b")).where("b is not null").distinct()
    return d.select("source_page", "id", "b.x0", "b.y0", "b.x1", "b.y1")


@_query("SELECT DISTINCT document, source_image_sha256 FROM page_audit WHERE document IN (SELECT source_document FROM aligned_lines WHERE alignment_score >= 0.68)")
def attribution_list(spark, sf):
    """Page images of the documents that an accepted line comes from."""
    files = table(spark, sf, "page_audit").select(F.col("document").alias("source_document"), "source_image_sha256").distinct()
    good = table(spark, sf, "aligned_lines").where("alignment_score >= cast(0.68 as float)")
    return silver_lines.attributions(files, good).select(F.col("source_document").alias("document"), "source_image_sha256")


@_query(f"SELECT split, document, n FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY substr(sha256('1337:' || document), 1, 16), document) AS r FROM (SELECT {_SPLIT} AS split, source_document AS document, count(DISTINCT id) AS n FROM aligned_lines GROUP BY 1, 2) WHERE n > 0) WHERE r <= 3")
def accepted_documents(spark, sf):
    """Of each split the first three documents by hash with an accepted line."""
    d = table(spark, sf, "aligned_lines").groupBy(t.split_name(F.col("split")).alias("split"), F.col("source_document").alias("document")).agg(F.count_distinct("id").alias("n"))
    return selection.accepted_documents(d, "split", [t.stable_order(F.col("document")), "document"], "n", 3)


@_query()
def polygon_order(spark, sf):
    """Reading order of the detected lines of each page by their boxes."""
    d = table(spark, sf, "detected_lines").where("source_page is not null and polygon is not null").select("source_page", "line_index", g.polygon_box(F.col("polygon")).alias("box")).distinct()
    return layout.order_lines(d, ["source_page"], "line_index", "box", 1200.0)


def _page_documents(spark, sf, text: str, off: bool = False) -> DataFrame:
    """Aligned lines as documents: a page for each page, a region for each line; its box off by up to 30 each way."""
    d = _once(table(spark, sf, "aligned_lines"), "source_page", "line_index")
    b = _once(table(spark, sf, "detected_lines"), "source_page", "line_index").select("source_page", "line_index", g.polygon_box(F.col("polygon")).alias("bbox"))
    if off:
        dx, dy = (F.pmod(F.xxhash64("source_page", "line_index", F.lit(k)), F.lit(61)) - 30 for k in (1, 2))
        b = b.withColumn("bbox", g.box(F.col("bbox.x0") + dx, F.col("bbox.y0") + dy, F.col("bbox.x1") + dx, F.col("bbox.y1") + dy))
    x = d.join(b, ["source_page", "line_index"])
    line = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.lit(0).alias("order"))
    region = F.struct(F.col("line_index").alias("order"), F.lit("text").alias("label"), "bbox", F.array(line).alias("lines"))
    p = x.groupBy(F.col("source_document").alias("doc"), F.regexp_extract("source_page", r"(\d+)$", 1).cast("int").alias("number")).agg(F.array_sort(F.collect_list(region)).alias("regions"))
    return p.groupBy("doc").agg(F.collect_list(F.struct("number", "regions")).alias("pages"))


@_query()
def document_evaluation(spark, sf):
    """Bootstrap predictions of every page evaluated against the transcriptions: layout, order and text."""
    from bohagi.operators.evaluation import evaluate_documents

    r = evaluate_documents(_page_documents(spark, sf, "transcription"), _page_documents(spark, sf, "prediction", True))
    return r["layout"].crossJoin(r["order"].select("concordant", "comparable", "accuracy")).crossJoin(r["ocr"].select("samples", "cer", "wer"))  # one row each


@_query()
def page_overlays(spark, sf):
    """Mark-up of every scanned page with a transparent span for each line."""
    d = _once(table(spark, sf, "text_lines"), "source_page", "line_order")
    line = F.struct(F.col("line_order").alias("order"), "bbox", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))
    region = F.struct(F.lit("text").alias("label"), F.struct(*[F.lit(v).alias(k) for k, v in (("x0", 0.0), ("y0", 0.0), ("x1", 1000.0), ("y1", 1400.0))]).alias("bbox"), F.array_sort(F.collect_list(line)).alias("lines"))
    p = d.groupBy("source_page", "page_number").agg(region.alias("r"))
    page = F.struct(F.col("page_number").alias("number"), F.lit(1000).alias("width"), F.lit(1400).alias("height"), F.array("r").alias("regions"))
    return p.select("source_page", writers.page_overlay(page, F.lit(b"")).alias("html"))


@_query()
def weighted_draw(spark, sf):
    """How often each word crop comes in a draw of as many rows with replacement, hard characters twice as likely."""
    d = table(spark, sf, "mozhi_words").select(F.lit("real").alias("source"), "id", "text").distinct()
    w = selection.sampling_weights(d, "text", "source", {"real": 1.0}, _HARD, 2.0)
    return selection.draw(w, "weight", d.count(), ["id", "text"], 7).select("id", "text", "copies")
