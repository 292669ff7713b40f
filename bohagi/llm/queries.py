"""Queries of this subpackage over the test tables: name -> (spark, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bohagi.llm import encoding, grouped_splits, leakage, lookalikes, near_duplicates, packing, quality, scans, split_overlap, term_counts
from bohagi.session import scratch, table


#: The tables come in two deliveries, before and since; rows without a time are in the second.
DELIVERED = "coalesce(ingested_at < timestamp'2023-01-01', false)"


def _counts(spark: SparkSession, sf: str) -> dict[str, term_counts.TermCounts]:
    out = {}
    for collection, name, unit in (("characters", "corpus_lines", "characters"), ("words", "documents", "words")):
        c = term_counts.TermCounts(spark, scratch(spark, "terms"), unit)
        c.apply(term_counts.added(table(spark, sf, name).where(DELIVERED), "text"))
        c.apply(term_counts.added(table(spark, sf, name).where(f"not {DELIVERED}"), "text"))
        out[collection] = c
    return out


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Characters of corpus_lines and words of documents that are too rare or too common."""
    parts = [c.marked().select(F.lit(k).alias("collection"), "term", "mark") for k, c in _counts(spark, sf).items()]
    return parts[0].unionByName(parts[1])


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Occurrences and records of every character and word."""
    parts = [c.counts().select(F.lit(k).alias("collection"), "term", "occurrences", "records") for k, c in _counts(spark, sf).items()]
    return parts[0].unionByName(parts[1])


def p1_after_changes(spark: SparkSession, sf: str) -> DataFrame:
    """Word counts of documents after they came in two deliveries: first those ingested before 2023 with
    every lang in lower case, then the rest and the corrections. Equals the counts of the whole table."""
    docs = table(spark, sf, "documents").select("doc_id", "text", "ingested_at")
    early = docs.where(DELIVERED).withColumn("text", F.lower("text"))
    c = term_counts.TermCounts(spark, scratch(spark, "terms"), "words")
    c.apply(term_counts.added(early, "text"))
    c.apply(term_counts.changes_between(early, docs, "doc_id", "text"))
    return c.counts()


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of documents of at least 20 words of whose three-word runs at least half are shared."""
    return near_duplicates.near_duplicate_pairs(table(spark, sf, "documents"), k=3, threshold=0.5, least_words=20)


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every document with a near-duplicate: its group and its number of links."""
    return near_duplicates.near_duplicate_groups(table(spark, sf, "documents"), k=3, threshold=0.5, least_words=20)


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Records of evaluation splits that lie in train as well: images by hash, lines by text."""
    a = split_overlap.image_overlap(table(spark, sf, "mozhi_words"))
    b = split_overlap.text_overlap(table(spark, sf, "corpus_lines"))
    return a.select(F.lit("image").alias("kind"), "id_a", "id_b").unionByName(b.select(F.lit("text").alias("kind"), "id_a", "id_b"))


def p3_images(spark: SparkSession, sf: str) -> DataFrame:
    """The image pairs of p3_found by themselves."""
    return split_overlap.image_overlap(table(spark, sf, "mozhi_words"))


def p3_report(spark: SparkSession, sf: str) -> DataFrame:
    """How many evaluation records lie in train, by split and source."""
    w, c = table(spark, sf, "mozhi_words"), table(spark, sf, "corpus_lines")
    a = split_overlap.overlap_report(split_overlap.overlapping_images(w), w, "id", "split", "source_config")
    b = split_overlap.overlap_report(split_overlap.overlapping_texts(c), c, "id", "split", "source_title")
    return a.select(F.lit("image").alias("kind"), "split", "source", "records").unionByName(b.select(F.lit("text").alias("kind"), "split", "source", "records"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines that a reader cannot tell apart although their characters differ."""
    a = lookalikes.same_looking(table(spark, sf, "corpus_lines"), "id", "text")
    b = lookalikes.same_looking(table(spark, sf, "aligned_lines"), "id", "transcription")
    return a.select(F.lit("corpus_lines").alias("source_table"), "id_a", "id_b").unionByName(b.select(F.lit("aligned_lines").alias("source_table"), "id_a", "id_b"))


def p4_forms(spark: SparkSession, sf: str) -> DataFrame:
    """The one form of the texts of all four tables."""
    parts = []
    for name, key, text in (("corpus_lines", "id", "text"), ("mozhi_words", "id", "text"), ("documents", "doc_id", "text"), ("aligned_lines", "id", "transcription")):
        d = table(spark, sf, name).select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
        parts.append(lookalikes.canonical_texts(d, "id", "text").select(F.lit(name).alias("source_table"), "id", "form"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose related records lie in more than one split."""
    return grouped_splits.torn_sources(table(spark, sf, "corpus_lines"))


def p5_splits(spark: SparkSession, sf: str) -> DataFrame:
    """The split of every source, related ones together, in the proportions 90, 5 and 5 %."""
    return grouped_splits.grouped_splits(table(spark, sf, "corpus_lines"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of scanned pages with furniture, page numbers, broken words or misread characters."""
    return scans.noise(table(spark, sf, "detected_lines"), table(spark, sf, "aligned_lines"), table(spark, sf, "text_lines"), table(spark, sf, "corpus_lines"))


def p6_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Readable paragraphs of every book, joined over its pages."""
    return scans.book_paragraphs(table(spark, sf, "detected_lines"), table(spark, sf, "aligned_lines"), table(spark, sf, "text_lines"), table(spark, sf, "corpus_lines"))


def p6_page_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Readable paragraphs of every page by itself."""
    return scans.paragraphs(table(spark, sf, "detected_lines"), table(spark, sf, "aligned_lines"), table(spark, sf, "text_lines"), table(spark, sf, "corpus_lines"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least 12 successive words of an evaluation item."""
    return leakage.leaked(table(spark, sf, "documents"), table(spark, sf, "eval_passages"))


def p7_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Documents without the leaked spans."""
    return leakage.without_leaks(table(spark, sf, "documents"), table(spark, sf, "eval_passages"))


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    """The ids of every document by byte_bpe_50k."""
    return encoding.encode_corpus(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    """Every document (or part of one longer than that) in a container of 8,192 ids of byte_bpe_50k."""
    return packing.pack_documents(table(spark, sf, "documents"))


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return quality.text_statistics(table(spark, sf, "documents")).where("kind in ('list', 'table', 'junk')").select("doc_id", "kind")


def p10_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Quality statistics of every document."""
    return quality.text_statistics(table(spark, sf, "documents"))


def p10_ratios(spark: SparkSession, sf: str) -> DataFrame:
    """Of the statistics those that SQL can say."""
    d = quality.text_statistics(table(spark, sf, "documents"))
    return d.select("doc_id", "n_words", "n_lines", *[F.round(c, 6).alias(c) for c in ("mean_word_length", "ended_lines", "single_letters", "repeated_words", "repeated_lines")])


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p1_after_changes, p2_found, p2_groups, p3_found, p3_images, p3_report, p4_found, p4_forms, p5_found, p5_splits, p6_found, p6_paragraphs, p6_page_paragraphs, p7_found, p7_clean, p8_ids, p9_containers, p10_found, p10_statistics, p10_ratios)}

#: White space as Python counts it, for DuckDB.
_WS = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NORM = f"trim(regexp_replace(nfc_normalize(text), '{_WS}+', ' ', 'g'))"
_WORDS = f"SELECT doc_id AS k, list_filter(string_split({_NORM}, ' '), lambda x: x <> '') AS t FROM documents WHERE text IS NOT NULL"
_LETTERS = f"SELECT row_number() OVER () AS k, regexp_extract_all({_NORM}, '(?s).') AS t FROM corpus_lines WHERE text IS NOT NULL"
_COUNTS = "SELECT term, count(*) AS occurrences, count(DISTINCT k) AS records FROM (SELECT k, unnest(t) AS term FROM ({0})) GROUP BY 1"
_MARKED = "SELECT '{0}' AS collection, term, m AS mark FROM ({1}) c, (VALUES ('rare'), ('common')) v(m), (SELECT count(*) AS n FROM ({2})) z WHERE (m = 'rare' AND records < 3) OR (m = 'common' AND records * 2 > n)"

#: SQL of the queries that SQL can express over whole tables.
ORACLES: dict[str, str] = {
    "p1_found": _MARKED.format("characters", _COUNTS.format(_LETTERS), _LETTERS) + " UNION ALL " + _MARKED.format("words", _COUNTS.format(_WORDS), _WORDS),
    "p1_counts": f"SELECT 'characters' AS collection, * FROM ({_COUNTS.format(_LETTERS)}) UNION ALL SELECT 'words', * FROM ({_COUNTS.format(_WORDS)})",
    "p1_after_changes": _COUNTS.format(_WORDS),
    "p5_found": f"""WITH RECURSIVE f AS (SELECT DISTINCT split_part(id, ':', 2) AS s, nullif(trim(regexp_replace(nfc_normalize(source_title), '{_WS}+', ' ', 'g')), '') AS t, nullif(lower(trim(split)), '') AS p FROM corpus_lines WHERE split_part(id, ':', 2) <> ''),
r AS (SELECT DISTINCT s, s AS o FROM f UNION SELECT r.s, b.s FROM r JOIN f a ON a.s = r.o JOIN f b ON b.t = a.t)
SELECT r.s AS source_id FROM r JOIN f ON f.s = r.o WHERE f.p IS NOT NULL GROUP BY 1 HAVING count(DISTINCT f.p) > 1""",
    "p2_found": f"""WITH w AS (SELECT k, t FROM ({_WORDS}) WHERE len(t) >= 20),
s AS (SELECT DISTINCT k, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) AS g FROM w),
n AS (SELECT k, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT a.k AS x, b.k AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.k < b.k GROUP BY 1, 2)
SELECT x AS doc_id_a, y AS doc_id_b FROM o JOIN n p ON p.k = x JOIN n q ON q.k = y WHERE 2 * o >= p.n + q.n - o""",
}

_SPLIT = "lower(trim(split))"
_SIDE = f"SELECT DISTINCT id, lower(trim(image_sha256)) AS h, {_SPLIT} = 'train' AS t FROM mozhi_words WHERE id IS NOT NULL AND trim(image_sha256) <> '' AND {_SPLIT} IN ('train', 'validation', 'test')"
_PIECES = f"regexp_extract_all(text, '[^{_WS[1:]}+')"
_ENDS = ", ".join("'" + c + "'" for c in quality.ENDINGS)
ORACLES |= {
    "p2_groups": f"""WITH RECURSIVE pr AS ({ORACLES["p2_found"]}), e AS (SELECT doc_id_a AS a, doc_id_b AS b FROM pr UNION SELECT doc_id_b, doc_id_a FROM pr),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), d AS (SELECT a, count(*) AS n FROM e GROUP BY 1)
SELECT r.a AS doc_id, min(r.b) AS class_id, min(d.n) AS links FROM r JOIN d ON d.a = r.a GROUP BY 1""",
    "p3_images": f"SELECT DISTINCT least(a.id, b.id) AS id_a, greatest(a.id, b.id) AS id_b FROM ({_SIDE}) a JOIN ({_SIDE}) b ON a.h = b.h AND a.t AND NOT b.t AND a.id <> b.id",
    "p10_ratios": f"""WITH d AS (SELECT doc_id, {_PIECES} AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^{_WS[1:]}')) AS l FROM documents)
SELECT doc_id, CAST(coalesce(len(w), 0) AS INT) AS n_words, CAST(coalesce(len(l), 0) AS INT) AS n_lines, CASE WHEN len(w) > 0 THEN round(list_sum(list_transform(w, lambda x: length(x))) / len(w), 6) ELSE 0 END AS mean_word_length,
CASE WHEN len(w) > 0 THEN round(len(list_filter(l, lambda x: right(regexp_replace(x, '{_WS}+$', ''), 1) IN ({_ENDS}))) / len(l), 6) ELSE 0 END AS ended_lines,
CASE WHEN len(w) > 0 THEN round(len(list_filter(w, lambda x: length(x) <= 1)) / len(w), 6) ELSE 0 END AS single_letters,
CASE WHEN len(w) > 0 THEN round(1 - len(list_distinct(w)) / len(w), 6) ELSE 0 END AS repeated_words, CASE WHEN len(w) > 0 THEN round(1 - len(list_distinct(l)) / len(l), 6) ELSE 0 END AS repeated_lines FROM d""",
}
