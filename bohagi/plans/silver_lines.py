"""Aligned lines of proofread pages: gates, alignment, first-wins deduplication, ledger and audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bohagi.functions.align import align_transcription
from bohagi.functions.html import page_text
from bohagi.functions.text import ASSAMESE, ctc_steps, label_reason, normalize_label, usable_license
from bohagi.operators.cross_split import first_wins


def is_scan_title(title: Column, djvu: bool = False) -> Column:
    low = F.lower(title)
    return low.endswith(".pdf") | (low.endswith(".djvu") if djvu else F.lit(False))


def page_reason(quality: Column, image: Column, revision: Column, license: Column, text: Column, any_license: bool = False) -> Column:
    """Why a page is left out, the first that fails; ok otherwise. The length is looked at before validity."""
    return (
        F.when(F.coalesce(quality, F.lit(0)) != 4, "not_validated")
        .when(image.isNull(), "missing_image")
        .when(revision.isNull(), "missing_revision")
        .when(~F.coalesce(usable_license(license), F.lit(False)) & F.lit(not any_license), "unusable_license")
        .when(F.length(text) < 24, "short_text")
        .otherwise(label_reason(text, ASSAMESE, ASSAMESE.line_ratio))
    )


def transcriptions(pages: DataFrame, markup: str = "html") -> DataFrame:
    """pages with their text from mark-up."""
    return pages.withColumn("text", page_text(F.col(markup)))


def aligned(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """(source_page, line_index, prediction, transcription, score): detected lines of each page in order, aligned
    with the page's text. A page's lines are gathered, no more."""
    p = lines.withColumn("prediction", normalize_label(F.col("prediction"))).where("prediction <> ''")
    g = p.groupBy("source_page").agg(F.array_sort(F.collect_list(F.struct("line_index", "prediction"))).alias("l")).join(pages.select("source_page", "text"), "source_page")
    a = g.select("source_page", "l", align_transcription(F.col("l.prediction"), F.col("text")).alias("a"))
    x = a.select("source_page", F.explode(F.transform("a", lambda r: F.struct(F.get(F.col("l.line_index"), r["index"]).alias("line_index"), r["prediction"].alias("prediction"), r["transcription"].alias("transcription"), r["score"].alias("score")))).alias("x"))
    return x.select("source_page", "x.*")


def line_reason(text: Column, score: Column, covered: Column, width: Column, height: Column, least: float = 0.68, most_width: int = 768) -> Column:
    """Why a line is left out, the first that fails; ok otherwise (duplicates are found afterwards)."""
    crop = F.bround(width * 48 / F.greatest(F.lit(1), height), 0)
    return (
        F.when(score < least, "low_alignment")
        .when(F.length(text) < 3, "short_text")
        .when(label_reason(text, ASSAMESE, ASSAMESE.line_ratio) != "ok", label_reason(text, ASSAMESE, ASSAMESE.line_ratio))
        .when(~covered, "outside_vocabulary")
        .when(ctc_steps(text) * 4 > most_width, "too_many_steps")
        .when(crop > round(most_width * 1.15), "too_wide")
        .otherwise("ok")
    )


def accepted(gated: DataFrame, image_hash: str, order: list) -> DataFrame:
    """Lines that pass every gate, each image once in order of work."""
    return first_wins(gated.where("reason = 'ok'"), image_hash, order)


def ledger(*reasons: DataFrame) -> DataFrame:
    """(reason, n) over every table's rejected rows."""
    every = reasons[0].select("reason")
    for r in reasons[1:]:
        every = every.unionByName(r.select("reason"))
    return every.where("reason <> 'ok'").groupBy("reason").agg(F.count("*").alias("n"))


def gated_pages(listed: DataFrame, details: DataFrame, files: DataFrame, texts: DataFrame, any_license: bool = False) -> DataFrame:
    """Listed pages (source_document, source_page) with their details (source_page, quality, image, revision), their
    file's licence (source_document, license) and text (source_page, text), and the reason of each. Pages
    without details, licence or text keep nulls and fall to the gate that asks for them."""
    d = listed.join(details, "source_page", "left").join(files.select("source_document", "license"), "source_document", "left").join(texts.select("source_page", "text"), "source_page", "left")
    return d.withColumn("reason", page_reason(*(F.col(c) for c in ("quality", "image", "revision", "license")), F.coalesce("text", F.lit("")), any_license))


def gated_lines(lines: DataFrame, covered: Column, duplicate: str = "image_hash", order: list | None = None) -> DataFrame:
    """Aligned lines (source_document, source_page, line_index, transcription, score, width, height, image_hash) with the
    reason of each: the gates in order, then duplicate for an image that an earlier line has."""
    order = order or ["source_document", "source_page", "line_index"]
    d = lines.withColumn("transcription", F.coalesce("transcription", F.lit("")))
    d = d.withColumn("reason", line_reason(F.col("transcription"), F.coalesce("score", F.lit(0.0)), covered, F.col("width"), F.col("height")))
    good = d.where("reason = 'ok'")
    first = first_wins(good, duplicate, order).select("source_page", "line_index", F.lit(True).alias("first"))
    marked = good.join(first, ["source_page", "line_index"], "left").withColumn("reason", F.when(F.col("first"), "ok").otherwise("duplicate")).drop("first")
    return d.where("reason <> 'ok'").unionByName(marked)


def build(listed: DataFrame, details: DataFrame, files: DataFrame, texts: DataFrame, detected: DataFrame, covered: Column, alignment: DataFrame | None = None, any_license: bool = False) -> dict[str, DataFrame]:
    """The whole preparation from a list of pages: accepted lines, rejected ones with reasons, the ledger of both
    gates, the audit of detected and accepted lines of each page that passed, and the attributions.

    detected has source_page, line_index, prediction, width, height and image_hash, one row for each line. Its lines are
    aligned with the page's text (alignment gives source_page, line_index, transcription and score where that has been
    done). covered says of a column transcription whether a vocabulary has all of it."""
    pages = gated_pages(listed, details, files, texts, any_license)
    good = pages.where("reason = 'ok'").select("source_document", "source_page", "text")
    done = alignment if alignment is not None else aligned(detected, good)
    facts = detected.select("source_page", "line_index", "width", "height", "image_hash")
    lines = good.drop("text").join(done.select("source_page", "line_index", "transcription", "score"), "source_page").join(facts, ["source_page", "line_index"])
    lines = gated_lines(lines, covered)
    kept = lines.where("reason = 'ok'").drop("reason")
    count = lambda d, n: d.groupBy("source_page").agg(F.count("*").alias(n))
    audit = good.drop("text").join(count(detected, "detected"), "source_page", "left").join(count(kept, "accepted"), "source_page", "left").fillna(0, ["detected", "accepted"])
    return {"accepted": kept, "rejected": lines.where("reason <> 'ok'"), "ledger": ledger(pages, lines), "page_audit": audit, "attributions": attributions(files, kept)}


def attributions(files: DataFrame, accepted_lines: DataFrame) -> DataFrame:
    """Attribution of the files that an accepted line comes from."""
    return files.join(accepted_lines.select("source_document").distinct(), "source_document", "left_semi")
