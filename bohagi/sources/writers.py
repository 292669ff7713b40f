"""Sinks: data sets by split, JSON lines, reports, text, mark-up overlays, manifests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bohagi.functions.geometry import height, html_font_size, width
from bohagi.functions.html import escape


def _hadoop(path: str):
    """(file system, path) of any scheme."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        raise ValueError(f"{path} needs a session")
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def guard(path: str, overwrite: bool = False) -> None:
    """Refuses the root, the working folder and its parents, and folders that hold something unless told. Paths with a
    scheme are looked up in their own file system."""
    if "://" in path and not path.startswith("file://"):
        fs, at = _hadoop(path)
        if at.getParent() is None:
            raise ValueError(f"refusing to write to {path}")
        if fs.exists(at) and len(fs.listStatus(at)) and not overwrite:
            raise FileExistsError(f"{path} holds something")
        return
    p = Path(path.removeprefix("file://")).resolve()
    if p == Path(p.anchor) or p == Path.cwd() or p in Path.cwd().parents:
        raise ValueError(f"refusing to write to {p}")
    if p.exists() and any(p.iterdir()) and not overwrite:
        raise FileExistsError(f"{p} holds something")


def write_dataset(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by split."""
    df.write.mode("overwrite" if overwrite else "errorifexists").partitionBy("split").parquet(path)


def write_jsonl(df: DataFrame, path: str, overwrite: bool = False) -> None:
    df.write.mode("overwrite" if overwrite else "errorifexists").json(path)


def report(df: DataFrame) -> str:
    """A one-row table as readable JSON."""
    return df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("j")).first()["j"]


def write_report(df: DataFrame, path: str) -> None:
    """Written beside and renamed, so a reader never sees half of it."""
    new = f"{path}.new"
    Path(new).write_text(report(df) + "\n", encoding="utf-8")
    os.replace(new, path)


def promote(spark, staged: str, target: str) -> None:
    """A staged folder takes the place of the target. The old one is set aside first and removed last, and comes back if
    the staged one can't be renamed, so at every moment one of them is whole."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    new, at, aside = (jvm.org.apache.hadoop.fs.Path(x) for x in (staged, target, target.rstrip("/") + ".old"))
    fs = at.getFileSystem(conf)
    if not fs.exists(new):
        raise OSError(f"{staged} is not there")
    if fs.exists(at):
        fs.delete(aside, True)  # left by a job that broke off after its rename
        if not fs.rename(at, aside):
            raise OSError(f"could not set {target} aside")
    if not fs.rename(new, at):
        if fs.exists(aside):
            fs.rename(aside, at)
        raise OSError(f"could not rename {staged} to {target}")
    fs.delete(aside, True)


def write_text(documents: DataFrame, path: str, name: str = "name", pages: str = "pages", overwrite: bool = False) -> None:
    """The text of each document (name, pages) in a folder name=..., one file for each."""
    d = documents.select(F.col(name).alias("name"), document_text(F.col(pages)).alias("value")).where("value <> ''")
    d.select("name", F.regexp_replace("value", r"\n$", "").alias("value")).write.mode("overwrite" if overwrite else "errorifexists").partitionBy("name").text(path)


def document_text(pages: Column) -> Column:
    """Text of a document's pages in reading order: blank lines dropped, an empty line between regions, a form
    feed between pages, one line end at the end; empty where there is no text."""

    def lines(r: Column) -> Column:
        s = F.array_sort(F.transform(r["lines"], lambda x, i: F.struct(x["order"].alias("o"), i.alias("i"), F.trim(F.regexp_replace(x["text"], r"^[\s]+|[\s]+$", "")).alias("t"))))
        return F.array_join(F.transform(F.filter(s, lambda x: x["t"] != ""), lambda x: x["t"]), "\n")

    def regions(p: Column) -> Column:
        s = F.array_sort(F.transform(p["regions"], lambda r, i: F.struct(r["order"].alias("o"), i.alias("i"), lines(r).alias("t"))))
        return F.array_join(F.transform(F.filter(s, lambda x: x["t"] != ""), lambda x: x["t"]), "\n\n")

    t = F.regexp_replace(F.array_join(F.transform(pages, regions), "\n\n\f\n\n"), r"\s+$", "")
    return F.when(t == "", "").otherwise(F.concat(t, F.lit("\n")))


def _style(b: Column) -> Column:
    return F.format_string("left:%spx;top:%spx;width:%spx;height:%spx", b["x0"], b["y0"], width(b), height(b))


def page_overlay(page: Column, image: Column) -> Column:
    """Mark-up of a page: its image, a box for each region and a transparent, selectable span for each line."""
    regions = F.array_join(F.transform(page["regions"], lambda r: F.concat(F.lit('<div class="region" title="'), escape(r["label"]), F.lit('" style="'), _style(r["bbox"]), F.lit('"></div>'))), "")
    spans = F.array_join(F.flatten(F.transform(page["regions"], lambda r: F.transform(r["lines"], lambda x: F.concat(
        F.lit('<span class="line" data-confidence="'), F.format_string("%.6f", x["confidence"]), F.lit('" style="'), _style(x["bbox"]), F.format_string(";font-size:%spx", html_font_size(x["bbox"])), F.lit('">'), escape(x["text"]), F.lit("</span>"))))), "")
    head = F.format_string('<section class="page" style="width:%spx;height:%spx">', page["width"], page["height"])
    return F.concat(head, F.lit('<img src="data:image/webp;base64,'), F.regexp_replace(F.base64(image), r"\s", ""), F.format_string('" alt="page %d">', page["number"]), regions, spans, F.lit("</section>"))


#: The overlay's style sheet.
STYLE = ".page{position:relative;margin:1em auto}.page img{position:absolute;width:100%;height:100%}.region{position:absolute}.line{position:absolute;color:transparent;white-space:pre}"


def html_page(sections: Column, language: str = "as", title: str = "Document") -> Column:
    """A whole document of page sections."""
    head = f'<!doctype html>\n<html lang="{language}"><head><meta charset="utf-8"><title>{title}</title><style>{STYLE}</style></head><body>'
    return F.concat(F.lit(head), F.array_join(sections, ""), F.lit("</body></html>"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of a bundle's files."""
    return files.select("path", "bytes", "sha256")
