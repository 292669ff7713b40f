"""Evaluation of recognised documents against expected ones: layout, order and text together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bohagi.operators.layout import match_regions, order_pairs
from bohagi.operators.metrics import detection_rates, ocr_metrics


def _pages(docs: DataFrame) -> DataFrame:
    return docs.select("doc", F.explode("pages").alias("p")).select("doc", F.col("p.number").alias("page"), F.col("p.regions").alias("regions"))


def _regions(pages: DataFrame) -> DataFrame:
    return pages.select("doc", "page", F.posexplode("regions").alias("idx", "r")).select("doc", "page", "idx", "r.label", "r.bbox", "r.order")


def _text(pages: DataFrame, name: str) -> DataFrame:
    """All lines of a page by region and line order; blank ones stay. Regions may have no lines at all."""
    rs = F.array_sort(F.transform("regions", lambda r, i: F.struct(r["order"].alias("o"), i.alias("i"), F.array_sort(F.transform(r["lines"], lambda x, k: F.struct(x["order"].alias("o"), k.alias("k"), x["text"].alias("t")))).alias("l"))))
    return pages.select("doc", "page", F.array_join(F.transform(F.flatten(F.transform(F.filter(rs, lambda r: r["l"].isNotNull()), lambda r: r["l"])), lambda x: x["t"]), "\n").alias(name))


def evaluate_documents(expected: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> dict[str, DataFrame]:
    """layout, layout_by_class, order and ocr of documents (doc, pages). A page that only one side has is an
    error, raised as the tables are computed."""
    ep, pp = _pages(expected), _pages(predicted)
    both = _text(ep, "reference").join(_text(pp, "hypothesis"), ["doc", "page"], "full_outer")
    whole = both.where(F.col("reference").isNotNull() & F.col("hypothesis").isNotNull() | F.raise_error(F.concat(F.lit("a page is on one side only: "), F.col("page").cast("string"))).cast("boolean"))
    er, pr = _regions(ep), _regions(pp)
    m = match_regions(er, pr, ["doc", "page"], threshold)
    hits = m.join(er.select("doc", "page", F.col("idx").alias("e"), "label", F.col("order").alias("eo")), ["doc", "page", "e"]).join(pr.select("doc", "page", F.col("idx").alias("p"), F.col("order").alias("po")), ["doc", "page", "p"])
    zero = F.lit(0).cast("long")
    n = hits.groupBy("label").agg(F.count("*").alias("tp"), zero.alias("e"), zero.alias("p"))
    n = n.unionByName(er.groupBy("label").agg(zero.alias("tp"), F.count("*").alias("e"), zero.alias("p"))).unionByName(pr.groupBy("label").agg(zero.alias("tp"), zero.alias("e"), F.count("*").alias("p")))
    counts = [F.sum("tp").alias("true_positive"), (F.sum("p") - F.sum("tp")).alias("false_positive"), (F.sum("e") - F.sum("tp")).alias("false_negative")]
    return {
        "layout": detection_rates(n.agg(*counts)),
        "layout_by_class": detection_rates(n.groupBy("label").agg(*counts)),
        "order": order_pairs(hits, ["doc", "page"], "eo", "po"),
        "ocr": ocr_metrics(whole, "reference", "hypothesis", []),
    }
