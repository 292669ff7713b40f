"""Pages to documents with models plugged in: detect regions and lines, recognise, arrange, nest.

Models are factories: each task makes its own once and calls it on page images. Fakes stand in tests.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from bohagi import schemas
from bohagi.operators.layout import arrange_pages, line_order


class LayoutDetector(Protocol):
    def __call__(self, image: bytes, width: int, height: int) -> list[dict]: ...  # id, label, bbox, confidence


class TextDetector(Protocol):
    def __call__(self, image: bytes, width: int, height: int) -> list[list[list[float]]]: ...  # polygons


class TextRecognizer(Protocol):
    def __call__(self, image: bytes, polygon: list[list[float]]) -> tuple[str, float]: ...  # text, confidence


def recognise(pages: DataFrame, layout: Callable[[], LayoutDetector], detector: Callable[[], TextDetector], recognizer: Callable[[], TextRecognizer]) -> DataFrame:
    """(doc, number, width, height, regions, lines) of page images (doc, number, width, height, content)."""
    kind = f"doc string, number int, width int, height int, regions array<struct<{schemas.REGION}>>, lines array<struct<{schemas.LINE}>>"
    types = [pa.string(), pa.int32(), pa.int32(), pa.int32()]

    target = to_arrow_schema(T.StructType.fromDDL(kind))

    def run(batches):
        find, lines, read = layout(), detector(), recognizer()
        for b in batches:
            for doc, n, w, h, image in zip(*(b.column(i).to_pylist() for i in range(5))):
                polys = lines(image, w, h)
                boxes = [(min(x for x, _ in p), min(y for _, y in p), max(x for x, _ in p), max(y for _, y in p)) for p in polys]
                out = []
                for k, i in enumerate(line_order(boxes, w)):
                    text, sure = read(image, polys[i])
                    x0, y0, x1, y1 = map(float, boxes[i])
                    out.append({"id": f"p{n}-line-{k:05d}", "bbox": {"x0": x0, "y0": y0, "x1": x1, "y1": y1}, "polygon": polys[i], "text": text, "confidence": sure, "order": 0})
                regions = [r | {"order": 0, "lines": []} for r in find(image, w, h)]
                cols = [pa.array([v], t) for v, t in zip((doc, n, w, h), types)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array([regions], target.field("regions").type), pa.array([out], target.field("lines").type)], schema=target)

    return pages.select("doc", F.col("number").cast("int"), F.col("width").cast("int"), F.col("height").cast("int"), "content").mapInArrow(run, kind)


def documents(recognised: DataFrame, language: str = "as") -> DataFrame:
    """One row a document: schema_version, language, source, pages in order, metadata."""
    p = arrange_pages(recognised, ["doc", "number", "width", "height"])
    page = F.struct("number", F.col("width").cast("double").alias("width"), F.col("height").cast("double").alias("height"), "regions")
    return p.groupBy("doc").agg(F.array_sort(F.collect_list(page), lambda a, b: a["number"] - b["number"]).alias("pages")).select(
        "doc", F.lit("1.0").alias("schema_version"), F.lit(language).alias("language"), F.col("doc").alias("source"), "pages", F.create_map().cast("map<string,string>").alias("metadata"))
