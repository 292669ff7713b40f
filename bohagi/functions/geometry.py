"""Box geometry as expressions over struct<x0, y0, x1, y1> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from bohagi.schemas import LAYOUT_LABELS


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"))


def width(b: Column) -> Column:
    return b["x1"] - b["x0"]


def height(b: Column) -> Column:
    return b["y1"] - b["y0"]


def center_x(b: Column) -> Column:
    return (b["x0"] + b["x1"]) / 2


def center_y(b: Column) -> Column:
    return (b["y0"] + b["y1"]) / 2


def is_box(b: Column) -> Column:
    """Whether its ends are in order."""
    return (b["x1"] >= b["x0"]) & (b["y1"] >= b["y0"])


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), width(b)) * F.greatest(F.lit(0.0), height(b))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h)


def iou(a: Column, b: Column, floor: float = 1.0) -> Column:
    """Intersection over union, the union being floor at least: 1 in layout, 1e-9 in evaluation."""
    i = intersection(a, b)
    return i / F.greatest(F.lit(floor), area(a) + area(b) - i)


def line_overlap(region: Column, line: Column) -> Column:
    return intersection(region, line) / F.greatest(F.lit(1.0), area(line))


def horizontal_overlap(a: Column, b: Column) -> Column:
    o = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return o / F.greatest(F.lit(1.0), F.least(width(a), width(b)))


def polygon_box(p: Column) -> Column:
    """The envelope of an array of points."""
    xs, ys = F.transform(p, lambda q: q[0]), F.transform(p, lambda q: q[1])
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def reading_box(region: Column) -> Column:
    """The envelope of a region's lines, or its own box where it has none."""
    lines = region["lines"]
    env = F.struct(*[f(F.transform(lines, lambda x, k=k: x["bbox"][k])).alias(k) for k, f in (("x0", F.array_min), ("y0", F.array_min), ("x1", F.array_max), ("y1", F.array_max))])
    return F.when(F.size(lines) > 0, env).otherwise(region["bbox"])


def round_up(v: Column, multiple: int) -> Column:
    return F.greatest(F.lit(multiple), F.ceil(v / multiple) * multiple).cast("int")


def resized_width(w: Column, h: Column, to: int = 48) -> Column:
    """Width at a fixed height, half to even."""
    return F.bround(w * to / F.greatest(F.lit(1), h), 0).cast("int")


def canvas_width(w: Column, h: Column, steps: Column, to: int = 48, least: int = 32, most: int = 768, stride: int = 4) -> Column:
    """Canvas of a crop: aspect, minimum and CTC widths, a multiple of the stride; null where CTC can't fit."""
    need = steps * stride
    target = round_up(F.greatest(F.lit(least), F.bround(w * to / h, 0), need), stride)
    return F.when(need <= most, F.least(F.lit(most), target))


def output_length(w: Column, stride: int = 4) -> Column:
    return F.floor(w / stride).cast("int")


def quad_extent(p: Column) -> Column:
    """(width, height, rotate) of the upright crop of a quadrilateral: the longer of opposite edges, 2 at least."""

    def edge(i: int, j: int) -> Column:
        a, b = F.element_at(p, i), F.element_at(p, j)
        return F.sqrt(F.pow(a[0] - b[0], 2) + F.pow(a[1] - b[1], 2))

    w = F.greatest(F.lit(2), F.bround(F.greatest(edge(1, 2), edge(4, 3)), 0).cast("int"))
    h = F.greatest(F.lit(2), F.bround(F.greatest(edge(1, 4), edge(2, 3)), 0).cast("int"))
    return F.struct(w.alias("width"), h.alias("height"), (h > w * 1.5).alias("rotate"))


def clip_detection(b: Column, page_width: Column, page_height: Column, score: Column | None = None, least: float = 0.0) -> Column:
    """The box within its page; null where nothing is left, or where a score is given and below the least."""
    x0, y0 = F.greatest(F.lit(0.0), b["x0"]), F.greatest(F.lit(0.0), b["y0"])
    x1, y1 = F.least(page_width.cast("double"), b["x1"]), F.least(page_height.cast("double"), b["y1"])
    seen = (x1 > x0) & (y1 > y0) if score is None else (x1 > x0) & (y1 > y0) & (score >= least)
    return F.when(seen, F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def layout_label(index: Column) -> Column:
    """Name of a detector class."""
    names = F.array(*[F.lit(x) for x in LAYOUT_LABELS])
    return F.when((index >= 0) & (index < len(LAYOUT_LABELS)), F.get(names, index)).otherwise("unknown")


def html_font_size(b: Column) -> Column:
    return F.greatest(F.lit(8.0), height(b) * 0.72)


def pdf_font_size(b: Column) -> Column:
    return F.greatest(F.lit(4.0), height(b) * 0.7)


def pdf_zoom(dpi: Column) -> Column:
    return dpi / 72


def softmax(logits: Column) -> Column:
    """Probabilities of an array, stable for large values."""
    top = F.array_max(logits)
    e = F.transform(logits, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda s, y: s + y))


def argmax(values: Column) -> Column:
    """Place (from 0) of the first greatest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")
