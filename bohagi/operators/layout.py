"""Layout of a page: duplicate boxes, lines in regions, reading order, matching of two layouts.

A page is one row with arrays, bounded by the page. What depends on the order of work inside a page is
a fold: over arrays in the JVM where that is short, else an Arrow batch function over whole pages.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bohagi.functions.geometry import iou

#: Labels that hold lines before any other, and labels that stay without lines.
STRUCTURAL = frozenset({"form", "key_value_region", "table"})
KEEP_EMPTY = frozenset({"checkbox_selected", "checkbox_unselected", "formula", "picture", "table"})


def suppress_duplicates(regions: Column, threshold: float = 0.9) -> Column:
    """Regions by falling confidence (ties by place) without those that overlap a kept one by the threshold."""
    ranked = F.array_sort(F.transform(regions, lambda r, i: F.struct((-r["confidence"]).alias("c"), i.alias("i"), r.alias("r"))))
    plain = F.transform(ranked, lambda x: x["r"])
    none = F.filter(plain, lambda r: F.lit(False))
    return F.aggregate(plain, none, lambda kept, r: F.when(F.exists(kept, lambda k: iou(k["bbox"], r["bbox"]) >= threshold), kept).otherwise(F.concat(kept, F.array(r))))


def _area(b: dict) -> float:
    return max(0.0, b["x1"] - b["x0"]) * max(0.0, b["y1"] - b["y0"])


def _share(region: dict, line: dict) -> float:
    """Share of a line's box that lies in a region's."""
    w = min(region["x1"], line["x1"]) - max(region["x0"], line["x0"])
    h = min(region["y1"], line["y1"]) - max(region["y0"], line["y0"])
    return max(0.0, w) * max(0.0, h) / max(1.0, _area(line))


def _own_script(text: str, lo: int = 0x980, hi: int = 0x9FF) -> float:
    kinds = [lo <= ord(c) <= hi for c in text if unicodedata.category(c)[0] in "LM"]
    return sum(kinds) / len(kinds) if kinds else 1.0


def place_lines(regions: list[dict], lines: list[dict]) -> list[dict]:
    """Regions with their lines. A line goes to a region that holds half of it: structural ones first, then
    the smallest, then the surest, then the first. A line without one makes a region of its own, which
    later lines may join. Lines of a picture that aren't in the script are noise and dropped."""
    out = [r | {"lines": []} for r in regions]
    for k, line in enumerate(lines):
        fits = [(r["label"] not in STRUCTURAL, _area(r["bbox"]), -r["confidence"], i) for i, r in enumerate(out) if _share(r["bbox"], line["bbox"]) >= 0.5]
        if fits:
            home = out[min(fits)[3]]
        else:
            home = {"id": f"region-fallback-{k:04d}", "label": "text", "bbox": line["bbox"], "confidence": 0.0, "order": 0, "lines": []}
            out.append(home)
        if home["label"] != "picture" or _own_script(line["text"] or "") >= 0.8:
            home["lines"].append(line)
    return [r for r in out if r["lines"] or r["label"] in KEEP_EMPTY]


def _extent(region: dict) -> tuple[float, float, float, float]:
    """x0, y0, x1, y1 of the lines, or of the region where it has none."""
    boxes = [x["bbox"] for x in region["lines"]] or [region["bbox"]]
    return min(b["x0"] for b in boxes), min(b["y0"] for b in boxes), max(b["x1"] for b in boxes), max(b["y1"] for b in boxes)


def _by_row(items: list[tuple]) -> list[tuple]:
    return sorted(items, key=lambda x: (x[0][1], x[0][0]))


def _by_column(items: list[tuple]) -> list[tuple]:
    """Items (extent, region) of a band, column by column. Fewer than three are one column."""
    if len(items) < 3:
        return _by_row(items)
    columns: list[dict] = []
    for e, r in sorted(items, key=lambda x: (x[0][0], x[0][1])):
        best, at = 0.0, None
        for c in columns:
            shared = max(0.0, min(e[2], c["x1"]) - max(e[0], c["x0"])) / max(1.0, min(e[2] - e[0], c["x1"] - c["x0"]))
            if shared > best:
                best, at = shared, c
        if at is None or best < 0.25:
            columns.append({"x0": e[0], "x1": e[2], "items": [(e, r)]})
        else:
            at["x0"], at["x1"] = min(at["x0"], e[0]), max(at["x1"], e[2])
            at["items"].append((e, r))
    return [x for c in sorted(columns, key=lambda c: c["x0"]) for x in _by_row(c["items"])]


def reading_order(regions: list[dict], page_width: float, page_height: float | None = None, wide: float = 0.62) -> list[dict]:
    """Regions in reading order, numbered: what begins in the top sixth or so, then bands between full-width
    regions, each column by column. After the last full-width region come those that began above its end
    but in no band, then the rest. Lines of a region go by y, then x."""
    left = [(_extent(r), r) for r in regions]
    top = [x for x in left if page_height and x[0][1] <= 0.16 * page_height]
    left = [x for x in left if not (page_height and x[0][1] <= 0.16 * page_height)]
    across = [x for x in left if (x[0][2] - x[0][0]) / max(1.0, page_width) >= wide]
    left = [x for x in left if (x[0][2] - x[0][0]) / max(1.0, page_width) < wide]
    out, bound = _by_row(top), float("-inf")
    for sep in _by_row(across):
        band = [x for x in left if bound <= x[0][1] < sep[0][1]]
        left = [x for x in left if not bound <= x[0][1] < sep[0][1]]
        out += [*_by_column(band), sep]
        bound = sep[0][3]
    out += _by_column([x for x in left if x[0][1] < bound]) + _by_column([x for x in left if x[0][1] >= bound])
    return [
        r | {"order": k, "lines": [x | {"order": i} for i, x in enumerate(sorted(r["lines"], key=lambda x: (x["bbox"]["y0"], x["bbox"]["x0"])))]}
        for k, (_, r) in enumerate(out)
    ]


def line_order(boxes: list[tuple[float, float, float, float]], page_width: float) -> list[int]:
    """Places of line boxes in reading order. Two columns are seen where at least six narrow boxes have a gap
    of centres of 12 % of the width with three on either side, strictly apart; else it goes by y, then x."""
    at = range(len(boxes))
    row = lambda ks: sorted(ks, key=lambda k: (boxes[k][1], boxes[k][0]))
    full = [k for k in at if (boxes[k][2] - boxes[k][0]) / max(1, page_width) >= 0.62]
    narrow = [k for k in at if k not in set(full)]
    if len(narrow) >= 6:
        mid = {k: (boxes[k][0] + boxes[k][2]) / 2 for k in narrow}
        c = sorted(mid.values())
        gap, a, b = max((y - x, x, y) for x, y in zip(c, c[1:]))
        left = [k for k in narrow if mid[k] < (a + b) / 2]
        right = [k for k in narrow if mid[k] >= (a + b) / 2]
        if gap >= 0.12 * page_width and min(len(left), len(right)) >= 3 and max(boxes[k][2] for k in left) < min(boxes[k][0] for k in right):
            first = min(boxes[k][1] for k in narrow)
            return row(k for k in full if boxes[k][1] < first) + row(left) + row(right) + row(k for k in full if boxes[k][1] >= first)
    return row(at)


def arrange_pages(pages: DataFrame, keep: list[str], regions: str = "regions", lines: str = "lines", width: str = "width", height: str = "height") -> DataFrame:
    """keep columns and regions: duplicates suppressed, lines placed, all in reading order. Null arrays count
    as empty. One narrow stage."""
    fields = pages.schema[regions].dataType.simpleString()
    d = pages.select(*keep, suppress_duplicates(F.coalesce(F.col(regions), F.array().cast(fields))).alias("_regions"), F.coalesce(F.col(lines), F.array().cast(pages.schema[lines].dataType)).alias("_lines"), F.col(width).cast("double").alias("_width"), F.col(height).cast("double").alias("_height"))

    def run(batches):
        for b in batches:
            rows = [reading_order(place_lines(r, x), w or 0.0, h) for r, x, w, h in zip(*(b.column(len(keep) + i).to_pylist() for i in range(4)))]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(rows, b.column(len(keep)).type)], [*keep, "regions"])

    kinds = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keep)
    return d.mapInArrow(run, f"{kinds}, regions {fields}")


def match_regions(expected: DataFrame, predicted: DataFrame, page: list[str], threshold: float = 0.5) -> DataFrame:
    """(page, e, p, iou): greedy one-to-one matches of regions of one label, best overlap first (ties: the later
    regions first). Both tables have page, idx, label and bbox. Candidates come from an equi-join on page and
    label; the greedy choice is a fold over the candidates of a page."""
    e = expected.select(*page, "label", F.col("idx").alias("e"), F.col("bbox").alias("eb"))
    p = predicted.select(*page, "label", F.col("idx").alias("p"), F.col("bbox").alias("pb"))
    c = e.join(p, [*page, "label"]).select(*page, "e", "p", iou(F.col("eb"), F.col("pb"), 1e-9).alias("iou")).where(F.col("iou") >= threshold)
    best = c.groupBy(*page).agg(F.reverse(F.array_sort(F.collect_list(F.struct("iou", "e", "p")))).alias("c"))
    none = F.filter("c", lambda x: F.lit(False))
    taken = F.aggregate("c", none, lambda acc, x: F.when(F.exists(acc, lambda m: (m["e"] == x["e"]) | (m["p"] == x["p"])), acc).otherwise(F.concat(acc, F.array(x))))
    return best.select(*page, F.explode(taken).alias("m")).select(*page, "m.e", "m.p", "m.iou")


def order_pairs(matches: DataFrame, page: list[str], expected_order: str, predicted_order: str) -> DataFrame:
    """(concordant, comparable, accuracy) over pairs of matched regions of a page."""
    m = matches.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(expected_order).alias("e"), F.col(predicted_order).alias("p")))).alias("m"))
    later = F.aggregate(F.transform("m", lambda x, i: F.size(F.filter("m", lambda y, j: (j > i) & (y["p"] > x["p"])))), F.lit(0), lambda s, n: s + n)
    s = m.agg(F.coalesce(F.sum(later), F.lit(0)).cast("long").alias("concordant"), F.coalesce(F.sum(F.expr("size(m) * (size(m) - 1) div 2")), F.lit(0)).cast("long").alias("comparable"))
    return s.withColumn("accuracy", F.round(F.col("concordant") / F.greatest(F.lit(1), F.col("comparable")), 6))


def order_lines(lines: DataFrame, page: list[str], key: str, box: str, page_width: float) -> DataFrame:
    """(page, key, place): place of each line of a page in reading order. Lines with equal boxes go by key."""
    from pyspark.sql.functions import arrow_udf
    from pyspark.sql.types import ArrayType, IntegerType

    @arrow_udf(ArrayType(IntegerType()))
    def order(a: pa.Array) -> pa.Array:
        out = [line_order([(b["x0"], b["y0"], b["x1"], b["y1"]) for b in x], page_width) for x in a.to_pylist()]
        return pa.array(out, pa.list_(pa.int32()))

    g = lines.groupBy(*page).agg(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col(box).alias("b")))).alias("l"))
    o = g.select(*page, "l", order(F.col("l.b")).alias("o"))
    return o.select(*page, "l", F.posexplode("o").alias("place", "i")).select(*page, F.get("l", F.col("i"))["k"].alias(key), "place")
