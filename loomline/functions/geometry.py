"""Box geometry as columns: boxes are structs (or four columns) x1, y1, x2, y2 in pixels.

``*_sql`` give the same as SQL text over two prefixes, for use inside SQL lambdas.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"


def box(x1, y1, x2, y2) -> Column:
    return F.struct(*(F.col(c).cast("double").alias(n) if isinstance(c, str) else c.cast("double").alias(n) for c, n in zip((x1, y1, x2, y2), ("x1", "y1", "x2", "y2"))))


def checked_box(b: Column) -> Column:
    """The box; an error if it ends before it starts."""
    return F.when((b["x2"] < b["x1"]) | (b["y2"] < b["y1"]), F.raise_error("box ends before it starts")).otherwise(b)


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def area(b: Column) -> Column:
    return width(b) * height(b)


def iou_sql(a: str, b: str) -> str:
    """Intersection over union; 0 for boxes that only touch, or without area together."""
    w = f"(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1))"
    h = f"(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    both = f"(({a}.x2 - {a}.x1) * ({a}.y2 - {a}.y1) + ({b}.x2 - {b}.x1) * ({b}.y2 - {b}.y1) - {w} * {h})"
    return f"(case when {w} <= 0 or {h} <= 0 or {both} <= 0 then cast(0 as double) else {w} * {h} / {both} end)"


def iou(a: str, b: str) -> Column:
    """IoU of two boxes given by the names of struct columns or table aliases."""
    return F.expr(iou_sql(a, b))


def to_xywh(b: Column) -> Column:
    return F.struct(b["x1"].alias("x"), b["y1"].alias("y"), width(b).alias("w"), height(b).alias("h"))


def from_xywh(b: Column) -> Column:
    return F.struct(b["x"].alias("x1"), b["y"].alias("y1"), (b["x"] + b["w"]).alias("x2"), (b["y"] + b["h"]).alias("y2"))


def to_cxcywh(b: Column) -> Column:
    return F.struct(((b["x1"] + b["x2"]) / 2).alias("cx"), ((b["y1"] + b["y2"]) / 2).alias("cy"), width(b).alias("w"), height(b).alias("h"))


def from_cxcywh(b: Column) -> Column:
    return F.struct((b["cx"] - b["w"] / 2).alias("x1"), (b["cy"] - b["h"] / 2).alias("y1"), (b["cx"] + b["w"] / 2).alias("x2"), (b["cy"] + b["h"] / 2).alias("y2"))


def _sized(w: Column, h: Column, value: Column) -> Column:
    return F.when((w <= 0) | (h <= 0), F.raise_error("image without area")).otherwise(value)


def normalise(b: Column, w: Column, h: Column) -> Column:
    """In shares of the image's sides."""
    return _sized(w, h, F.struct((b["x1"] / w).alias("x1"), (b["y1"] / h).alias("y1"), (b["x2"] / w).alias("x2"), (b["y2"] / h).alias("y2")))


def denormalise(b: Column, w: Column, h: Column) -> Column:
    return F.struct((b["x1"] * w).alias("x1"), (b["y1"] * h).alias("y1"), (b["x2"] * w).alias("x2"), (b["y2"] * h).alias("y2"))


def clip_to_image(b: Column, w: Column, h: Column) -> Column:
    """Inside the image, and not ending before it starts."""
    def held(v: Column, most: Column) -> Column:
        return F.least(F.greatest(v, F.lit(0.0)), most.cast("double"))

    x1, y1 = held(b["x1"], w), held(b["y1"], h)
    return F.struct(x1.alias("x1"), y1.alias("y1"), F.greatest(x1, held(b["x2"], w)).alias("x2"), F.greatest(y1, held(b["y2"], h)).alias("y2"))


def area_ratio(b: Column, w: Column, h: Column) -> Column:
    """Share of the image's area (0 for an image without any)."""
    return F.when(w * h > 0, area(b) / (w * h)).otherwise(0.0)


def min_side(b: Column) -> Column:
    return F.least(width(b), height(b))


def nms_sql(boxes: str, limit: float) -> str:
    """Greedy non-maximum suppression of a sorted array of structs: those that no kept earlier one overlaps beyond ``limit``."""
    return f"aggregate({boxes}, slice({boxes}, 1, 0), (acc, c) -> if(exists(acc, k -> {iou_sql('k', 'c')} > {limit}D), acc, concat(acc, array(c))))"
