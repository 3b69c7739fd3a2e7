"""Box arithmetic as columns.

A box is a struct of x1, y1, x2, y2, half-open at the right and bottom edge.
Everything here stays in generated code; nothing is a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000
_SIDES = ("x1", "y1", "x2", "y2")


def _struct(*values: Column) -> Column:
    return F.struct(*[v.cast("double").alias(n) for n, v in zip(_SIDES, values, strict=True)])


def box(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return _struct(x1, y1, x2, y2)


def from_array(values: Column) -> Column:
    """A box from four numbers; null unless there are just four."""
    return F.when(F.size(values) == 4, _struct(*[F.get(values, F.lit(i)) for i in range(4)]))


def is_valid(b: Column) -> Column:
    """Finite sides, and some width and height."""
    inf = F.lit(float("inf"))
    finite = [~F.isnan(b[s]) & (F.abs(b[s]) < inf) for s in _SIDES]
    return F.coalesce(finite[0] & finite[1] & finite[2] & finite[3] & (b["x2"] > b["x1"]) & (b["y2"] > b["y1"]), F.lit(False))


def area(b: Column) -> Column:
    return (b["x2"] - b["x1"]) * (b["y2"] - b["y1"])


def shifted(b: Column, dx: Column, dy: Column) -> Column:
    return _struct(b["x1"] + dx, b["y1"] + dy, b["x2"] + dx, b["y2"] + dy)


def scaled(b: Column, sx: Column, sy: Column) -> Column:
    return _struct(b["x1"] * sx, b["y1"] * sy, b["x2"] * sx, b["y2"] * sy)


def clamped(b: Column, width: Column, height: Column) -> Column:
    """The part of a box inside the image; null if there is none."""
    zero = F.lit(0.0)
    inside = _struct(*[F.greatest(F.least(b[s], limit.cast("double")), zero) for s, limit in zip(_SIDES, (width, height, width, height), strict=True)])
    return F.when((inside["x2"] > inside["x1"]) & (inside["y2"] > inside["y1"]), inside)


def to_array(b: Column, rounded: bool = False) -> Column:
    """[x1, y1, x2, y2]; rounded to whole numbers, halves to the even one."""
    if rounded:
        return F.array(*[F.bround(b[s]).cast("int") for s in _SIDES])
    return F.array(*[b[s] for s in _SIDES])


def from_annotation(b: Column, inclusive: Column, width: Column, height: Column) -> Column:
    """An annotated box as a half-open one; null if it leaves the image (it is never clamped)."""
    shift = F.when(inclusive, 1.0).otherwise(0.0)
    opened = _struct(b["x1"] - shift, b["y1"] - shift, b["x2"], b["y2"])
    inside = (opened["x1"] >= 0) & (opened["y1"] >= 0) & (opened["x2"] <= width) & (opened["y2"] <= height)
    return F.when(inside & is_valid(opened), opened)


def on_grid(b: Column, width: Column, height: Column) -> Column:
    """Whole numbers 0 to 1000 across the image, halves upwards; null if the box collapses."""
    sides = [F.round(b[s] / size * GRID).cast("int") for s, size in zip(_SIDES, (width, height, width, height), strict=True)]
    whole = F.array(*sides)
    return F.when((sides[2] > sides[0]) & (sides[3] > sides[1]), whole)


def from_grid(grid: Column, width: Column, height: Column) -> Column:
    """The pixel box of a grid box, clamped to the image."""
    sides = [F.get(grid, F.lit(i)) / GRID * size for i, size in enumerate((width, height, width, height))]
    return clamped(_struct(*sides), width, height)


def overlap(a: Column, b: Column) -> Column:
    """Intersection over union."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    shared = w * h
    return F.coalesce(F.try_divide(shared, area(a) + area(b) - shared), F.lit(0.0))


def for_concept(objects: Column, concept: Column) -> Column:
    """Sorted boxes of one concept among an image's objects (structs of concept and box array)."""
    return F.array_sort(F.transform(F.filter(objects, lambda o: o["concept"] == concept), lambda o: o["box"]))


def concepts(objects: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(objects, lambda o: o["concept"])))


def count_slice(n: Column) -> Column:
    return F.when(n == 0, "empty").when(n == 1, "one").otherwise("multi")


def area_slice(pixel_boxes: Column, width: Column, height: Column) -> Column:
    """small, medium or large by the mean share of the image; null without boxes."""
    image = (width * height).cast("double")
    total = F.aggregate(pixel_boxes, F.lit(0.0), lambda s, b: s + (b[2] - b[0]) * (b[3] - b[1]) / image)
    mean = F.try_divide(total, F.size(pixel_boxes))
    return F.when(F.size(pixel_boxes) > 0, F.when(mean < 0.01, "small").when(mean < 0.10, "medium").otherwise("large"))


def set_f1(tp: Column, fp: Column, fn: Column) -> Column:
    return F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), F.lit(1.0))


def soft_set_f1(matched: Column, predicted: Column, targets: Column) -> Column:
    """Twice the matched overlap over all boxes; empty beside empty is 1."""
    return F.when((predicted == 0) & (targets == 0), 1.0).when((predicted == 0) | (targets == 0), 0.0).otherwise(2 * matched / (predicted + targets))


def reward(valid: Column, soft: Column) -> Column:
    return F.when(valid, 0.10 + 0.90 * soft).otherwise(0.0)
