"""Requests for a model from dataset records: image places, reference boxes, query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DataError
from boxloom.functions import boxes
from boxloom.operators.checks import PREVIEW

REQUEST = ("id", "reference_image", "reference_boxes", "target_image", "query")


def image_place(image: Column, folders: dict[str, str]) -> Column:
    """Where an image of a record lies; null if its source is unknown or it has no path. ``folders``: image folder by source name."""
    known = F.create_map(*[F.lit(x) for pair in folders.items() for x in pair]) if folders else F.lit(None).cast("map<string,string>")
    folder = F.try_element_at(known, F.coalesce(image["source"], F.lit("")))
    return F.when(folder.isNotNull() & image["path"].isNotNull(), F.concat_ws("/", folder, image["path"]))


def pixel_boxes(values: Column) -> tuple[Column, Column]:
    """Boxes of an array of arrays of numbers, and whether all of them are valid (null counts as not)."""
    made = F.transform(values, boxes.from_array)
    return made, F.coalesce(F.forall(made, lambda b: F.coalesce(boxes.is_valid(b), F.lit(False))), F.lit(False))


def from_records(records: DataFrame, folders: dict[str, str]) -> DataFrame:
    """``REQUEST`` and problem (null: none) of every record."""
    reference, target = (image_place(F.col(side), folders) for side in ("reference", "target"))
    given = F.col("reference.boxes_xyxy")
    _, valid = pixel_boxes(given)
    query = F.trim(F.col("query"), F.lit(" \t\n\r\x0b\x0c"))
    problem = (
        F.when(F.col("reference").isNull() | F.col("target").isNull(), "no image")
        .when(~valid, "invalid reference boxes")
        .when(F.coalesce(F.size(given), F.lit(0)) < 1, "no reference boxes")
        .when(F.coalesce(query, F.lit("")) == "", "no query")
        .when(reference.isNull() | target.isNull(), "unknown image source")
    )
    return records.select("id", reference.alias("reference_image"), F.transform(given, lambda b: F.transform(b, lambda v: v.cast("double"))).alias("reference_boxes"), target.alias("target_image"), query.alias("query"), problem.alias("problem"))


def require(requests: DataFrame) -> DataFrame:
    """``requests`` without the column problem, if no row has one; else DataError with the first by id."""
    bad = requests.where("problem is not null").orderBy("id").limit(PREVIEW).collect()
    if bad:
        raise DataError("; ".join(f"{r['id']}: {r['problem']}" for r in bad))
    return requests.drop("problem")


def missing_images(requests: DataFrame, listed: DataFrame) -> DataFrame:
    """Places (image) that requests name and ``listed`` (path) lacks."""
    named = requests.select(F.explode(F.array("reference_image", "target_image")).alias("image")).distinct()
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    return named.join(listed.select(plain(F.col("path")).alias("_at")), plain(F.col("image")) == F.col("_at"), "left_anti")
