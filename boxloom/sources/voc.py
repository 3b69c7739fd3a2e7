"""Pascal VOC annotations: XML files beside images."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions import boxes
from boxloom.functions.hashing import group_key
from boxloom.operators.checks import PREVIEW, orphans
from boxloom.errors import DataError
from boxloom.sources.files import images, listing

ANNOTATION = "struct<size:struct<width:string,height:string>,object:array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>>"


def whole(value: Column) -> Column:
    return F.when(F.trim(value).rlike(r"^[+-]?[0-9]+$"), F.trim(value).try_cast("int"))


def parsed(xml: Column) -> Column:
    """An annotation's struct; null where there is a document type, an entity, or no XML."""
    safe = ~F.contains(xml, F.lit("<!DOCTYPE")) & ~F.contains(xml, F.lit("<!ENTITY"))
    return F.when(safe, F.from_xml(xml, ANNOTATION, {"rowTag": "annotation", "mode": "PERMISSIVE"}))


def objects(annotation: Column, inclusive: bool, width: Column, height: Column) -> Column:
    """Sorted structs of concept and box array; a broken object gives a null box."""

    def one(o: Column) -> Column:
        b = o["bndbox"]
        raw = boxes.box(*[whole(b[s]) for s in ("xmin", "ymin", "xmax", "ymax")])
        opened = boxes.from_annotation(raw, F.lit(inclusive), width, height)
        return F.struct(F.nullif(F.trim(o["name"]), F.lit("")).alias("concept"), F.when(opened.isNotNull(), F.transform(boxes.to_array(opened), lambda v: v.cast("int"))).alias("box"))

    return F.array_sort(F.transform(F.coalesce(annotation["object"], F.array().cast("array<struct<name:string,bndbox:struct<xmin:string,ymin:string,xmax:string,ymax:string>>>")), one))


def load(spark: SparkSession, source: str, image_dir: str, annotation_dir: str, inclusive: bool = True) -> tuple[DataFrame, DataFrame]:
    """Annotated images, and the images without an annotation. All that is wrong with a source is told at once, the first 20 files by name."""
    found = images(spark, image_dir, source)
    notes = listing(spark, annotation_dir, ("xml",)).select("stem", parsed(F.decode("content", "UTF-8")).alias("_a"))
    met = notes.join(found, "stem", "left").withColumn("_w", whole(F.col("_a.size.width"))).withColumn("_h", whole(F.col("_a.size.height")))
    rows = met.withColumn("objects", objects(F.col("_a"), inclusive, F.col("width"), F.col("height")))
    wrong = (
        F.when(F.col("_a").isNull(), "malformed or forbidden XML")
        .when(F.col("path").isNull(), "no image")
        .when(F.col("width").isNull(), "unreadable image")
        .when(F.col("_w").isNull() | F.col("_h").isNull(), "no size")
        .when((F.col("_w") != F.col("width")) | (F.col("_h") != F.col("height")), "size differs from the image")
        .when(F.exists("objects", lambda o: o["concept"].isNull() | o["box"].isNull()), "an object lacks its name or a box inside the image")
    )
    broken = rows.select("stem", wrong.alias("why")).where("why is not null").orderBy("stem").limit(PREVIEW).collect()
    if broken:
        raise DataError("; ".join(f"{source}/{r['stem']}: {r['why']}" for r in broken))
    kept = rows.select(
        F.concat_ws("/", "source", "stem").alias("record_id"), "source", "stem", F.regexp_extract("path", r"([^/]+)$", 1).alias("path"),
        "width", "height", "content_sha256", group_key(F.col("source"), F.col("stem")).alias("group_key"), "objects",
    )
    return kept, orphans(found.select("source", "stem"), notes, ["stem"])
