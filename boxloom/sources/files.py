"""File listings and JSON-lines scans, all through Spark's readers."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.errors import DataError
from boxloom.functions import strict
from boxloom.functions.hashing import safe_name
from boxloom.functions.images import HEAD
from boxloom.functions.images import size as image_size
from boxloom.functions.images import whole as image_whole
from boxloom.functions.schema import RECORD
from boxloom.operators.checks import repeated

IMAGE_SUFFIXES = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def suffix_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r".\.([^.]*)$", 1))


def listing(spark: SparkSession, folder: str, suffixes: tuple[str, ...]) -> DataFrame:
    """path, stem, content and sha256 of a folder's files (not of folders below it) with one of the suffixes in any case."""
    found = spark.read.format("binaryFile").load(folder).where(suffix_of(F.col("path")).isin(*suffixes))
    return found.select("path", stem_of(F.col("path")).alias("stem"), "content", F.sha2("content", 256).alias("content_sha256"))


#: Files above this many bytes are read in pieces; Spark's reader holds a file in one value.
WHOLE = 1 << 30
PIECE, TAIL = 8 << 20, 64


def _in_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """path, content_sha256, head and tail of files of any length, read through Arrow's file systems."""
    for batch in batches:
        rows = []
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                head = tail = stream.read(HEAD)
                digest.update(head)
                while piece := stream.read(PIECE):
                    digest.update(piece)
                    tail = (tail + piece)[-TAIL:]
            rows.append((path, digest.hexdigest(), head, tail[-TAIL:]))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.binary()), strict=True)], names=["path", "content_sha256", "head", "tail"])


def read_once(found: DataFrame, whole: int = WHOLE) -> DataFrame:
    """path, content_sha256, head and tail of ``found`` (rows of Spark's binaryFile source), each file read once and none held whole if it is large."""
    content = F.col("content")
    small = found.where(F.col("length") <= whole).select("path", F.sha2(content, 256).alias("content_sha256"), F.substring(content, 1, HEAD).alias("head"), F.substring(content, -TAIL, TAIL).alias("tail"))
    large = found.where(F.col("length") > whole).select("path")
    spread = large.repartition(F.col("path")).mapInArrow(_in_pieces, "path string, content_sha256 string, head binary, tail binary")
    return small.unionByName(spread)


def images(spark: SparkSession, folder: str, source: str, whole: int = WHOLE) -> DataFrame:
    """source, path, stem, width, height and content_sha256; a stem that repeats is an error, and a broken image has no size.

    Sizes come from the files' first bytes; an image is broken if they hold none
    or its end is missing. Its pixels are not decoded.
    """
    found = spark.read.format("binaryFile").load(folder).where(suffix_of(F.col("path")).isin(*IMAGE_SUFFIXES))
    twice = repeated(found.select(stem_of(F.col("path")).alias("stem")), "stem").orderBy("stem").limit(10).collect()
    if twice:
        raise DataError(f"{source} has several images called {[r['stem'] for r in twice]}")
    sized = read_once(found, whole).withColumn("size", F.when(image_whole(F.col("head"), F.col("tail")), image_size(F.col("head"))))
    return sized.select(F.lit(source).alias("source"), "path", stem_of(F.col("path")).alias("stem"), F.col("size.width").alias("width"), F.col("size.height").alias("height"), "content_sha256")


def records(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Dataset records of a JSON-lines split; blank or broken lines and rows of another split stop the job."""
    rows = spark.read.schema(RECORD).option("mode", "FAILFAST").json(path)
    if split is None:
        return rows
    fits = F.when(F.col("split") == split, F.col("split")).otherwise(F.raise_error(F.concat(F.lit("row of another split: "), F.coalesce("split", F.lit("null")))))
    return rows.withColumn("split", fits)


def _read_strictly(lines: DataFrame, found: Column, what: str, *others: str) -> DataFrame:
    """The fields that ``found`` gives for each line that is not blank; a line with an error stops the job."""
    read = lines.select(*others, "value", found.alias("_f")).where("_f is not null")
    shown = F.concat(F.lit(f"not a {what}: "), F.col("_f.error"), F.lit(": "), F.substring("value", 1, 80))
    return read.select(*others, F.when(F.col("_f.error").isNull(), F.col("_f")).otherwise(F.raise_error(shown)).alias("_f")).select(*others, "_f.*").drop("error")


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """id and raw_completion; blank lines are skipped; unknown keys, other kinds, empty ids and repeated ids are errors."""
    checked = _read_strictly(spark.read.text(path), strict.prediction("value"), "prediction")
    twice = repeated(checked, "id").orderBy("id").limit(5).collect()
    if twice:
        raise DataError(f"predictions repeat ids: {[r['id'] for r in twice]}")
    return checked


def resolved(path: Column, base: Column) -> Column:
    """A path against a folder, unless it is absolute or names its store."""
    return F.when(path.startswith("/") | path.rlike("^[A-Za-z][A-Za-z0-9+.-]*:/"), path).otherwise(F.concat_ws("/", base, path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tasks of a manifest: line, ordinal, id, paths against the manifest's folder, boxes, query, problem and output name.

    Blank lines and lines that begin with # are skipped; a line that is no
    object, a missing or unknown key, a bad id, two tasks with one output name,
    or no task at all is an error. A task with bad boxes, paths or an empty
    query has a ``problem`` and fails when it is run. A manifest is one file that
    a person wrote; its lines are numbered in one partition.
    """
    lines = spark.read.text(path).coalesce(1).withColumn("line", F.monotonically_increasing_id() + 1)
    tasks = _read_strictly(lines, strict.task("value"), "task", "line").withColumn("ordinal", F.monotonically_increasing_id())
    named = tasks.withColumn("id", F.coalesce("id", F.format_string("task-%06d", F.col("ordinal"))))
    base = F.lit(path.rpartition("/")[0])
    done = named.withColumns({"reference_image": resolved(F.col("reference_image"), base), "target_image": resolved(F.col("target_image"), base), "output_name": safe_name(F.col("id"))})
    twice = repeated(done, "output_name").orderBy("output_name").limit(5).collect()
    if twice:
        raise DataError(f"tasks share output names: {[r['output_name'] for r in twice]}")
    if done.isEmpty():
        raise DataError(f"{path} has no tasks")
    return done
