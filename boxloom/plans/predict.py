"""The model seam: rows in, completions out, a model loaded once a task."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from boxloom.functions import boxes
from boxloom.functions.detections import canonical, parse, parsed, serialize
from boxloom.plans import sinks
from boxloom.runtime import write_table

#: Makes, on an executor, the function from a request (a dict) and a budget of new tokens to a completion.
ModelFactory = Callable[[], Callable[[dict[str, Any], int], str]]
BUDGETS = (192, 96, 48)


class TooLong(Exception):
    """A model's word that a request leaves no room for so many new tokens."""


def fixed(completion: str) -> ModelFactory:
    """A model that always says the same."""
    return lambda: lambda request, budget: completion


def _generate(model: Callable[[dict[str, Any], int], str], request: dict[str, Any]) -> str:
    for budget in BUDGETS[:-1]:
        try:
            return model(request, budget)
        except TooLong:
            continue
    return model(request, BUDGETS[-1])


def predict(requests: DataFrame, factory: ModelFactory) -> DataFrame:
    """id and raw_completion of every request (a row with an id and whatever the model reads)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            yield pd.DataFrame({"id": part["id"], "raw_completion": [_generate(model, r) for r in part.to_dict("records")]})

    return requests.mapInPandas(run, "id string, raw_completion string")


def batch(tasks: DataFrame, factory: ModelFactory, done: DataFrame | None = None) -> DataFrame:
    """id, ordinal, status (ok, skipped, failed), raw_completion and error; one bad row never stops the others.

    ``done``: output names that exist; their tasks are skipped. A task with a
    ``problem`` (see :func:`boxloom.sources.files.manifest`) fails with it, and
    so does one whose completion is no strict detection set.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = factory()
        for part in parts:
            rows = []
            for r in part.to_dict("records"):
                try:
                    if isinstance(r.get("problem"), str):
                        raise ValueError(r["problem"])
                    said = _generate(model, r)
                    parse(said)
                    rows.append((r["id"], r["ordinal"], "ok", said, None))
                except Exception as e:  # noqa: BLE001  the row's own failure is its result
                    rows.append((r["id"], r["ordinal"], "failed", None, str(e) or type(e).__name__))
            yield pd.DataFrame(rows, columns=["id", "ordinal", "status", "raw_completion", "error"])

    schema = "id string, ordinal long, status string, raw_completion string, error string"
    todo = tasks if done is None else tasks.join(done.select("output_name"), "output_name", "left_anti")
    out = todo.mapInPandas(run, schema)
    if done is not None:
        skipped = tasks.join(done.select("output_name"), "output_name", "left_semi")
        out = out.unionByName(skipped.select("id", F.col("ordinal").cast("long"), F.lit("skipped").alias("status"), F.lit(None).cast("string").alias("raw_completion"), F.lit(None).cast("string").alias("error")))
    return out


def kept(results: DataFrame) -> DataFrame:
    """``results`` as a written table: what a model said once is read as often as needed."""
    return write_table(results, "results")


def detections(completions: DataFrame) -> DataFrame:
    """``completions`` (raw_completion, width, height) with valid, error and pixel_boxes."""
    rows = completions.withColumn("_p", parsed("raw_completion"))
    pixel = F.transform(F.col("_p.boxes"), lambda b: boxes.from_grid(b, F.col("width"), F.col("height")))
    return rows.select(*completions.columns, F.col("_p.valid").alias("valid"), F.col("_p.error").alias("error"), pixel.alias("pixel_boxes"))


def detect(model: Callable[[dict[str, Any], int], str], request: dict[str, Any], width: int, height: int) -> dict[str, Any]:
    """One request, answered: the detection set, its boxes in pixels of the target image, and what the model said. ValueError if that is no strict set."""
    said = _generate(model, request)
    found, labels = parse(said)
    scale = (width, height, width, height)
    pixel = [[min(max(v / boxes.GRID * s, 0), s) for v, s in zip(b, scale, strict=True)] for b in found]
    listed = [{"bbox_2d": g, "bbox_xyxy": [round(v) for v in b], "label": label} for g, b, label in zip(found, pixel, labels, strict=True)]
    return {"schema_version": 1, **{k: request.get(k) for k in ("reference_image", "reference_boxes", "target_image", "query")}, "detection_set": serialize(found, labels), "detections": listed, "raw_completion": said}


@F.arrow_udf(T.StringType())
def _result_lines(rows: pa.Array) -> pa.Array:
    out = []
    for r in rows.to_pylist():
        told = {"id": r["id"], "status": r["status"]}
        if r["status"] == "ok":
            boxes_, labels = parse(r["raw_completion"])
            told |= {"result": r["place"], "detection_set": [{"bbox_2d": b} | ({} if n is None else {"label": n}) for b, n in zip(boxes_, labels, strict=True)]}
        elif r["status"] == "skipped":
            told["output"] = r["place"]
        else:
            told |= {"line": r["line"], "error": r["error"]}
        out.append(canonical(told))
    return pa.array(out, pa.string())


def result_lines(results: DataFrame, tasks: DataFrame, folder: str) -> DataFrame:
    """ordinal and the JSON line of each result: what was found, where it stood already, or at which line what failed."""
    named = tasks.select(F.col("ordinal").alias("_ordinal"), "output_name", F.col("line").cast("long").alias("line"))
    place = F.concat(F.lit(folder.rstrip("/") + "#"), F.col("output_name"))
    met = results.join(named, F.col("ordinal") == F.col("_ordinal"))
    return met.select("ordinal", _result_lines(F.struct("id", "status", "raw_completion", "error", "line", place.alias("place"))).alias("value"))


def write_results(lines: DataFrame, path: str) -> None:
    """Result lines in the order of the manifest, files by ranges of ordinals."""
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lines.repartitionByRange(parts, "ordinal").sortWithinPartitions("ordinal").select("value").write.text(path)


#: Documents a file, about.
FILE_ROWS = 10_000


def write_outputs(results: DataFrame, tasks: DataFrame, folder: str, file_rows: int = FILE_ROWS) -> None:
    """Add a JSON document for each task that went well to the table at ``folder``.

    Documents lie together, ordered by output name, so that one is found by the
    files' own ranges of names. Files show when Spark commits them all, and a
    run adds to what is there: of two documents of one name the later counts.
    """
    named = tasks.select(F.col("ordinal").alias("_ordinal"), "output_name", "reference_image", "target_image", "query")
    good = results.where("status = 'ok'")
    met = good.join(named, F.col("ordinal") == F.col("_ordinal"))
    told = F.to_json(F.struct(F.lit(1).alias("schema_version"), "id", "reference_image", "target_image", "query", "raw_completion"))
    files = max(1, -(-good.count() // file_rows))
    rows = met.select("output_name", told.alias("value"), F.current_timestamp().alias("made"))
    rows.repartitionByRange(files, "output_name").sortWithinPartitions("output_name").write.mode("append").parquet(folder)


def outputs(spark: SparkSession, folder: str) -> DataFrame:
    """output_name and value of every document in ``folder``, the last of each name; none if there is no folder."""
    if not sinks.exists(spark, folder):
        return spark.createDataFrame([], "output_name string, value string")
    rows = spark.read.schema("output_name string, value string, made timestamp").parquet(folder)
    return rows.groupBy("output_name").agg(F.max_by("value", "made").alias("value"))


def finished(spark: SparkSession, folder: str) -> DataFrame:
    """output_name of the tasks with a document in ``folder``."""
    return outputs(spark, folder).select("output_name")
