"""From records and predictions to a published report."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.errors import EvaluationError
from boxloom.operators import checks, report, scoring
from boxloom.plans import sinks
from boxloom.plans.artifacts import digest
from boxloom.plans.gates import finite
from boxloom.runtime import write_table


def examples(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """Records beside their completions; every record needs one and no other may be there."""
    checks.require_clean(records, checks.record_violations(), "id")
    checks.require_coverage(records, predictions)

    def key(side: str):
        return F.concat_ws("/", f"{side}.source", f"{side}.path")

    rows = records.join(predictions, "id")
    return rows.select(
        "id", "visual_concept", "query", key("target").alias("target_key"), key("reference").alias("reference_key"),
        F.array_sort(F.transform("detection_set", lambda d: d["bbox_2d"])).alias("targets"), F.col("target.boxes_xyxy").alias("pixel_boxes"),
        F.col("target.width").alias("width"), F.col("target.height").alias("height"), "raw_completion",
    )


def prediction_hash(scored: DataFrame) -> str:
    """Of what predictions mean, whatever the order of their rows and boxes and whatever their labels."""
    return sinks.content_hash(scored.select("id", "format_valid", F.array_sort("prediction").alias("prediction"), F.when(~F.col("format_valid"), F.col("raw_completion")).alias("raw")))


def evaluate(spark: SparkSession, records: DataFrame, predictions: DataFrame, output: str, lineage: dict[str, str] | None = None) -> dict[str, Any]:
    """Score, summarize and publish report.json and the scored rows; the report. ``lineage``: the hashes of what went in, by name (``gates.PROVENANCE``)."""
    scored = write_table(scoring.score(examples(records, predictions)), "scored")
    made = {
        "schema_version": 1,
        "slices": [r.asDict() for r in report.exact_slices(scored).orderBy("slice", "value").collect()],
        "reference_swap": report.reference_swap(scored).first().asDict(),
        "prediction_hash": prediction_hash(scored),
    }
    made |= {"prediction_content_fingerprint": made["prediction_hash"]} | (lineage or {})
    if not finite(made):
        raise EvaluationError("a metric is not finite")
    made["evaluation_fingerprint"] = digest(made)
    with sinks.publish(spark, output) as folder:
        sinks.write_lines(scored.drop("raw_completion"), f"{folder}/records")
        whole = made | {"files": sinks.file_hashes(spark, f"{folder}/records")}
        sinks.write_document(spark, f"{folder}/report.json", whole | {"report_fingerprint": digest(whole)})
    return made


def open_report(spark: SparkSession, folder: str) -> dict[str, Any]:
    """The report in ``folder``, after its own fingerprint and the hashes of its rows have been checked."""
    found = sinks.read_document(spark, f"{folder}/report.json")
    if not isinstance(found, dict) or found.get("schema_version") != 1:
        raise EvaluationError("the report is of an unknown schema")
    if found.pop("report_fingerprint", None) != digest(found):
        raise EvaluationError("the report changed since it was made")
    if sinks.file_hashes(spark, f"{folder}/records") != found.get("files"):
        raise EvaluationError("scored rows changed since the report")
    return found
