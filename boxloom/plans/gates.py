"""Acceptance gates: what is required, what the evidence says, and whether all of it passes."""

from __future__ import annotations

import math
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.functions.detections import canonical, parsed
from boxloom.plans import sinks

#: The gates, the memory a run may take, and the hashes an evaluation report must have (with their names in a gate's report).
MEMORY_GIB = 44.0
PROVENANCE = {
    "config_hash": "resolved_config", "adapter_contract_fingerprint": "contract", "dataset_fingerprint": "manifest",
    "adapter_artifact_fingerprint": "artifact", "prediction_content_fingerprint": "predictions",
}
GATES = ("C0", "C1", "C2", "H1", "H2", "D1")
#: Gates that each profile cannot do without.
MANDATORY = {"pr": ("C0", "C1", "C2"), "release": ("C0", "C1", "C2", "H1", "H2"), "distributed": ("C0", "C1", "C2", "H1", "H2", "D1")}


def expected(spark: SparkSession, profile: str) -> DataFrame:
    return spark.createDataFrame([(g, g in MANDATORY[profile]) for g in GATES], "gate string, mandatory boolean")


def gate_report(wanted: DataFrame, evidence: DataFrame) -> DataFrame:
    """gate, mandatory and status: pass, fail, or skipped where there is no evidence. ``evidence``: gate and passed."""
    seen = evidence.groupBy("gate").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))
    status = F.when(F.col("passed").isNull(), "skipped").when(F.col("passed"), "pass").otherwise("fail")
    return wanted.join(seen, "gate", "left").select("gate", "mandatory", status.alias("status"))


def accepted(report: DataFrame) -> DataFrame:
    """One row: whether every mandatory gate passed; a skipped one did not."""
    passed = F.bool_and(F.when(F.col("mandatory"), F.col("status") == "pass"))
    return report.agg(F.coalesce(passed, F.lit(True)).alias("accepted"), F.count_if(F.col("mandatory") & (F.col("status") != "pass")).alias("open_gates"))


def read_evidence(spark: SparkSession, paths: list[str]) -> DataFrame:
    """gate and passed from evidence files: a list under ``gates``, or ``gate`` with ``passed`` or ``accepted``. A file that is no JSON stops the job."""
    shape = "gate string, passed boolean, accepted boolean, gates array<struct<gate:string,status:string>>"
    rows = spark.read.schema(shape).option("multiLine", True).option("mode", "FAILFAST").json(paths)
    listed = rows.select(F.explode("gates").alias("g")).select(F.col("g.gate").alias("gate"), (F.col("g.status") == "pass").alias("passed"))
    single = rows.where("gate is not null").select("gate", F.coalesce("passed", "accepted", F.lit(False)).alias("passed"))
    return listed.unionByName(single)


def finite(value: Any) -> bool:
    """Whether a JSON value has no NaN or infinity anywhere, and nothing that JSON lacks."""
    if isinstance(value, dict):
        return all(isinstance(k, str) and finite(v) for k, v in value.items())
    if isinstance(value, list):
        return all(map(finite, value))
    return math.isfinite(value) if isinstance(value, float) else value is None or isinstance(value, (bool, str, int))


#: What rules of a gate can ask of a fact, as the text that names the fault.
FAULTS = {"at_most": "is not at most", "at_least": "is not at least", "equals": "is not", "present": "is missing", "boxes": "is no detection set"}
RULE = "gate string, name string, rule string, bound string"


def hardware_rules(spark: SparkSession, equal: dict[str, str | None]) -> DataFrame:
    """The rules (``RULE``) of the gates that judge a run by its facts; ``equal``: facts that must have these values."""
    runs = [(g, *rule) for g in ("H1", "H2", "D1") for rule in (("peak_reserved_gib", "at_most", str(MEMORY_GIB)), ("positive_completion", "boxes", ""), ("negative_completion", "boxes", ""), ("offline", "equals", "true"))]
    return spark.createDataFrame([*runs, ("D1", "world_size", "at_least", "2"), *[(g, k, "equals", v) for g in ("H1", "H2", "D1") for k, v in sorted(equal.items())]], RULE)


def report_rules(spark: SparkSession) -> DataFrame:
    """The rules of an evaluation report: it says where all that went into it comes from."""
    return spark.createDataFrame([("evaluation", k, "present", "") for k in sorted(PROVENANCE)], RULE)


def facts_of(spark: SparkSession, gate: str, document: dict[str, Any]) -> DataFrame:
    """gate, name and value (as text) of the plain values of a document."""
    rows = [(gate, k, canonical(v) if isinstance(v, bool) else str(v)) for k, v in document.items() if isinstance(v, (str, int, float, bool))]
    return spark.createDataFrame(rows, "gate string, name string, value string")


def judged(rules: DataFrame, facts: DataFrame) -> DataFrame:
    """gate, passed and faults (sorted text) of every gate that has facts: its rules that they break, and numbers that are not finite.

    A fact that is missing breaks its rule. Names with several values are judged
    by each of them.
    """
    known = facts.select("gate").distinct()
    met = rules.join(known, "gate").join(facts, ["gate", "name"], "left").withColumn("_x", F.col("value").try_cast("double")).withColumn("_bound", F.col("bound").try_cast("double"))
    number = F.col("_x").isNotNull() & ~F.isnan("_x")
    text = met.where("rule <> 'boxes'").withColumn(
        "_held",
        F.when(F.col("rule") == "at_most", number & (F.col("_x") <= F.col("_bound")))
        .when(F.col("rule") == "at_least", number & (F.col("_x") >= F.col("_bound")))
        .when(F.col("rule") == "equals", F.col("value").eqNullSafe(F.col("bound")))
        .otherwise(F.coalesce(F.col("value") != "", F.lit(False))),
    )
    boxes = met.where("rule = 'boxes'").withColumn("_held", parsed("value")["valid"])
    said = F.element_at(F.create_map(*[F.lit(x) for pair in FAULTS.items() for x in pair]), F.col("rule"))
    broken = text.unionByName(boxes).where(~F.col("_held")).select("gate", F.rtrim(F.concat_ws(" ", F.col("name"), said, F.coalesce("bound", F.lit("null")))).alias("fault"))
    value = F.col("value").try_cast("double")
    odd = facts.where(F.isnan(value) | F.abs(value).isin(float("inf"))).select("gate", F.concat(F.col("name"), F.lit(" is not finite")).alias("fault"))
    faults = broken.unionByName(odd).groupBy("gate").agg(F.array_sort(F.collect_set("fault")).alias("faults"))
    none = F.array().cast("array<string>")
    return known.join(faults, "gate", "left").select("gate", F.col("faults").isNull().alias("passed"), F.coalesce("faults", none).alias("faults"))


def assemble(spark: SparkSession, profile: str, evidence: list[str], path: str) -> dict[str, Any]:
    """One report over all gates of a profile, from the evidence files that there are."""
    there = [p for p in evidence if sinks.exists(spark, p)]
    seen = read_evidence(spark, there) if there else spark.createDataFrame([], "gate string, passed boolean")
    rows = gate_report(expected(spark, profile), seen)
    listed = [r.asDict() for r in rows.orderBy("gate").collect()]
    made = {"schema_version": 1, "profile": profile, "accepted": accepted(rows).first()["accepted"], "gates": listed, "hashes": {p.rpartition("/")[2]: sinks.file_digest(spark, p) for p in there}}
    sinks.write_document(spark, path, made)
    return made
