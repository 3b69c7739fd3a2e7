"""What a config needs before work begins: inputs that are there, outputs that are not."""

from __future__ import annotations

from typing import Any

from pyspark.sql import SparkSession

from boxloom.errors import ArtifactError, DataError, EvaluationError
from boxloom.plans import sinks
from boxloom.sources import config as C
from boxloom.sources import files


def _need(spark: SparkSession, error: type[Exception], **paths: str) -> None:
    lacking = [f"{name} ({path})" for name, path in paths.items() if not sinks.exists(spark, path)]
    if lacking:
        raise error(f"not there: {', '.join(lacking)}")


def _free(spark: SparkSession, error: type[Exception], path: str) -> None:
    if sinks.exists(spark, path):
        raise error(f"{path} exists")


def check(spark: SparkSession, config: Any) -> None:
    """Raise if the config's inputs are missing or its output exists. Artifacts are opened by the work itself, which knows their contract."""
    if isinstance(config, C.DetectConfig):
        _need(spark, DataError, artifact=config.artifact, reference_image=config.request.reference_image, target_image=config.request.target_image)
    elif isinstance(config, C.BatchConfig):
        _need(spark, DataError, artifact=config.artifact, manifest=config.manifest)
        for r in files.manifest(spark, config.manifest).where("problem is null").select("id", "reference_image", "target_image").toLocalIterator():
            _need(spark, DataError, **{f"{side} of {r['id']}": r[side] for side in ("reference_image", "target_image")})
    elif isinstance(config, C.ArtifactConfig):
        _need(spark, ArtifactError, source_adapter=config.source_adapter, contract=config.contract, **({"parent_artifact": config.parent_artifact} if config.parent_artifact else {}))
        _free(spark, ArtifactError, config.output)
    elif isinstance(config, C.CompileConfig):
        _need(spark, DataError, **{f"{s.name} {what}": path for s in config.sources for what, path in (("images", s.image_dir), ("annotations", s.annotation_dir))})
        _free(spark, DataError, config.output)
    elif isinstance(config, C.TrainConfig):
        _need(spark, DataError, dataset=config.dataset, **({"parent_artifact": config.parent_artifact} if config.parent_artifact else {}))
        _free(spark, ArtifactError, config.artifact)
    elif isinstance(config, C.PredictConfig):
        _need(spark, DataError, dataset=config.dataset, artifact=config.artifact)
        _free(spark, EvaluationError, config.predictions)
    elif isinstance(config, C.EvaluateConfig):
        _need(spark, EvaluationError, records=config.records, predictions=config.predictions)
        _free(spark, EvaluationError, config.output)
