"""Work that arrives over time: score new completions as files come in, and resume where a run stopped.

The batch operators are stateless by row, so they run on streams unchanged; the
stream's checkpoint, in the cluster's shared folder, says what is done.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from boxloom.functions.schema import PREDICTION
from boxloom.operators.scoring import rewards
from boxloom.runtime import new_path


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Predictions from JSON-lines files as they arrive."""
    return spark.readStream.schema(PREDICTION).option("maxFilesPerTrigger", files_a_batch).json(folder)


def score_stream(completions: DataFrame, truth: DataFrame) -> DataFrame:
    """Rewards of arriving completions; ``truth`` (id, targets) is a static table."""
    return rewards(completions.join(truth.select("id", "targets"), "id"))


def write_stream(rows: DataFrame, folder: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append to Parquet until what is there now is done."""
    place = checkpoint or new_path(rows.sparkSession, "stream")
    return rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", place).trigger(availableNow=True).start()


def pending(tasks: DataFrame, done: DataFrame, key: str = "id") -> DataFrame:
    """Tasks without a result."""
    return tasks.join(done.select(key).distinct(), key, "left_anti")

