"""Scored examples: one call of the matching UDF a row, everything else in columns.

An example has id, visual_concept, query, target_key, reference_key, targets
(grid boxes), pixel_boxes, width, height and raw_completion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.functions import boxes
from boxloom.functions.detections import scored
from boxloom.operators.ranking import unused

N_THRESHOLDS = 10


def score(examples: DataFrame) -> DataFrame:
    """``examples`` with format_valid, format_error, prediction, tp, set_f1 (ten values), soft_set_f1 and slices.

    An invalid completion has no boxes and scores 0 throughout, though its
    targets still count as missed; a valid empty one beside no targets scores 1.
    """
    told = unused(examples, "_scored")
    rows, n, found = examples.withColumn(told, scored("raw_completion", "targets")), F.size("targets"), F.col(told)
    valid = found["valid"]

    def f1_at(i: Column) -> Column:
        tp = F.get(found["tp"], i)
        return boxes.set_f1(tp, F.size(found["boxes"]) - tp, n - tp)

    f1 = F.transform(F.sequence(F.lit(0), F.lit(N_THRESHOLDS - 1)), lambda i: F.when(valid, f1_at(i)).otherwise(0.0))
    return rows.select(
        *examples.columns,
        valid.alias("format_valid"),
        found["error"].alias("format_error"),
        found["boxes"].alias("prediction"),
        found["tp"].alias("tp"),
        f1.alias("set_f1"),
        F.when(valid, boxes.soft_set_f1(found["matched"], F.size(found["boxes"]), n)).otherwise(0.0).alias("soft_set_f1"),
        boxes.count_slice(n).alias("count_slice"),
        boxes.area_slice(F.col("pixel_boxes"), F.col("width"), F.col("height")).alias("area_slice"),
    )


def mean_f1(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.lit(float(N_THRESHOLDS))


def rewards(completions: DataFrame) -> DataFrame:
    """``completions`` (raw_completion, targets) with format_valid, soft_set_f1, format_reward, quality_reward and reward."""
    told = unused(completions, "_scored")
    rows, found = completions.withColumn(told, scored("raw_completion", "targets")), F.col(told)
    valid = found["valid"]
    soft = F.when(valid, boxes.soft_set_f1(found["matched"], F.size(found["boxes"]), F.size("targets"))).otherwise(0.0)
    return rows.select(
        *completions.columns, valid.alias("format_valid"), soft.alias("soft_set_f1"),
        F.when(valid, 0.10).otherwise(0.0).alias("format_reward"), F.when(valid, 0.90 * soft).otherwise(0.0).alias("quality_reward"), boxes.reward(valid, soft).alias("reward"),
    )


def uneven_rewards(scored_rows: DataFrame) -> DataFrame:
    """Per id: completions, and whether two or more of them differ in reward by over 1e-8."""
    spread = F.max("reward") - F.min("reward")
    return scored_rows.groupBy("id").agg(F.count(F.lit(1)).alias("n"), spread.alias("spread"), ((F.count(F.lit(1)) >= 2) & (spread > 1e-8)).alias("nonzero_advantage"))


def completion_text(blocks: Column) -> Column:
    """The text of a chat completion: its text blocks joined, trimmed."""
    return F.trim(F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), ""))
