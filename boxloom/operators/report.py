"""Metrics of scored examples: summaries, slices and the reference swap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.functions.boxes import set_f1
from boxloom.functions.detections import agreement
from boxloom.functions.exact import exact_means
from boxloom.operators.scoring import N_THRESHOLDS, mean_f1

METRICS = (
    "examples", "positive_examples", "negative_examples", "positive_macro_mean_set_f1_50_95", "all_macro_mean_set_f1_50_95",
    "true_positives", "false_positives", "false_negatives", "precision", "recall", "f1",
    "positive_macro_soft_set_f1", "strict_valid_rate", "correct_empty_rate", "negative_false_positive_boxes_per_image",
)


def _means() -> dict[str, Column]:
    """What the summary's means are over; null where an example does not count."""
    positive, found = F.size("targets") > 0, F.size("prediction")
    return {
        "positive_macro_mean_set_f1_50_95": F.when(positive, mean_f1(F.col("set_f1"))),
        "all_macro_mean_set_f1_50_95": mean_f1(F.col("set_f1")),
        "positive_macro_soft_set_f1": F.when(positive, F.col("soft_set_f1")),
        "strict_valid_rate": F.col("format_valid").cast("double"),
        "correct_empty_rate": F.when(~positive, (F.col("format_valid") & (found == 0)).cast("double")),
        "negative_false_positive_boxes_per_image": F.when(~positive, found.cast("double")),
    }


def _counts() -> list[Column]:
    positive = F.size("targets") > 0
    tp, found, wanted = F.get("tp", F.lit(0)), F.size("prediction"), F.size("targets")
    return [
        F.count(F.lit(1)).alias("examples"),
        F.count_if(positive).alias("positive_examples"),
        F.count_if(~positive).alias("negative_examples"),
        F.coalesce(F.sum(tp), F.lit(0)).cast("long").alias("true_positives"),
        F.coalesce(F.sum(found - tp), F.lit(0)).cast("long").alias("false_positives"),
        F.coalesce(F.sum(wanted - tp), F.lit(0)).cast("long").alias("false_negatives"),
    ]


def _sums() -> list[Column]:
    """The aggregates a summary needs; each is combined before the shuffle."""
    return [*_counts(), *[F.avg(c).alias(name) for name, c in _means().items()]]


def _finished(summed: DataFrame, keys: list[str]) -> DataFrame:
    tp, fp, fn = F.col("true_positives"), F.col("false_positives"), F.col("false_negatives")
    precision = F.coalesce(F.try_divide(tp, tp + fp), F.when(fn == 0, 1.0).otherwise(0.0))
    recall = F.coalesce(F.try_divide(tp, tp + fn), F.when(fp == 0, 1.0).otherwise(0.0))
    done = summed.withColumns({"precision": precision, "recall": recall, "f1": set_f1(tp, fp, fn)})
    return done.select(*keys, *METRICS)


def summarize(scored: DataFrame) -> DataFrame:
    """One row of ``METRICS``; means over nobody are null, and precision, recall and F1 of nothing are 1."""
    return _finished(scored.agg(*_sums()), [])


def exact_slices(scored: DataFrame) -> DataFrame:
    """:func:`slices` with means that are the same bits under any partitions, for reports that must repeat byte by byte."""
    of = {"overall": F.lit("all"), "count": F.col("count_slice"), "area": F.col("area_slice"), "concept": F.col("visual_concept")}
    names = list(_means())
    short = scored.select(F.explode(F.array(*[F.struct(F.lit(k).alias("slice"), v.alias("value")) for k, v in of.items()])).alias("_in"), *[c.alias(name) for name, c in _means().items()])
    means = exact_means(short.select("_in.*", *names).where("value is not null"), ["slice", "value"], {name: F.col(name) for name in names})
    return slices(scored).drop(*names).join(means, ["slice", "value"], "left").select("slice", "value", *METRICS)


def slices(scored: DataFrame) -> DataFrame:
    """The summary overall and by count slice, area slice and concept, in one pass: slice, value and ``METRICS``.

    Count and area slices always appear, concepts where they occur; examples
    without an area are in no area slice.
    """
    spark = scored.sparkSession
    by = ["count_slice", "area_slice", "visual_concept"]
    grouped = scored.groupingSets([[], ["count_slice"], ["area_slice"], ["visual_concept"]], *by).agg(*_sums(), *[F.grouping(c).alias(f"_g_{c}") for c in by])
    names = {"count_slice": "count", "area_slice": "area", "visual_concept": "concept"}
    slice_, value = F.lit("overall"), F.lit("all")
    for column, name in names.items():
        slice_ = F.when(F.col(f"_g_{column}") == 0, name).otherwise(slice_)
        value = F.when(F.col(f"_g_{column}") == 0, F.col(column)).otherwise(value)
    found = grouped.withColumn("slice", slice_).withColumn("value", value).where("value is not null").drop(*by, *[f"_g_{c}" for c in by])
    fixed = [("overall", "all"), *(("count", v) for v in ("empty", "one", "multi")), *(("area", v) for v in ("small", "medium", "large"))]
    every = spark.createDataFrame(fixed, "slice string, value string").unionByName(found.where("slice = 'concept'").select("slice", "value"))
    filled = every.join(found, ["slice", "value"], "left").fillna(0, ["examples", "positive_examples", "negative_examples", "true_positives", "false_positives", "false_negatives"])
    return _finished(filled, ["slice", "value"])


def swap_pairs(scored: DataFrame) -> DataFrame:
    """Pairs of examples alike but for the reference, within groups of two or more references.

    The examples are shuffled once, by target, query and concept: the groups'
    checks are windows over these partitions, and both sides of the pairs read them.
    """
    keys = ["target_key", "query", "visual_concept"]
    parts = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = scored.select(*keys, "id", "reference_key", "format_valid", "prediction", F.array_sort("targets").alias("_truth")).repartition(parts, *keys)
    group = Window.partitionBy(*keys)
    of = {"_first": F.min("reference_key"), "_last": F.max("reference_key"), "_low": F.min("_truth"), "_high": F.max("_truth")}
    seen = side.withColumns({name: c.over(group) for name, c in of.items()})
    agreed = F.when(F.col("_low") == F.col("_high"), True).otherwise(F.raise_error("examples of one target disagree in their truth").cast("boolean"))
    several = seen.where(F.when(F.col("_first") < F.col("_last"), agreed).otherwise(False))
    left, right = (several.select(*keys, *[F.col(c).alias(f"{p}_{c}") for c in ("id", "reference_key", "format_valid", "prediction")]) for p in "lr")
    return left.join(right, keys).where("l_id < r_id and l_reference_key <> r_reference_key")


def reference_swap(scored: DataFrame) -> DataFrame:
    """One row: applicable, groups, pairs and the three rates (null without pairs)."""
    pairs = swap_pairs(scored).withColumn("_tp", agreement("l_prediction", "r_prediction"))
    both = F.col("l_format_valid") & F.col("r_format_valid")
    f1 = F.transform(F.sequence(F.lit(0), F.lit(N_THRESHOLDS - 1)), lambda i: set_f1(F.get("_tp", i), F.size("l_prediction") - F.get("_tp", i), F.size("r_prediction") - F.get("_tp", i)))
    same = both & (F.array_sort("l_prediction") == F.array_sort("r_prediction"))
    return pairs.agg(
        (F.count(F.lit(1)) > 0).alias("applicable"),
        F.count_distinct("target_key", "query", "visual_concept").alias("groups"),
        F.count(F.lit(1)).alias("pairs"),
        F.avg(both.cast("double")).alias("strict_valid_pair_rate"),
        F.avg(same.cast("double")).alias("exact_detection_set_rate"),
        F.avg(F.when(both, mean_f1(f1)).otherwise(0.0)).alias("pairwise_macro_mean_set_f1_50_95"),
    )

