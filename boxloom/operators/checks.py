"""Fail-closed checks: coverage, leakage, uniqueness, violations. Each reads its input once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DataError, EvaluationError
from boxloom.functions.boxes import GRID
from boxloom.functions.schema import SPLITS

PREVIEW = 20


def coverage(expected: DataFrame, found: DataFrame, key: str = "id") -> DataFrame:
    """Keys on one side only: key and side (missing, extra)."""
    e, f = expected.select(F.col(key).alias("k"), F.lit(1).alias("e")), found.select(F.col(key).alias("k"), F.lit(1).alias("f"))
    met = e.join(f, "k", "full_outer")
    return met.where("e is null or f is null").select(F.col("k").alias(key), F.when(F.col("f").isNull(), "missing").otherwise("extra").alias("side"))


def require_coverage(expected: DataFrame, found: DataFrame, key: str = "id", preview: int = 5) -> None:
    gaps = coverage(expected, found, key)
    counts = {r["side"]: r["n"] for r in gaps.groupBy("side").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts:
        shown = {side: [r[key] for r in gaps.where(F.col("side") == side).orderBy(key).limit(preview).collect()] for side in counts}
        raise EvaluationError(f"predictions and records differ: {counts}; {shown}")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def orphans(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``left`` without a partner, such as images without an annotation."""
    return left.join(right.select(*keys).distinct(), keys, "left_anti")


def leaking_groups(rows: DataFrame) -> DataFrame:
    """Groups found in more than one split."""
    return rows.groupBy("group_id").agg(F.array_sort(F.collect_set("split")).alias("splits")).where(F.size("splits") > 1)


def violations(**rules: Column) -> Column:
    """Names of the rules (true where broken, or null) that a row breaks."""
    named = [F.when(F.coalesce(broken, F.lit(True)), F.lit(name)) for name, broken in rules.items()]
    return F.array_compact(F.array(*named))


def record_violations() -> Column:
    """Rules of a dataset record."""
    n = F.size("detection_set")
    t = F.col("target")
    off_grid = F.exists("detection_set", lambda d: (F.size(d["bbox_2d"]) != 4) | ~F.forall(d["bbox_2d"], lambda v: v.between(0, GRID)) | (F.get(d["bbox_2d"], 2) <= F.get(d["bbox_2d"], 0)) | (F.get(d["bbox_2d"], 3) <= F.get(d["bbox_2d"], 1)))
    outside = F.exists(t["boxes_xyxy"], lambda b: (b[0] < 0) | (b[1] < 0) | (b[2] > t["width"]) | (b[3] > t["height"]) | (b[2] <= b[0]) | (b[3] <= b[1]))
    return violations(
        empty_id=F.trim("id") == "", empty_concept=F.trim("visual_concept") == "", empty_query=F.trim("query") == "",
        bad_size=(t["width"] <= 0) | (t["height"] <= 0), count_differs=n != F.size(t["boxes_xyxy"]), positive_differs=F.col("positive") != (n > 0), box_outside=outside, truth_off_grid=off_grid,
    )


def require_clean(rows: DataFrame, rules: Column, key: str) -> None:
    """Raise with the first broken rows by key; one aggregation says whether there are any."""
    broken = rows.select(F.col(key), rules.alias("broken")).where(F.size("broken") > 0)
    shown = broken.orderBy(key).limit(PREVIEW).collect()
    if shown:
        raise DataError(f"{broken.count()} rows break rules: " + "; ".join(f"{r[key]}: {', '.join(r['broken'])}" for r in shown))


def kind_counts(rows: DataFrame) -> DataFrame:
    """split, records, positive and negative of each split, those without records included."""
    every = rows.sparkSession.createDataFrame([(s,) for s in SPLITS], "split string")
    counted = rows.groupBy("split").agg(F.count(F.lit(1)).alias("records"), F.count_if("positive").alias("positive"), F.count_if(~F.col("positive")).alias("negative"))
    return every.join(counted, "split", "left").fillna(0, ["records", "positive", "negative"])


def validate_training(rows: DataFrame) -> None:
    """Both kinds in training, no group in two splits, and (where ``rows`` are whole records) none that breaks a rule."""
    kinds = kind_counts(rows).where("split = 'train'").first()
    if not kinds["positive"] or not kinds["negative"]:
        raise DataError("training needs positive and negative records")
    if "detection_set" in rows.columns:
        require_clean(rows, record_violations(), "id")
    leaks = leaking_groups(rows).orderBy("group_id").limit(5).collect()
    if leaks:
        raise DataError(f"groups in several splits: {[r['group_id'] for r in leaks]}")


def consensus(rows: DataFrame, column: str) -> bool:
    """Whether all rows agree, nulls included."""
    r = rows.agg(F.count_distinct(column).alias("n"), F.count_if(F.col(column).isNull()).alias("nulls")).first()
    return r["n"] + (r["nulls"] > 0) <= 1


def require_classes(found: DataFrame, requested: list[str], column: str = "concept") -> None:
    asked = found.sparkSession.createDataFrame([(c,) for c in requested], f"{column} string")
    missing = [r[0] for r in asked.join(found.select(column).distinct(), column, "left_anti").orderBy(column).collect()]
    if missing:
        raise DataError(f"no such concepts: {missing}")
