"""What ranks and checkpoints of training runs report, as tables. boxloom.streaming.runs follows runs over time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DataError

#: Fixed value: how a checkpoint's folder is named.
NAMED = r"checkpoint-([0-9]+)$"


def complete_steps(listed: DataFrame) -> DataFrame:
    """run and the last complete step of (run, folder, complete) rows, over any number of runs; two complete folders for one step are an error."""
    step = F.regexp_extract("folder", NAMED, 1)
    whole = listed.where((step != "") & F.col("complete")).select("run", step.cast("long").alias("step"))
    by_step = whole.groupBy("run", "step").agg(F.count(F.lit(1)).alias("n"))
    one = F.when(F.col("n") == 1, F.col("step")).otherwise(F.raise_error(F.concat(F.lit("a step has two checkpoints in "), "run")).cast("long"))
    return by_step.groupBy("run").agg(F.max(one).alias("step"))


def over_ranks(reports: DataFrame) -> DataFrame:
    """One row of what (rank, peak_gib, seen_positive, seen_negative) reports come to: the highest peak, and what any rank saw."""
    return reports.agg(
        F.count_distinct("rank").alias("ranks"), F.max("peak_gib").alias("peak_gib"),
        F.coalesce(F.bool_or("seen_positive"), F.lit(False)).alias("seen_positive"), F.coalesce(F.bool_or("seen_negative"), F.lit(False)).alias("seen_negative"),
    )


def kinds_seen(events: DataFrame) -> DataFrame:
    """One row over (id, positive, reward) events: how many, which kinds, and the ids whose rewards differ by over 1e-8."""
    by_id = events.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("q"), (F.max("reward") - F.min("reward")).alias("spread"))
    return by_id.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), (F.coalesce(F.sum("p"), F.lit(0)) > 0).alias("positive"), (F.coalesce(F.sum("q"), F.lit(0)) > 0).alias("negative"), F.count_if((F.col("n") >= 2) & (F.col("spread") > 1e-8)).alias("uneven_ids"))


def require_kinds(seen: DataFrame, least: int = 4) -> None:
    """Both kinds, ``least`` events, and an id with uneven rewards; else training told nothing apart."""
    r = seen.first()
    if r["events"] < least or not r["positive"] or not r["negative"] or not r["uneven_ids"]:
        raise DataError(f"too little was seen: {r.asDict()}")
