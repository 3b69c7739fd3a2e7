"""Training order: hash orders, interleaving, epochs, front-loading, shards. Rows have id and positive."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.errors import DataError
from boxloom.operators.ranking import class_rank, global_rank, unused


def _kind_hash(prefix: list) -> Column:
    """sha256 of ``prefix:kind:id`` with kind p or n."""
    return F.sha2(F.concat_ws(":", *[F.lit(str(p)) if not isinstance(p, Column) else p for p in prefix], F.when(F.col("positive"), "p").otherwise("n"), F.col("id").cast("string")), 256)


def interleave(rows: DataFrame, seed: int) -> DataFrame:
    """Positives and negatives in turn, what is left at the end: ``rows`` with position."""
    place = unused(rows, "_i")
    hashed = F.sha2(F.concat_ws(":", F.lit(str(seed)), F.when(F.col("positive"), "positive").otherwise("negative"), F.col("id").cast("string")), 256)
    ranked = class_rank(rows, "positive", [hashed], place)
    return global_rank(ranked, [F.col(place), F.col("positive").desc()], "position").drop(place)


def _ratio_place(place: Column, n_pos: int, n_neg: int) -> Column:
    """(bucket, kind, place) that sorts max(1, P // N) positives before each negative."""
    ratio = max(1, n_pos // n_neg)
    bucket = F.when(F.col("positive"), F.least(F.floor(place / ratio), F.lit(n_neg))).otherwise(place)
    return F.struct(bucket.cast("long").alias("bucket"), (~F.col("positive")).cast("int").alias("kind"), place.alias("i"))


def ratio_epoch(rows: DataFrame, seed: int, epoch: int) -> DataFrame:
    """One epoch: as many positives as the ratio gives, then a negative, again and again; what is left last."""
    place = unused(rows, "_i")
    ranked = class_rank(rows, "positive", [_kind_hash([seed, epoch])], place)
    counts = ranked.agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("n")).first()
    if not counts["p"] or not counts["n"]:
        raise DataError("a schedule needs positive and negative rows")
    return global_rank(ranked, [_ratio_place(F.col(place), counts["p"], counts["n"])], "place").drop(place).withColumn("epoch", F.lit(epoch))


def epochs(rows: DataFrame, n: float, seed: int) -> DataFrame:
    """Whole epochs, each in its own order, then the first part of another: ``rows`` with epoch, place and position."""
    total, out = rows.count(), None
    for epoch in range(math.ceil(n)):
        part = ratio_epoch(rows, seed, epoch)
        if epoch + 1 > n:
            part = part.where(F.col("place") < math.ceil(total * (n - int(n))))
        out = part if out is None else out.unionByName(part)
    return out.withColumn("position", F.col("epoch") * total + F.col("place"))


def front_load(rows: DataFrame, k: int) -> DataFrame:
    """The first positive and the first negative by position, then the others, ``k`` rows in all.

    Later rows that repeat one of the two are left out, as they say the same thing.
    """
    firsts = {r["positive"]: (r["position"], r["id"]) for r in rows.groupBy("positive").agg(F.min("position").alias("position"), F.min_by("id", "position").alias("id")).collect()}
    if set(firsts) != {True, False}:
        raise DataError("no positive and negative pair to begin with")
    (p, p_id), (n, n_id) = firsts[True], firsts[False]
    front = F.when(F.col("position") == p, 0).when(F.col("position") == n, 1).otherwise(2)
    kept = rows.where((front < 2) | ~F.col("id").isin(p_id, n_id))
    return global_rank(kept, [front, F.col("position")], "place").where(F.col("place") < k)


def within_length(rows: DataFrame, tokens: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to the limit, and the ids of the others; nothing is ever truncated."""
    return rows.where(F.col(tokens) <= limit), rows.where(F.col(tokens) > limit).select("id")


def stride_shard(rows: DataFrame, world: int, order: list[Column] | None = None) -> DataFrame:
    """``rows`` with rank (in order, by id if not given) and shard = rank mod world."""
    return global_rank(rows, order or [F.col("id")]).withColumn("shard", F.pmod("rank", F.lit(world)).cast("int"))


def padded_shards(rows: DataFrame, world: int) -> DataFrame:
    """Shards filled to equal length by repeating their own rows from the start: rows with shard, slot and padded.

    A shard is short of the longest by one row at most, or empty where there are fewer rows than shards.
    """
    sharded = stride_shard(rows, world).withColumn("slot", F.floor(F.col("rank") / world).cast("long"))
    longest = -(-rows.count() // world)
    short = sharded.where((F.lit(longest - 1) * world + F.col("shard") >= rows.count()) & (F.col("slot") == 0))
    extra = short.withColumn("slot", F.lit(longest - 1).cast("long")).withColumn("padded", F.lit(True))
    return sharded.withColumn("padded", F.lit(False)).unionByName(extra)
