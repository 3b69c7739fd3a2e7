"""Whether shards cover a range of places, each place once.

Nothing lists the expected places. Intervals are cut at the borders of buckets
of ``WIDTH`` places; a bucket finds the gaps and the repeats between its own
intervals and hands its outer ends on, as one interval, to the buckets of
buckets, until one is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Places a bucket, and buckets a bucket of buckets.
WIDTH = 4096


def _steps(cut: DataFrame, width: int) -> DataFrame:
    """Each interval with ``_seen``, the last place of those before it in its bucket."""
    before = Window.partitionBy("_bucket").orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    return cut.withColumn("_bucket", F.floor(F.col("lo") / width)).withColumn("_seen", F.max("hi").over(before))


def interval_faults(intervals: DataFrame, start: int, end: int, width: int = WIDTH) -> DataFrame:
    """kind, lo and hi of what keeps ``intervals`` (lo, hi, both included) from covering start..end-1 once.

    ``gap``: places that nobody has; ``repeat``: places that are covered once
    more; ``outside``: places beyond the range. Intervals with hi below lo are
    empty. A gap or repeat that crosses a bucket's border may come in pieces.
    """
    whole = intervals.select(F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi")).where("lo <= hi")
    low, high = F.lit(start).cast("long"), F.lit(end - 1).cast("long")
    sides = F.array(F.struct(F.col("lo"), F.least("hi", low - 1).alias("hi")), F.struct(F.greatest("lo", high + 1).alias("lo"), F.col("hi")))
    outside = whole.select(F.inline(sides)).where("lo <= hi").select(F.lit("outside").alias("kind"), "lo", "hi")
    inside = whole.select(F.greatest("lo", low).alias("lo"), F.least("hi", high).alias("hi")).where("lo <= hi")
    buckets = F.sequence(F.floor(F.col("lo") / width), F.floor(F.col("hi") / width))
    level = inside.withColumn("_b", F.explode(buckets)).select(F.greatest("lo", F.col("_b") * width).alias("lo"), F.least("hi", (F.col("_b") + 1) * width - 1).alias("hi"))
    faults, size = outside, width
    while True:
        steps = _steps(level, size)
        gaps = steps.where("lo > _seen + 1").select(F.lit("gap").alias("kind"), (F.col("_seen") + 1).alias("lo"), (F.col("lo") - 1).alias("hi"))
        twice = steps.where("lo <= _seen").select(F.lit("repeat").alias("kind"), "lo", F.least("hi", "_seen").alias("hi"))
        faults = faults.unionByName(gaps).unionByName(twice)
        if start // size == (end - 1) // size:
            break
        level = level.groupBy(F.floor(F.col("lo") / size).alias("_bucket")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("_bucket")
        size *= width
    if start >= end:
        return faults
    ends = level.agg(F.min("lo").alias("first"), F.max("hi").alias("last"))
    edges = F.array(F.struct(low.alias("lo"), F.coalesce(F.col("first") - 1, high).alias("hi")), F.struct((F.coalesce("last", high) + 1).alias("lo"), high.alias("hi")))
    return faults.unionByName(ends.select(F.inline(edges)).where("lo <= hi").select(F.lit("gap").alias("kind"), "lo", "hi"))


def sampler_faults(items: DataFrame, start: int, end: int, item: str = "item") -> DataFrame:
    """:func:`interval_faults` of single places: what the ranks of a sampler were given, rows of ``item``."""
    return interval_faults(items.where(F.col(item).isNotNull()).select(F.col(item).alias("lo"), F.col(item).alias("hi")), start, end)
