"""Row numbers over a whole table without gathering it in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.runtime import write_table

_ROWS = (1 << 33) - 1


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def global_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """``df`` with its zero-based place in ``order`` (ties in any order).

    Rows are range-partitioned and sorted where they lie; only the size of each
    partition comes to the driver.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    at = unused(df, "_at")
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id())
    table = write_table(placed, "ranked")
    part, row = F.shiftrightunsigned(at, 33).cast("int"), F.col(at).bitwiseAND(F.lit(_ROWS))
    sizes = {r["p"]: r["n"] for r in table.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [0] * (max(sizes, default=0) + 1), 0
    for p in range(len(before)):
        before[p], total = total, total + sizes.get(p, 0)
    return table.withColumn(name, F.get(F.array(*[F.lit(b).cast("long") for b in before]), part) + row).drop(at)


def class_rank(df: DataFrame, flag: str, order: list[Column], name: str = "rank") -> DataFrame:
    """As :func:`global_rank`, within the rows where the boolean ``flag`` is true and within those where it is false."""
    all_ = unused(df, "_all")
    ranked = global_rank(df, [F.col(flag).desc(), *order], all_)
    ahead = ranked.where(F.col(flag)).count()
    return ranked.withColumn(name, F.when(F.col(flag), F.col(all_)).otherwise(F.col(all_) - ahead)).drop(all_)
