"""Means that are the same bits however rows are dealt.

A double is a whole number times a power of two. Whole numbers of one power add
up exactly, in any order and on any partition, so sums by power are ordinary
aggregates, combined before the shuffle; a mean is one division of the exact
total, rounded once.
"""

from __future__ import annotations

from fractions import Fraction

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of a double's whole number, and one to spare for a logarithm that is a little off.
_BITS = 53


def parts(value: Column) -> Column:
    """struct(power, whole): the value is whole * 2^power; an error for NaN and infinity."""
    power = F.when(value == 0, 0).otherwise(F.floor(F.log2(F.abs(value))).cast("int") - _BITS)
    half = F.floor(-power / 2).cast("int")  # in two steps, as the power for a tiny value is beyond doubles
    two = lambda n: F.pow(F.lit(2.0), n.cast("double"))
    whole = value * two(half) * two(-power - half)
    odd = F.isnan(value) | F.abs(value).isin(float("inf"))
    return F.when(odd, F.raise_error("a value is not finite")).otherwise(F.struct(power.alias("power"), whole.cast("long").alias("whole")))


@F.arrow_udf(T.DoubleType())
def _mean(sums: pa.Array, n: pa.Array) -> pa.Array:
    return pa.array([float(sum(Fraction(int(s["whole"])) * Fraction(2) ** s["power"] for s in one) / k) for one, k in zip(sums.to_pylist(), n.to_pylist(), strict=True)])


def exact_means(rows: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """``keys`` and the mean of each column over the rows where it is not null; null over none, an error where a value is not finite."""
    named = F.array(*[F.struct(F.lit(name).alias("_name"), c.cast("double").alias("_value")) for name, c in columns.items()])
    long = rows.select(*keys, F.inline(named))
    split = long.select(*keys, "_name", F.when(F.col("_value").isNotNull(), parts(F.col("_value"))).alias("_p"))
    sums = split.groupBy(*keys, "_name", F.col("_p.power").alias("power")).agg(F.sum(F.col("_p.whole").cast("decimal(28,0)")).alias("whole"), F.count("_p").alias("_n"))
    listed = F.filter(F.collect_list(F.struct("power", "whole")), lambda s: s["power"].isNotNull())
    one = sums.groupBy(*keys, "_name").agg(listed.alias("_sums"), F.sum("_n").alias("_n"))
    told = one.withColumn("_mean", F.when(F.col("_n") > 0, _mean("_sums", F.greatest("_n", F.lit(1)))))
    return told.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == name, F.col("_mean"))).alias(name) for name in columns])
