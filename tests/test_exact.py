"""Exact means against exact fractions, and interval coverage against a list of all places."""

import random
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from boxloom.functions import exact
from boxloom.operators import coverage


def exactly(values):
    return float(sum(map(Fraction, values)) / len(values)) if values else None


def test_means_are_the_same_bits_under_any_partitions(spark):
    rng = random.Random(1)
    odd = [0.0, -0.0, 0.1, 1e308, -1e308, 5e-324, 2.0**-1030, 1.0, 0.5, 2.0**52 + 1, 1 / 3, -1 / 3, 0.9999999999999999, 2.0**1000]
    rows = [(k, rng.choice(odd) if rng.random() < 0.3 else rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 12), rng.random() if rng.random() < 0.5 else None) for k in ("a", "b") for _ in range(700)]
    rows += [("c", None, None), ("d", 0.7, None)]
    want = {k: tuple(exactly([r[i] for r in rows if r[0] == k and r[i] is not None]) for i in (1, 2)) for k in "abcd"}
    for parts in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame(rows, "k string, x double, y double").repartition(parts)
        found = exact.exact_means(df, ["k"], {"x": F.col("x"), "y": F.col("y")}).collect()
        assert {r["k"]: (r["x"], r["y"]) for r in found} == want
    assert exact.exact_means(df.where("k = 'd'"), [], {"x": F.col("x")}).first()["x"] == 0.7
    assert exact.exact_means(df.limit(0), ["k"], {"x": F.col("x")}).collect() == []


@pytest.mark.parametrize("bad", [float("nan"), float("inf"), float("-inf")])
def test_values_that_are_not_finite(spark, bad):
    with pytest.raises(Exception, match="not finite"):
        exact.exact_means(spark.createDataFrame([(1.0,), (bad,)], "x double"), [], {"x": F.col("x")}).collect()


@pytest.mark.parametrize(("seed", "start", "end", "width"), [(1, 0, 100, 4), (2, 13, 300, 8), (3, 5, 6, 4), (4, 0, 1000, 4096), (5, 64, 64, 4), (6, 0, 64, 4)])
def test_intervals_against_a_list(spark, seed, start, end, width):
    rng = random.Random(seed)
    intervals = [(lo, lo + rng.randrange(-1, 12)) for lo in (rng.randrange(start - 5, end + 5) for _ in range((end - start) // 7))]
    held = Counter(p for lo, hi in intervals for p in range(lo, hi + 1))
    found = coverage.interval_faults(spark.createDataFrame(intervals or [(1, 0)], "lo long, hi long"), start, end, width).collect()
    told = {kind: Counter(p for r in found if r["kind"] == kind for p in range(r["lo"], r["hi"] + 1)) for kind in ("gap", "repeat", "outside")}
    assert told["gap"] == Counter({p: 1 for p in range(start, end) if p not in held})
    assert set(told["repeat"]) == {p for p, n in held.items() if n > 1 and start <= p < end}
    assert told["outside"] == Counter({p: n for p, n in held.items() if not start <= p < end})


def test_sampler(spark):
    shards = [(rank, item) for rank in range(3) for item in range(rank, 9001, 3)]
    df = spark.createDataFrame(shards, "rank int, item long")
    assert coverage.sampler_faults(df, 0, 9001).collect() == []
    broken = df.where("item <> 4096 AND item <> 9000").unionByName(df.where("item = 17")).unionByName(spark.createDataFrame([(0, 9001), (0, None)], "rank int, item long"))
    assert {tuple(r) for r in coverage.sampler_faults(broken, 0, 9001).collect()} == {("gap", 4096, 4096), ("gap", 9000, 9000), ("repeat", 17, 17), ("outside", 9001, 9001)}
    assert [tuple(r) for r in coverage.sampler_faults(df.limit(0), 3, 9).collect()] == [("gap", 3, 8)]
