"""Pairing, group names and split fill against loops over small tables."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from boxloom.operators import grouping, pairing, ranking, schedule, scoring, splits
from tests.test_operators import brute_splits

IMAGE = "record_id string, group_id string, split string, concepts array<string>"
ASKED = "record_id string, group_id string, split string, concept string, positive boolean"


def digest(*parts):
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()


def scene(seed, n, groups):
    """Images of which a third lie in one group; the concept ``alone`` occurs in that group only."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        group = "big" if rng.random() < 0.34 else f"g{rng.randrange(groups)}"
        concepts = rng.sample(["a", "b", "c"], rng.randint(1, 2)) + (["alone"] if group == "big" else [])
        rows.append((f"r{i:04d}", group, "test" if group[-1] == "1" else "train", sorted(concepts)))
    asked = [(r, g, s, c, c in has) for r, g, s, has in rows for c in ("a", "b", "c", "alone")]
    return rows, asked


def pairs(frame):
    rows = [tuple(r) for r in frame.select("record_id", "group_id", "split", "concept", "positive", "reference_id").collect()]
    assert len(set(rows)) == len(rows)
    return {(r[0], r[3]): r[5] for r in rows}


def offers(rows, asked):
    for r, g, s, c, _ in asked:
        yield r, c, [x for x, group, split, has in rows if split == s and c in has and group != g]


@pytest.mark.parametrize(("block", "short_list"), [(3, 1), (8, 2), (1024, 32)])
def test_least_hash_reference(spark, block, short_list):
    rows, asked = scene(1, 60, 6)
    found = pairs(pairing.references(spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, IMAGE), 5, block, short_list))
    assert found == {(r, c): min(xs, key=lambda x: digest(5, r, c, x)) for r, c, xs in offers(rows, asked) if xs}


@pytest.mark.parametrize(("seed", "n", "groups", "arc"), [(1, 60, 6, 4), (2, 300, 40, 8), (3, 300, 3, 2), (4, 12, 2, 4096), (5, 200, 1, 3)])
def test_ring_reference(spark, seed, n, groups, arc):
    rows, asked = scene(seed, n, groups)

    def ahead(r, c):
        at = digest(7, r, c)
        return lambda x: (digest(7, c, x) < at, digest(7, c, x), x)

    found = pairs(pairing.ring_references(spark.createDataFrame(asked, ASKED), spark.createDataFrame(rows, IMAGE), 7, arc))
    assert found == {(r, c): min(xs, key=ahead(r, c)) for r, c, xs in offers(rows, asked) if xs}


def test_ring_reference_of_nothing(spark):
    rows, asked = scene(6, 10, 2)
    some, none = spark.createDataFrame(rows, IMAGE), spark.createDataFrame([], IMAGE)
    assert pairs(pairing.ring_references(spark.createDataFrame(asked, ASKED), none, 7)) == {}
    assert pairs(pairing.ring_references(spark.createDataFrame([], ASKED), some, 7)) == {}


def test_group_names(spark):
    members = {"a": ["a", "b", "x" * 50], "c": ["c"], "d": [f"d{i:06d}" for i in range(30_000)], "é": ["é", "日"]}
    rows = [(m, c) for c, ms in members.items() for m in ms]
    random.Random(1).shuffle(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        found = grouping.group_names(spark.createDataFrame(rows, "m string, component string"), "m").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {r["component"]: (r["group_id"], r["members"]) for r in found} == {c: (digest(*sorted(ms))[:24], len(ms)) for c, ms in members.items()}
    numbers = grouping.group_names(spark.createDataFrame([(i, 9) for i in (100, 9, 20)], "m long, component long"), "m").first()
    assert (numbers["component"], numbers["group_id"]) == (9, digest(9, 20, 100)[:24])
    assert grouping.group_names(spark.createDataFrame([], "m long, component long"), "m").collect() == []


@pytest.mark.parametrize(("lack", "n"), [((50, 5, 5), 60), ((3, 9, 9), 30), ((4, 4, 4), 25), ((0, 7, 3), 40), ((10, -2, -5), 11), ((20, 1, 6), 19), ((1, 1, 1), 0)])
def test_fill(spark, lack, n):
    left = dict(zip(splits.SPLITS, lack, strict=True))
    rest = [f"g{i}" for i in range(n)]
    found = splits.fill(spark.createDataFrame([(g,) for g in rest], "group_id string"), left, 3).collect()
    want = {}
    for g in sorted(rest, key=lambda g: digest(3, "remaining", g)):
        want[g] = min(splits.SPLITS, key=lambda s: (-left[s], digest(3, g, s)))
        left[want[g]] -= 1
    assert {r["group_id"]: r["split"] for r in found} == want and len(found) == n


@pytest.mark.parametrize("pool", [1, 2, 5, 1024])
def test_seed_groups_with_small_pools(spark, pool):
    rng = random.Random(pool)
    classes = ["a", "b", "c", "d", "e"]
    groups = {f"g{i}": frozenset(rng.sample([*classes, "z"], rng.randrange(1, 4))) for i in range(70)}
    df = spark.createDataFrame([(g, sorted(c)) for g, c in groups.items()], "group_id string, concepts array<string>").coalesce(1).cache()
    taken = splits.seed_groups(df, classes, 17, pool)
    every = brute_splits(groups, classes, {"train": 0.8, "validation": 0.1, "test": 0.1}, 17)
    assert taken and all(every[g] == s for g, s in taken.items())
    held = Counter((s, c) for g, s in taken.items() for c in groups[g])
    assert all(held[s, c] >= 2 for s in splits.SPLITS for c in classes)


def test_ranks_keep_every_column(spark):
    rows = spark.createDataFrame([(3, "x"), (1, "y"), (2, "z")], "_id long, _at string")
    assert {tuple(r) for r in ranking.global_rank(rows, [F.col("_id")]).collect()} == {(1, "y", 0), (2, "z", 1), (3, "x", 2)}


def test_schedules_and_scores_keep_every_column(spark):
    names = ["_i", "_h", "_at", "_all", "_front", "_scored"]
    rows = spark.createDataFrame([(i, i % 3 > 0, i, "[]", []) for i in range(7)], "id long, positive boolean, position long, raw_completion string, targets array<array<int>>").selectExpr("*", *[f"id AS {n}" for n in names])
    for made in (schedule.interleave(rows, 1), schedule.ratio_epoch(rows, 1, 0), schedule.front_load(rows, 7), scoring.rewards(rows)):
        got = made.collect()
        assert len(got) == 7 and all(r[n] == r["id"] for r in got for n in names)


def test_pairs_of_a_hot_concept_are_the_work_of_all_tasks(spark, monkeypatch):
    rows = [(i, f"g{i % 7}", "train", ["bolt"]) for i in range(1000)]
    images = spark.createDataFrame(rows, IMAGE)
    asked = images.select("record_id", "group_id", "split", F.lit("bolt").alias("concept"), F.lit(True).alias("positive"))
    met, real = [], pairing.write_table

    def seen(df, name):
        met.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    monkeypatch.setattr(pairing, "write_table", seen)
    assert pairing.references(asked, images, 3).count() == 1000
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    dealt = [line for line in met[0].splitlines() if "REPARTITION_BY_NUM" in line]
    assert len(dealt) == 2 and all("_block" in line and f", {parts})" in line for line in dealt)


def test_a_hot_concept_has_a_block_for_each_partition(spark, monkeypatch):
    images = spark.createDataFrame([(i, f"g{i % 7}", "train", ["bolt"]) for i in range(1000)], IMAGE)
    asked = images.select("record_id", "group_id", "split", F.lit("bolt").alias("concept"), F.lit(True).alias("positive"))
    blocks, real = [], pairing._least_hash

    def seen(wanted, *rest):
        blocks.append(wanted.select("_block").distinct().count())
        return real(wanted, *rest)

    monkeypatch.setattr(pairing, "_least_hash", seen)
    pairing.references(asked, images, 3)
    assert blocks[0] == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_a_task_meets_a_chunk_of_candidates_and_members_of_a_large_group_are_no_late_work(spark, monkeypatch):
    """One group has most images of a concept, and what a task holds does not grow with the concept."""
    rows = [(f"r{i:04d}", "big" if i % 25 else f"g{i}", "train", ["bolt"]) for i in range(1000)]
    images = spark.createDataFrame(rows, IMAGE)
    asked = images.select("record_id", "group_id", "split", F.lit("bolt").alias("concept"), F.lit(True).alias("positive"))
    met, real = [], pairing._least_hash

    def seen(wanted, offered, *rest):
        cells = offered.groupBy(*[c for c in ("split", "concept", "_block", "_chunk") if c in offered.columns]).count()
        met.append((wanted.select("record_id").distinct().count(), cells.agg(F.max("count")).first()[0]))
        return real(wanted, offered, *rest)

    monkeypatch.setattr(pairing, "_least_hash", seen)
    found = pairs(pairing.references(asked, images, 5, 100, 8))
    assert found == {(r, "bolt"): min((x for x, group, *_ in rows if group != g), key=lambda x: digest(5, r, "bolt", x)) for r, g, *_ in rows}
    (all_, widest), (late, widest_late) = met
    assert all_ == 1000 and late <= 5 and max(widest, widest_late) <= 200


def test_looking_up_the_missed_deals_the_candidates_of_their_blocks_only(spark):
    """Nobody is missed here: after the pairs were written, images may be shuffled once, but no row of a cell."""
    images = spark.createDataFrame([(i, f"g{i % 7}", "train", ["bolt"]) for i in range(1000)], IMAGE)
    asked = images.select("record_id", "group_id", "split", F.lit("bolt").alias("concept"), F.lit(True).alias("positive"))
    paired = pairing.references(asked, images, 3)
    sc = spark.sparkContext

    def shuffled():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}

    before = shuffled()
    assert paired.count() == 1000
    assert sum(n for stage, n in shuffled().items() if stage not in before) < 2000
