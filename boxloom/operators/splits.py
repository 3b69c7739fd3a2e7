"""Stratified assignment of leakage groups to train, validation and test.

Two greedy passes give every split one and then two groups of every concept. A
pick is the group with the most concepts that the split still lacks; as a pass
goes on a split lacks ever less, so what a group once offered bounds what it
offers later. The best ``POOL`` groups of one look at the table therefore serve
for many picks, until one of the others might be as good.

The groups that are left go, in hash order, to the split that lacks most, ties
by hash. That has a closed form: the split that lacks most takes groups alone
until it lacks no more than the second, then the two take turns, then all three.
So a group's place in hash order tells its round, the splits of that round, and
its turn; a round's groups, three at most, choose among its splits by hash, one
after the other.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.errors import DataError
from boxloom.functions.hashing import stable_hash
from boxloom.functions.schema import SPLITS
from boxloom.operators.ranking import global_rank

LEAST_GROUPS = 6
#: Groups that come to the driver in one look at the table.
POOL = 1024


def targets(n_groups: int, ratios: dict[str, float]) -> dict[str, int]:
    """Groups wanted in each split: halves to even, and what rounding leaves goes to train."""
    wanted = {s: round(n_groups * ratios[s]) for s in SPLITS}
    wanted["train"] += n_groups - sum(wanted.values())
    return wanted


def _offers(groups: DataFrame, lacking: set[str], taken: dict[str, str], order: Column, pool: int) -> list[tuple[int, str, str, frozenset]]:
    """The ``pool`` best groups for a split that lacks these concepts: (minus how many it offers, hash, group, concepts)."""
    offered = -F.size(F.array_intersect("concepts", F.array(*[F.lit(c) for c in sorted(lacking)])))
    free = ~F.col("group_id").isin(sorted(taken)) if taken else F.lit(True)
    rows = groups.where(free).select(offered.alias("n"), order.alias("h"), "group_id", "concepts").where("n < 0")
    return [(r["n"], r["h"], r["group_id"], frozenset(r["concepts"])) for r in rows.orderBy("n", "h", "group_id").limit(pool).collect()]


def seed_groups(groups: DataFrame, classes: list[str], seed: int, pool: int = POOL) -> dict[str, str]:
    """The groups of the two greedy passes. ``groups``: group_id and its concepts."""
    taken: dict[str, str] = {}
    held: dict[str, Counter] = {s: Counter() for s in SPLITS}
    for count in (1, 2):
        for split in SPLITS:
            offers: list[tuple[int, str, str, frozenset]] = []
            while lacking := {c for c in classes if held[split][c] < count}:
                ranked = sorted((-len(has & lacking), hash_, group, has) for _, hash_, group, has in offers if group not in taken)
                # groups beyond the pool were no better than its last then, and are not now
                if not ranked or (len(offers) == pool and ranked[0][:2] > offers[-1][:2]):
                    offers = _offers(groups, lacking, taken, stable_hash(seed, count, split, F.col("group_id")), pool)
                    ranked = offers
                if not ranked or not ranked[0][0]:
                    raise DataError(f"no group left for {split}; missing {sorted(lacking)}")
                _, _, group, has = ranked[0]
                taken[group] = split
                held[split].update(has)
    return taken


def fill(rest: DataFrame, lack: dict[str, int], seed: int) -> DataFrame:
    """group_id and split of the groups ``rest`` when splits lack so many."""
    order = sorted(SPLITS, key=lambda s: -lack[s])
    first, second, third = (lack[s] for s in order)
    alone, turns = first - second, 2 * (second - third)
    ranked = global_rank(rest.select("group_id", stable_hash(seed, "remaining", F.col("group_id")).alias("_hash")), [F.col("_hash"), F.col("group_id")], "_rank")
    rank = F.col("_rank")
    width = F.when(rank < alone, 1).when(rank < alone + turns, 2).otherwise(3)
    since = rank - F.when(rank < alone, 0).when(rank < alone + turns, alone).otherwise(alone + turns)
    keyed = F.array(*[F.struct(stable_hash(seed, F.col("group_id"), s).alias("h"), F.lit(s).alias("s")) for s in order])
    placed = ranked.select("group_id", width.alias("_width"), since.alias("_since"), keyed.alias("_keyed"))
    placed = placed.withColumn("_round", F.floor(F.col("_since") / F.col("_width"))).withColumn("_turn", F.col("_since") % F.col("_width")).withColumn("_open", F.slice("_keyed", 1, F.col("_width")))
    together = Window.partitionBy("_width", "_round")

    def least(among: Column) -> Column:
        return F.array_min(among)["s"]

    def of_turn(turn: int, choice: Column) -> Column:
        return F.max(F.when(F.col("_turn") == turn, choice)).over(together)

    chosen = placed.withColumn("_0", of_turn(0, least(F.col("_open"))))
    chosen = chosen.withColumn("_1", of_turn(1, least(F.filter("_open", lambda x: x["s"] != F.col("_0")))))
    left = least(F.filter("_open", lambda x: (x["s"] != F.col("_0")) & (x["s"] != F.col("_1"))))
    return chosen.select("group_id", F.when(F.col("_turn") == 0, F.col("_0")).when(F.col("_turn") == 1, F.col("_1")).otherwise(left).alias("split"))


def assign_splits(groups: DataFrame, classes: list[str], ratios: dict[str, float], seed: int) -> DataFrame:
    """group_id and split. ``groups``: group_id and concepts (array) of each group."""
    spark = groups.sparkSession
    groups = groups.select("group_id", F.array_sort("concepts").alias("concepts"))
    seen = {r["c"]: r["n"] for r in groups.select(F.explode("concepts").alias("c")).groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
    short = {c: seen.get(c, 0) for c in classes if seen.get(c, 0) < LEAST_GROUPS}
    if short:
        raise DataError(f"a concept needs {LEAST_GROUPS} groups: {short}")
    taken = seed_groups(groups, classes, seed)
    first = spark.createDataFrame(sorted(taken.items()), "group_id string, split string")
    wanted, held = targets(groups.count(), ratios), Counter(taken.values())
    filled = fill(groups.join(F.broadcast(first), "group_id", "left_anti"), {s: wanted[s] - held[s] for s in SPLITS}, seed)
    return first.unionByName(filled)
