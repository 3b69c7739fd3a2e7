"""URL filtering by exact Bloom filter cascades.

A rule or list entry is a key: a host and the beginning of a path. A URL can only
meet keys made of a suffix of its host (at a label boundary) and a prefix of its
path as long as some listed path; these are its candidate keys. The different
candidate keys of the whole corpus are the *universe*.

A cascade holds one list exactly over that universe: level 0 is a Bloom filter
of the listed keys, level 1 one of the universe's keys that level 0 wrongly
takes, level 2 one of the listed keys that level 1 takes, and so on until a
level takes nothing wrongly. A key is listed if the first level that refuses it
is an odd one. Only listed keys that the universe has are held, as no others can
be asked for. A level's bits travel with the plan as one binary value, so that
the URLs are judged without any join (some 1.5 log2(universe / held) bits a held
key: 3 MB for a million hosts of a universe of 10**9). A list whose cascade would
pass ``MAX_BYTES`` is dealt into shards by hash, each with a cascade of its own,
and the URLs are judged by one shard after the other.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule, and is allowed; rows that repeat are judged each; an empty table gives
no rows; other columns are passed by.
"""

from __future__ import annotations

import math
import sys
from array import array
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boxloom.llm.text import let, lower_ascii
from boxloom.runtime import drop_tables, sized_broadcast, write_table

#: Bytes of one cascade at most, some 10 million held keys.
MAX_BYTES = 64 << 20
#: Sides of fewer keys take levels of a lower rate: these cost a few bytes more and save rounds over the tables.
SMALL = 1 << 20
#: Words of a level that are gathered in one job; more come partition by partition.
GATHERED = 1 << 16
#: Bits in one place of a level's bytes.
WORD = 32


def host_of(url: Column) -> Column:
    return lower_ascii(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def candidates(host: Column, path: Column, labels: Iterable[int], lengths: Iterable[int]) -> Column:
    """Keys that a URL can meet, the longest first. labels, lengths: those that listed hosts and paths have."""
    parts = F.split(host, r"\.")
    hosts = F.array(*[F.when(F.size(parts) >= n, F.array_join(F.slice(parts, -n, n), ".")) for n in sorted(labels, reverse=True)])
    paths = F.array(*[F.when(F.char_length(path) >= n, F.substring(path, 1, n)) for n in sorted(lengths, reverse=True)])
    pairs = F.flatten(F.transform(F.array_compact(hosts), lambda h: F.transform(F.array_compact(paths), lambda p: F.struct((-F.length(h) - F.length(p)).alias("order"), F.concat(h, p).alias("key")))))
    return F.transform(F.array_sort(pairs), lambda x: x["key"])


@dataclass(frozen=True)
class Level:
    """A Bloom filter. ``blob``: its words, big-endian."""

    blob: bytes
    bits: int
    hashes: int
    seed: int

    def places(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.seed), F.lit(i), key), F.lit(self.bits)) for i in range(self.hashes)]

    def takes(self, key: Column) -> Column:
        def taken(blob: Column) -> Column:
            out = F.lit(True)
            for place in self.places(key):
                at = (F.floor(place / WORD) * (WORD // 8) + 1).cast("int")
                word = F.conv(F.hex(F.substring(blob, at, F.lit(WORD // 8))), 16, 10).cast("bigint")
                bit = F.call_function("shiftright", word, F.pmod(place, F.lit(WORD)).cast("int")).bitwiseAND(F.lit(1))
                out = out & (bit == 1)
            return out

        return let(F.lit(self.blob), taken)  # the plan holds the words once


def _level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    bits = max(1, math.ceil(-n * math.log(rate) / math.log(2) ** 2 / WORD)) * WORD
    shape = Level(b"", bits, max(1, round(-math.log2(rate))), seed)
    places = keys.select(F.explode(F.array(*shape.places(F.col("key")))).alias("at"))
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("at", F.lit(WORD)).cast("int"))
    found = places.groupBy(F.floor(F.col("at") / WORD).alias("word")).agg(F.bit_or(mask).alias("mask"))
    words = array("I", bytes(bits // 8))
    for r in found.collect() if len(words) <= GATHERED else found.toLocalIterator():
        words[r["word"]] = r["mask"]
    if sys.byteorder == "little":
        words.byteswap()
    return Level(words.tobytes(), bits, shape.hashes, seed)


def _rate(listed: int, universe: int) -> float:
    """The share of the universe's other keys that level 0 may take."""
    return min(0.5, listed / (math.sqrt(2) * max(universe, 1)))


def shards(listed: int, universe: int) -> int:
    """How many cascades a list is held in."""
    return max(1, math.ceil(-listed * math.log(_rate(listed, universe)) / math.log(2) ** 2 / 8 * 2 / MAX_BYTES)) if listed else 0


def _of_shard(key: Column, shard: int, of: int) -> Column:
    return F.pmod(F.xxhash64(F.lit("shard"), key), F.lit(of)) == shard


class Cascade:
    """Exact membership of a list over a universe of keys."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def holds(self, key: Column) -> Column:
        out = F.lit(len(self.levels) % 2 == 1)
        for depth in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[depth].takes(key), out).otherwise(F.lit(depth % 2 == 1))
        return out

    @classmethod
    def build(cls, listed: DataFrame, universe: DataFrame) -> Cascade:
        """``listed`` and ``universe``: written tables of keys, each once."""
        counts = [listed.count(), universe.count()]
        if not counts[0]:
            return cls([])
        sides = [listed, universe.join(sized_broadcast(listed), "key", "left_anti")]
        rate = _rate(*counts)
        levels: list[Level] = []
        made: list[DataFrame] = []
        while counts[0]:
            level = _level(sides[0], counts[0], (1 / 16 if counts[0] < SMALL else 0.5) if levels else rate, len(levels))
            levels.append(level)
            wrong = write_table(sides[1].where(level.takes(F.col("key"))), "wrong")
            made.append(wrong)
            sides, counts = [wrong, sides[0]], [wrong.count(), counts[0]]
        drop_tables(*made)
        return cls(levels)


def _test(cascade: Cascade, shard: int, of: int) -> Callable[[Column], Column]:
    """Whether a key is of the shard and held by its cascade."""
    return lambda key: cascade.holds(key) if of == 1 else F.when(_of_shard(key, shard, of), cascade.holds(key)).otherwise(F.lit(False))


def _lists(spark: SparkSession, rules: dict[str, str], listed: DataFrame | Iterable[str]) -> dict[str, DataFrame]:
    """The lists as written tables of different keys."""

    def made(keys: list[str]) -> DataFrame:
        return spark.createDataFrame([(k,) for k in keys], "key string")

    hosts = listed.select(F.col(listed.columns[0]).cast("string").alias("key")) if isinstance(listed, DataFrame) else made(list(listed))
    by = {"block": made([k for k, v in rules.items() if v == "block"]), "allow": made([k for k, v in rules.items() if v == "allow"]), "listed": hosts}
    return {name: write_table(keys.where("key is not null").distinct(), "keys") for name, keys in by.items()}


def judge(pages: DataFrame, rules: dict[str, str], listed: DataFrame | Iterable[str] = (), url_col: str = "url") -> DataFrame:
    """``pages`` with host, path, rule and verdict.

    ``rules``: key (host and path prefix) to "allow" or "block"; the longest key
    that fits decides. ``listed``: hosts blocked with all their subdomains where
    no rule fits, as strings or as the first column of a table; anything else is
    allowed.
    """
    lists = _lists(pages.sparkSession, rules, listed)
    # what decides which suffixes and prefixes of a URL are looked up: numbers of labels, and lengths of paths
    host = F.substring_index("key", "/", 1)
    shapes = [keys.select((F.size(F.split(host, r"\.")).alias("labels")), (F.char_length("key") - F.char_length(host)).alias("length")).distinct() for keys in lists.values()]
    seen = reduce(DataFrame.unionByName, shapes).distinct().collect()
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parted = pages.select(*kept, host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    none = F.lit(None).cast("string")
    if not seen:
        return parted.select("*", none.alias("rule"), F.lit("allow").alias("verdict"))
    shape = {r["labels"] for r in seen}, {r["length"] for r in seen}
    universe = write_table(parted.select("host", "path").select(F.explode(candidates(F.col("host"), F.col("path"), *shape)).alias("key")).distinct(), "universe")
    held = {name: write_table(keys.join(universe, "key", "left_semi"), "held") for name, keys in lists.items()}
    total = universe.count()
    dealt = {name: shards(keys.count(), total) for name, keys in held.items()}
    columns = [f"c{i}" for i in range(len(kept))]
    plain = parted.toDF(*columns, "_host", "_path").withColumn("_keys", candidates(F.col("_host"), F.col("_path"), *shape))
    found = plain.select(*columns, "_host", "_path", "_keys", *[none.alias(f"_{name}") for name in lists])
    passes = max(dealt.values())
    before: list[DataFrame] = []
    for shard in range(passes):
        met = {}
        for name, of in dealt.items():
            if shard < of:
                cascade = Cascade.build(*[keys.where(_of_shard(F.col("key"), shard, of)) for keys in (held[name], universe)])
                hit = F.get(F.filter("_keys", _test(cascade, shard, of)), 0)
                old = F.col(f"_{name}")
                met[f"_{name}"] = hit if not shard else F.when(old.isNull() | (F.length(hit) > F.length(old)), hit).otherwise(old)
        found = found.withColumns(met)
        if shard + 1 < passes:
            found = write_table(found, "judged")
            drop_tables(*before)
            before = [found]
    drop_tables(universe, *lists.values(), *held.values())
    blocks = F.col("_block").isNotNull() & (F.col("_allow").isNull() | (F.length("_block") > F.length("_allow")))
    rule = F.when(blocks, F.col("_block")).otherwise(F.col("_allow"))
    verdict = F.when(blocks, "block").when(F.col("_allow").isNotNull(), "allow").when(F.col("_listed").isNotNull(), "block").otherwise("allow")
    return found.select(*columns, "_host", "_path", rule.alias("rule"), verdict.alias("verdict")).toDF(*kept, "host", "path", "rule", "verdict")
