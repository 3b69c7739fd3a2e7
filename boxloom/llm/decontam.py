"""Benchmark decontamination as a prefix-filtered set join.

A benchmark item's windows are ``size`` consecutive words (an item of fewer
words is one window). A window can only occur where its rarest word does, so
that word is its prefix: words are ordered by how often the documents hold
them, and each window is reached through its rarest word alone. Windows that
share a rarest word at the same place of an item share one *anchor* with up to
``size - 1`` words of the item on either side.

Documents are read twice: to count the benchmark's words, and to look every
word up among the anchors. An anchor that passes the positional and length
bounds is verified by comparing neighbouring words outwards; the matched run
is a union of whole windows, so runs as long as the window give exactly the
words inside occurring windows. A sentinel word after each text meets a
sentinel anchor, which carries the word count without a join. Everything is
JVM expressions inside code generation; no text is shuffled.

Anchors are broadcast in blocks of at most ``block`` (some 300 bytes each), so
a benchmark of any size is handled, with a further reading for each block.

Defined results: null or wordless texts have no words and no hits; a null or
wordless item has no window; an item_id counts once however often it repeats,
a null one makes words hit but is not counted; rows that repeat a doc_id stay
separate; empty tables give no rows or clean rows; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.text import MARKS, words
from boxloom.runtime import write_table

VOCABULARY = 1_000_000


def _items(bench: DataFrame, size: int) -> DataFrame:
    found = bench.select(F.col("item_id"), words(F.col("text"), MARKS).alias("iw")).where(F.size("iw") > 0)
    return found.select("item_id", "iw", F.least(F.size("iw"), F.lit(size)).alias("width")).withColumn("item", F.xxhash64("item_id", "iw"))


def rarity(docs: DataFrame, items: DataFrame, text_col: str) -> DataFrame:
    """word and how often the documents hold it, for every word of the items."""
    vocabulary = write_table(items.select(F.explode("iw").alias("word")).distinct(), "vocabulary")
    held = docs.select(F.explode(words(F.col(text_col), MARKS)).alias("word"))
    if vocabulary.count() <= VOCABULARY:
        counts = held.join(F.broadcast(vocabulary), "word").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    else:
        counts = held.groupBy("word").agg(F.count(F.lit(1)).alias("n")).join(vocabulary, "word")
    return write_table(vocabulary.join(counts, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n")), "rarity")


def anchors(items: DataFrame, counts: DataFrame, size: int) -> DataFrame:
    """The prefix words of all windows with their neighbours and the words a document must hold before and after."""
    placed = items.select("item_id", "item", "iw", "width", F.posexplode("iw").alias("pos", "word")).join(counts, "word")
    first = F.greatest(F.col("pos") - F.col("width") + 1, F.lit(0))
    last = F.least("pos", F.size("iw") - F.col("width"))
    offered = placed.select("*", F.explode(F.sequence(first, last)).alias("start"))
    best = F.row_number().over(Window.partitionBy("item", "item_id", "start").orderBy("n", "word", "pos"))
    chosen = offered.withColumn("_best", best).where("_best = 1")
    grouped = chosen.groupBy("item", "item_id", "pos", "word").agg(F.first("iw").alias("iw"), F.first("width").alias("width"), F.min("start").alias("lo"), F.max("start").alias("hi"))
    reach = F.lit(size - 1)
    left_from = F.greatest(F.col("pos") - reach, F.lit(0))
    return grouped.select(
        "item_id",
        "word",
        F.col("width").cast("int").alias("width"),
        (F.col("pos") - F.col("hi")).alias("before"),
        (F.col("lo") + F.col("width") - 1 - F.col("pos")).alias("after"),
        F.reverse(F.slice("iw", left_from + 1, F.col("pos") - left_from)).alias("left"),
        F.slice("iw", F.col("pos") + 2, reach).alias("right"),
    )


def _run(side: str, sign: int, size: int) -> Column:
    """How many words on one side agree without a gap."""
    out = F.lit(0)
    for j in range(size - 1, 0, -1):
        same = F.get("_words", F.col("_at") + F.lit(sign * j)) == F.get(side, F.lit(j - 1))
        out = F.when(same, F.lit(1) + out).otherwise(F.lit(0))
    return out


def matches(docs: DataFrame, bench: DataFrame, size: int = 10, block: int = 100_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of first and last word) and items (array of item_id) of every row."""
    items = write_table(_items(bench, size), "items")
    keys = write_table(anchors(items, rarity(docs, items, text_col), size), "anchors")
    blocks = max(1, -(-keys.count() // block))
    spark = docs.sparkSession
    sentinel = spark.range(1).select(
        F.lit(None).cast(keys.schema["item_id"].dataType).alias("item_id"), F.lit("").alias("word"), F.lit(1).alias("width"), F.lit(0).alias("before"), F.lit(0).alias("after"),
        F.array().cast("array<string>").alias("left"), F.array().cast("array<string>").alias("right"),
    )
    base = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), words(F.col(text_col), MARKS).alias("_words"))
    places = base.select("doc_id", "_row", "_words", F.posexplode(F.concat("_words", F.array(F.lit("")))).alias("_at", "_word"))

    def look_up(k: int) -> DataFrame:
        part = keys if blocks == 1 else keys.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == k)
        part = part.unionByName(sentinel) if k == 0 else part
        met = places.join(F.broadcast(part), F.col("_word") == F.col("word"))
        met = met.where((F.col("_word") == "") | ((F.col("_at") >= F.col("before")) & (F.col("_at") + F.col("after") < F.size("_words"))))
        met = met.select("doc_id", "_row", "item_id", "width", "_word", "_at", _run("left", -1, size).alias("_l"), _run("right", 1, size).alias("_r"))
        end = F.col("_word") == ""
        return met.where(end | (F.col("_l") + F.col("_r") + 1 >= F.col("width"))).select(
            "doc_id", "_row",
            F.when(end, F.col("_at")).alias("_n"),
            F.when(~end, F.struct((F.col("_at") - F.col("_l")).alias("a"), (F.col("_at") + F.col("_r")).alias("b"))).alias("_run"),
            F.when(~end, F.col("item_id")).alias("_item"),
        )

    found = reduce(DataFrame.unionByName, [look_up(k) for k in range(blocks)])
    return found.groupBy("_row", "doc_id").agg(F.max("_n").cast("long").alias("n_words"), F.collect_set("_run").alias("runs"), F.collect_set("_item").alias("items")).drop("_row")


def hit_words(runs: Column) -> Column:
    """Words inside any of the runs."""
    start = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, run: Column) -> Column:
        fresh = F.greatest(run["b"] - F.greatest(run["a"] - 1, acc["end"]), F.lit(0))
        return F.struct(F.greatest(acc["end"], run["b"]).alias("end"), (acc["n"] + fresh).alias("n"))

    return F.aggregate(F.array_sort(runs), start, step)["n"]


def decontaminate(docs: DataFrame, bench: DataFrame, size: int = 10, **kwargs) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items (sorted as strings) and contaminated of every row."""
    found = matches(docs, bench, size, **kwargs)
    n_hit = hit_words(F.col("runs"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.array_sort(F.transform("items", lambda x: x.cast("string"))).alias("items"), (n_hit > 0).alias("contaminated"),
    )
