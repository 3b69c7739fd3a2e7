"""Filter interaction audit: what each filter removes in every order of application.

Documents are first told apart by which filters they fail (their *mask*, one bit
a filter) and counted: a part of the corpus has at most 2^filters *cells*. The
audit itself works on cells alone. They are unpivoted against the steps of all
orders into a long table (part, mask, order, step), a running bit-or over the
steps before tells which documents are gone by then, conditional sums give the
counts of each step, and a window over a filter's steps in all orders gives its
Shapley total.

Copies: a document fails ``copy`` if an equal text has a smaller doc_id. Equal
texts fail the other filters alike, so they are counted by text before a window
looks for the least doc_id; a text that a third of all documents share is a few
rows there. Labels meet documents by doc_id; documents without one are spread.

Defined results: a null text counts as empty, a null part as the empty string; a
null doc_id is no copy, makes no other text a copy and has no labels; a doc_id
that repeats is counted each time, and is no copy of itself; a doc_id with
several label rows is good (toxic) if any of them says so; a part has its steps
even where nothing is removed; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.text import SPACES, let


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """What filters look at: ``_id``, ``part``, ``_text`` and ``_counts``, a text's words and distinct words."""
    part = F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part")
    texts = docs.select(F.col(id_col).alias("_id"), part, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    words = F.array_remove(F.split(F.col("_text"), SPACES), "")
    counts = let(words, lambda w: F.struct(F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    return texts.withColumn("_counts", counts)


def text_failures() -> dict[str, Column]:
    """When a :func:`measured` text fails the filters A (short), B (repeats words), C (capitals) and D (signs)."""
    text, words, distinct = F.col("_text"), F.col("_counts.words"), F.col("_counts.distinct")
    return {
        "A": words < 50,
        "B": 100 * distinct < 65 * words,
        "C": 100 * F.char_length(F.regexp_replace(text, "[^A-Z]+", "")).cast("long") > 5 * F.char_length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def mask(failing: dict[str, Column]) -> Column:
    """A bit for each filter that a document fails, in their order from bit 0."""
    bits = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(failing.values())]
    return sum(bits[1:], bits[0])


def _labels(labels: DataFrame) -> DataFrame:
    """One row a doc_id."""
    said = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_label_of"))
    return said.agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("_toxic")
    ).withColumn("_place", F.col("_label_of"))


def cells(texts: DataFrame, labels: DataFrame, failing: dict[str, Column]) -> DataFrame:
    """part, mask, n, good, toxic: :func:`measured` documents by what they fail; the bit after those of ``failing`` is the copy filter's."""
    facts = texts.select("_id", "part", mask(failing).alias("_mask"), F.unhex(F.sha2("_text", 256)).alias("_text"))
    same = facts.groupBy("_id", "part", "_mask", "_text").agg(F.count(F.lit(1)).alias("_n"))
    at = F.coalesce(F.col("_id"), F.xxhash64("_text"))  # rows without an id meet no label, so they can go anywhere
    told = same.withColumn("_at", at).join(_labels(labels), (F.col("_at") == F.col("_place")) & (F.col("_id") == F.col("_label_of")), "left")
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in ("_good", "_toxic")]
    by_text = (
        told.select("_id", "part", "_mask", "_text", "_n", *flags)
        .groupBy("_text", "part", "_mask", "_good", "_toxic")
        .agg(
            F.sum("_n").alias("_n"),
            F.sum(F.when(F.col("_id").isNull(), F.col("_n")).otherwise(F.lit(0))).alias("_nameless"),
            F.min("_id").alias("_least"),
            F.min_by("_n", "_id").alias("_least_n"),
        )
    )
    first = F.min("_least").over(Window.partitionBy("_text"))
    own = F.col("_nameless") + F.when(F.col("_least") == F.col("_first"), F.col("_least_n")).otherwise(F.lit(0))
    copy = F.col("_mask").bitwiseOR(F.lit(1 << len(failing)))
    split = F.array(F.struct(F.col("_mask").alias("mask"), F.col("_own").alias("n")), F.struct(copy.alias("mask"), (F.col("_n") - F.col("_own")).alias("n")))
    rows = by_text.withColumn("_first", first).withColumn("_own", own).select("part", "_good", "_toxic", F.inline(split)).where("n > 0")
    labelled = {name: F.sum(F.when(F.col(f"_{name}"), F.col("n")).otherwise(F.lit(0))).alias(name) for name in ("good", "toxic")}
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), *labelled.values())


def interactions(found: DataFrame, letters: str) -> DataFrame:
    """The audit of ``found`` (cells) over all orders of the filters named by ``letters``, from bit 0."""
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    steps = F.sequence(F.lit(1), F.lit(len(letters)))
    long = found.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(steps))
    letter = F.substring(F.col("filter_order"), F.col("step"), F.lit(1))
    bits = F.create_map(*[x for i, c in enumerate(letters) for x in (F.lit(c), F.lit(1 << i))])
    long = long.withColumn("_letter", letter).withColumn("_bit", F.element_at(bits, F.col("_letter")))
    failed = F.col("mask").bitwiseAND(F.col("_bit"))
    before = Window.partitionBy("part", "mask", "filter_order").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("_failed", failed).withColumn("_earlier", F.coalesce(F.bit_or("_failed").over(before), F.lit(0)))
    fails, gone = F.col("_failed") != 0, F.col("_earlier") != 0

    def total(value: str, when: Column) -> Column:
        return F.sum(F.when(when, F.col(value)).otherwise(F.lit(0)))

    counts = long.groupBy("part", "filter_order", "step", "_letter").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("_bit")).alias("unique_fails"),
        total("good", fails & ~gone).alias("good_lost"),
        total("toxic", fails & ~gone).alias("toxic_lost"),
    )
    return counts.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "_letter"))).drop("_letter")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """The audit of ``docs`` under the text filters A to D and the copy filter E."""
    failing = text_failures()
    return interactions(cells(measured(docs, id_col, text_col, part_col), labels, failing), "".join(failing) + "E")
