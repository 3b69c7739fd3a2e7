"""Quality scores by a sparse ensemble of rules.

*Statistics* of a text (``STATISTICS``) are column expressions, found in one pass
over the texts and kept in a written table. *Rules* are the paths of shallow
trees: every node of a random forest but the roots is the conjunction of the
splits above it, that is, a low and a high bound on some statistics. A logistic
regression with a lasso penalty weighs them; most weights become zero. What is
left is compiled into one column expression, so that scoring needs no model.

*Learning* sees at most ``PER_CLASS`` documents a label (the least hash of doc_id
in each of as many hash buckets), each weighed so that the labels count as they
do among all labelled documents. The bound, the forest's size and the penalty
are parameters. Documents that are held out are never learned from.

Defined results: a null text counts as empty; labels other than 0 and 1, null
ids, and ids labelled both 0 and 1 teach nothing; an id that repeats teaches
once, by its least statistics; with labels of one kind or none every score is
(ones + 1) / (labelled + 2); rows that repeat are scored each; an empty table
gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boxloom.llm.language import held_out
from boxloom.llm.text import SPACES, let
from boxloom.runtime import write_table

PER_CLASS = 4096
TREES, DEPTH, PENALTY, SEED = 24, 3, 0.002, 17
STATISTICS = (
    "chars", "words", "lines", "word_length", "longest_word", "distinct_words", "distinct_lines", "line_length",
    "letters", "capitals", "digits", "stops", "exclaimed", "signs",
)
#: A weight below this counts as zero.
LEAST_WEIGHT = 1e-6


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def _left(text: Column, pattern: str) -> Column:
    """How many characters a text has that ``pattern``, a class of others, does not take away."""
    return F.char_length(F.regexp_replace(text, pattern, ""))


def _of_words(words: Column) -> Column:
    """Number, distinct number, longest length and total length of words."""
    sizes = F.transform(words, F.char_length)
    return F.struct(
        F.size(words).alias("n"),
        F.size(F.array_distinct(words)).alias("distinct"),
        F.coalesce(F.array_max(sizes), F.lit(0)).alias("longest"),
        F.aggregate(sizes, F.lit(0).cast("long"), lambda a, x: a + x).alias("letters"),
    )


def statistics() -> dict[str, Column]:
    """The statistics by name, over the columns ``_text``, ``_words`` and ``_lines``."""
    text, words, lines = F.col("_text"), F.col("_words"), F.col("_lines")
    chars = F.char_length(text)
    return {
        "chars": chars.cast("double"),
        "words": words["n"].cast("double"),
        "lines": lines["n"].cast("double"),
        "word_length": _share(words["letters"], words["n"]),
        "longest_word": words["longest"].cast("double"),
        "distinct_words": _share(words["distinct"], words["n"]),
        "distinct_lines": _share(lines["distinct"], lines["n"]),
        "line_length": _share(lines["letters"], lines["n"]),
        "letters": _share(_left(text, r"\P{L}+"), chars),
        "capitals": _share(_left(text, r"\P{Lu}+"), chars),
        "digits": _share(_left(text, r"\P{Nd}+"), chars),
        "stops": _share(_left(text, "[^.!?]+"), words["n"]),
        "exclaimed": _share(_left(text, "[^!]+"), chars),
        "signs": _share(_left(text, r"[\p{L}\p{Nd}\s.,;:!?'\"()-]+"), chars),
    }


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the statistics of every text."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    split = {name: F.array_remove(F.split("_text", by), "") for name, by in (("_words", SPACES), ("_lines", "\n"))}
    return texts.select("doc_id", "_text", *[let(parts, _of_words).alias(name) for name, parts in split.items()]).select("doc_id", *[c.alias(name) for name, c in statistics().items()])


@dataclass(frozen=True)
class Rule:
    """Statistics that must be above a low and at most a high bound."""

    bounds: tuple[tuple[str, float, float], ...]

    def column(self) -> Column:
        met = F.lit(True)
        for name, low, high in self.bounds:
            met = met & (F.col(name) > low if low > float("-inf") else F.lit(True)) & (F.col(name) <= high if high < float("inf") else F.lit(True))
        return met

    def __str__(self) -> str:
        return " and ".join(" ".join([f"{low:.6g} <"] * (low > float("-inf")) + [name] + [f"<= {high:.6g}"] * (high < float("inf"))) for name, low, high in self.bounds)


@dataclass(frozen=True)
class RuleSet:
    """Weighed rules; :meth:`score` is their probability of label 1 as a column over the statistics."""

    intercept: float
    weighed: tuple[tuple[Rule, float], ...] = field(default=())

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.weighed:
            total = total + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def __str__(self) -> str:
        return "\n".join([f"{self.intercept:+.4f}", *(f"{weight:+.4f} if {rule}" for rule, weight in self.weighed)])


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def paths(forest: str, names: list[str]) -> list[Rule]:
    """The distinct rules of all nodes below the roots, read from a forest's printed form."""
    found: dict[Rule, None] = {}
    above: list[tuple[int, int, str, float]] = []  # depth, statistic, side and threshold of each split on the way
    for line in forest.splitlines():
        if line.lstrip().startswith("Tree "):
            above = []
        split = _SPLIT.match(line)
        if not split:
            continue
        depth = len(split[1])
        above = [x for x in above if x[0] < depth] + [(depth, int(split[3]), split[4], float(split[5]))]
        bounds: dict[str, tuple[float, float]] = {}
        for _, at, side, threshold in above:
            low, high = bounds.get(names[at], (float("-inf"), float("inf")))
            bounds[names[at]] = (low, min(high, threshold)) if side == "<=" else (max(low, threshold), high)
        found[Rule(tuple((name, *bounds[name]) for name in sorted(bounds)))] = None
    return list(found)


def sample(stats: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> tuple[DataFrame, dict[int, int]]:
    """Statistics, ``label`` and ``weight`` of at most ``per_class`` learnable documents a label, and how many each label has."""
    ids, said = F.col("doc_id"), F.col("quality")
    learnable = ids.isNotNull() & said.isin(0, 1) & ~held_out(ids)
    one = labels.where(learnable).groupBy("doc_id").agg(F.min(said).alias("label"), F.max(said).alias("_most")).where("label = _most")
    hashed = F.xxhash64("doc_id")
    buckets = one.groupBy("label", F.pmod(hashed, F.lit(per_class)).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(hashed.alias("hash"), ids.alias("id"))).alias("_pick"))
    picked = buckets.select("label", "_n", F.col("_pick.id").alias("_id")).collect()  # per_class rows a label at most
    totals = {k: sum(r["_n"] for r in picked if r["label"] == k) for k in (0, 1)}
    counts = {k: max(1, sum(r["label"] == k for r in picked)) for k in (0, 1)}
    rows = [(r["_id"], float(r["label"]), totals[r["label"]] / counts[r["label"]]) for r in picked]
    wanted = stats.sparkSession.createDataFrame(rows, "_id long, label double, weight double")
    found = stats.join(F.broadcast(wanted), ids == F.col("_id")).groupBy("_id", "label", "weight").agg(F.min(F.struct(*STATISTICS)).alias("_least"))
    return found.select("_id", "label", "weight", "_least.*"), totals


def learn(stats: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY) -> RuleSet:
    """Rules learned from the statistics of labelled documents."""
    chosen, _ = sample(stats, labels, per_class)
    names = list(STATISTICS)
    vector = array_to_vector(F.array(*names)).alias("features")
    table = write_table(chosen.coalesce(1).sortWithinPartitions("_id"), "labelled")  # bounded; one order, so that a forest repeats
    seen = {r["label"]: r["n"] for r in table.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
    if len(seen) < 2:
        ones, both = seen.get(1.0, 0.0), sum(seen.values())
        return RuleSet(_logit((ones + 1) / (both + 2)))
    mean = sum(seen.values()) / table.count()
    rows = table.withColumn("weight", F.col("weight") / mean)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=4, featureSubsetStrategy="onethird", seed=SEED, weightCol="weight", maxBins=64)
    rules = paths(forest.fit(rows.select(vector, "label", "weight")).toDebugString, names)
    if not rules:
        return RuleSet(_logit(seen[1.0] / sum(seen.values())))
    met = array_to_vector(F.array(*[r.column().cast("double") for r in rules])).alias("features")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, weightCol="weight", maxIter=60)
    fitted = lasso.fit(rows.select(met, "label", "weight"))
    weighed = [(rule, float(w)) for rule, w in zip(rules, fitted.coefficients.toArray(), strict=True) if abs(w) > LEAST_WEIGHT]
    return RuleSet(float(fitted.intercept), tuple(weighed))


def _logit(p: float) -> float:
    from math import log

    return log(p / (1 - p))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text", per_class: int = PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of every row; learns from ``labels`` (doc_id, quality)."""
    stats = write_table(measured(docs, id_col, text_col), "statistics")
    told = stats.withColumn("score", learn(stats, labels, per_class).score())
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS)
