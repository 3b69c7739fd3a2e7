"""The rule ensemble: statistics and compiled scores by hand, held-out accuracy, odd tables."""

import math
import re
import zlib

import pytest

from boxloom.llm import rules

SF = "/root/testdata/sf0.01"


def by_hand(text):
    text = text or ""
    words, lines = [w for w in re.split(r"[ \t-\r]+", text) if w], [x for x in text.split("\n") if x]
    share = lambda a, b: a / b if b else 0.0
    n = len(text)
    return {
        "chars": n, "words": len(words), "lines": len(lines), "word_length": share(sum(map(len, words)), len(words)), "longest_word": max(map(len, words), default=0),
        "distinct_words": share(len(set(words)), len(words)), "distinct_lines": share(len(set(lines)), len(lines)), "line_length": share(sum(map(len, lines)), len(lines)),
        "letters": share(sum(c.isalpha() for c in text), n), "capitals": share(sum(c.isupper() for c in text), n), "digits": share(sum(c.isdigit() for c in text), n),
        "stops": share(sum(c in ".!?" for c in text), len(words)), "exclaimed": share(text.count("!"), n),
        "signs": share(sum(not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-") for c in text), n),
    }


def test_statistics(spark):
    texts = [None, "", " ", "One two. Two!\nÉté 42 #%\n\nOne two. Two!", "x" * 200_000, "a " * 50_000, "\t\n\x0b", "ÄÖ ßü № €"]
    rows = rules.measured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in rows:
        assert {k: r[k] for k in rules.STATISTICS} == pytest.approx(by_hand(texts[r["doc_id"]])), texts[r["doc_id"]][:20]


FOREST = """RandomForestClassificationModel: uid=x, numTrees=2, numClasses=2, numFeatures=3
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0E-4)
      Predict: 0.0
     Else (feature 1 > 2.0E-4)
      If (feature 0 <= 0.25)
       Predict: 1.0
      Else (feature 0 > 0.25)
       Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
  Tree 1 (weight 1.0):
    If (feature 0 <= 0.5)
     Predict: 0.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""


def test_paths_of_a_forest():
    told = {str(r) for r in rules.paths(FOREST, ["a", "b", "c"])}
    assert told == {
        "a <= 0.5", "0.5 < a", "a <= 0.5 and b <= 0.0002", "a <= 0.5 and 0.0002 < b", "a <= 0.25 and 0.0002 < b", "0.25 < a <= 0.5 and 0.0002 < b",
    }


def test_compiled_scores(spark):
    inf = float("inf")
    learned = rules.RuleSet(0.25, ((rules.Rule((("a", 0.25, 0.5), ("b", -inf, 1.0))), 1.5), (rules.Rule((("a", 0.5, inf),)), -2.0)))
    rows = spark.createDataFrame([(0.25, 0.0), (0.3, 1.0), (0.5, 1.5), (0.5001, 9.0)], "a double, b double").withColumn("s", learned.score()).collect()
    want = [0.25 + 1.5 * (0.25 < r["a"] <= 0.5 and r["b"] <= 1.0) - 2.0 * (r["a"] > 0.5) for r in rows]
    assert [r["s"] for r in rows] == pytest.approx([1 / (1 + math.exp(-x)) for x in want])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    found = {r["doc_id"]: r for r in rules.classify(docs, labels).collect()}
    assert len(found) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for i, r in found.items())
    told = [(found[r["doc_id"]], r["quality"]) for r in labels.collect() if r["doc_id"] in found]
    held = [(r["predicted"], q) for r, q in told if r["held_out"]]
    good, bad = ([p for p, q in held if q == k] for k in (1, 0))
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_held_out_labels_change_nothing(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.measured(docs).cache()
    turned = labels.selectExpr("doc_id", "if(crc32(cast(doc_id AS string)) % 4 = 2, 1 - quality, quality) AS quality", "toxic")
    learned = rules.learn(stats, labels)
    assert len(learned.weighed) > 0 and rules.learn(stats, turned) == learned


def test_odd_tables(spark):
    kinds = "doc_id long, text string, score string, words string, label string", "doc_id long, quality int, weight int"
    docs = [(None, "a b", "x", "y", "z"), (1, None, "", "", ""), (1, None, "", "", ""), (2, "Good text here.", "", "", ""), (3, "", "", "", "")]

    def scores(rows, said):
        found = rules.classify(spark.createDataFrame(rows, kinds[0]), spark.createDataFrame(said, kinds[1])).collect()
        return sorted(((r["doc_id"] or 0, r["score"]) for r in found))

    assert scores([], []) == [] and scores([], [(1, 1, 0), (3, 0, 0)]) == []
    assert scores(docs, []) == [(i, 0.5) for i in (0, 1, 1, 2, 3)]
    learnable = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 != 2]
    many = [(i, "Good text here." if i % 2 else "### $$$ ***", "", "", "") for i in range(40)]
    assert [s for _, s in scores(many, [(i, 1, 0) for i in learnable])] == pytest.approx([(len(learnable) + 1) / (len(learnable) + 2)] * 40)
    odd = [(i, i % 2, 0) for i in learnable] + [(None, 1, 0), (learnable[0], 1 - learnable[0] % 2, 0), (learnable[1], 7, 0), (learnable[2], None, 0), (999, 1, 0)]
    found = dict(scores(many, odd))
    assert all((found[i] > 0.5) == (i % 2 == 1) for i in range(40))
