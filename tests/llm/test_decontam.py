import re

from pyspark.sql import functions as F

from boxloom.llm.decontam import decontaminate

DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text, items, size):
    doc, hit, found = words_of(text), set(), set()
    for item_id, item in items:
        words = words_of(item)
        width = min(size, len(words))
        for s in range(len(words) - width + 1) if words else ():
            for p in range(len(doc) - width + 1):
                if doc[p : p + width] == words[s : s + width]:
                    hit |= set(range(p, p + width))
                    found |= {str(item_id)} if item_id is not None else set()
    return len(doc), len(hit), sorted(found)


def check(spark, docs, items, size, **kwargs):
    d = spark.createDataFrame(docs, DOCS).withColumn("item_id", F.lit("x")).withColumn("word", F.lit(1))
    b = spark.createDataFrame(items, ITEMS).withColumn("doc_id", F.lit("x")).withColumn("n", F.lit(1))
    got = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in decontaminate(d, b, size, **kwargs).collect()), key=str)
    want = []
    for doc_id, text in docs:
        n, hit, found = brute(text, items, size)
        want.append((doc_id, n, hit, found, hit > 0))
    assert got == sorted(want, key=str)


def test_small_vocabulary_against_brute_force(spark):
    import random

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c d é".split()) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(120)] + [(200, None), (201, ""), (202, "..,"), (None, "a b c d"), (3, "A-b C d"), (3, "A-b C d")]
    items = [(i, text(rng.randrange(1, 9))) for i in range(12)] + [(50, None), (51, ""), (None, "a b c d"), (9, "d d d"), (10, "d d d")]
    check(spark, docs, items, 4)
    check(spark, docs, items, 4, block=3)


def test_real_rows(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    docs += [(10_000 + i, f"lead words here {items[i % len(items)][1].upper()} and a tail") for i in range(5)]
    d, b = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontaminate(d, b).collect()}
    for doc_id, text in docs[-25:]:
        assert got[doc_id] == brute(text, items, 10)


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS), spark.createDataFrame([], ITEMS)
    assert decontaminate(none[0], none[1]).collect() == []
    rows = decontaminate(spark.createDataFrame([(1, "a b")], DOCS), none[1]).collect()
    assert [(r["n_words"], r["n_hit"], r["contaminated"]) for r in rows] == [(2, 0, False)]
