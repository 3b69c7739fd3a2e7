import random
import re

import corpus_pipeline
from pyspark.sql import functions as F

from boxloom.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text.lower())
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def planted(spark):
    rng = random.Random(8)
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    long_ = [r for r in rows if r[4] > 900][:30]
    at, copies = 100_000, {}
    for r in long_:
        words = r[1].split(" ")
        for _ in range(2):
            for _ in range(max(1, len(words) // 150)):
                words[rng.randrange(len(words))] = "swapped"
            text = " ".join(words)
            if jaccard(text, r[1]) >= 0.8:
                copies[at] = r[0]
                rows.append((at, text, r[2], r[3], len(text)))
                at += 1
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first()["text"]
    lead = long_[0][1].split(" ")
    rng.shuffle(lead)
    rows.append((200_000, " ".join(lead) + " " + item.upper(), "en", "s", 0))
    rows += [(200_001, None, None, None, None), (200_002, "", "en", "s", 0), (200_003, "123 !!", "en", "s", 6)]
    return rows, copies


def test_stages_by_brute_force(spark):
    rows, copies = planted(spark)
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit("kept"))
    text = {r[0]: r[1] for r in rows}
    sf_dir, seen = "/root/testdata/sf0.001", []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == before.columns
        seen.append({r["doc_id"]: r["text"] for r in docs.collect()})
    known, single, clean, masked = seen
    assert set(text) - set(known) == {200_001, 200_002, 200_003}
    # near copies leave one of each group; nothing else goes
    groups = {}
    for i in known:
        for j in known:
            if i < j and jaccard(known[i], known[j]) >= 0.8:
                a, b = groups.setdefault(i, {i}), groups.setdefault(j, {j})
                a |= b
                for k in a:
                    groups[k] = a
    for i in set(known) - set(single):
        assert i in groups and min(groups[i]) < i
    assert not set(copies) & set(single)
    assert len(set(single.values())) == len(single)
    assert 200_000 not in clean and set(clean) <= set(single)
    assert set(masked) == set(clean)
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(spark.createDataFrame([(i, t) for i, t in clean.items()], "doc_id long, text string")).collect()}
    for i, t in clean.items():
        assert (masked[i] != t) == bool(spans[i])
        assert not any(t[s["start"] : s["end"]] in masked[i] for s in spans[i] if s["end"] - s["start"] > 20)
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in out} == set(masked)


def test_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the cat sat on the mat and looked", "en", "s", 3, 3, 4, 5), (None, "the dog ran to the house and back", "en", "s", 3, 3, 4, 5), (3, "123", "en", "s", 3, 3, 4, 5)], SCHEMA + ", told int, gone_id int, _gone int").withColumn("_told", F.lit(6))
    docs = docs.unionByName(docs)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        columns, docs = docs.columns, stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert docs.columns == columns
    assert sorted((r["doc_id"] or 0, r["told"], r["gone_id"], r["_gone"], r["_told"]) for r in docs.collect()) == [(0, 3, 4, 5, 6), (1, 3, 4, 5, 6)]


def test_empty_benchmark(spark, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 3)], SCHEMA)
    assert corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).count() == 1


def test_empty_documents(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.collect() == []
